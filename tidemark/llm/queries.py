"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, jaccard, kd_clusters, license_scan, packing, prefix_trie, secret_scan, suffix_dedup, token_counts, toxicity, url_filter, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0, with_ids=False
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, percent=90)


#: verdict, host, path, as the contract lists them.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The rules in op6's SQL, which is not to be changed: net/de/ and example.net/de/8 have each other's words there.
SQL_URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@lru_cache(maxsize=1)
def url_model() -> tuple[list[int], int]:
    return url_filter.train(url_filter.labelled_names())


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_model())


def _op6_sql() -> str:
    weights, bias = url_model()
    part = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(SQL_URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    grams = lambda c: (
        f"list_transform(range(1, length({c}) + 1), lambda i: (unicode(substr('^' || {c} || '$', i, 1)) * {131 * 131} + "
        f"unicode(substr('^' || {c} || '$', i + 1, 1)) * 131 + unicode(substr('^' || {c} || '$', i + 2, 1))) % {url_filter.BUCKETS})"
    )
    return f"""
        WITH a AS (SELECT page_id, {part} AS rest FROM pages),
        b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
        c AS (SELECT page_id, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM b),
        d AS (SELECT *, CAST({bias} + coalesce(list_sum(list_transform(list_distinct(list_concat({grams('host')}, {grams('path')})),
                     lambda i: ({weights})[i + 1])), 0) AS BIGINT) AS model_score FROM c)
        SELECT page_id, host, path, CASE {rule} END AS rule,
               CASE {verdict} ELSE CASE WHEN model_score > 0 THEN 'block' ELSE 'allow' END END AS verdict, model_score
        FROM d"""


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line", "licence", F.round("dice", 6).alias("dice"))


def _op7_sql() -> str:
    t = license_scan.THRESHOLD
    quoted = lambda words: "[" + ", ".join("'" + w + "'" for w in words) + "]"
    known = ", ".join(f"('{name}', {quoted(license_scan.bigrams(text))})" for name, text in license_scan.TEMPLATES.items())
    return f"""
        WITH templates(licence, own) AS (VALUES {known}),
        lines AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents WHERE text IS NOT NULL),
        units AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS unit FROM lines
                  UNION ALL SELECT doc_id, -1, text FROM lines WHERE len(l) > 1),
        words AS (SELECT doc_id, line, string_split(lower(trim(regexp_replace(unit, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM units),
        pairs AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p
                  FROM words WHERE len(w) > 1),
        scored AS (SELECT doc_id, line, licence, 2.0::DOUBLE * len(list_intersect(p, own)) / (len(p) + len(own)) AS dice
                   FROM pairs JOIN templates ON len(p) * {t} <= len(own) * {2 - t} + 1e-9 AND len(own) * {t} <= len(p) * {2 - t} + 1e-9),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, licence) AS k FROM scored WHERE dice >= {t} - 1e-9)
        SELECT doc_id, CAST(line AS INTEGER) AS line, licence, round(dice, 6) AS dice FROM best WHERE k = 1"""


def op7_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_license_scans, whose units are lines and whole texts, has no row for."""
    found = license_scan.passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line", "licence", F.round("dice", 6).alias("dice"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _number(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return secret_scan.scan_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[_number(k) for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400).drop("removed")


def _op11_sql(least: int = 400) -> str:
    return f"""
        WITH texts AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, length(x) // 2 AS n FROM documents),
        starts AS MATERIALIZED (
            SELECT r, p, md5_number(substr(x, 2 * p + 1, {2 * least})) AS m FROM texts, unnest(range(0, n - {least - 1})) t(p)),
        again AS (SELECT r, p FROM starts WHERE m IN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1)),
        marked AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {least} THEN 0 ELSE 1 END AS opens FROM again),
        numbered AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
        runs AS MATERIALIZED (SELECT r, run, min(p) AS a, max(p) + {least} AS b FROM numbered GROUP BY r, run),
        gaps AS (
            SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM runs
            UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
        kept AS (
            SELECT r, sha256(unhex(string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a, b NULLS LAST))) AS kept_sha256
            FROM gaps JOIN texts USING (r) GROUP BY r),
        totals AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               coalesce(kept_sha256, sha256(unhex(x))) AS kept_sha256
        FROM texts LEFT JOIN totals USING (r) LEFT JOIN kept USING (r)"""


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c
            FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
            SELECT r, vec_id, v, c, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS distance
            FROM kept, c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
            SELECT cluster, list(m ORDER BY i) AS c FROM (
                SELECT cluster, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, 65) t(i) GROUP BY cluster, i)
            GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds}"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def _op13_sql() -> str:
    byte = "list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))"
    step = "lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p // 2, 3988292384) ELSE p // 2 END"
    crc = f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), {step})), 4294967295)"
    return f"""
        WITH turns AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
                   md5(to_json([coalesce(role, ''), coalesce(text, '')])) AS u, length(coalesce(text, '')) AS size
            FROM conversations WHERE conv_id IS NOT NULL),
        named AS (SELECT c, list(u ORDER BY k) AS u, list(size ORDER BY k) AS size, CAST(c AS VARCHAR) AS s FROM turns GROUP BY c),
        own AS (SELECT c, u, size, {crc} % 6 AS h FROM named),
        rebuilt AS (
            SELECT o.c, list_concat(coalesce(b.u[1:o.h], []), o.u[o.h + 1:]) AS u, list_concat(coalesce(b.size[1:o.h], []), o.size[o.h + 1:]) AS size
            FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
        prefixes AS (SELECT c, d, u[1:d] AS path, coalesce(size[d], 0) AS size, d = len(u) AS last FROM rebuilt, unnest(range(0, len(u) + 1)) t(d)),
        nodes AS MATERIALIZED (
            SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(CASE WHEN d = 0 THEN 0 ELSE size END) AS saving,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
            FROM prefixes GROUP BY path, d),
        linked AS MATERIALIZED (
            SELECT n.*, p.conv_id AS parent_conv_id, count(k.d) AS n_children
            FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
            LEFT JOIN nodes k ON k.d = n.d + 1 AND k.path[1:k.d - 1] = n.path GROUP BY ALL),
        below AS (
            SELECT path[1:a] AS path, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved_tokens
            FROM linked, unnest(range(0, d + 1)) t(a) GROUP BY ALL)
        SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM linked JOIN below USING (path, d)"""


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_url_filters": op6_url_filters,
    "op7_license_scans": op7_license_scans,
    "op7_license_passages": op7_license_passages,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scans": op9_secret_scans,
    "op10_toxicity": op10_toxicity,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": _op6_sql(), "op7_license_scans": _op7_sql(), "op11_suffix_dedup": _op11_sql(), "op12_centroid_clusters": _op12_sql(), "op13_prefix_trie": _op13_sql(),
}
