"""Secret scans with structural confirmation.

Plain patterns give the base spans: assignments to secret-like names, access key ids and long hex runs. Beyond them,
candidates are decoded and reported only if their bytes have the structure of a key or a signed token:

- `pem`: the body between BEGIN and END lines of a private key, base64, that holds a key encoding, plain or encrypted; its line ends may
  be written out, and header lines may come first;
- `der`: a base64 run (whole, or behind a slash) or a hex run of either case that decodes to an ASN.1 private key, every nested
  length fitting its parent exactly;
- `ssh`: such a run that decodes to the OpenSSH private key format with its length-prefixed fields;
- `jwt`: three dot-separated base64url parts, the first two JSON objects, the first with a string `alg`.

Spans are in code points, the end exclusive, ordered by start and then by KINDS. Null text counts as empty: no spans.
Each row is scanned whole and on its own, in one pass without a shuffle; ids may be null or repeat. Texts may be of any length.
Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_text, use_table

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE_KINDS = KINDS[:3]
# The base patterns and lengths that the contract states.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 18
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Hex of either case that can hold a key, and base64 behind a path or a name, where it can begin at any part.
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}")
# Runs that can hold a hex run or an encoded candidate; what stands before a run cannot belong to it.
RUN = re.compile(r"(?<![0-9A-Za-z+/_.=-])[0-9A-Za-z+/_.=-]{16,}")
ENCODED = re.compile(r"[0-9A-Za-z+/_-]{40,}={0,2}")
# One part of a token; three that follow each other, one full stop between them, make a candidate.
PART = re.compile(r"[0-9A-Za-z_-]+")
BEGIN = "-----BEGIN "
END = re.compile(r"-----END ((?:[A-Z]{1,20} ){0,4}PRIVATE KEY)-----")
ENCRYPTED_HEADER = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED")
SSH_MAGIC = b"openssh-key-v1\0"
#: What base64 of a sequence with a length of one, two or three bytes, and of the OpenSSH format, begins with; in a run it
#: stands first, or behind what ends a path's or a name's part.
SSH_START = "b3BlbnNzaC1rZXkt"
KEY_START = re.compile(rf"(?:\A|(?<=[/_-]))(?:M[A-I]|{SSH_START})")


def decoded(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that data consists of; None unless all nested lengths fit exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        content = data[at : at + size]
        if tag & 0x20 and (depth > 16 or der_items(content, depth + 1) is None):
            return None
        items.append((tag, content))
        at += size
    return items


def is_der_key(data: bytes | None) -> bool:
    """One sequence that begins with a small version number and has two or more other values, as private keys have."""
    if not data or data[0] != 0x30:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1])
    return bool(inner) and len(inner) >= 3 - (inner[0][1] == b"\1") and inner[0][0] == 2 and inner[0][1] in (b"\0", b"\1")


def is_encrypted_key(data: bytes | None) -> bool:
    """One sequence of an algorithm (a sequence that begins with an object identifier) and an octet string, as encrypted keys are."""
    if not data or data[0] != 0x30:
        return False
    outer = der_items(data)
    inner = der_items(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or [t for t, _ in inner] != [0x30, 4] or len(inner[1][1]) < 16:
        return False
    algorithm = der_items(inner[0][1])
    return bool(algorithm) and algorithm[0][0] == 6


def pem_holds_key(label: str, body: str) -> bool:
    """The body between a key's BEGIN and END lines; line ends may be written out as \\n, and header lines may come first."""
    body = body.replace("\\r", "\n").replace("\\n", "\n")
    lines = [x.strip() for x in body.split("\n")]
    data = decoded("".join("".join(x.split()) for x in lines if ":" not in x and "," not in x))
    if label.startswith("ENCRYPTED"):
        return is_encrypted_key(data)
    if ENCRYPTED_HEADER.search(body):
        return data is not None and len(data) >= 32 and len(data) % 8 == 0  # whole cipher blocks
    return is_der_key(data) or is_ssh_key(data)


def pem_runs(text: str) -> list[tuple[int, int]]:
    """Keys between BEGIN and END lines: each END is paired with the last BEGIN after the END before, so a text is read once."""
    found, since = [], 0
    for end in END.finditer(text):
        begin = text.rfind(BEGIN, since, end.start())
        head = f"{BEGIN}{end[1]}-----"
        if begin >= 0 and text.startswith(head, begin) and pem_holds_key(end[1], text[begin + len(head) : end.start()]):
            found.append((begin, end.end()))
        since = end.end()
    return found


def declared_size(text: str) -> int | None:
    """Bytes that base64 of a sequence claims to have, by its first eight characters."""
    head = decoded(text[:8])
    if not head or len(head) < 6 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 0 < n <= 4 else 2 + head[1] if head[1] < 0x80 else None


def key_runs(run: str) -> list[tuple[str, int, int]]:
    """Encoded keys in a run of base64: whole, or behind a slash, a hyphen or an underscore, however far into the run.

    A start is decoded to the end only if the size that its first bytes claim is the size of all that follows."""
    found = []
    for m in ENCODED.finditer(run):
        size = len(m[0].rstrip("="))
        for at in (s.start() for s in KEY_START.finditer(m[0])):
            if len(m[0]) - at < 40:
                break
            if not m[0].startswith(SSH_START, at) and declared_size(m[0][at : at + 8]) != (size - at) * 3 // 4:
                continue
            data = decoded(m[0][at:])
            kind = "der" if is_der_key(data) or is_encrypted_key(data) else "ssh" if is_ssh_key(data) else None
            if kind:
                found.append((kind, m.start() + at, m.end()))
                break
    return found


def token_runs(run: str) -> list[tuple[int, int]]:
    """Signed tokens in a run, from left to right; parts are found in one pass, so that a long run takes no longer than its length."""
    parts, found, at = [m.span() for m in PART.finditer(run)], [], 0
    while at + 2 < len(parts):
        (a, b), (c, d), (e, f) = parts[at : at + 3]
        joined = c == b + 1 and e == d + 1 and run[b] == "." and run[d] == "."
        if joined and b - a >= 8 and d - c >= 4 and run.startswith(("ey", "ew"), a) and is_signed_token(run[a:f]):
            found.append((a, f))
            at += 3
        else:
            at += 1
    return found


def is_ssh_key(data: bytes | None) -> bool:
    if not data or not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 8 <= len(data) and int.from_bytes(data[at : at + 4], "big") >= 1


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".", 2)
    try:
        first, second = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span of a text."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    for run in RUN.finditer(text):
        whole, at = run[0], run.start()
        found += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(whole)]
        if len(whole) >= 40:
            for m in ANY_HEX.finditer(whole):
                data = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "6f", "6F") else None
                if is_der_key(data) or is_encrypted_key(data):
                    found.append(("der", at + m.start(), at + m.end()))
                elif is_ssh_key(data):
                    found.append(("ssh", at + m.start(), at + m.end()))
            found += [(kind, at + a, at + b) for kind, a, b in key_runs(whole)]
        if whole.count(".") >= 2:
            found += [("jwt", at + a, at + b) for a, b in token_runs(whole)]
    if BEGIN in text:
        found += [("pem", *span) for span in pem_runs(text)]
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, value>>: one row per document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in scan(t)] if t else []
            for t in batch.column(1).to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=kind)], names=["doc_id", "spans"])

    return map_text(
        docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], step,
        "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string>>",
    )


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, mask: str) -> str:
    out, at = [], 0
    for _, a, b in scan(text):
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text (overlapping ones together) replaced by the mask; null text stays null.

    n_chars, where docs has it, follows the new text. All rows and columns are kept.
    """

    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        use_table("secrets", lambda: None)
        texts = [redacted(t, mask) if t else t for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if count >= 0:
            sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(count).type)
            columns[count] = pc.coalesce(sizes, batch.column(count))
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_text(docs, [F.col(f"`{c}`") for c in docs.columns], step, docs.schema, text=at)
