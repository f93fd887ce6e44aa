"""Detectors and interventions: rule logic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts (low, medium, high) by detector, target volatility, reduction by severity.
CUTS = {"ram": (0.2, 0.4, 0.7), "psa": (0.2, 0.4, 0.7), "gso": (0.2, 0.4, 0.7)}
TARGET_VOL = 0.10
REDUCTION = (0.0, 0.25, 0.6, 1.0)
LEVELS = ("none", "low", "medium", "high")
FLAT = 1e-9


def severity(score: Column, cuts: tuple) -> Column:
    """none, low, medium or high; medium and high are raised to the cut below where they are under it. Cuts: numbers or columns."""
    low, medium, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in cuts)
    medium = F.greatest(medium, low)
    high = F.greatest(high, medium)
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("none")


def default_severity(score: Column) -> Column:
    """By the uncalibrated cuts, the score clipped to [0, 1]."""
    return severity(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), (0.2, 0.4, 0.7))


def calibrated_cuts(scores: DataFrame, key: str = "ticker", flag_percent: int = 90) -> DataFrame:
    """key and, for each of the detectors, its low, medium and high cut by percentiles of scores (key, detector, score).

    psa and gso: 95, 99 and the largest score; ram: 75, flag_percent, and the larger of that and 99. Where a key has no
    score of a detector, its cuts are null: uncalibrated() fills in those of CUTS.
    """
    at = F.percentile("score", F.array(*[F.lit(p / 100) for p in (75, flag_percent, 95, 99)]))
    one = scores.groupBy(key, "detector").agg(at.alias("p"), F.max("score").alias("top"))
    p = lambda i: F.element_at("p", i)
    ram = F.struct(p(1).alias("low"), p(2).alias("medium"), F.greatest(p(4), p(2)).alias("high"))
    other = F.struct(p(3).alias("low"), p(4).alias("medium"), F.col("top").alias("high"))
    made = one.select(key, "detector", F.when(F.col("detector") == "ram", ram).otherwise(other).alias("cut"))
    wide = made.groupBy(key).agg(*[F.max(F.when(F.col("detector") == d, F.col("cut"))).alias(d) for d in CUTS])
    return wide.select(key, *[F.col(f"{d}.{c}").alias(f"{d}_{c}") for d in CUTS for c in ("low", "medium", "high")])


def uncalibrated(cuts: DataFrame) -> DataFrame:
    """cuts with those of CUTS where there are none."""
    return cuts.withColumns({f"{d}_{c}": F.coalesce(f"{d}_{c}", F.lit(v)) for d, values in CUTS.items() for c, v in zip(("low", "medium", "high"), values, strict=True)})


def cut_columns(detector: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{detector}_{c}") for c in ("low", "medium", "high"))


def gate_cuts(tau: float | Column) -> tuple:
    """The regime check's cuts for a gate: half of it, itself, 0.70."""
    return tau / 2, tau, 0.70


def action_of(word: Column) -> Column:
    """long, short or hold of an order's or an opinion's word."""
    word = F.lower(F.trim(word))
    return F.when(word.isin("buy", "cover", "bullish"), "long").when(word.isin("short", "sell", "bearish"), "short").otherwise("hold")


def size_of(word: Column, quantity: Column, price: Column, cash: Column) -> Column:
    """Share of the cash that an order moves, within [-1, 1], negative for short and sell; 0 for hold and non-positive inputs."""
    word = F.lower(F.trim(word))
    fine = (word != "hold") & (quantity > 0) & (price > 0) & (cash > 0)
    share = F.least(F.lit(1.0), quantity * price / F.when(cash > 0, cash))
    return F.when(fine, F.when(word.isin("short", "sell"), -share).otherwise(share)).otherwise(0.0)


def order(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def run_length_severity(run: Column, window: int) -> Column:
    return F.when(run <= 1, "high").when(run <= 3, "medium").when(run <= window, "low").otherwise("none")


def ram_score(size: Column, calm: Column, crisis: Column) -> Column:
    against = F.when(size < 0, calm).otherwise(crisis)
    return F.when(F.abs(size) < FLAT, 0.0).otherwise(F.least(F.lit(1.0), against))


def gso_bound(sigma: Column) -> Column:
    return F.when(sigma > 0, F.least(F.lit(1.0), F.lit(TARGET_VOL) / sigma)).otherwise(1.0)


def gso_score(size: Column, bound: Column) -> Column:
    return F.greatest(F.lit(0.0), F.abs(size) - bound) / F.greatest(bound, F.lit(1e-3))


def gso_relative(size: Column, bound: Column) -> Column:
    """How many doublings the size is away from the bound; 3 for none."""
    ratio = F.abs(size) / F.greatest(bound, F.lit(1e-3))
    return F.when(ratio > 0, F.abs(F.log2(F.when(ratio > 0, ratio)))).otherwise(3.0)


def detect(df: DataFrame, cuts: dict[str, tuple] | None = None) -> DataFrame:
    """df (size, calm, crisis, sigma) with scores, severities and flags of the regime and volatility checks.

    cuts: by detector, three numbers or columns of df; CUTS where there are none.
    """
    size, cuts = F.col("size"), CUTS | (cuts or {})
    df = df.withColumns({"ram": ram_score(size, F.col("calm"), F.col("crisis")), "bound": gso_bound(F.coalesce("sigma", F.lit(0.0)))})
    df = df.withColumns({"gso": gso_score(size, F.col("bound")), "gso_rel": gso_relative(size, F.col("bound"))})
    return df.withColumns({
        "ram_severity": severity(F.col("ram"), cuts["ram"]), "gso_severity": severity(F.col("gso"), cuts["gso"]),
        "rel_severity": F.when(F.col("gso_rel") < 0.3, "none").when(F.col("gso_rel") < 0.585, "low").when(F.col("gso_rel") < 1, "medium").otherwise("high"),
        "regime_sign": F.when(F.col("calm") >= F.col("crisis"), 1).otherwise(-1), "p_dominant": F.greatest("calm", "crisis"),
    }).withColumns({
        "ram_flag": order(F.col("ram_severity")) >= 2, "gso_flag": F.col("gso") > 0, "rel_flag": F.col("rel_severity") != "none",
        "bounded": F.signum(size) * F.least(F.abs(size), F.col("bound")), "rescaled": F.signum(size) * F.col("bound"),
        "convicted": F.signum(size) * F.least(F.lit(1.0), F.abs(size) / 0.25) * F.col("bound"),
    })


def decided(mode: str, variant: str = "C", reduce: str = "bucket") -> tuple[Column, Column, Column]:
    """Final size, final action and whether it was touched, over detect()'s columns, psa and psa_severity."""
    size = F.col("size")
    worst = F.greatest(*[order(F.col(f"{d}_severity")) for d in ("ram", "psa", "gso")])
    if mode == "warn":
        return size, F.col("action"), F.lit(False)
    if mode == "reduce":
        clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        cut = {
            "bucket": F.element_at(F.array(*map(F.lit, REDUCTION)), worst + 1),
            "continuous": clip(F.greatest("ram", "psa", "gso")),
            "ram_continuous": F.when(order(F.col("ram_severity")) >= 2, clip(F.col("ram"))).otherwise(0.0),
        }.get(reduce)
        if cut is None:
            raise ValueError(f"unknown reduction {reduce}")
        final, touched = size * (1 - cut), {"bucket": worst > 0, "continuous": cut > 0}.get(reduce, order(F.col("ram_severity")) >= 2)
    elif mode == "override":
        bound = F.col("bound")
        replace = {"A": F.lit(0.0), "B": 0.5 * F.col("regime_sign") * bound * F.col("p_dominant"), "C": F.col("regime_sign") * bound, "D": F.col("regime_sign") * F.abs(size)}
        if variant not in replace:
            raise ValueError(f"unknown variant {variant}")
        one = F.when(order(F.col("gso_severity")) >= 2, F.col("bounded")).otherwise(size)
        two = F.when(order(F.col("ram_severity")) >= 2, replace[variant]).otherwise(one)
        final = F.when(F.col("psa_severity") == "high", two * 0.5).otherwise(two)
        touched = (order(F.col("gso_severity")) >= 2) | (order(F.col("ram_severity")) >= 2) | (F.col("psa_severity") == "high")
    else:
        raise ValueError(f"unknown mode {mode}")
    final = final + 0.0
    return final, F.when(F.abs(final) < FLAT, "hold").when(final > 0, "long").otherwise("short"), touched


def intervene(df: DataFrame, mode: str, variant: str = "C", reduce: str = "bucket") -> DataFrame:
    """df (detect's columns and psa_severity, psa) with final_size, final_action, was_intervened."""
    size, action, touched = decided(mode, variant, reduce)
    return df.withColumns({"final_size": size, "final_action": action, "was_intervened": touched})


def supervise(
    df: DataFrame, mode: str = "warn", variant: str = "A", reduce: str = "bucket", enabled: frozenset[str] | set[str] = frozenset(CUTS),
    psa_signal: str = "cp_prob", gso_mode: str = "absolute", cuts: dict[str, tuple] | None = None, window: int = 5,
) -> DataFrame:
    """Detectors that are on, then the intervention. df: size, calm, crisis, sigma, action, and sizing_anomaly()'s columns.

    A detector that is off has no score, no severity and no flag; the volatility check stays on in override mode. gso_mode:
    absolute, relative or relative_conviction, whose severity needs no cuts. Missing probabilities and volatility count as 0.
    """
    if unknown := set(enabled) - set(CUTS):
        raise ValueError(f"unknown detectors {sorted(unknown)}")
    if gso_mode not in ("absolute", "relative", "relative_conviction"):
        raise ValueError(f"unknown gso_mode {gso_mode}")
    on = set(enabled) | ({"gso"} if mode == "override" else set())
    df = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("calm", "crisis", "sigma")})
    df = detect(df, cuts)
    if psa_signal == "map_runlength":
        level, flag = run_length_severity(F.col("map_run_length"), window), F.col("map_run_length") <= window
    else:
        level = severity(F.col("psa"), (CUTS | (cuts or {}))["psa"])
        flag = order(level) >= 2
    ready = F.col("psa_ready")
    df = df.withColumns({"psa_severity": F.when(ready, level).otherwise("none"), "psa_flag": ready & flag})
    if gso_mode != "absolute":
        to = "rescaled" if gso_mode == "relative" else "convicted"
        df = df.withColumns({"gso": F.col("gso_rel"), "gso_severity": F.col("rel_severity"), "gso_flag": F.col("rel_flag"), "bounded": F.col(to)})
    for d in set(CUTS) - on:
        df = df.withColumns({d: F.lit(0.0), f"{d}_severity": F.lit("none"), f"{d}_flag": F.lit(False)})
    return intervene(df, mode, variant, reduce)
