"""Numbers as readable text: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "n/a"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def percent(x: Column, digits: int = 2) -> Column:
    """Signed percent of a share; n/a for null and non-finite numbers."""
    return F.when(_finite(x), F.format_string(f"%+.{digits}f%%", x * 100)).otherwise(NONE)


def number(x: Column, digits: int = 2) -> Column:
    return F.when(_finite(x), F.format_string(f"%.{digits}f", x)).otherwise(NONE)


def family(feature: Column) -> Column:
    """What kind of input a feature of the meta-learner is."""
    return F.when(feature.isin("ram_score", "psa_score", "gso_score"), "supervision").when(feature.isin("calm_prob", "stress_prob", "crisis_prob", "garch_sigma"), "regime").otherwise("personality")


def lines(*parts: Column) -> Column:
    """Parts joined by line ends; a null part is no line."""
    return F.concat_ws("\n", *parts)


def snapshot_text(benchmark: str = "index") -> Column:
    """A market snapshot (macro.snapshots) in lines: the index, risk, sectors from the strongest on, and the ticker itself."""
    c = F.col
    state = lambda p: [
        F.concat(F.lit("  Close: "), number(c(f"{p}_close"))), F.concat(F.lit("  1 month: "), percent(c(f"{p}_ret_1m"))),
        F.concat(F.lit("  3 months: "), percent(c(f"{p}_ret_3m"))), F.concat(F.lit("  Year to date: "), percent(c(f"{p}_ret_ytd"))),
    ]
    sector = F.transform("rotation", lambda s: F.concat(F.lit("  "), s["sector"], F.lit(": "), percent(s["excess"])))
    own = F.when(c("ticker") != benchmark, lines(F.concat(F.lit("Asset "), c("ticker")), *state("own")))
    return lines(
        F.concat(F.lit("Market on "), F.date_format("date", "yyyy-MM-dd")), F.lit("Index"), *state("index"), F.lit("Risk"),
        F.concat(F.lit("  Implied volatility: "), number(c("risk_close")), F.lit(" (day "), percent(c("risk_ret_1d")), F.lit("; 1-year percentile "), number(c("risk_percentile")), F.lit(")")),
        F.concat(F.lit("  10-year rate: "), number(c("rate_close")), F.lit(" (day "), percent(c("rate_ret_1d")), F.lit(")")),
        F.lit("Sectors, 1 month over the index"), F.when(F.size("rotation") > 0, F.array_join(sector, "\n")).otherwise("  (no data)"), own,
    )


def statistics_text(calm: Column, stress: Column, crisis: Column, state: Column, sigma: Column, bound: Column, leverage: Column | None = None) -> Column:
    """Regime, volatility and the position that a volatility budget allows, as neutral facts. leverage: the sign of how returns
    and regimes went together in calibration (null or 0: not told)."""
    two = lambda x: F.format_string("%.2f", F.coalesce(x, F.lit(0.0)))
    told = F.lit(None).cast("string") if leverage is None else F.when(leverage > 0, "In calibration, mean returns were positive in calm and negative in crisis.").when(leverage < 0, "In calibration, mean returns were negative in calm and positive in crisis.")
    return lines(
        F.lit("State of the market today, as information and not as advice:"),
        F.concat(F.lit("- Regime probabilities: calm "), two(calm), F.lit(", stress "), two(stress), F.lit(", crisis "), two(crisis), F.lit(" (most likely path: "), F.coalesce(state.cast("string"), F.lit("?")), F.lit(").")),
        F.concat(F.lit("- Volatility forecast, a year: "), F.format_string("%.1f%%", F.coalesce(sigma, F.lit(0.0)) * 100), F.lit(".")),
        F.concat(F.lit("- Largest position within a volatility budget of 10% a year: "), two(bound), F.lit(".")),
        told,
    )
