"""What is known of the features by name: sources, rationales, families, representations, rungs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("case_raw", "rain_raw")

# Name fragments and what they stand for, tried in this order.
RAIN_WORDS = ("rain", "wet", "monsoon", "enso", "ix_", "logistic", "hill", "_rc")
CALENDAR_STARTS = ("sin", "cos", "weeks_into")
BIOLOGY_WORDS = ("stalta", "var12", "ac1_", "_x_", "inter_epidemic", "suscept", "sum52")
TRANSMISSION_WORDS = ("stalta", "inter_epidemic", "suscept", "sum52")
RATIONALES = {
    "case_lag": "lagged case count — recent transmission level",
    "rain_lag": "lagged rainfall — delayed vector-habitat effect",
    "case_mean": "smoothed case level over the window",
    "rain_mean": "smoothed rainfall over the window",
    "rain_sum": "accumulated rainfall — habitat persistence",
    "rain_accum": "n-week accumulated rainfall — threshold/breeding signal",
    "case_std": "case volatility over the window",
    "rain_std": "rainfall variability over the window",
    "case_stalta": "transmission-acceleration order parameter (cases)",
    "rain_stalta": "rainfall surge relative to baseline",
    "inter_epidemic_interval": "weeks since last epidemic-level incidence (susceptibility clock)",
    "susceptibility_proxy": "accumulated-susceptibles proxy (long interval, low recent burden)",
    "sum52": "52-week cumulative cases (recent burden / immunity depletion)",
    "case_delta": "week-on-week change in cases",
    "rain_delta": "week-on-week change in rainfall",
    "case_accel": "acceleration of cases",
    "rain_accel": "acceleration of rainfall",
    "case_pct": "relative change in cases",
    "rain_pct": "relative change in rainfall",
    "woy_anom": "anomaly vs prior-years week-of-year climatology",
    "woy_z": "standardized week-of-year anomaly",
    "woy_mean": "prior-years week-of-year baseline",
    "sin": "Fourier seasonality term",
    "cos": "Fourier seasonality term",
    "logistic_Rc": "phase-transition view of 8-week rainfall at a critical scale",
    "hill_R8": "saturating (Hill) view of 8-week rainfall",
    "long26": "low-frequency rainfall anomaly (ENSO-like)",
    "long52": "annual-scale rainfall level (ENSO-like)",
    "wet_season": "wet-season indicator from rainfall structure",
    "wet_run": "consecutive wet weeks",
    "cumyear": "cumulative within-year total",
    "weeks_into_year": "calendar position in the year",
    "var12": "rolling variance — critical slowing down",
    "ac1_12": "rolling lag-1 autocorrelation — critical slowing down",
    "x_": "interaction term",
    "_x_": "interaction term",
    "log_": "log1p-compressed level",
    "over_": "ratio feature",
    "_over_": "ratio feature",
    "pct_unit": "within-unit percentile rank of accumulated rainfall",
    "skew": "rolling skewness",
    "max": "rolling maximum",
    "min": "rolling minimum",
    "ix_": "climate index proxy derived from rainfall",
}
DEFAULT_RATIONALE = "domain-derived feature"


def _any(name: Column, words: tuple[str, ...], how: str = "contains") -> Column:
    return reduce(lambda a, b: a | b, (getattr(name, how)(w) for w in words))


def source_of(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.startswith("c22"), "catch22").when(_any(low, RAIN_WORDS), "rain").when(_any(low, CALENDAR_STARTS, "startswith"), "calendar").otherwise("case")


def rationale_of(name: Column) -> Column:
    """The first fragment found in the name decides."""
    return F.coalesce(*(F.when(name.contains(k), v) for k, v in RATIONALES.items()), F.lit(DEFAULT_RATIONALE))


def is_biology(name: Column) -> Column:
    return _any(name, BIOLOGY_WORDS)


def family_of(name: Column) -> Column:
    early = F.when(_any(F.lower(name), TRANSMISSION_WORDS), "transmission").otherwise("early-warning")
    return F.when(F.lower(name).startswith("c22"), "catch22").when(is_biology(name), early).when(source_of(name) == "rain", "climate").when(source_of(name) == "calendar", "season").otherwise("case")


def ladder_of(name: Column) -> Column:
    return F.when(is_biology(name), "biology").when(source_of(name) == "case", "case_view").when(source_of(name).isin("rain", "calendar"), "climate")


def dictionary(spark: SparkSession, columns: list[str]) -> DataFrame:
    """``feature, source, rationale, family, ladder`` of each column."""
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    f = F.col("feature")
    return names.select("feature", source_of(f).alias("source"), rationale_of(f).alias("rationale"), family_of(f).alias("family"), ladder_of(f).alias("ladder"))


def source_name(name: str) -> str:
    """``source_of`` for a name on the driver."""
    low = name.lower()
    if low.startswith("c22"):
        return "catch22"
    if any(w in low for w in RAIN_WORDS):
        return "rain"
    return "calendar" if low.startswith(CALENDAR_STARTS) else "case"


def representations(domain: list[str], signatures: list[str]) -> dict[str, list[str]]:
    """The column lists that are scored against each other."""
    case_only = [c for c in domain if source_name(c) in ("case", "calendar")]
    return {"raw_2col": list(RAW), "case_only": case_only, "catch22_only": [*RAW, *signatures], "domain_only": domain, "enriched": [*domain, *signatures]}


def ladder(domain: list[str], signatures: list[str]) -> dict[str, list[str]]:
    """Five rungs. Those of raw and group columns count the raw columns that a group holds twice."""
    rest = [c for c in domain if not any(w in c for w in BIOLOGY_WORDS)]
    case_view = [*RAW, *(c for c in rest if source_name(c) == "case")]
    climate = [*case_view, *(c for c in rest if source_name(c) in ("rain", "calendar"))]
    return {"raw 2 cols": list(RAW), "+ case views": case_view, "+ climate": climate, "+ transmission biology": domain, "+ catch22": [*domain, *signatures]}


def unpivoted(enriched: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, value``: a row for each known value of each column."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return enriched.select(F.inline(cells)).where("value IS NOT NULL")


def described(enriched: DataFrame, columns: list[str]) -> DataFrame:
    """The dictionary of the columns with ``n_known``, how many values each has."""
    counts = unpivoted(enriched, columns).groupBy("feature").agg(F.count(F.lit(1)).alias("n_known"))
    return dictionary(enriched.sparkSession, columns).join(counts, "feature", "left").withColumn("n_known", F.coalesce("n_known", F.lit(0).cast("long")))
