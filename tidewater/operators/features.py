"""108 features of a weekly panel, as window expressions in four stages.

Each stage only looks at columns of the stages before it. All windows partition by unit, and
Catalyst computes them after one exchange. Features that are not selected are pruned. The one
order statistic of all earlier weeks is kept in a sorted list a unit, where it is asked for.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import adjusted_skew, clipped, lag_correlation, ratio
from ..functions.windows import history, in_history, in_season, same_week, season

# The windows, lags and constants that define the features.
LAGS = (1, 2, 3, 4, 6, 8)
LONG_LAGS = (10, 12, 16)
MEANS = (2, 4, 8, 12, 26)
SPREADS = (4, 8, 12)
ACCUMULATIONS = (4, 6, 8, 10, 12, 16)
EXTREMES = (4, 12)
SHORT_TERM, GUARD, LONG_TERM = 4, 2, 26
LEAST_LONG_TERM = 4
PERIOD = 52.0
HARMONICS = (1, 2, 3)
LOGISTIC_CENTRES, LOGISTIC_SLOPE, LOGISTIC_CLIP = (250, 350, 450, 550), 0.02, 50.0
HILL_HALF = 400.0
HIGH_SHARE = 0.9
YEAR_WEEKS, LEAST_YEAR_WEEKS = 52, 8
SERIES = {"case": "c", "rain": "r"}


def trailing(function, column: str, width: int) -> Column:
    return function(column).over(season(-(width - 1), 0))


def acceleration_ratio(column: str) -> Column:
    """Mean of the last rows over the mean of an earlier, longer stretch of the year."""
    late = F.avg(column).over(season(-(SHORT_TERM - 1), 0))
    frame = season(-(SHORT_TERM + GUARD + LONG_TERM - 1), -(SHORT_TERM + GUARD))
    early = F.avg(column).over(frame)
    return F.when(F.count(F.lit(1)).over(frame) >= LEAST_LONG_TERM, ratio(late, F.when(early > 0, early)))


def _first_stage() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, x in SERIES.items():
        c = F.col(x)
        out |= {f"{name}_lag{k}": F.lag(x, k).over(in_season()) for k in (*LAGS, *LONG_LAGS)}
        out[f"{name}_raw"] = c
        out |= {f"{name}_mean{w}": trailing(F.avg, x, w) for w in MEANS}
        out |= {f"{name}_std{w}": trailing(F.stddev_samp, x, w) for w in SPREADS}
        out[f"{name}_stalta"] = acceleration_ratio(x)
        out[f"{name}_delta"] = c - F.lag(x).over(in_season())
        out[f"{name}_woy_mean"] = F.avg(x).over(same_week())
        out[f"_{name}_woy_std"] = F.stddev_samp(x).over(same_week())
        out[f"_{name}_filled"] = F.last(x, ignorenulls=True).over(season())
        out[f"{name}_var12"] = F.when(F.count(x).over(season(-11, 0)) >= 3, F.var_samp(x).over(season(-11, 0)))
        out[f"{name}_skew12"] = adjusted_skew(c, season(-11, 0), 4)
        out[f"_{name}_before"] = F.lag(x).over(in_season())
        out[f"{name}_max4"], out[f"{name}_max12"] = trailing(F.max, x, 4), trailing(F.max, x, 12)
        out[f"log_{name}"] = F.log1p(clipped(c, low=0))
        out[f"{name}_cumyear"] = F.when(c.isNotNull(), F.sum(x).over(season()))
    out |= {f"case_min{w}": trailing(F.min, "c", w) for w in EXTREMES}
    out |= {f"rain_sum{w}": trailing(F.sum, "r", w) for w in MEANS}
    out |= {f"rain_accum{w}": trailing(F.sum, "r", w) for w in ACCUMULATIONS}
    out["rain_long52_mean"] = trailing(F.avg, "r", YEAR_WEEKS)
    angle = lambda k: 2 * math.pi * k * F.col("wn").cast("double") / PERIOD
    out |= {f"sin{k}": F.sin(angle(k)) for k in HARMONICS} | {f"cos{k}": F.cos(angle(k)) for k in HARMONICS}
    out["weeks_into_year"] = (F.row_number().over(in_season()) - 1).cast("double")
    out["_place"] = F.row_number().over(in_history()) - 1
    out["case_sum52"] = F.when(F.count("c").over(history(-(YEAR_WEEKS - 1))) >= LEAST_YEAR_WEEKS, F.sum("c").over(history(-(YEAR_WEEKS - 1))))
    return out


def _second_stage() -> dict[str, Column]:
    c, r8 = F.col, F.col("rain_sum8")
    out: dict[str, Column] = {}
    for name, x in SERIES.items():
        anomaly = c(x) - c(f"{name}_woy_mean")
        out[f"{name}_accel"] = c(f"{name}_delta") - F.lag(f"{name}_delta").over(in_season())
        out[f"{name}_pct"] = ratio(c(f"_{name}_filled"), F.lag(f"_{name}_filled").over(in_season())) - 1
        out[f"{name}_woy_anom"] = anomaly
        out[f"{name}_woy_z"] = ratio(anomaly, c(f"_{name}_woy_std"))
        out[f"{name}_ac1_12"] = lag_correlation(c(x), c(f"_{name}_before"), season(-10, 0), season(-11, 0), 4)
    for centre in LOGISTIC_CENTRES:
        out[f"rain_logistic_Rc{centre}"] = 1 / (1 + F.exp(clipped(-LOGISTIC_SLOPE * (r8 - centre), -LOGISTIC_CLIP, LOGISTIC_CLIP)))
    out["rain_hill_R8"] = r8 * r8 / (r8 * r8 + HILL_HALF**2)
    out["rain_long26_anom"] = c("rain_mean26") - c("rain_long52_mean")
    out["ix_enso_proxy"] = c("rain_mean26") - c("rain_long52_mean")
    out["rain_12w_minus_woy"] = c("rain_mean12") - c("rain_woy_mean")
    out["wet_season_flag"] = F.coalesce(r8 > c("rain_mean26") * 8, F.lit(False)).cast("double")
    out["rain8_x_sin1"], out["rain8_x_cos1"] = r8 * c("sin1"), r8 * c("cos1")
    out["rain8_x_caseStalta"] = r8 * F.coalesce("case_stalta", F.lit(0.0))
    out["caseLag1_x_rain8"] = r8 * F.coalesce("case_lag1", F.lit(0.0))
    out["case_over_rain8"] = ratio(c("c"), r8 + 1)
    out["rain8_over_woy"] = ratio(r8, F.abs("rain_woy_mean") + 1)
    by_size = Window.partitionBy("unit").orderBy(r8.asc_nulls_last())
    ties, known = F.count(F.lit(1)).over(Window.partitionBy("unit", r8)), F.count(r8).over(Window.partitionBy("unit"))
    out["rain_pct_unit"] = F.when(r8.isNotNull(), (F.rank().over(by_size) + (ties - 1) / 2) / known)
    out["stalta_delta"] = c("case_stalta") - F.lag("case_stalta").over(in_season())
    out["rain_sum8_woy_anom"] = r8 - F.avg(r8).over(same_week())
    out["_hit"] = F.when(c("c") >= c("_high"), c("_place"))
    return out


def _third_stage() -> dict[str, Column]:
    c = F.col
    return {
        "_turn": (c("wet_season_flag") != F.lag("wet_season_flag").over(in_season())).cast("int"),
        "inter_epidemic_interval": (c("_place") - F.coalesce(F.max("_hit").over(history(end=-1)), F.lit(0))).cast("double"),
        "ix_rain_anom_ratio": ratio(c("rain_woy_anom"), F.abs("rain_woy_mean") + 1),
    }


def _fourth_stage() -> dict[str, Column]:
    return {
        "_run": F.coalesce(F.sum("_turn").over(season()), F.lit(0)),
        "susceptibility_proxy": ratio(F.col("inter_epidemic_interval"), F.log1p(clipped(F.col("case_sum52"), low=0)) + 1),
    }


def _fifth_stage() -> dict[str, Column]:
    run = Window.partitionBy("unit", "yr", "_run").orderBy("wn")
    return {"wet_run_len": F.row_number().over(run) * F.col("wet_season_flag")}


#: What needs the running level of high counts.
CLOCK = ("inter_epidemic_interval", "susceptibility_proxy")


def earlier_levels(values: np.ndarray, share: float) -> list[float | None]:
    """For each value the ``share`` quantile of the known ones strictly before it, between neighbours in proportion."""
    seen: list[float] = []
    out: list[float | None] = []
    for v in values.tolist():
        at = (len(seen) - 1) * share
        low = int(at)
        out.append(None if not seen else seen[low] if at == low else seen[low] + (seen[low + 1] - seen[low]) * (at - low))
        if v == v:
            insort(seen, v)
    return out


def ranks_so_far(values: np.ndarray) -> list[float | None]:
    """For each known value its share of the rank among those up to it, equal ones sharing the mean of theirs."""
    seen: list[float] = []
    out: list[float | None] = []
    for v in values.tolist():
        if v != v:
            out.append(None)
            continue
        insort(seen, v)
        out.append((bisect_left(seen, v) + bisect_right(seen, v) + 1) / 2 / len(seen))
    return out


def in_order(df: DataFrame, column: str, name: str, running: Callable[[np.ndarray], list[float | None]]) -> DataFrame:
    """Adds ``name``: ``running`` of a unit's values in the order of its weeks.

    An order statistic of all that went before has no window that takes it from row to row: a frame
    that only grows is sorted anew for each. Here each unit keeps one sorted list.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("yr", "ascending"), ("wn", "ascending")])
        values = table.column(column).cast(pa.float64()).to_numpy()
        return table.append_column(name, pa.array(running(values), pa.float64()))

    return df.groupBy("unit").applyInArrow(one, schema)


def with_causal_rank(df: DataFrame) -> DataFrame:
    """Adds ``rain_pct_unit_causal``, a variant of the unit rank that only looks back; no part of the 108."""
    return in_order(df, "rain_sum8", "rain_pct_unit_causal", ranks_so_far)


def enrich(panel: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The panel and its features, or ``only`` those named."""
    clock = only is None or not set(CLOCK).isdisjoint(only)
    out = in_order(panel, "c", "_high", partial(earlier_levels, share=HIGH_SHARE)) if clock else panel.withColumn("_high", F.lit(None).cast("double"))
    for columns in (_first_stage(), _second_stage(), _third_stage(), _fourth_stage(), _fifth_stage()):
        out = out.select("*", *(v.alias(k) for k, v in columns.items()))
    return out.select(*panel.columns, *(only if only is not None else (c for c in out.columns if c not in panel.columns and not c.startswith("_"))))


def feature_columns(df: DataFrame) -> list[str]:
    """All columns but keys, measures, flags and labels."""
    return [c for c in df.columns if c not in ("unit", "yr", "wn", "c", "r", "y", "labelable") and not c.startswith("flag_")]
