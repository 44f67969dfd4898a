"""The queries of the panel operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.windows import season
from ..operators import catalogue, comparator, evaluate, features, forest, inference, labels, metrics, reporting, resampling, signatures, trigger
from ..session import configure, materialised, new_folder
from ..sources import panel as source
from . import oracle as sql

KEYS = source.KEYS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The feature families by the columns they hold.
FAMILIES: dict[str, list[str]] = {
    "e01_lags": [f"{n}_lag{k}" for n in ("case", "rain") for k in features.LAGS],
    "e02_raw": ["case_raw", "rain_raw"],
    "e03_means": [f"{n}_mean{w}" for n in ("case", "rain") for w in features.MEANS],
    "e04_rain_sums": [f"rain_sum{w}" for w in features.MEANS],
    "e05_stds": [f"{n}_std{w}" for n in ("case", "rain") for w in features.SPREADS],
    "e06_accumulations": [f"rain_accum{w}" for w in features.ACCUMULATIONS],
    "e07_stalta": ["case_stalta", "rain_stalta"],
    "e08_delta": ["case_delta", "rain_delta"],
    "e09_accel": ["case_accel", "rain_accel"],
    "e10_pct": ["case_pct", "rain_pct"],
    "e11_woy_mean": ["case_woy_mean", "rain_woy_mean"],
    "e12_woy_anom": ["case_woy_anom", "rain_woy_anom"],
    "e13_woy_z": ["case_woy_z", "rain_woy_z"],
    "e14_fourier": ["sin1", "sin2", "sin3", "cos1", "cos2", "cos3"],
    "e15_logistic": [f"rain_logistic_Rc{k}" for k in features.LOGISTIC_CENTRES],
    "e16_hill": ["rain_hill_R8"],
    "e17_long26": ["rain_long26_anom"],
    "e18_long52": ["rain_long52_mean"],
    "e19_12w_minus_woy": ["rain_12w_minus_woy"],
    "e20_wet_flag": ["wet_season_flag"],
    "e21_wet_run": ["wet_run_len"],
    "e22_rain_cumyear": ["rain_cumyear"],
    "e23_weeks_into_year": ["weeks_into_year"],
    "e24_var12": ["case_var12", "rain_var12"],
    "e25_ac1": ["case_ac1_12", "rain_ac1_12"],
    "e26_rain8_x_season": ["rain8_x_sin1", "rain8_x_cos1"],
    "e27_rain8_x_state": ["rain8_x_caseStalta", "caseLag1_x_rain8"],
    "e28_long_lags": [f"{n}_lag{k}" for n in ("case", "rain") for k in features.LONG_LAGS],
    "e29_extremes": ["case_max4", "case_max12", "case_min4", "case_min12", "rain_max4", "rain_max12"],
    "e30_logs": ["log_case", "log_rain"],
    "e31_case_over_rain8": ["case_over_rain8"],
    "e32_rain8_over_woy": ["rain8_over_woy"],
    "e33_rain_pct_unit": ["rain_pct_unit"],
    "e34_stalta_delta": ["stalta_delta"],
    "e35_rain_sum8_woy_anom": ["rain_sum8_woy_anom"],
    "e36_case_cumyear": ["case_cumyear"],
    "e37_skew12": ["rain_skew12", "case_skew12"],
    "e38_enso_proxy": ["ix_enso_proxy"],
    "e39_anom_ratio": ["ix_rain_anom_ratio"],
    "e40_inter_epidemic": ["inter_epidemic_interval"],
    "e41_case_sum52": ["case_sum52"],
    "e42_susceptibility": ["susceptibility_proxy"],
}

DOMAIN = [c for cs in FAMILIES.values() for c in cs]
OWN = [f"c22fb_{n}_{s}" for s in ("case", "rain") for n in signatures.NAMES]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return register


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.weekly_panel(spark, sf_dir)


def family_query(columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.enrich(weekly(spark, sf_dir), columns).select(*KEYS, *columns))


for _name, _columns in FAMILIES.items():
    query(_name, sql.family(_columns))(partial(family_query, _columns))


@query("e43_enriched", f"WITH {sql.features()} SELECT unit, yr, wn, {sql.rounded([c for cs in FAMILIES.values() for c in cs], 5)} FROM enriched")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.enrich(weekly(spark, sf_dir)).select(*KEYS, *(c for cs in FAMILIES.values() for c in cs)), 5)


@query("e44_rain_pct_unit_causal", f"""WITH {sql.features()}, v AS (SELECT unit, yr, wn, rain_sum8 AS v FROM enriched) SELECT a.unit, a.yr, a.wn,
  round(CASE WHEN a.v IS NOT NULL THEN (count(*) FILTER (WHERE b.v < a.v) + (count(*) FILTER (WHERE b.v = a.v) + 1) / 2.0) / nullif(count(b.v), 0) END, 6) + 0 AS rain_pct_unit_causal
  FROM v a JOIN v b ON a.unit = b.unit AND (b.yr < a.yr OR (b.yr = a.yr AND b.wn <= a.wn)) GROUP BY a.unit, a.yr, a.wn, a.v""")
def causal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant of e33 that only looks back; no part of the 108."""
    return rounded(features.with_causal_rank(features.enrich(weekly(spark, sf_dir), ["rain_sum8"]).select(*KEYS, "rain_sum8")).drop("rain_sum8"))


@query("entry_slice")
def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_query(["case_mean4", "rain_sum8", "case_lag1", "case_stalta", "case_woy_anom"], spark, sf_dir)


SQL["entry_slice"] = sql.family(["case_mean4", "rain_sum8", "case_lag1", "case_stalta", "case_woy_anom"])


# Sources, filters, sets

for _level in ("region", "nation"):
    query(f"io1_panel_{_level}", f"WITH {sql.panel(_level)} SELECT unit, yr, wn, c, round(r, 6) + 0 AS r FROM panel")(lambda spark, sf_dir, _level=_level: rounded(source.weekly_panel(spark, sf_dir, _level)))

_FLAGGED = """, flagged AS (SELECT *, CASE WHEN yr = 1998 THEN 1 ELSE 0 END AS flag_covid,
  CASE WHEN count(*) OVER (PARTITION BY unit, yr) < 40 THEN 1 ELSE 0 END AS flag_terminal_gap,
  CASE WHEN (CAST(c AS BIGINT) * 7 + wn) % 17 = 0 THEN 1 ELSE 0 END AS flag_plausibility FROM panel),
f1 AS (SELECT * FROM flagged WHERE yr NOT IN (SELECT yr FROM flagged GROUP BY yr HAVING avg(flag_covid) >= 0.5)),
f2 AS (SELECT * FROM f1 WHERE yr NOT IN (SELECT yr FROM f1 GROUP BY yr HAVING avg(flag_terminal_gap) >= 0.5))"""


@query("f1_drop_flagged_years", f"WITH {sql.panel()}{_FLAGGED} SELECT unit, yr, wn, c FROM f2")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.drop_flagged_years(source.with_flags(weekly(spark, sf_dir))).select(*KEYS, "c")


@query("f2_plausible_rows", f"WITH {sql.panel()}{_FLAGGED} SELECT unit, yr, wn, c FROM flagged WHERE flag_plausibility = 0")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.plausible(source.with_flags(weekly(spark, sf_dir))).select(*KEYS, "c")


@query("f4_fold_rows", f"""WITH {sql.panel()}, {sql.placed()}, later AS (SELECT yr AS fold FROM (SELECT yr, row_number() OVER (ORDER BY yr) AS n FROM (SELECT DISTINCT yr FROM limb WHERE labelable = 1)) WHERE n > 2),
years AS (SELECT fold FROM limb JOIN later ON yr < fold WHERE labelable = 1 GROUP BY fold HAVING max(y) = 1 AND min(y) = 0) SELECT fold, CASE WHEN yr = fold THEN 1 ELSE 0 END AS is_test, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM limb JOIN years ON yr <= fold WHERE labelable = 1 GROUP BY ALL""")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.folds(labels.label(weekly(spark, sf_dir))).groupBy("fold", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("j1_features_join_labels", f"WITH {sql.features()}, {sql.placed()} SELECT e.unit, e.yr, e.wn, round(case_mean4, 6) + 0 AS case_mean4, y, labelable FROM enriched e JOIN limb l ON e.unit = l.unit AND e.yr = l.yr AND e.wn = l.wn")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = weekly(spark, sf_dir)
    return rounded(features.enrich(panel, ["case_mean4"]).select(*KEYS, "case_mean4").join(labels.label(panel).select(*KEYS, "y", "labelable"), KEYS))


def climates(spark: SparkSession) -> DataFrame:
    """A small dimension: two regions have a type, the others fall back to NA."""
    return spark.createDataFrame([("AFRICA", "I"), ("ASIA", "II"), ("EUROPE", "I")], "unit string, climate_type string")


_CLIMATES = "climates AS (SELECT * FROM (VALUES ('AFRICA', 'I'), ('ASIA', 'II'), ('EUROPE', 'I')) t(unit, climate_type))"


@query("j4_dimension_lookup", f"WITH {sql.panel()}, {_CLIMATES} SELECT unit, coalesce(climate_type, 'NA') AS climate_type, count(*) AS n FROM panel LEFT JOIN climates USING (unit) GROUP BY ALL")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).join(F.broadcast(climates(spark)), "unit", "left").groupBy("unit", F.coalesce("climate_type", F.lit("NA")).alias("climate_type")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_distinct_years", f"WITH {sql.panel()} SELECT DISTINCT yr FROM panel")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("yr").distinct()


@query("s4_training_cap")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = evaluate.cap_training(evaluate.folds(labels.label(weekly(spark, sf_dir))), [], most=500)
    return capped.groupBy("fold", "is_test", "y").agg(F.count(F.lit(1)).alias("n"))


SQL["s4_training_cap"] = f"""WITH {sql.panel()}, {sql.placed()},
years AS (SELECT yr AS fold FROM (SELECT yr, row_number() OVER (ORDER BY yr) AS n FROM (SELECT DISTINCT yr FROM limb WHERE labelable = 1)) WHERE n > 2),
sizes AS (SELECT fold, CASE WHEN yr = fold THEN 1 ELSE 0 END AS is_test, sum(y) AS pos, sum(1 - y) AS neg FROM limb JOIN years ON yr <= fold WHERE labelable = 1 GROUP BY ALL),
quota AS (SELECT *, least(neg, 500 - least(pos, 250)) AS keep_neg FROM sizes),
kept AS (SELECT fold, is_test, CASE WHEN is_test = 1 OR pos + neg <= 500 THEN pos ELSE least(pos, 500 - keep_neg) END AS p, CASE WHEN is_test = 1 OR pos + neg <= 500 THEN neg ELSE keep_neg END AS n FROM quota)
SELECT fold, is_test, 1 AS y, CAST(p AS BIGINT) AS n FROM kept UNION ALL SELECT fold, is_test, 0, CAST(n AS BIGINT) FROM kept"""


# Catalogue

def whole_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 132 features, with their keys."""
    panel = weekly(spark, sf_dir)
    return features.enrich(panel).select(*KEYS, *DOMAIN).join(signatures.add_signatures(panel).select(*KEYS, *OWN), KEYS)


_KNOWN = sql.known_values(DOMAIN, OWN)


@query("p3_feature_dictionary", f"WITH {_KNOWN} {sql.dictionary(catalogue)}")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, rationale, family and rung of each of the 132 features, and how many values it has."""
    return catalogue.described(whole_frame(spark, sf_dir), [*DOMAIN, *OWN])


def _sets() -> list[tuple[str, str, str]]:
    """(kind, name, feature) of each representation and rung; a feature that a rung holds twice is there twice."""
    both = (("representation", catalogue.representations(DOMAIN, OWN)), ("rung", catalogue.ladder(DOMAIN, OWN)))
    return [(kind, name, c) for kind, sets in both for name, columns in sets.items() for c in columns]


@query("p7_representations", f"""WITH {_KNOWN}, sets(kind, name, feature) AS (VALUES {", ".join(str(row) for row in _sets())})
SELECT kind, name, count(*) AS n, count(DISTINCT feature) AS n_distinct, CAST(sum(n_known) AS BIGINT) AS n_known FROM sets JOIN known_values USING (feature) GROUP BY kind, name""")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each representation and rung, and the values they hold; rungs count raw columns twice where groups hold them too."""
    sets = spark.createDataFrame(_sets(), "kind string, name string, feature string")
    counts = catalogue.unpivoted(whole_frame(spark, sf_dir), [*DOMAIN, *OWN]).groupBy("feature").agg(F.count(F.lit(1)).alias("n_known"))
    joined = sets.join(counts, "feature", "left")
    return joined.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature").alias("n_distinct"), F.sum("n_known").alias("n_known"))


# Signatures

def signature_query(spark: SparkSession, sf_dir: str, series: str, columns: list[str] | None = None) -> DataFrame:
    names = columns or [f"c22fb_{n}_{series}" for n in signatures.NAMES]
    return rounded(signatures.add_signatures(weekly(spark, sf_dir)).select(*KEYS, *names))


for _series, _x in (("case", "c"), ("rain", "r")):
    query(f"c_signatures_{_series}", sql.signatures(_x, _series))(partial(signature_query, series=_series))
for _i, _n in enumerate(signatures.NAMES, 1):
    query(f"c{_i:02d}_{_n}", f"SELECT unit, yr, wn, c22fb_{_n}_case FROM ({sql.signatures('c', 'case')})")(partial(signature_query, series="case", columns=[f"c22fb_{_n}_case"]))


# Labels

for _mode in ("limb", "prepeak"):
    query(f"l3_label_{_mode}" if _mode == "limb" else "l4_label_prepeak", f"WITH {sql.panel()}, {sql.placed()} SELECT unit, yr, wn, y, labelable FROM {_mode}")(lambda spark, sf_dir, _mode=_mode: labels.label(weekly(spark, sf_dir), _mode).select(*KEYS, "y", "labelable"))


@query("l1_eligibility", f"WITH {sql.panel()}, {sql.placed()} SELECT unit, yr, max(weeks) AS weeks, bool_or(fit) AS eligible FROM p2 GROUP BY ALL")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.positions(weekly(spark, sf_dir)).groupBy("unit", "yr").agg(F.max("_weeks").alias("weeks"), F.max("_fit").alias("eligible"))


@query("l2_first_peak", f"WITH {sql.panel()}, {sql.placed()} SELECT DISTINCT unit, yr, CAST(peak AS INTEGER) AS peak, CAST(onset AS INTEGER) AS onset FROM p4")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = labels.onsets(labels.positions(weekly(spark, sf_dir)))
    return placed.select("unit", "yr", F.col("_peak").cast("int").alias("peak"), F.col("_onset").cast("int").alias("onset")).distinct()


# Metrics, on a label and three scores that both engines can make

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.label(weekly(spark, sf_dir)).where("labelable = 1")
    top = 1 + F.max("c").over(Window.partitionBy("unit"))
    return comparator.with_cluster(rows).select(*KEYS, "cluster", "y", F.round(F.col("c") / top, 1).alias("p1"), F.round(F.coalesce(F.avg("c").over(season(-3, 0)) / top, F.lit(0.0)), 3).alias("p2"), F.round(0.5 + 0.5 * F.sin(F.col("wn") / 8), 3).alias("p3"))


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = F.array(*(F.struct(F.lit(r).alias("rep"), F.col(p).alias("p")) for r, p in (("level", "p1"), ("mean", "p2"), ("season", "p3"))))
    return scored(spark, sf_dir).select(*KEYS, "cluster", "y", F.inline(reps))


_ONES = "(SELECT *, 1 AS one FROM oof)"
SQL["m1_auroc"] = f"WITH {sql.long_scores()} SELECT rep, unit, round(auroc, 6) + 0 AS auroc FROM ({sql.weighted_auroc(_ONES, 'rep, unit', 'one')})"
query("m1_auroc")(lambda spark, sf_dir: rounded(metrics.auroc(long_scores(spark, sf_dir), ["rep", "unit"])))

SQL["m2_auprc"] = f"""WITH {sql.long_scores()}, sums AS (SELECT rep, unit, p, sum(y) AS wp, sum(1 - y) AS wn FROM oof GROUP BY ALL),
steps AS (SELECT *, sum(wp) OVER w AS tp, sum(wn) OVER w AS fp FROM sums WINDOW w AS (PARTITION BY rep, unit ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT rep, unit, round(CASE WHEN sum(wn) > 0 THEN sum(wp * tp / (tp + fp)) / nullif(sum(wp), 0) END, 6) + 0 AS auprc FROM steps GROUP BY ALL"""
query("m2_auprc")(lambda spark, sf_dir: rounded(metrics.auprc(long_scores(spark, sf_dir), ["rep", "unit"])))

SQL["m3_brier"] = f"WITH {sql.long_scores()} SELECT rep, unit, round(avg((p - y) * (p - y)), 6) + 0 AS brier FROM oof GROUP BY ALL"
query("m3_brier")(lambda spark, sf_dir: rounded(metrics.brier(long_scores(spark, sf_dir), ["rep", "unit"])))

SQL["m4_ece"] = f"""WITH {sql.long_scores()}, edges AS (SELECT i, i * 0.1::DOUBLE AS lo, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(10) t(i)),
bins AS (SELECT rep, i, count(*) AS n, avg(y) AS rate, avg(p) AS mean FROM oof LEFT JOIN edges ON p >= lo AND p < hi GROUP BY ALL)
SELECT rep, round(sum(CASE WHEN i IS NOT NULL THEN n * abs(rate - mean) ELSE 0 END) / sum(n), 6) + 0 AS ece FROM bins GROUP BY ALL"""
query("m4_ece")(lambda spark, sf_dir: rounded(metrics.ece(long_scores(spark, sf_dir), ["rep"])))

SQL["m5_logit"] = f"WITH {sql.long_scores()} SELECT rep, unit, yr, wn, round(ln(q / (1 - q)), 6) + 0 AS logit FROM (SELECT *, CASE WHEN p < 1e-6 THEN 1e-6 WHEN p > 1 - 1e-6 THEN 1 - 1e-6 ELSE p END AS q FROM oof)"
query("m5_logit")(lambda spark, sf_dir: rounded(long_scores(spark, sf_dir).select("rep", *KEYS, metrics.logit(F.col("p")).alias("logit"))))

SQL["m6_spiegelhalter"] = f"""WITH {sql.long_scores()}, z AS (SELECT rep, sum((y - p) * (1 - 2 * p)) / nullif(sqrt(sum((1 - 2 * p) * (1 - 2 * p) * p * (1 - p))), 0) AS z FROM oof GROUP BY rep)
SELECT rep, round(z, 6) + 0 AS z, round({sql.normal_p('z')}, 6) + 0 AS p_value FROM z"""
query("m6_spiegelhalter")(lambda spark, sf_dir: rounded(metrics.spiegelhalter(long_scores(spark, sf_dir), ["rep"])))

query("m7_cox")(lambda spark, sf_dir: rounded(metrics_cox(spark, sf_dir)))


def metrics_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton's method has no SQL; tests hold it against a direct solution."""
    return inference.cox(long_scores(spark, sf_dir), ["rep"])


SQL["m8_midrank"] = f"WITH {sql.scores()} SELECT unit, yr, wn, rank() OVER (PARTITION BY unit ORDER BY p1) + (count(*) OVER (PARTITION BY unit, p1) - 1) / 2.0::DOUBLE AS midrank FROM scored"
query("m8_midrank")(lambda spark, sf_dir: metrics.with_midrank(scored(spark, sf_dir), ["unit"], "p1").select(*KEYS, "midrank"))

_MID = "rank() OVER (PARTITION BY unit{g} ORDER BY {p}) + (count(*) OVER (PARTITION BY unit{g}, {p}) - 1) / 2.0"
SQL["m9_delong"] = f"""WITH {sql.scores()}, ranks AS (SELECT unit, y, sum(y) OVER (PARTITION BY unit) AS m, sum(1 - y) OVER (PARTITION BY unit) AS n,
  {_MID.format(g='', p='p1')} AS a1, {_MID.format(g=', y', p='p1')} AS o1, {_MID.format(g='', p='p2')} AS a2, {_MID.format(g=', y', p='p2')} AS o2 FROM scored),
v AS (SELECT unit, y, m, n, CASE WHEN y = 1 THEN (a1 - o1) / n ELSE 1 - (a1 - o1) / m END AS v1, CASE WHEN y = 1 THEN (a2 - o2) / n ELSE 1 - (a2 - o2) / m END AS v2 FROM ranks),
t AS (SELECT unit, avg(v1) FILTER (WHERE y = 1) AS auc1, avg(v2) FILTER (WHERE y = 1) AS auc2, var_samp(v1 - v2) FILTER (WHERE y = 1) / max(m) + var_samp(v1 - v2) FILTER (WHERE y = 0) / max(n) AS var FROM v GROUP BY unit),
z AS (SELECT *, CASE WHEN var > 0 THEN (auc1 - auc2) / sqrt(var) END AS z FROM t)
SELECT unit, round(auc1, 6) + 0 AS auc1, round(auc2, 6) + 0 AS auc2, round(z, 6) + 0 AS z, round({sql.normal_p('z')}, 6) + 0 AS p_value FROM z"""
query("m9_delong")(lambda spark, sf_dir: rounded(metrics.delong(scored(spark, sf_dir), ["unit"])))

SQL["m10_fdr"] = f"""WITH {sql.long_scores()}, p AS (SELECT rep, unit, avg(p) AS p_value FROM oof GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY p_value, unit) AS k, count(*) OVER (PARTITION BY rep) AS n FROM p)
SELECT rep, unit, round(p_value, 6) + 0 AS p_value, round(greatest(0, least(1, min(p_value * n / k) OVER (PARTITION BY rep ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))), 6) + 0 AS p_adjusted FROM r"""
query("m10_fdr")(lambda spark, sf_dir: rounded(metrics.benjamini_hochberg(long_scores(spark, sf_dir).groupBy("rep", "unit").agg(F.avg("p").alias("p_value")), ["rep"], tie="unit")))

SQL["m11_kruskal"] = f"""WITH {sql.scores()}, r AS (SELECT unit, yr, rank() OVER (PARTITION BY unit ORDER BY p1) + (count(*) OVER (PARTITION BY unit, p1) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY unit, p1) AS t FROM scored),
g AS (SELECT unit, yr, count(*)::DOUBLE AS k, sum(k) AS s, sum(t * t - 1) AS t FROM r GROUP BY ALL),
h0 AS (SELECT unit, sum(k) AS n, sum(s * s / k) AS q, sum(t) AS t, count(*) AS n_groups FROM g GROUP BY unit),
h AS (SELECT unit, n_groups, CASE WHEN n_groups >= 2 THEN (12 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - t / (n * n * n - n), 0) END AS h FROM h0)
SELECT unit, round(h, 6) + 0 AS h, n_groups, round({sql.chi_squared_p('h', 'n_groups - 1')}, 6) + 0 AS p_value FROM h"""
query("m11_kruskal")(lambda spark, sf_dir: rounded(metrics.kruskal(scored(spark, sf_dir), ["unit"], "p1", "yr")))

SQL["m11_group_means"] = f"WITH {sql.scores()} SELECT unit, yr, round(avg(p1), 6) + 0 AS mean, count(p1) AS n FROM scored GROUP BY ALL HAVING count(p1) >= 2"
query("m11_group_means")(lambda spark, sf_dir: rounded(metrics.group_means(scored(spark, sf_dir), ["unit"], "p1", "yr")))


# Bootstrap

def shared_draws(oof: DataFrame, replicates: int) -> DataFrame:
    """Multiplicities that SQL can make too: (31 b + 17 k + b k) mod 3, k the cluster's place."""
    places = oof.select("cluster").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster")) - 1)
    b = places.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return b.select("b", "cluster", ((F.col("b") * 31 + F.col("k") * 17 + F.col("b") * F.col("k")) % 3).alias("mult"))


#: Seeds of the stability query.
SEEDS = 5
#: Replicates of the queries that SQL is held against: they check the arithmetic. The b8 to b11 draw as many as the protocol says.
REPS = 40


def replicated(spark: SparkSession, sf_dir: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    oof = long_scores(spark, sf_dir)
    return oof, inference.replicate_metrics(oof, shared_draws(oof, REPS), by, ("auroc",))


_DRAWN = f"{sql.long_scores()}, {sql.multiplicity(REPS)}"
SQL["b1_multiplicities"] = f"WITH {_DRAWN} SELECT b, rep, round(auroc, 6) + 0 AS auroc FROM ({sql.weighted_auroc('drawn', 'b, rep')})"
query("b1_multiplicities")(lambda spark, sf_dir: rounded(replicated(spark, sf_dir, ["rep"])[1].withColumn("b", F.col("b").cast("long"))))

SQL["b2_paired_bootstrap"] = f"""WITH {_DRAWN}, reps AS ({sql.weighted_auroc('drawn', 'b, rep')}), point AS ({sql.weighted_auroc(_ONES, 'rep', 'one')}),
d AS (SELECT x.rep AS a, z.rep AS b_rep, x.auroc - z.auroc AS d FROM reps x JOIN reps z ON x.b = z.b AND x.rep < z.rep WHERE x.auroc - z.auroc IS NOT NULL),
s AS (SELECT a, b_rep, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi, least(1.0, 2 * least(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN d < 0 THEN 1.0 ELSE 0 END)) + 1.0 / (count(*) + 1)) AS p_value FROM d GROUP BY ALL)
SELECT a, b_rep, round(x.auroc - z.auroc, 6) + 0 AS delta, round(ci_lo, 6) + 0 AS ci_lo, round(ci_hi, 6) + 0 AS ci_hi, round(p_value, 6) + 0 AS p_value FROM s JOIN point x ON x.rep = a JOIN point z ON z.rep = b_rep"""


@query("b2_paired_bootstrap")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof, reps = replicated(spark, sf_dir, ["rep"])
    return rounded(inference.paired_contrasts(metrics.auroc(oof, ["rep"]), reps, "rep", "auroc").select("a", "b_rep", "delta", "ci_lo", "ci_hi", "p_value"))


@query("b3_calibration")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton's method has no SQL, so the draws are those of production."""
    return rounded(inference.calibration(materialised(long_scores(spark, sf_dir), "scores"), ["rep"]))


SQL["b4_beats_chance"] = f"""WITH {_DRAWN}, reps AS ({sql.weighted_auroc('drawn', 'b, rep, unit')}), point AS ({sql.weighted_auroc(_ONES, 'rep, unit', 'one')}),
ci AS (SELECT rep, unit, quantile_cont(auroc, 0.025) AS ci_lo, quantile_cont(auroc, 0.975) AS ci_hi FROM reps WHERE auroc IS NOT NULL GROUP BY ALL)
SELECT rep, unit, round(auroc, 6) + 0 AS auroc, round(ci_lo, 6) + 0 AS ci_lo, round(ci_hi, 6) + 0 AS ci_hi, coalesce(ci_lo > 0.5, false) AS beats_chance FROM point LEFT JOIN ci USING (rep, unit)"""


@query("b4_beats_chance")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof = long_scores(spark, sf_dir)
    return rounded(inference.beats_chance(oof, ["rep", "unit"], shared_draws(oof, REPS)))


@query("b5_confirmatory")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.confirmatory(b2(spark, sf_dir), "level", "mean"))


SQL["b5_confirmatory"] = f"""WITH c AS ({SQL['b2_paired_bootstrap']}), m AS (SELECT *, CASE WHEN a = 'level' AND b_rep = 'mean' THEN 'confirmatory' ELSE 'exploratory' END AS family FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, a || '|' || b_rep) AS k, count(*) OVER (PARTITION BY family) AS n FROM m)
SELECT a, b_rep, delta, ci_lo, ci_hi, p_value, family, round(greatest(0, least(1, min(p_value * n / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))), 6) + 0 AS p_adjusted FROM r"""


@query("b6_stability", f"WITH {_DRAWN}, reps AS ({sql.weighted_auroc('drawn', 'b, rep')}) SELECT rep, round(avg(auroc), 6) + 0 AS mean, round(stddev_samp(auroc), 6) + 0 AS sd, count(auroc) AS n_seeds FROM reps GROUP BY rep")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.stability(replicated(spark, sf_dir, ["rep"])[1], ["rep"], "auroc"))


@query("b7_numpy_draws")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production draws, as many as ``REPLICATES``; tests hold them against numpy."""
    return rounded(inference.beats_chance(materialised(long_scores(spark, sf_dir), "scores"), ["rep"]))


def drawn(spark: SparkSession, sf_dir: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scores, and their metrics under each of the ``REPLICATES`` seeded draws of clusters."""
    oof = materialised(long_scores(spark, sf_dir), "scores")
    return oof, resampling.replicate_metrics(resampling.chunks(oof, by), by)


@query("b8_drawn_multiplicities")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drawn(spark, sf_dir, ["rep"])[1])


@query("b9_drawn_contrasts")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b2, b5 and g1 on production draws and by three metrics: intervals, p, adjusted p and stars; tests hold it against numpy."""
    return judged(materialised(long_scores(spark, sf_dir), "scores"), "level", "mean")


def judged(oof: DataFrame, a: str, b: str, names: tuple[str, ...] = resampling.METRICS) -> DataFrame:
    """Each pair's contrasts, adjusted and starred."""
    return adjusted(rounded(inference.contrasts(oof, names=names)), a, b)


def adjusted(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The AUROC of ``a`` and ``b`` is planned and stays as it is; the other contrasts are adjusted for each other, each metric apart."""
    marked = pairs.withColumn("planned", ((F.col("a") == min(a, b)) & (F.col("b_rep") == max(a, b)) & (F.col("metric") == "auroc")))
    found = metrics.benjamini_hochberg(marked.withColumn("_tie", F.concat_ws("|", "a", "b_rep")), ["metric", "planned"], tie="_tie")
    return rounded(found.withColumn("family", F.when(F.col("planned"), "confirmatory").otherwise("exploratory")).drop("planned", "_tie")).withColumn("stars", reporting.stars(F.col("p_value")))


@query("b10_drawn_beats_chance")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's AUROC, with draws of its own years."""
    return rounded(inference.beats_chance(materialised(long_scores(spark, sf_dir), "scores"), ["rep", "unit"], within=["unit"]))


@query("b11_drawn_stability")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a score's AUROC is spread over draws; ``v13_seed_stability`` has the spread over seeds."""
    return rounded(inference.stability(drawn(spark, sf_dir, ["rep"])[1], ["rep"], "auroc"))


# Comparator

_TREND = f"""trend0 AS (SELECT *, row_number() OVER (PARTITION BY unit, yr ORDER BY wn) AS n FROM limb),
trend AS (SELECT *, CASE WHEN n > 1 AND count(c) {sql.over(sql.SEASON, -7)} = count(*) {sql.over(sql.SEASON, -7)} THEN regr_slope(c, n) {sql.over(sql.SEASON, -7)} END AS slope FROM trend0),
promised AS (SELECT unit, yr, wn, y, slope, CASE WHEN n >= 12 AND labelable = 1 THEN CASE WHEN slope > 0 THEN slope * 8 ELSE slope END END AS score FROM trend)"""


@query("t2_trend_score", f"WITH {sql.panel()}, {sql.placed()}, {_TREND} SELECT unit, yr, wn, round(slope, 6) + 0 AS slope, round(score, 6) + 0 AS score FROM promised")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparator.trend_scores(labels.label(weekly(spark, sf_dir))).select(*KEYS, "slope", "score"))


def comparator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparator.trend_scores(labels.label(weekly(spark, sf_dir))).where("score IS NOT NULL").select("unit", "y", F.round("score", 6).alias("p"))


_PROMISED = "(SELECT unit, y, round(score, 6) AS p, 1 AS one FROM promised WHERE score IS NOT NULL)"


@query("t4_trend_auroc", f"WITH {sql.panel()}, {sql.placed()}, {_TREND} SELECT unit, round(auroc, 6) + 0 AS auroc, round(auprc, 6) + 0 AS auprc FROM ({sql.weighted_auroc(_PROMISED, 'unit', 'one')}) JOIN ({sql.average_precision(_PROMISED, 'unit')}) USING (unit)")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comparator_rows(spark, sf_dir)
    return rounded(metrics.auroc(rows, ["unit"]).join(metrics.auprc(rows, ["unit"]), "unit"))


@query("j2_oof_join_comparator", f"WITH {sql.scores()}, {_TREND.replace('FROM limb', 'FROM limb')} SELECT cluster, s.wn, p1, round(score, 6) + 0 AS score FROM scored s JOIN promised p ON s.unit = p.unit AND s.yr = p.yr AND s.wn = p.wn WHERE score IS NOT NULL AND (SELECT count(*) FROM promised WHERE score IS NOT NULL) >= 30")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = comparator.with_cluster(comparator.trend_scores(labels.label(weekly(spark, sf_dir)))).where("score IS NOT NULL").select("cluster", "wn", "score")
    both = scored(spark, sf_dir).select("cluster", "wn", "p1").join(own, ["cluster", "wn"])
    enough = both.agg(F.count(F.lit(1)).alias("_n")).where("_n >= 30")
    return rounded(both.join(F.broadcast(enough), F.lit(True), "left_semi"))


# Trigger

def ready(spark: SparkSession, sf_dir: str, mode: str = "continuous") -> DataFrame:
    return trigger.prepared(labels.label(weekly(spark, sf_dir)), mode)


_ROWS = f"{sql.panel()}, {sql.placed()}, trows AS (SELECT unit, yr, wn, c, r FROM limb WHERE labelable = 1)"
_H = lambda s: sql.over(sql.HISTORY, -s)
_CONT = f"ta AS (SELECT *, CASE WHEN avg(c) {_H(11)} > 0 AND avg(c) {_H(2)} / nullif(avg(c) {_H(11)}, 0) > 1.33 THEN 1 ELSE 0 END AS ta FROM trows)"
_TARGETS = "goal AS (SELECT *, min(CASE WHEN ta = 1 THEN wn END) OVER (PARTITION BY unit, yr) - wn AS ahead FROM ta)"
_RAIN = f"""rf0 AS (SELECT *, coalesce(r, 0.0) AS z FROM goal),
rf1 AS (SELECT *, {', '.join(f'sum(z) {_H(w - 1)} AS rain_accum{w}w' for w in (4, 8, 12))}, {', '.join(f'avg(z) {_H(s - 1)} / nullif(avg(z) {_H(n - 1)}, 0) AS rain_stalta{s}_{n}' for s, n in ((3, 12), (4, 26)))} FROM rf0),
rf AS (SELECT *, {', '.join(f'rain_accum{w}w - lag(rain_accum{w}w, {w}) OVER ({sql.HISTORY}) AS rain_rate{w}w' for w in (4, 8))}, {', '.join(f'CASE WHEN ahead IS NOT NULL THEN CASE WHEN ahead BETWEEN 1 AND {k} THEN 1 ELSE 0 END END AS y{k}' for k in (4, 6, 8, 10))} FROM rf1)"""
_READY = f"{_ROWS}, {_CONT}, {_TARGETS}, {_RAIN}"


# The latch as a recursion over the weeks of a year, all years at once.
_LATCH = f"""RECURSIVE {_ROWS}, means AS (SELECT unit, yr, wn, row_number() OVER ({sql.SEASON}) AS n, row_number() OVER ({sql.HISTORY}) > 31 AS ready, avg(c) {_H(3)} AS sta,
  avg(c) {sql.over(sql.HISTORY, -31, -6)} AS lta FROM trows),
latch AS (SELECT DISTINCT unit, yr, CAST(0 AS BIGINT) AS wn, CAST(0 AS BIGINT) AS n, false AS lit, CAST(NULL AS DOUBLE) AS base FROM means
  UNION ALL SELECT unit, yr, wn, n, lit, CASE WHEN lit THEN level END AS base FROM (
    SELECT unit, yr, wn, n, level, ready AND CASE WHEN was THEN NOT coalesce(sta < 0.73 * level AND level > 0, false) ELSE coalesce(sta >= 1.33 * level AND level > 0, false) END AS lit FROM (
      SELECT m.unit, m.yr, m.wn, m.n, m.ready, m.sta, s.lit AS was, CASE WHEN s.lit AND s.base IS NOT NULL THEN s.base ELSE CASE WHEN m.ready THEN m.lta END END AS level
      FROM latch s JOIN means m ON m.unit = s.unit AND m.yr = s.yr AND m.n = s.n + 1)))"""


@query("r1_constant_latch", f"WITH {_LATCH} SELECT unit, yr, wn, CAST(lit AS INTEGER) AS ta FROM latch WHERE n > 0")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine; tests hold it against a loop, too."""
    return trigger.constant_latch(labels.label(weekly(spark, sf_dir)).where("labelable = 1").select(*KEYS, "c", "r")).select(*KEYS, "ta")


@query("r2_continuous_trigger", f"WITH {_ROWS}, {_CONT} SELECT unit, yr, wn, ta FROM ta")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark, sf_dir).select(*KEYS, "ta")


@query("r3_rain_features", f"WITH {_READY} SELECT unit, yr, wn, {sql.rounded(list(trigger.FEATURES))} FROM rf")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ready(spark, sf_dir).select(*KEYS, *trigger.FEATURES))


@query("r6_onset_targets", f"WITH {_READY} SELECT unit, yr, wn, y4, y6, y8, y10 FROM rf")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark, sf_dir).select(*KEYS, "y4", "y6", "y8", "y10")


def threshold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form on features rounded to 6 places, so that both engines tie alike."""
    return trigger.long_form(rounded(ready(spark, sf_dir)))


_LONG = f"""{_READY}, tall AS (SELECT unit, yr, wn, feature, feature_ord, x, lead, y FROM (
  {' UNION ALL '.join(f"SELECT unit, yr, wn, '{f}' AS feature, {i} AS feature_ord, round({f}, 6) AS x, {k} AS lead, y{k} AS y FROM rf" for i, f in enumerate(trigger.FEATURES) for k in trigger.LEADS)}) WHERE x IS NOT NULL AND y IS NOT NULL)"""
_FIT = f"""{_LONG}, grp AS (SELECT unit, feature, feature_ord, lead, count(*) AS n, sum(y) AS pos, count(DISTINCT x) AS k,
  quantile_cont(x, [{', '.join(repr(0.02 + i * (0.96 / 99)) for i in range(100))}]) AS q FROM tall GROUP BY ALL HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*)),
cand AS (SELECT DISTINCT unit, feature, lead, unnest(q) AS t FROM grp WHERE k > 120 UNION SELECT DISTINCT a.unit, a.feature, a.lead, a.x FROM tall a JOIN grp USING (unit, feature, lead) WHERE k <= 120),
judged AS (SELECT g.unit, g.feature, g.feature_ord, g.lead, g.n, t AS threshold, sum(CASE WHEN x >= t THEN y ELSE 0 END) / max(pos) AS sens, 1 - sum(CASE WHEN x >= t THEN 1 - y ELSE 0 END) / max(g.n - pos) AS spec
  FROM grp g JOIN cand USING (unit, feature, lead) JOIN tall USING (unit, feature, lead) GROUP BY ALL),
best AS (SELECT *, round(sens + spec - 1, 12) AS j FROM judged QUALIFY row_number() OVER (PARTITION BY unit, feature, lead ORDER BY round(sens + spec - 1, 12) DESC, threshold) = 1)"""


@query("r7_youden_threshold", f"WITH {_FIT} SELECT unit, feature, lead, n, round(threshold, 6) + 0 AS threshold, round(sens, 6) + 0 AS sensitivity, round(spec, 6) + 0 AS specificity, round(j, 6) + 0 AS youden_j FROM best")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trigger.fit_thresholds(threshold_rows(spark, sf_dir), ["unit", "feature", "feature_ord", "lead"]).drop("feature_ord"))


@query("r8_select_best", f"WITH {_FIT} SELECT unit, feature, lead, round(threshold, 6) + 0 AS threshold, round(j, 6) + 0 AS youden_j FROM best QUALIFY row_number() OVER (PARTITION BY unit ORDER BY j DESC, feature_ord, lead) = 1")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = trigger.select_best(trigger.fit_thresholds(threshold_rows(spark, sf_dir), ["unit", "feature", "feature_ord", "lead"]), ["unit"])
    return rounded(best.select("unit", "feature", "lead", "threshold", "youden_j"))


@query("r9_median_lead", f"""WITH {_FIT}, pick AS (SELECT unit, feature, threshold FROM best QUALIFY row_number() OVER (PARTITION BY unit ORDER BY j DESC, feature_ord, lead) = 1),
onset AS (SELECT unit, yr, min(wn) AS onset FROM rf WHERE ta = 1 GROUP BY ALL), crossed AS (SELECT unit, yr, min(wn) AS crossing FROM tall JOIN pick USING (unit, feature) WHERE x >= threshold GROUP BY ALL)
SELECT unit, median(onset - crossing) AS median_lead FROM onset JOIN crossed USING (unit, yr) WHERE onset > crossing GROUP BY unit""")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threshold_rows(spark, sf_dir)
    best = trigger.select_best(trigger.fit_thresholds(rows, ["unit", "feature", "feature_ord", "lead"]), ["unit"])
    return trigger.median_lead(rows.select("unit", "yr", "wn", "feature", "x").distinct(), ready(spark, sf_dir), best)


_FOLDS = f"""{_LONG}, train AS (SELECT tall.*, fold FROM tall JOIN (SELECT DISTINCT unit, yr AS fold FROM tall) USING (unit) WHERE yr <> fold),
grp AS (SELECT unit, fold, feature, feature_ord, lead, count(*) AS n, sum(y) AS pos, count(DISTINCT x) AS k,
  quantile_cont(x, [{', '.join(repr(0.02 + i * (0.96 / 99)) for i in range(100))}]) AS q FROM train GROUP BY ALL HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*)),
cand AS (SELECT DISTINCT unit, fold, feature, lead, unnest(q) AS t FROM grp WHERE k > 120 UNION SELECT DISTINCT unit, fold, feature, lead, x FROM train JOIN grp USING (unit, fold, feature, lead) WHERE k <= 120),
judged AS (SELECT unit, fold, feature, g.feature_ord, lead, t AS threshold, sum(CASE WHEN x >= t THEN y ELSE 0 END) / max(pos) - sum(CASE WHEN x >= t THEN 1 - y ELSE 0 END) / max(g.n - pos) AS j
  FROM grp g JOIN cand USING (unit, fold, feature, lead) JOIN train USING (unit, fold, feature, lead) GROUP BY ALL),
best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY unit, fold ORDER BY round(j, 12) DESC, feature_ord, lead, threshold) = 1),
oof AS (SELECT unit, yr, x AS p, y, 1 AS one, CASE WHEN x >= threshold THEN 1 ELSE 0 END AS hit FROM tall JOIN (SELECT unit, fold AS yr, feature, lead, threshold FROM best) USING (unit, yr, feature, lead)),
pctl AS (SELECT unit, fold, feature, 100 * avg(CASE WHEN x < threshold THEN 1.0 ELSE 0.0 END) AS pctl FROM best JOIN (SELECT DISTINCT unit, feature, yr, wn, x FROM tall) USING (unit, feature) WHERE yr <> fold AND (unit, fold) IN (SELECT (unit, yr) FROM oof) GROUP BY ALL),
areas AS (SELECT unit, avg(auroc) AS auroc_loyo FROM ({sql.weighted_auroc('oof', 'unit, yr', 'one')}) GROUP BY unit),
rates AS (SELECT unit, sum(hit * y) / nullif(sum(y), 0) AS sens_loyo, sum((1 - hit) * (1 - y)) / nullif(sum(1 - y), 0) AS spec_loyo FROM oof GROUP BY unit),
modal AS (SELECT unit, feature AS modal_feature FROM (SELECT unit, feature, count(*) AS votes, min(fold) AS seen FROM pctl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY votes DESC, seen) = 1),
spread AS (SELECT unit, stddev_pop(pctl) / nullif(avg(pctl), 0) AS threshold_pctl_cv FROM pctl GROUP BY unit)"""


@query("r10_leave_one_year_out", f"""WITH {_FOLDS} SELECT unit, round(auroc_loyo, 6) + 0 AS auroc_loyo, round((coalesce(sens_loyo, spec_loyo) + coalesce(spec_loyo, sens_loyo)) / 2, 6) + 0 AS balanced_acc_loyo,
  round(sens_loyo, 6) + 0 AS sens_loyo, round(spec_loyo, 6) + 0 AS spec_loyo, modal_feature, round(threshold_pctl_cv, 6) + 0 AS threshold_pctl_cv FROM rates JOIN modal USING (unit) JOIN spread USING (unit) LEFT JOIN areas USING (unit)""")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialised(trigger.by_feature(rounded(ready(spark, sf_dir))), "tall")
    return rounded(trigger.fold_summary(*trigger.leave_one_year_out(rows, materialised(trigger.fold_fits(rows, ["unit"]), "fits"))))


# The rounded columns of a unit's row; a threshold has one place for accumulations, three for dynamics.
_SHOWN = {"threshold": 3, "threshold_pctl": 1, "auroc_insample": 3, "youden_j": 3, "sensitivity": 3, "specificity": 3, "auroc_loyo": 3, "balanced_acc_loyo": 3, "sens_loyo": 3, "spec_loyo": 3, "median_lead_weeks": 1, "threshold_pctl_cv": 3}


def _unit_sql(accum: bool, name: str, places: int) -> str:
    """The headline columns of one kind of features."""
    kind = lambda text: text.replace("x IS NOT NULL AND y IS NOT NULL)", f"x IS NOT NULL AND y IS NOT NULL AND contains(feature, 'accum') = {accum})")
    shown = _SHOWN | {"threshold": places}
    return f"""SELECT unit, {", ".join(f"{c} AS {name}{c}" for c in ("feature", "lead", "modal_feature", "n"))}, {", ".join(f"round({c} + 1e-10, {k}) AS {name}{c}" for c, k in shown.items())} FROM (
  WITH {kind(_FIT)}, pick AS (SELECT unit, feature, lead, threshold, n, sens AS sensitivity, spec AS specificity, j AS youden_j FROM best QUALIFY row_number() OVER (PARTITION BY unit ORDER BY j DESC, feature_ord, lead) = 1),
  own AS (SELECT unit, x AS p, y, 1 AS one FROM tall JOIN pick USING (unit, feature, lead)),
  below AS (SELECT unit, 100 * avg(CASE WHEN x < threshold THEN 1.0 ELSE 0.0 END) AS threshold_pctl FROM pick JOIN (SELECT DISTINCT unit, feature, yr, wn, x FROM tall) USING (unit, feature) GROUP BY unit),
  onset AS (SELECT unit, yr, min(wn) AS onset FROM rf WHERE ta = 1 GROUP BY ALL), crossed AS (SELECT unit, yr, min(wn) AS crossing FROM tall JOIN pick USING (unit, feature) WHERE x >= threshold GROUP BY ALL),
  ahead AS (SELECT unit, median(onset - crossing) AS median_lead_weeks FROM onset JOIN crossed USING (unit, yr) WHERE onset > crossing GROUP BY unit)
  SELECT pick.*, auroc AS auroc_insample, threshold_pctl, median_lead_weeks FROM pick JOIN ({sql.weighted_auroc('own', 'unit', 'one')}) USING (unit) JOIN below USING (unit) LEFT JOIN ahead USING (unit))
LEFT JOIN (WITH {kind(_FOLDS)} SELECT unit, auroc_loyo, (coalesce(sens_loyo, spec_loyo) + coalesce(spec_loyo, sens_loyo)) / 2 AS balanced_acc_loyo, sens_loyo, spec_loyo, modal_feature, threshold_pctl_cv
  FROM rates JOIN modal USING (unit) JOIN spread USING (unit) LEFT JOIN areas USING (unit)) USING (unit)"""


@query("r11_unit_rows", f"SELECT * FROM ({_unit_sql(True, '', 1)}) LEFT JOIN ({_unit_sql(False, 'dyn_', 3)}) USING (unit)")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigger.unit_rows(materialised(rounded(ready(spark, sf_dir)), "ready"))


_TEXTS = ("feature", "modal_feature", "dyn_feature", "dyn_modal_feature")
_NUMBERS = [f"{name}{c}" for name in ("", "dyn_") for c in (*_SHOWN, "lead", "n")]
SQL["r12_median_row"] = f"""WITH u AS ({SQL['r11_unit_rows']}) SELECT unit, {", ".join(_TEXTS)}, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NUMBERS)} FROM u
UNION ALL BY NAME SELECT '(scale median)' AS unit, {", ".join(f"(SELECT {c} FROM u WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, min(unit) LIMIT 1) AS {c}" for c in _TEXTS)}, {", ".join(f"round(median({c}) + 1e-10, 3) AS {c}" for c in _NUMBERS)} FROM u"""


@query("r12_median_row")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigger.with_median_row(materialised(r11(spark, sf_dir), "units"))


#: Below so many unit-weeks that both kinds score there is no contrast.
LEAST_PAIRS = 30


@query("r13_dynamics_contrast")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamics less accumulation, on the weeks both score; the sign is that of dynamics."""
    return rounded(dynamics_contrast(materialised(trigger.by_feature(rounded(ready(spark, sf_dir))), "tall")))


def dynamics_contrast(rows: DataFrame, least: int = LEAST_PAIRS) -> DataFrame:
    by = ["unit", "kind"]
    found = materialised(trigger.leave_one_year_out(rows, materialised(trigger.fold_fits(rows, by), "fits"), by)[1], "kinds")
    a, d = found.where("kind = 0").select(*KEYS, "y", F.col("x").alias("pa")), found.where("kind = 1").select(*KEYS, F.col("x").alias("pd"))
    both = materialised(comparator.with_cluster(a.join(d, KEYS)), "both")
    sizes = both.agg(F.count(F.lit(1)).alias("n_common"), F.count_distinct("cluster").alias("n_clusters")).where(F.col("n_common") >= least)
    cells = F.array(F.struct(F.lit("accumulation").alias("rep"), F.col("pa").alias("p")), F.struct(F.lit("dynamics").alias("rep"), F.col("pd").alias("p")))
    out = inference.contrasts(both.select("cluster", "y", F.inline(cells)), names=("auroc",))
    return out.select((-F.col("delta")).alias("dyn_minus_accum"), (-F.col("ci_hi")).alias("ci_lo"), (-F.col("ci_lo")).alias("ci_hi"), "p_value").crossJoin(F.broadcast(sizes))


# Evaluation

def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled_of(weekly(spark, sf_dir))


def modelled_of(panel: DataFrame) -> DataFrame:
    """All features and the labels of a panel."""
    own = signatures.add_signatures(panel).select(*KEYS, *OWN)
    return labels.label(panel).select(*KEYS, "y", "labelable").join(features.enrich(panel).drop("c", "r"), KEYS).join(own, KEYS)


_SCORES: dict[tuple[str, str], DataFrame] = {}


def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the five representations and the five rungs, by the offline learner.

    One table for all that is asked of it in an application: the fits are read again, not made again.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _SCORES:
        frame = materialised(modelled(spark, sf_dir), "modelled")
        sets = catalogue.representations(DOMAIN, OWN) | catalogue.ladder(DOMAIN, OWN)
        _SCORES[key] = cut(comparator.with_cluster(evaluate.fit_predict_sets(frame, sets, [])).drop("seed", "fold"))
    return _SCORES[key]


def cut(df: DataFrame) -> DataFrame:
    """The rows without the plan that made them, which would be planned anew for each use."""
    return materialised(df, "scores")


def represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oof_scores(spark, sf_dir).where(F.col("rep").isin(list(catalogue.representations(DOMAIN, OWN))))


@query("v1_out_of_fold_scores")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(oof_scores(spark, sf_dir))


@query("v9_representation_contrasts")
def v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main result: raw_2col against enriched, planned, and the other pairs and metrics, over seeded draws of unit-years."""
    return judged(represented(spark, sf_dir), "raw_2col", "enriched")


@query("v10_ladder_dips")
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rungs in their order, and where one lies below the one before."""
    rungs = catalogue.ladder(DOMAIN, OWN)
    order = spark.createDataFrame([(i, k, len(v)) for i, (k, v) in enumerate(rungs.items())], "place int, rep string, n_features int")
    oof = oof_scores(spark, sf_dir).where(F.col("rep").isin(list(rungs)))
    scores = rounded(metrics.auroc(oof, ["rep"]).join(metrics.auprc(oof, ["rep"]), "rep"))
    return reporting.dips(order.join(scores, "rep", "left"), [], "place", "auroc")


def delong_pairs(oof: DataFrame, by: list[str]) -> DataFrame:
    """``*by, a, b_rep, auc1, auc2, z, p_value``: DeLong's test of each pair of representations on the rows both score."""
    one = oof.select(*KEYS, F.col("rep").alias("a"), "y", F.col("p").alias("p1"))
    other = oof.select(*KEYS, F.col("rep").alias("b_rep"), F.col("p").alias("p2"))
    return metrics.delong(one.join(other, KEYS).where("a < b_rep"), [*by, "a", "b_rep"])


@query("v11_delong_raw_enriched")
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_2col against enriched by DeLong's test, in each unit, adjusted over units."""
    found = delong_pairs(represented(spark, sf_dir).where("rep IN ('raw_2col', 'enriched')"), ["unit"]).where("p_value IS NOT NULL")
    return rounded(metrics.benjamini_hochberg(found, ["a", "b_rep"], tie="unit"))


@query("v14_delong_pairs")
def v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten pairs of representations by DeLong's test on the pooled scores."""
    return rounded(delong_pairs(represented(spark, sf_dir), []))


@query("v12_enriched_calibration")
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.calibration(represented(spark, sf_dir).where("rep = 'enriched'"), ["rep"]))


@query("v15_comparator_contrasts")
def v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enriched against the trend forecast by AUROC and AUPRC, on the unit-weeks both score; none below 30 of them."""
    own = represented(spark, sf_dir).where("rep = 'enriched'").select("cluster", "wn", "y", F.col("p").alias("pe"))
    trend = comparator.with_cluster(comparator.trend_scores(labels.label(weekly(spark, sf_dir)))).where("score IS NOT NULL").select("cluster", "wn", F.col("score").alias("pt"))
    both = materialised(own.join(trend, ["cluster", "wn"]), "common")
    enough = both.agg(F.count(F.lit(1)).alias("n_common")).where("n_common >= 30")
    cells = F.array(F.struct(F.lit("enriched").alias("rep"), F.col("pe").alias("p")), F.struct(F.lit("trend").alias("rep"), F.col("pt").alias("p")))
    found = rounded(inference.contrasts(both.select("cluster", "y", F.inline(cells)), names=("auroc", "auprc")))
    return found.crossJoin(F.broadcast(enough))


@query("v13_seed_stability")
def v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lift of enriched over raw_2col under five seeds of the training sample: mean and deviation."""
    sets = catalogue.representations(DOMAIN, OWN)
    oof = evaluate.fit_predict_sets(materialised(modelled(spark, sf_dir), "modelled"), {k: sets[k] for k in ("raw_2col", "enriched")}, [], seeds=tuple(range(SEEDS)))
    return rounded(inference.stability(inference.lifts(oof, "raw_2col", "enriched"), ["measure"], "value"))


SQL_MEDIAN = f"""WITH {sql.features()}, {sql.placed()}, lab AS (SELECT unit, yr, wn, y, case_lag4, labelable FROM enriched JOIN limb USING (unit, yr, wn)),
years AS (SELECT yr AS fold FROM (SELECT yr, row_number() OVER (ORDER BY yr) AS n FROM (SELECT DISTINCT yr FROM lab WHERE labelable = 1)) WHERE n > 2),
m AS (SELECT fold, median(case_lag4) AS m FROM lab JOIN years ON yr < fold WHERE labelable = 1 GROUP BY fold)
SELECT unit, yr, wn, fold, round(coalesce(case_lag4, m), 6) + 0 AS case_lag4 FROM lab JOIN years ON yr <= fold JOIN m USING (fold) WHERE labelable = 1"""


@query("v2_median_imputer", SQL_MEDIAN)
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = evaluate.folds(modelled(spark, sf_dir).select(*KEYS, "y", "labelable", "case_lag4"))
    return rounded(evaluate.impute_medians(folded, ["case_lag4"], []).select(*KEYS, "fold", "case_lag4"))


@query("v3_rank_gaussian")
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = evaluate.folds(modelled(spark, sf_dir).select(*KEYS, "y", "labelable", "case_mean4"))
    return rounded(evaluate.rank_gaussian(folded, "case_mean4", []).select(*KEYS, "fold", "case_mean4", "case_mean4_g"))


@query("v4_fold_years", f"WITH {sql.panel()}, {sql.placed()} SELECT yr AS fold FROM (SELECT yr, row_number() OVER (ORDER BY yr) AS n FROM (SELECT DISTINCT yr FROM limb WHERE labelable = 1)) WHERE n > 2")
def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fold_years(labels.label(weekly(spark, sf_dir)))


# The nearest rising levels as the greatest of the least means of neighbouring scores.
SQL["v5_recalibrated"] = f"""WITH {sql.long_scores()}, places AS (SELECT rep, round(p, 6) AS s, sum(y) AS y, count(*) AS n FROM oof GROUP BY ALL), sums AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY s) AS i FROM places),
upto AS (SELECT rep, s, i, y, n, sum(y) OVER w AS ty, sum(n) OVER w AS tn FROM sums WINDOW w AS (PARTITION BY rep ORDER BY i)),
spans AS (SELECT a.rep, a.i AS lo, b.i AS hi, (b.ty - a.ty + a.y) * 1.0 / (b.tn - a.tn + a.n) AS mean FROM upto a JOIN upto b ON a.rep = b.rep AND a.i <= b.i),
least_means AS (SELECT rep, lo, hi, min(mean) OVER (PARTITION BY rep, lo ORDER BY hi DESC) AS low FROM spans),
levels AS (SELECT rep, hi AS i, max(low) AS level FROM least_means GROUP BY ALL)
SELECT unit, yr, wn, cluster, oof.y, oof.rep, round(level, 6) + 0 AS p FROM oof JOIN sums k ON oof.rep = k.rep AND round(p, 6) = s JOIN levels ON levels.rep = k.rep AND levels.i = k.i"""


@query("v5_recalibrated")
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.recalibrated(long_scores(spark, sf_dir), ["rep"]))


@query("v7_summary", f"WITH {sql.long_scores()}, a AS ({sql.weighted_auroc(_ONES, 'rep', 'one')}) SELECT rep, count(*) AS n_test, round(avg(y), 6) + 0 AS base_rate, round(any_value(auroc), 6) + 0 AS auroc, round(any_value(auprc), 6) + 0 AS auprc, round(avg((p - y) * (p - y)), 6) + 0 AS brier FROM oof JOIN a USING (rep) JOIN ({sql.average_precision('oof', 'rep')}) USING (rep) GROUP BY rep")
def v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.summarise(long_scores(spark, sf_dir), ["rep"]).select("rep", "n_test", "base_rate", "auroc", "auprc", "brier"))


def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of models of each unit alone, over all features."""
    frame = materialised(modelled(spark, sf_dir), "modelled")
    oof = evaluate.fit_predict_sets(frame, {"enriched": [*DOMAIN, *OWN]}, ["unit"])
    return cut(comparator.with_cluster(oof.drop("seed", "fold", "rep")))


def unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof = unit_scores(spark, sf_dir)
    judged_units = inference.unit_intervals(oof, ["unit"])
    rows = evaluate.summarise(oof, ["unit"]).withColumn("n_features", F.lit(len(DOMAIN) + len(OWN))).join(judged_units, "unit", "left")
    return cut(reporting.by_climate(rows.select("*", F.coalesce("n_clusters", F.lit(0)).alias("n_year_clusters")).drop("n_clusters"), climates(spark)))


@query("v8_unit_evaluation")
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold loop inside each unit over all features: metrics, interval over the unit's years, and climate type."""
    return rounded(unit_metrics(spark, sf_dir))


@query("v16_climate_gradient")
def v16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kruskal-Wallis of the units' AUROC over climate types, with the types' means and sizes."""
    units = unit_metrics(spark, sf_dir).select("auroc", "climate_type", F.lit("auroc").alias("measure"))
    test = metrics.kruskal(units, ["measure"], "auroc", "climate_type")
    return rounded(metrics.group_means(units, ["measure"], "auroc", "climate_type").join(test, "measure", "left"))


# Reporting

@query("g1_stars", f"WITH c AS ({SQL['b2_paired_bootstrap']}) SELECT a, b_rep, p_value, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars FROM c")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b2(spark, sf_dir).select("a", "b_rep", "p_value", reporting.stars(F.col("p_value")).alias("stars"))


@query("g2_dips", f"WITH {sql.long_scores()}, a AS ({sql.weighted_auroc(_ONES, 'rep', 'one')}), r AS (SELECT rep, round(auroc, 6) + 0 AS auroc FROM a) SELECT rep, auroc, coalesce(auroc < lag(auroc) OVER (ORDER BY rep), false) AS dip FROM r")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.dips(rounded(metrics.auroc(long_scores(spark, sf_dir), ["rep"])), [], "rep", "auroc")


# Sixteen features, as SQL is held against them; g7 ranks all.
_ATTRIBUTED = ["case_lag1", "case_lag4", "case_mean2", "case_mean8", "case_max4", "case_min4", "case_cumyear", "weeks_into_year", "case_sum52", "inter_epidemic_interval", "case_delta", "case_woy_mean", "case_lag12", "case_lag16", "case_max12", "case_min12"]
_TALL = " UNION ALL ".join(f"SELECT '{c}' AS feature, y, {c} AS p, 1 AS one FROM e" for c in _ATTRIBUTED)


@query("g3_attribution", f"WITH {sql.features()}, {sql.placed()}, e AS (SELECT y, enriched.* FROM enriched JOIN limb USING (unit, yr, wn) WHERE labelable = 1), tall AS ({_TALL}) SELECT feature, round(abs(auroc - 0.5), 9) + 0 AS importance FROM ({sql.weighted_auroc('tall', 'feature', 'one')}) WHERE auroc IS NOT NULL ORDER BY importance DESC, feature LIMIT 14")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modelled(spark, sf_dir).where("labelable = 1")
    return reporting.attribution(rows, _ATTRIBUTED).drop("family")


@query("g7_attribution_all")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 first of all 132 features; tests hold it against numpy."""
    rows = modelled(spark, sf_dir).where("labelable = 1")
    return reporting.attribution(rows, [*DOMAIN, *OWN])


@query("g8_permutation_attribution")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 first of all 132 features by what trees lose without them; tests hold it against numpy."""
    return forest.predictive_attribution(materialised(modelled(spark, sf_dir), "modelled"), [*DOMAIN, *OWN])


@query("g4_by_climate", f"""WITH {sql.long_scores()}, {_CLIMATES}, u AS (SELECT unit, round(auroc, 6) + 0 AS auroc FROM ({sql.weighted_auroc("(SELECT *, 1 AS one FROM oof WHERE rep = 'mean')", 'unit', 'one')}))
SELECT unit, auroc, coalesce(climate_type, 'NA') AS climate_type, round(avg(auroc) OVER (PARTITION BY coalesce(climate_type, 'NA')), 6) + 0 AS type_mean FROM u LEFT JOIN climates USING (unit)""")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = rounded(metrics.auroc(long_scores(spark, sf_dir).where("rep = 'mean'"), ["unit"]))
    return rounded(reporting.by_climate(units, climates(spark)))


_CUTS = " ".join(f"WHEN {n} THEN quantile_cont(p, [{', '.join(repr(i / n) for i in range(1, n))}])" for n in range(3, 11))


@query("g5_reliability", f"""WITH {sql.long_scores()}, e AS (SELECT rep, CASE least(10, greatest(3, count(DISTINCT p))) {_CUTS} END AS q FROM oof GROUP BY rep),
b AS (SELECT rep, p, y, CAST(len(list_filter(q, lambda t: t < p)) AS INTEGER) AS bin FROM oof JOIN e USING (rep))
SELECT rep, bin, count(*) AS n, round(avg(p), 6) + 0 AS mean_score, round(avg(y), 6) + 0 AS rate FROM b GROUP BY ALL""")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reporting.reliability(long_scores(spark, sf_dir), ["rep"]))


@query("g6_separation", f"WITH {sql.long_scores()}, b AS (SELECT rep, y, CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM oof GROUP BY ALL) SELECT rep, y, bin, n, round(n * 20.0 / sum(n) OVER (PARTITION BY rep, y), 6) + 0 AS density FROM b")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reporting.separation(long_scores(spark, sf_dir), ["rep"]))


# A run's tables, written and read again


@query("io7_enriched_saved", SQL["e43_enriched"])
def io7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched panel as CSV, read with its schema."""
    frame, path = enriched(spark, sf_dir), new_folder(spark, "enriched")
    source.write_table(frame, path, "csv")
    return source.read_table(spark, path, "csv", frame.schema)


@query("io8_dictionary_saved", SQL["p3_feature_dictionary"])
def io8(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, path = p3(spark, sf_dir), new_folder(spark, "dictionary")
    source.write_table(frame, path, "csv")
    return source.read_table(spark, path, "csv", frame.schema)


@query("io9_predictions_saved", f"WITH {sql.long_scores()} SELECT unit, yr, wn, cluster, y, rep, round(p, 6) + 0 AS p FROM oof")
def io9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in a folder for each representation, all read again."""
    frame, path = rounded(long_scores(spark, sf_dir)), new_folder(spark, "predictions")
    source.write_table(frame, path, by=["rep"])
    return source.read_table(spark, path).select(*frame.columns)


@query("io10_summary_saved", SQL["v7_summary"])
def io10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested record of a run as JSON; its summary is read again."""
    summary, sizes = v7(spark, sf_dir), rounded(metrics.brier(long_scores(spark, sf_dir), ["rep", "unit"]))
    whole, path = source.record({"summary": summary, "units": sizes}), new_folder(spark, "record")
    source.write_table(whole, path, "json")
    return source.read_table(spark, path, "json", whole.schema).select(F.inline("summary"))


@query("io11_unit_metrics_saved", SQL["m1_auroc"])
def io11(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, path = rounded(metrics.auroc(long_scores(spark, sf_dir), ["rep", "unit"])), new_folder(spark, "units")
    source.write_table(frame, path, "csv")
    return source.read_table(spark, path, "csv", frame.schema)


def oracle_sql() -> dict[str, str]:
    return {name: sql.settled(text) for name, text in SQL.items()}
