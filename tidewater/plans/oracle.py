"""SQL for the queries, to be run by another engine on the same tables."""

from __future__ import annotations

SEASON = "PARTITION BY unit, yr ORDER BY wn"
WEEK = "PARTITION BY unit, wn ORDER BY yr"
HISTORY = "PARTITION BY unit ORDER BY yr, wn"


def over(partition: str, start: int | None = None, end: int = 0) -> str:
    """A window of rows; ``start`` None is unbounded."""
    low = "UNBOUNDED PRECEDING" if start is None else f"{-start} PRECEDING" if start else "CURRENT ROW"
    high = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"OVER ({partition} ROWS BETWEEN {low} AND {high})"


def settled(text: str) -> str:
    """Results rounded as ``rounded`` does it: a nudge before each last rounding."""
    return text.replace(", 6) + 0", " + 1.37e-9, 6) + 0").replace(", 5) + 0", " + 1.37e-8, 5) + 0")


def panel(level: str = "region", scale: float = 20.0) -> str:
    name = "r_name" if level == "region" else "n_name"
    return f"""
cases AS (
  SELECT {name} AS unit, CAST(isoyear(o_orderdate) AS BIGINT) AS yr, CAST(week(o_orderdate) AS BIGINT) AS wn, CAST(count(*) AS DOUBLE) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
), shipped AS (
  SELECT {name} AS unit, CAST(isoyear(l_shipdate) AS BIGINT) AS yr, CAST(week(l_shipdate) AS BIGINT) AS wn, sum(l_quantity) / {scale} AS r
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
), panel AS (
  SELECT unit, yr, wn, c, r FROM cases LEFT JOIN shipped USING (unit, yr, wn)
)"""


def trailing(fn: str, x: str, w: int) -> str:
    return f"{fn}({x}) {over(SEASON, -(w - 1))}"


def _skew(x: str) -> str:
    w = over(SEASON, -11)
    return f"CASE WHEN count({x}) {w} >= 4 THEN CASE WHEN min({x}) {w} = max({x}) {w} THEN 0.0 ELSE skewness({x}) {w} END END"


def _ac1(x: str, b: str) -> str:
    w, q = over(SEASON, -11), over(SEASON, -10)
    both = f"CASE WHEN {x} IS NOT NULL AND {b} IS NOT NULL THEN "
    p, s = f"{both}{x} END", f"{both}{b} END"
    return f"CASE WHEN count({x}) {w} >= 4 THEN CASE WHEN min({x}) {w} = max({x}) {w} THEN 0.0 ELSE covar_pop({p}, {s}) {q} / nullif(stddev_pop({p}) {q} * stddev_pop({s}) {q}, 0) END END"


def _stages() -> list[dict[str, str]]:
    one: dict[str, str] = {}
    for n, x in (("case", "c"), ("rain", "r")):
        one |= {f"{n}_lag{k}": f"lag({x}, {k}) OVER ({SEASON})" for k in (1, 2, 3, 4, 6, 8, 10, 12, 16)}
        one[f"{n}_raw"] = x
        one |= {f"{n}_mean{w}": trailing("avg", x, w) for w in (2, 4, 8, 12, 26)}
        one |= {f"{n}_std{w}": trailing("stddev_samp", x, w) for w in (4, 8, 12)}
        early = over(SEASON, -31, -6)
        one[f"{n}_stalta"] = f"CASE WHEN count(*) {early} >= 4 AND avg({x}) {early} > 0 THEN avg({x}) {over(SEASON, -3)} / (avg({x}) {early}) END"
        one[f"{n}_delta"] = f"{x} - lag({x}) OVER ({SEASON})"
        one[f"{n}_woy_mean"] = f"avg({x}) {over(WEEK, None, -1)}"
        one[f"{n}_woy_std"] = f"stddev_samp({x}) {over(WEEK, None, -1)}"
        one[f"{n}_filled"] = f"last_value({x} IGNORE NULLS) {over(SEASON)}"
        one[f"{n}_before"] = f"lag({x}) OVER ({SEASON})"
        one[f"{n}_var12"] = f"CASE WHEN count({x}) {over(SEASON, -11)} >= 3 THEN var_samp({x}) {over(SEASON, -11)} END"
        one[f"{n}_skew12"] = _skew(x)
        one |= {f"{n}_max{w}": trailing("max", x, w) for w in (4, 12)} | {f"{n}_min{w}": trailing("min", x, w) for w in (4, 12)}
        one[f"log_{n}"] = f"ln(1 + CASE WHEN {x} < 0 THEN 0 ELSE {x} END)"
        one[f"{n}_cumyear"] = f"CASE WHEN {x} IS NOT NULL THEN sum({x}) {over(SEASON)} END"
    one |= {f"rain_sum{w}": trailing("sum", "r", w) for w in (2, 4, 8, 12, 26)} | {f"rain_accum{w}": trailing("sum", "r", w) for w in (4, 6, 8, 10, 12, 16)}
    one["rain_long52_mean"] = trailing("avg", "r", 52)
    one |= {f"{f}{k}": f"{f}(2 * pi() * {k} * wn / 52.0)" for f in ("sin", "cos") for k in (1, 2, 3)}
    one["weeks_into_year"] = f"CAST(row_number() OVER ({SEASON}) - 1 AS DOUBLE)"
    one["place"] = f"row_number() OVER ({HISTORY}) - 1"
    one["high"] = f"quantile_cont(c, 0.9) {over(HISTORY, None, -1)}"
    one["case_sum52"] = f"CASE WHEN count(c) {over(HISTORY, -51)} >= 8 THEN sum(c) {over(HISTORY, -51)} END"
    two: dict[str, str] = {}
    for n, x in (("case", "c"), ("rain", "r")):
        two[f"{n}_accel"] = f"{n}_delta - lag({n}_delta) OVER ({SEASON})"
        two[f"{n}_pct"] = f"{n}_filled / nullif(lag({n}_filled) OVER ({SEASON}), 0) - 1"
        two[f"{n}_woy_anom"] = f"{x} - {n}_woy_mean"
        two[f"{n}_woy_z"] = f"({x} - {n}_woy_mean) / nullif({n}_woy_std, 0)"
        two[f"{n}_ac1_12"] = _ac1(x, f"{n}_before")
    r8 = "rain_sum8"
    for k in (250, 350, 450, 550):
        z = f"-0.02 * ({r8} - {k})"
        two[f"rain_logistic_Rc{k}"] = f"1 / (1 + exp(CASE WHEN {z} < -50 THEN -50 WHEN {z} > 50 THEN 50 ELSE {z} END))"
    two["rain_hill_R8"] = f"{r8} * {r8} / ({r8} * {r8} + 160000.0)"
    two["rain_long26_anom"] = two["ix_enso_proxy"] = "rain_mean26 - rain_long52_mean"
    two["rain_12w_minus_woy"] = "rain_mean12 - rain_woy_mean"
    two["wet_season_flag"] = f"CASE WHEN {r8} > rain_mean26 * 8 THEN 1.0 ELSE 0.0 END::DOUBLE"
    two["rain8_x_sin1"], two["rain8_x_cos1"] = f"{r8} * sin1", f"{r8} * cos1"
    two["rain8_x_caseStalta"], two["caseLag1_x_rain8"] = f"{r8} * coalesce(case_stalta, 0)", f"{r8} * coalesce(case_lag1, 0)"
    two["case_over_rain8"] = f"c / nullif({r8} + 1, 0)"
    two["rain8_over_woy"] = f"{r8} / (abs(rain_woy_mean) + 1)"
    two["rain_pct_unit"] = f"CASE WHEN {r8} IS NOT NULL THEN (rank() OVER (PARTITION BY unit ORDER BY {r8} NULLS LAST) + (count(*) OVER (PARTITION BY unit, {r8}) - 1) / 2.0) / count({r8}) OVER (PARTITION BY unit) END"
    two["stalta_delta"] = f"case_stalta - lag(case_stalta) OVER ({SEASON})"
    two["rain_sum8_woy_anom"] = f"{r8} - avg({r8}) {over(WEEK, None, -1)}"
    two["hit"] = "CASE WHEN c >= high THEN place END"
    three = {
        "turn": f"CASE WHEN wet_season_flag <> lag(wet_season_flag) OVER ({SEASON}) THEN 1 ELSE 0 END",
        "inter_epidemic_interval": f"CAST(place - coalesce(max(hit) {over(HISTORY, None, -1)}, 0) AS DOUBLE)",
        "ix_rain_anom_ratio": "rain_woy_anom / (abs(rain_woy_mean) + 1)",
    }
    four = {"run": f"sum(turn) {over(SEASON)}", "susceptibility_proxy": "inter_epidemic_interval / (ln(1 + CASE WHEN case_sum52 < 0 THEN 0 ELSE case_sum52 END) + 1)"}
    five = {"wet_run_len": "row_number() OVER (PARTITION BY unit, yr, run ORDER BY wn) * wet_season_flag"}
    return [one, two, three, four, five]


def features(level: str = "region") -> str:
    """CTEs from the panel to ``enriched``, which has all features."""
    out, source = panel(level), "panel"
    for i, stage in enumerate(_stages(), 1):
        name = "enriched" if i == 5 else f"s{i}"
        out += f", {name} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in stage.items()) + f" FROM {source})"
        source = name
    return out


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)


def family(columns: list[str]) -> str:
    return f"WITH {features()} SELECT unit, yr, wn, {rounded(columns)} FROM enriched"


def placed() -> str:
    year = "PARTITION BY unit, yr"
    return f"""
p1 AS (SELECT *, row_number() OVER ({SEASON}) - 1 AS pos, max(c) OVER ({year}) AS top, count(*) OVER ({year}) AS weeks FROM panel),
p2 AS (SELECT *, coalesce(weeks >= 10 AND top > 0, false) AS fit, min(CASE WHEN c = top THEN pos END) OVER ({year}) AS peak FROM p1),
p3 AS (SELECT *, min(CASE WHEN pos <= peak THEN c END) OVER ({year}) AS low FROM p2),
p4 AS (SELECT *, min(CASE WHEN pos <= peak AND c = low THEN pos END) OVER ({year}) AS onset FROM p3),
limb AS (SELECT unit, yr, wn, c, r, CASE WHEN fit AND pos >= onset AND pos < peak THEN 1 ELSE 0 END AS y, CASE WHEN fit THEN 1 ELSE 0 END AS labelable FROM p4),
prepeak AS (SELECT unit, yr, wn, c, r, CASE WHEN fit AND peak - pos > 0 AND peak - pos <= 8 THEN 1 ELSE 0 END AS y, CASE WHEN fit AND pos < peak THEN 1 ELSE 0 END AS labelable FROM p4)"""


def scores() -> str:
    """A label and three scores: unit, yr, wn, cluster, y, p1 (share of the season's highest), p2, p3."""
    return f"""{panel()}, {placed()},
scored AS (
  SELECT unit, yr, wn, unit || '-' || yr AS cluster, y,
         round(c / (1 + max(c) OVER (PARTITION BY unit)), 1) AS p1,
         round(coalesce(avg(c) {over(SEASON, -3)} / (1 + max(c) OVER (PARTITION BY unit)), 0), 3) AS p2,
         round((0.5 + 0.5 * sin(wn / 8.0)), 3) AS p3
  FROM limb WHERE labelable = 1
)"""


def long_scores() -> str:
    return scores() + """,
oof AS (
  SELECT unit, yr, wn, cluster, y, 'level' AS rep, p1 AS p FROM scored UNION ALL
  SELECT unit, yr, wn, cluster, y, 'mean', p2 FROM scored UNION ALL
  SELECT unit, yr, wn, cluster, y, 'season', p3 FROM scored
)"""


def multiplicity(n: int) -> str:
    """Draws both engines share: (31 b + 17 * place of the cluster) mod 3."""
    return f"""
places AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS k FROM (SELECT DISTINCT cluster FROM oof)),
mult AS (SELECT b, cluster, (b * 31 + k * 17 + b * k) % 3 AS mult FROM places, range({n}) AS t(b)),
drawn AS (SELECT oof.*, b, mult FROM oof JOIN mult USING (cluster) WHERE mult > 0)"""


def weighted_auroc(source: str, by: str, w: str = "mult") -> str:
    return f"""SELECT {by}, sum(wp * (coalesce(below, 0) + wn / 2)) / nullif(sum(wp) * sum(wn), 0) AS auroc FROM (
  SELECT *, sum(wn) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (
    SELECT {by}, p, CAST(sum(CASE WHEN y = 1 THEN {w} ELSE 0 END) AS DOUBLE) AS wp, CAST(sum(CASE WHEN y = 0 THEN {w} ELSE 0 END) AS DOUBLE) AS wn FROM {source} WHERE p IS NOT NULL GROUP BY {by}, p)) GROUP BY {by}"""


def normal_p(z: str) -> str:
    """The same rational approximation as the operator's."""
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + {x} / 2))"
    poly = "0.17087277"
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({k} + {t} * {poly})"
    return f"{t} * exp({poly} - {x} * {x})"


SIGNATURE_NAMES = ("mean", "std", "slope", "ac1", "acf_first_zero", "prop_above_mean", "longest_run_above_mean", "n_local_max", "iqr", "skew", "trend_resid_std", "recent_over_old")


def signatures(series: str = "c", suffix: str = "case") -> str:
    w = over(HISTORY, -51)
    dot = lambda lag: f"list_sum(list_transform(range(1, n - {lag} + 1), lambda i: d[i] * d[i + {lag}]))"
    return f"""WITH {panel()},
w0 AS (SELECT unit, yr, wn, list({series}) FILTER (WHERE {series} IS NOT NULL) {w} AS w, count({series}) {w} AS n, avg({series}) {w} AS m, stddev_pop({series}) {w} AS s,
  quantile_cont({series}, 0.75) {w} - quantile_cont({series}, 0.25) {w} AS q FROM panel),
w1 AS (SELECT *, list_transform(w, lambda x: x - m) AS d, list_sum(list_transform(range(1, n + 1), lambda i: w[i] * (i - 1 - (n - 1) / 2.0))) / (n * (n * n - 1) / 12.0) AS b FROM w0 WHERE n >= 12),
w2 AS (SELECT unit, yr, wn, m AS mean, s AS std, b AS slope, {dot(1)} / (list_sum(list_transform(d, lambda x: x * x)) + 1e-12) AS ac1,
  CAST(coalesce(list_filter(range(1, n), lambda lag: list_sum(list_transform(range(1, n - lag + 1), lambda i: d[i] * d[i + lag])) / (list_sum(list_transform(d, lambda x: x * x)) + 1e-12) <= 0)[1], 0) AS DOUBLE) AS acf_first_zero,
  len(list_filter(w, lambda x: x - m > 1e-9)) / CAST(n AS DOUBLE) AS prop_above_mean,
  CAST(coalesce(list_max(list_transform(string_split(array_to_string(list_transform(w, lambda x: CASE WHEN x - m > 1e-9 THEN '1' ELSE '0' END), ''), '0'), lambda t: len(t))), 0) AS DOUBLE) AS longest_run_above_mean,
  CAST(len(list_filter(range(2, n), lambda i: w[i] > w[i - 1] AND w[i] > w[i + 1])) AS DOUBLE) AS n_local_max, q AS iqr,
  list_sum(list_transform(d, lambda x: x * x * x)) / n / (s * s * s + 1e-12) AS skew,
  sqrt(list_sum(list_transform(range(1, n + 1), lambda i: pow(d[i] - b * (i - 1 - (n - 1) / 2.0), 2))) / n) AS trend_resid_std,
  (list_sum(list_transform(range(n - n // 2 + 1, n + 1), lambda i: w[i])) / (n // 2) + 1) / (list_sum(list_transform(range(1, n // 2 + 1), lambda i: w[i])) / (n // 2) + 1) AS recent_over_old FROM w1)
SELECT p.unit, p.yr, p.wn, """ + ", ".join(f"round({n}, 6) + 0 AS c22fb_{n}_{suffix}" for n in SIGNATURE_NAMES) + " FROM panel p LEFT JOIN w2 USING (unit, yr, wn)"


def average_precision(source: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN sum(wn) > 0 THEN sum(wp * tp / (tp + fp)) / nullif(sum(wp), 0) END AS auprc FROM (
  SELECT *, sum(wp) OVER w AS tp, sum(wn) OVER w AS fp FROM (SELECT {by}, p, sum(y) AS wp, sum(1 - y) AS wn FROM {source} GROUP BY ALL)
  WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY {by}"""


def chi_squared_p(x: str, df: str) -> str:
    """The upper tail of chi squared by its finite sums, for even and for odd degrees of freedom."""
    even = f"exp(-({x}) / 2) * list_sum(list_transform(range(0, ({df}) // 2), lambda k: pow(({x}) / 2, k) / gamma(k + 1)))"
    odd = f"{normal_p(f'sqrt({x})')} + exp(-({x}) / 2) * coalesce(list_sum(list_transform(range(0, (({df}) - 1) // 2), lambda k: pow(({x}) / 2, k + 0.5) / gamma(k + 1.5))), 0)"
    return f"CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END"


def known_values(domain: list[str], own: list[str]) -> str:
    """CTE ``known_values``: feature and n_known, over the panel's features and signatures."""
    counts = lambda columns: ", ".join(f"count({c}) AS {c}" for c in columns)
    one = f"SELECT {counts(domain)} FROM (WITH {features()} SELECT * FROM enriched)"
    parts = [f"SELECT {counts([c for c in own if c.endswith(s)])} FROM ({signatures(x, s)})" for x, s in (("c", "case"), ("r", "rain"))]
    tall = " UNION ALL ".join(f"SELECT feature, n_known FROM (UNPIVOT ({q}) ON COLUMNS(*) INTO NAME feature VALUE n_known)" for q in (one, *parts))
    return f"known_values AS ({tall})"


def dictionary(catalogue) -> str:
    """Source, rationale, family and rung of ``feature``, as the lists of name fragments say."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    holds = lambda words, x="feature": "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"
    starts = "(" + " OR ".join(f"starts_with(lower(feature), {text(w)})" for w in catalogue.CALENDAR_STARTS) + ")"
    source = f"CASE WHEN starts_with(lower(feature), 'c22') THEN 'catch22' WHEN {holds(catalogue.RAIN_WORDS, 'lower(feature)')} THEN 'rain' WHEN {starts} THEN 'calendar' ELSE 'case' END"
    rationale = "CASE " + " ".join(f"WHEN contains(feature, {text(k)}) THEN {text(v)}" for k, v in catalogue.RATIONALES.items()) + f" ELSE {text(catalogue.DEFAULT_RATIONALE)} END"
    biology, early = holds(catalogue.BIOLOGY_WORDS), f"CASE WHEN {holds(catalogue.TRANSMISSION_WORDS, 'lower(feature)')} THEN 'transmission' ELSE 'early-warning' END"
    family = f"CASE WHEN starts_with(lower(feature), 'c22') THEN 'catch22' WHEN {biology} THEN {early} WHEN {source} = 'rain' THEN 'climate' WHEN {source} = 'calendar' THEN 'season' ELSE 'case' END"
    rung = f"CASE WHEN {biology} THEN 'biology' WHEN {source} = 'case' THEN 'case_view' WHEN {source} IN ('rain', 'calendar') THEN 'climate' END"
    return f"SELECT feature, {source} AS source, {rationale} AS rationale, {family} AS family, {rung} AS ladder, n_known FROM known_values"
