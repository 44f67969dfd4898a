"""The panel queries against their SQL, and properties of the metrics."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidewater.operators import evaluate, inference, metrics, trigger
from tidewater.plans import queries
from tidewater.sources import panel as source

#: One query of each family; the slow ones are left to the driver.
SOME = ["entry_slice", "e21_wet_run", "e25_ac1", "e33_rain_pct_unit", "e37_skew12", "e40_inter_epidemic", "e43_enriched", "c_signatures_rain", "f1_drop_flagged_years", "j1_features_join_labels", "l3_label_limb", "l4_label_prepeak", "m1_auroc", "m2_auprc", "m4_ece", "m9_delong", "m10_fdr", "t2_trend_score", "r3_rain_features", "r6_onset_targets", "f4_fold_rows", "g5_reliability", "m11_kruskal", "t4_trend_auroc", "v7_summary", "v5_recalibrated", "r1_constant_latch", "r11_unit_rows"]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 5) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), columns)


def test_auroc_is_the_share_of_ordered_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(y), float(p)) for g in "ab" for y, p in zip(rng.integers(0, 2, 80), rng.integers(0, 9, 80) / 10, strict=True)]
    got = {r["g"]: r["auroc"] for r in metrics.auroc(spark.createDataFrame(rows, "g string, y int, p double"), ["g"]).collect()}
    for g in "ab":
        up, down = [p for k, y, p in rows if k == g and y], [p for k, y, p in rows if k == g and not y]
        assert got[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in up for b in down]))


def area(y, p, w):
    """AUROC of rows that count ``w`` times."""
    up, down = w * (y == 1), w * (y == 0)
    total = up.sum() * down.sum()
    if not total:
        return math.nan
    marks, at = np.unique(p, return_inverse=True)
    u, d = np.bincount(at, up, len(marks)), np.bincount(at, down, len(marks))
    return float((u * (np.cumsum(d) - d / 2)).sum() / total)


@pytest.fixture(scope="module")
def redrawn(spark, sf):
    """{rep: (AUROC, AUROC under each of the 2000 draws of clusters)}"""
    rows = queries.long_scores(spark, sf).select("rep", "cluster", "y", "p").toPandas()
    names = sorted(set(rows["cluster"]))
    mult = redraw(len(names))
    out = {}
    for rep, g in rows.groupby("rep"):
        place, y, p = np.searchsorted(names, g["cluster"]), g["y"].to_numpy(), g["p"].to_numpy(float)
        out[rep] = area(y, p, np.ones(len(g))), np.array([area(y, p, m[place]) for m in mult])
    return out


def redraw(n):
    """Multiplicities of 2000 draws, 250 of a stream."""
    streams = [np.random.default_rng([0, block]) for block in range(8)]
    return [np.bincount(rng.integers(0, n, n), minlength=n) for rng in streams for _ in range(250)]


def test_numpy_draws(spark, sf, redrawn):
    got = {r["rep"]: r for r in queries.QUERIES["b7_numpy_draws"](spark, sf).collect()}
    assert set(got) == set(redrawn)
    for rep, (point, reps) in redrawn.items():
        assert (got[rep]["auroc"], got[rep]["ci_lo"], got[rep]["ci_hi"]) == pytest.approx((point, *np.nanpercentile(reps, [2.5, 97.5])), abs=2e-6)
    spread = {r["rep"]: r for r in queries.QUERIES["b11_drawn_stability"](spark, sf).collect()}
    for rep, (_, reps) in redrawn.items():
        assert (spread[rep]["mean"], spread[rep]["sd"]) == pytest.approx((np.nanmean(reps), np.nanstd(reps, ddof=1)), abs=2e-6)


def test_drawn_contrasts(spark, sf, redrawn):
    found = queries.QUERIES["b9_drawn_contrasts"](spark, sf).collect()
    assert {r["metric"] for r in found} == {"auroc", "auprc", "brier"} and len(found) == 9
    got = {(r["a"], r["b_rep"]): r for r in found if r["metric"] == "auroc"}
    assert set(got) == {("level", "mean"), ("level", "season"), ("mean", "season")}
    for (a, b), r in got.items():
        d = redrawn[a][1] - redrawn[b][1]
        d = d[~np.isnan(d)]
        p = min(1, 2 * min((d > 1e-12).mean(), (d < -1e-12).mean()) + 1 / (len(d) + 1))
        assert len(d) > 1000
        assert (r["delta"], r["ci_lo"], r["ci_hi"]) == pytest.approx((redrawn[a][0] - redrawn[b][0], *np.percentile(d, [2.5, 97.5])), abs=2e-6)
        assert r["p_value"] == pytest.approx(p, abs=2e-3)
        assert r["stars"] == ("***" if r["p_value"] < 0.001 else "**" if r["p_value"] < 0.01 else "*" if r["p_value"] < 0.05 else "")
    assert [(r["a"], r["b_rep"], r["metric"]) for r in found if r["family"] == "confirmatory"] == [("level", "mean", "auroc")]


def test_units_draw_their_own_years(spark, sf):
    rows = queries.long_scores(spark, sf).select("rep", "unit", "cluster", "y", "p").toPandas()
    got = {(r["rep"], r["unit"]): r for r in queries.QUERIES["b10_drawn_beats_chance"](spark, sf).collect()}
    (rep, unit), g = next(iter(rows.groupby(["rep", "unit"])))
    names = sorted(set(g["cluster"]))
    place = np.searchsorted(names, g["cluster"])
    ends = np.nanpercentile([area(g["y"].to_numpy(), g["p"].to_numpy(float), m[place]) for m in redraw(len(names))], [2.5, 97.5])
    assert (got[rep, unit]["ci_lo"], got[rep, unit]["ci_hi"]) == pytest.approx(tuple(ends), abs=2e-6)


def test_replicates_that_set_no_floor(spark):
    """A clear contrast gets all its stars: 40 replicates can't go below 0.0244."""
    rows = [(f"u-{k}", rep, i % 2, float(i % 2 if rep == "a" else -(i % 2))) for k in range(8) for rep in "ab" for i in range(6)]
    oof = spark.createDataFrame(rows, "cluster string, rep string, y int, p double")
    (r,) = queries.judged(oof, "a", "b", ("auroc",)).collect()
    assert r["p_value"] == pytest.approx(1 / 2001, abs=1e-6) and r["stars"] == "***"


def test_attribution_ranks_all_features(spark, sf):
    panel = queries.weekly(spark, sf)
    joined = queries.features.enrich(panel).drop("c", "r").join(queries.signatures.add_signatures(panel).drop("c", "r"), queries.KEYS).join(queries.labels.label(panel).select(*queries.KEYS, "y", "labelable"), queries.KEYS)
    rows = joined.where("labelable = 1").toPandas()
    columns = [*queries.DOMAIN, *queries.OWN]
    assert len(set(columns)) == 132
    want = {}
    for c in columns:
        x = rows[c].to_numpy(float)
        known = ~np.isnan(x)
        a = area(rows["y"].to_numpy()[known], x[known], np.ones(known.sum()))
        if not math.isnan(a):
            want[c] = round(abs(a - 0.5), 9)
    got = {r["feature"]: r["importance"] for r in queries.QUERIES["g7_attribution_all"](spark, sf).collect()}
    assert len(got) == 14
    assert sorted(got.values(), reverse=True) == pytest.approx(sorted(want.values(), reverse=True)[:14], abs=1e-8)
    assert all(v == pytest.approx(want[c], abs=1e-8) for c, v in got.items())
    assert not set(got) <= set(queries._ATTRIBUTED)


@pytest.fixture(scope="module")
def out_of_fold(spark, sf):
    return queries.oof_scores(spark, sf).toPandas()


def test_all_representations_and_rungs_are_scored(spark, sf, out_of_fold):
    from tidewater.operators import catalogue

    sets = catalogue.representations(queries.DOMAIN, queries.OWN), catalogue.ladder(queries.DOMAIN, queries.OWN)
    assert set(out_of_fold["rep"]) == {*sets[0], *sets[1]} and len(sets[0]) == len(sets[1]) == 5
    assert out_of_fold["p"].between(0, 1).all()
    assert out_of_fold.groupby("rep").size().nunique() == 1
    assert not out_of_fold.duplicated(["rep", *queries.KEYS]).any()
    wide = out_of_fold.pivot(index=queries.KEYS, columns="rep", values="p")
    assert np.allclose(wide["raw_2col"], wide["raw 2 cols"]) and np.allclose(wide["enriched"], wide["+ catch22"])
    assert not np.allclose(wide["enriched"], wide["domain_only"])


def test_ladder_dips(spark, sf, out_of_fold):
    rungs = ["raw 2 cols", "+ case views", "+ climate", "+ transmission biology", "+ catch22"]
    want = [area(g["y"].to_numpy(), g["p"].to_numpy(), np.ones(len(g))) for g in (out_of_fold[out_of_fold["rep"] == r] for r in rungs)]
    got = sorted(queries.QUERIES["v10_ladder_dips"](spark, sf).collect(), key=lambda r: r["place"])
    assert [r["rep"] for r in got] == rungs
    assert [r["auroc"] for r in got] == pytest.approx(want, abs=2e-6)
    assert [r["dip"] for r in got] == [False, *(b < a for a, b in zip(want, want[1:]))]


def test_main_contrast(spark, sf, out_of_fold):
    found = queries.QUERIES["v9_representation_contrasts"](spark, sf).collect()
    got = {(r["a"], r["b_rep"]): r for r in found if r["metric"] == "auroc"}
    assert len(got) == 10 and len(found) == 30
    names = sorted(set(out_of_fold["cluster"]))
    mult = redraw(len(names))
    one = lambda g, m: area(g["y"].to_numpy(), g["p"].to_numpy(), m[np.searchsorted(names, g["cluster"])])
    e, r = (out_of_fold[out_of_fold["rep"] == k] for k in ("enriched", "raw_2col"))
    d = np.array([one(e, m) - one(r, m) for m in mult])
    d, main = d[~np.isnan(d)], got["enriched", "raw_2col"]
    ones = np.ones(len(names))
    assert main["family"] == "confirmatory" and main["p_adjusted"] == main["p_value"]
    assert (main["delta"], main["ci_lo"], main["ci_hi"]) == pytest.approx((one(e, ones) - one(r, ones), *np.percentile(d, [2.5, 97.5])), abs=2e-6)
    assert sum(x["family"] == "exploratory" for x in found) == 29


def test_distributions_against_the_library(spark):
    from statistics import NormalDist

    ps = [1e-7, 1e-4, 0.01, 0.0242, 0.0243, 0.2, 0.5, 0.77, 0.98, 0.999999]
    got = [r["z"] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(evaluate.probit(queries.F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)
    zs = [0.0, 0.1, -1.0, 1.96, 3.3, -5.0]
    got = [r["p"] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(metrics.normal_p(queries.F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-6, abs=1e-9)
    # the upper tail of chi squared, by adding up the density
    for df in (1, 2, 3, 6, 7):
        x = np.linspace(0, 200, 2_000_001)[1:]
        density = x ** (df / 2 - 1) * np.exp(-x / 2) / (2 ** (df / 2) * math.gamma(df / 2))
        for h in (1.0, 4.5, 20.0):
            tail = np.trapezoid(density[x >= h], x[x >= h])
            got = spark.range(1).select(metrics.chi_squared_p(queries.F.lit(h), queries.F.lit(df)).alias("p")).first()["p"]
            assert got == pytest.approx(tail, abs=2e-5)


def normal_scores(train, values, quantiles):
    """Values as normal quantiles of the train values, by interpolation from both sides."""
    from statistics import NormalDist

    places = np.linspace(0, 1, min(quantiles, len(train)))
    marks = np.quantile(train, places)
    up, down = np.interp(values, marks, places), 1 - np.interp(-values, -marks[::-1], places)
    out = np.where(values >= marks[-1], 1, np.where(values <= marks[0], 0, (up + down) / 2))
    return [NormalDist().inv_cdf(p) for p in out.clip(1e-7, 1 - 1e-7)]


@pytest.mark.parametrize("quantiles", [1000, 11])
def test_rank_gaussian(spark, quantiles):
    rng = np.random.default_rng(2)
    rows = [("u", 1, i, 0, 5, float(v)) for i, v in enumerate(rng.integers(0, 40, 60))] + [("u", 2, i, 1, 5, float(v)) for i, v in enumerate(np.r_[-5.0, 50.0, rng.random(30) * 40])] + [("u", 2, 99, 1, 5, None)]
    df = spark.createDataFrame(rows, "unit string, yr int, wn int, is_test int, fold int, x double")
    got = {(r["yr"], r["wn"]): r["x_g"] for r in evaluate.rank_gaussian(df, "x", [], quantiles).collect()}
    train = np.array([r[5] for r in rows if not r[3]])
    known = [r for r in rows if r[5] is not None]
    want = normal_scores(train, np.array([r[5] for r in known]), quantiles)
    assert [got[r[1], r[2]] for r in known] == pytest.approx(want, abs=1e-6)
    assert got[2, 99] is None


def test_steps_are_the_nearest_rising_ones():
    rng = np.random.default_rng(4)
    for _ in range(20):
        p, y = rng.integers(0, 12, 40) / 12, rng.integers(0, 2, 40).astype(float)
        points, levels = evaluate.steps(p, y)
        assert (np.diff(levels) >= 0).all()
        means = [y[p <= points[j]][np.isin(p[p <= points[j]], points[i:])].mean() for i in range(len(points)) for j in range(i, len(points))]
        table = iter(means)
        grid = {(i, j): next(table) for i in range(len(points)) for j in range(i, len(points))}
        n = len(points)
        want = [max(min(grid[i, j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert levels == pytest.approx(want)


def test_running_sums_by_ranges(spark):
    rng = np.random.default_rng(5)
    # a group of one value, one of many, a null group, a null value, and a value that a third of the rows hold
    rows = [("one", 0.5, 1.0)] + [("many", float(v), float(v % 7)) for v in rng.permutation(900)] + [(None, float(v), 1.0) for v in range(10)] + [("many", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double, n double")
    want = {tuple(r) for r in metrics.running(df, ["g"], "v", ["n"], ranges=1).collect()}
    assert len(want) == len(rows)
    for ranges in (2, 64, 2000):
        assert {tuple(r) for r in metrics.running(df, ["g"], "v", ["n"], ranges=ranges).collect()} == want
    plain = spark.createDataFrame([(r[1], r[2]) for r in rows], "v double, n double")
    assert {tuple(r) for r in metrics.running(plain, [], "v", ["n"]).collect()} == {tuple(r) for r in metrics.running(plain, [], "v", ["n"], ranges=1).collect()}
    assert metrics.running(df.limit(0), ["g"], "v", ["n"]).count() == 0


def test_midranks_with_a_hot_value(spark):
    values = [3.0] * 40 + [float(v) for v in range(50)] + [49.0] * 20
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    got = {r["v"]: (r["midrank"], r["_ties"]) for r in metrics.with_midrank(df, ["g"], "v").collect()}
    assert got == {v: (sum(w < v for w in values) + (values.count(v) + 1) / 2, values.count(v)) for v in set(values)}
    assert metrics.with_midrank(df, ["g"], "v").count() == len(values)


def test_delong_against_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [("a", int(rng.random() < 0.4), float(rng.integers(0, 12)), float(rng.integers(0, 5))) for _ in range(150)]
    got = metrics.delong(spark.createDataFrame(rows, "g string, y int, p1 double, p2 double"), ["g"]).first()
    y = np.array([r[1] for r in rows])
    variance, areas = 0.0, []
    places = []
    for k in (2, 3):
        p = np.array([r[k] for r in rows])
        beyond = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
        places.append((beyond.mean(1), beyond.mean(0)))
        areas.append(beyond.mean())
    for a, b in zip(*places, strict=True):
        variance += np.var(a - b, ddof=1) / len(a)
    assert np.allclose([got["auc1"], got["auc2"], got["z"]], [*areas, (areas[0] - areas[1]) / variance**0.5])


def test_folds_without_a_positive_of_their_own_stay(spark):
    rows = [("u", y, w, int(w == 1 and y != 4), 1) for y in range(1, 6) for w in range(3)]
    got = {(r["fold"], r["is_test"]): r["count"] for r in evaluate.folds(spark.createDataFrame(rows, "unit string, yr int, wn int, y int, labelable int")).groupBy("fold", "is_test").count().collect()}
    assert got == {(f, t): 3 if t else 3 * (f - 1) for f in (3, 4, 5) for t in (0, 1)}


def test_cox_against_a_direct_solution(spark):
    rng = np.random.default_rng(6)
    p = rng.random(300).clip(0.02, 0.98)
    y = (rng.random(300) < p**1.5).astype(int)
    got = inference.cox(spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(p, y, strict=True)], "g string, p double, y int"), ["g"]).first()
    x = np.stack([np.ones(300), np.log(p / (1 - p))])
    fit = 1 / (1 + np.exp(-np.array([got["cox_intercept"], got["cox_slope"]]) @ x))
    assert np.abs(x @ (y - fit)).max() < 1e-6  # the score equations hold


def test_latch_against_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = [("u", y, w, float(c), 0.0) for y in (1, 2, 3) for w, c in enumerate(np.abs(rng.normal(10, 6, 52) + 12 * np.sin(np.arange(52) / 6)))]
    got = {(r["yr"], r["wn"]): r["ta"] for r in trigger.constant_latch(spark.createDataFrame(rows, "unit string, yr int, wn int, c double, r double")).collect()}
    on, base, year = False, None, None
    for i, (_, y, w, *_) in enumerate(rows):
        if y != year:
            on, year = False, y
        c = [r[3] for r in rows]
        if i >= 31:
            short, long = np.mean(c[i - 3 : i + 1]), np.mean(c[i - 31 : i - 5])
            if not on:
                base = long
            on = bool(base > 0 and (short / base >= 0.73 if on else short / base >= 1.33))
        assert got[y, w] == int(on and i >= 31), (y, w)
    assert len(set(got.values())) == 2


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_sources_and_sinks(spark, tmp_path, kind):
    raw = spark.createDataFrame([("a", 2001, 3, 4.0, float("nan"), 0), ("b", 2001, 4, float("inf"), 2.5, 1)], "REGION string, YR int, WN int, CASE double, RF double, FLAG int")
    rain = source.first_column(raw.columns, prefix="RF")
    scale = source.Scale(unit=("REGION",), year="YR", week="WN", count="CASE", rain=rain)
    panel = source.panel_of(raw, scale)
    source.write_table(panel, f"{tmp_path}/p", kind)
    want = [("a", 2001, 3, 4.0, None), ("b", 2001, 4, None, 2.5)]
    assert sorted(tuple(r[c] for c in ("unit", "yr", "wn", "c", "r")) for r in source.read_panel(spark, f"{tmp_path}/p", kind).collect()) == want
    assert source.panel_of(raw, source.Scale((), "YR", "WN", "CASE", "RF")).first()["unit"] == "ALL"
    assert source.first_column(["x", "RF_B", "RF_A"], "RF_A", "RF_B") == "RF_A"
    # units' metrics, and scores in a folder for each representation
    scores = spark.createDataFrame([("raw", "a", 0.5), ("all", "a", 0.25)], "rep string, unit string, p double")
    source.write_table(scores, f"{tmp_path}/s", kind, by=["rep"])
    back = source.read_table(spark, f"{tmp_path}/s", kind, "unit string, p double, rep string")
    assert sorted((r["rep"], r["unit"], r["p"]) for r in back.collect()) == [("all", "a", 0.25), ("raw", "a", 0.5)]


def test_nested_record(spark, tmp_path):
    one, two = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "rep string, auroc double"), spark.createDataFrame([(3,)], "n int")
    source.write_table(source.record({"summary": one, "sizes": two}), f"{tmp_path}/r", "json")
    back = source.read_table(spark, f"{tmp_path}/r", "json", "summary array<struct<rep: string, auroc: double>>, sizes array<struct<n: int>>").collect()
    assert [[tuple(x) for x in back[0]["summary"]], back[0]["sizes"][0]["n"]] == [[("a", 1.0), ("b", 2.0)], 3]
    with pytest.raises(ValueError):
        source.read_table(spark, f"{tmp_path}/r", "json")


def test_what_was_materialised_can_be_cleared(spark, tmp_path, monkeypatch):
    from tidewater import session

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    assert session.materialised(spark.range(5), "five").count() == 5 and list(tmp_path.glob("panel/*/five-*"))
    session.clear(spark)
    assert not list(tmp_path.glob("panel/*"))
