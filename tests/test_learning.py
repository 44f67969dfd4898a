"""Boosted trees, samples of train rows and bootstraps against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_panel import area

from tidewater.operators import boosting, evaluate, inference, metrics, resampling
from tidewater.plans import queries

SMALL = boosting.Settings(rounds=6, leaves=5, least_rows=4, bins=1000)


def plain_trees(x, y, s):
    """Boosting the long way: every threshold of every column of every open leaf, no histograms."""
    medians = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else np.nan for c in x.T])
    x = np.where(np.isnan(x), medians, x)
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    raw, trees = np.zeros(len(y)), []

    def best(rows, g, h):
        found = []
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[rows, k] <= t
                a, b = rows[low], rows[~low]
                if min(len(a), len(b)) >= s.least_rows and min(h[a].sum(), h[b].sum()) >= s.least_curve:
                    found.append((g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum(), k, t))
        most = max((f[0] for f in found), default=0.0)
        return next(f for f in found if f[0] >= most - 1e-9) if most > 1e-12 else (0.0, None, None)

    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        leaves, tree = [(np.arange(len(y)), [])], []
        while len(leaves) < s.leaves:
            ranked = sorted(((*best(rows, g, h), i) for i, (rows, _) in enumerate(leaves)), key=lambda r: -r[0])
            gain, k, t, i = ranked[0]
            if k is None:
                break
            rows, path = leaves.pop(i)
            low = x[rows, k] <= t
            leaves += [(rows[low], [*path, (k, t, True)]), (rows[~low], [*path, (k, t, False)])]
        for rows, path in leaves:
            value = -s.rate * g[rows].sum() / h[rows].sum()
            raw[rows] += value
            tree.append((path, value))
        trees.append(tree)
    return medians, trees


def plain_scores(model, x):
    medians, trees = model
    x = np.where(np.isnan(x), medians, x)
    raw = np.zeros(len(x))
    for tree in trees:
        for path, value in tree:
            at = np.ones(len(x), bool)
            for k, t, low in path:
                at &= (x[:, k] <= t) == low
            raw[at] += value
    return 1 / (1 + np.exp(-raw))


def table(n, seed, units="ab"):
    rng = np.random.default_rng(seed)
    rows = []
    for unit in units:
        for yr in range(2000, 2006):
            for wn in range(n):
                x = rng.normal(size=3)
                y = int(x[0] + 0.4 * x[1] * x[1] + rng.normal() * 0.5 > 0.6)
                rows.append((unit, yr, wn, y, 1, float(x[0]), None if wn % 7 == 0 else float(x[1]), None))
    return rows


COLUMNS = "unit string, yr int, wn int, y int, labelable int, x0 double, x1 double, x2 double"


def test_trees_against_every_split():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[::5, 1] = np.nan
    x[:, 2] = np.nan
    y = (x[:, 0] + np.nan_to_num(x[:, 1]) ** 2 > 0.8).astype(float)
    model = boosting.fit(x, y, SMALL)
    new = np.r_[x, rng.normal(size=(40, 3)) * 2]
    assert np.allclose(boosting.walk(model, new), plain_scores(plain_trees(x, y, SMALL), new))
    assert len(model["roots"]) == 6 and (model["feature"] >= 0).sum() > 6


def test_trees_of_constant_columns_say_one_half():
    model = boosting.fit(np.ones((30, 2)), np.r_[np.ones(10), np.zeros(20)], SMALL)
    assert np.allclose(boosting.walk(model, np.zeros((3, 2))), 0.5)


def test_many_values_are_cut_at_quantiles():
    cuts = boosting.cut_points(np.arange(1000.0), 10)
    assert len(cuts) == 9 and np.abs(np.diff(np.searchsorted(np.arange(1000.0), cuts)) - 100).max() <= 1


@pytest.mark.parametrize("by", [[], ["unit"]])
def test_out_of_fold_scores_against_plain_trees(spark, by):
    rows = table(12, 5)
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    sets = {"one": ["x0"], "all": ["x0", "x1", "x2"], "again": ["x0"]}
    got = {(r["rep"], r["unit"], r["yr"], r["wn"]): r["p"] for r in evaluate.fit_predict_sets(df, sets, by, settings=SMALL).collect()}
    assert {k[2] for k in got} == {2002, 2003, 2004, 2005} and len(got) == 3 * 2 * 4 * 12
    data = np.array([[np.nan if v is None else v for v in r[5:]] for r in rows])
    years, units, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), np.array([r[3] for r in rows], float)
    for name, columns in (("one", [0]), ("all", [0, 1, 2])):
        for fold in range(2002, 2006):
            for unit in units[::72] if by else ["ab"]:
                mine = np.isin(units, list(unit))
                train, test = mine & (years < fold), mine & (years == fold)
                model = plain_trees(data[train][:, columns], y[train], SMALL)
                points, levels = evaluate.steps(plain_scores(model, data[train][:, columns]), y[train])
                want = np.interp(plain_scores(model, data[test][:, columns]), points, levels)
                assert [got[name, r[0], r[1], r[2]] for r, t in zip(rows, test, strict=True) if t] == pytest.approx(want.tolist(), abs=1e-9)
    assert all(got["again", *k[1:]] == v for k, v in got.items() if k[0] == "one")


def test_a_fold_without_a_class_has_no_scores(spark):
    rows = [("u", yr, w, int(yr > 2002 and w % 2), 1, float(w), 0.0, 0.0) for yr in range(2000, 2006) for w in range(20)]
    got = evaluate.fit_predict_sets(spark.createDataFrame(rows, COLUMNS), {"one": ["x0"]}, [], settings=SMALL)
    assert {r["yr"] for r in got.collect()} == {2004, 2005}
    assert evaluate.fit_predict_sets(spark.createDataFrame([], COLUMNS), {"one": ["x0"]}, [], settings=SMALL).collect() == []


@pytest.mark.parametrize("most", [30, 90, 10_000])
@pytest.mark.parametrize("by", [[], ["unit"]])
def test_samples_are_the_capped_rows(spark, by, most):
    df = spark.createDataFrame(table(15, 6), COLUMNS)
    for seed in (0, 3):
        capped = evaluate.cap_training(evaluate.folds(df, by), by, most, seed).where("is_test = 0")
        want = sorted(tuple(r) for r in capped.select("fold", "unit", "yr", "wn").collect())
        both = evaluate.train_samples(df, by, (0, 3), most)
        assert sorted(tuple(r) for r in both.where(F.col("seed") == seed).select("fold", "unit", "yr", "wn").collect()) == want


def drawn(n_clusters, replicates, seed=0):
    return np.concatenate([resampling.multiplicities(n_clusters, b, seed, size) for b, size in resampling.blocks_of(replicates)])


def precision(y, p, w):
    total = sum(w[(p == t) & (y == 1)].sum() * w[(p >= t) & (y == 1)].sum() / w[p >= t].sum() for t in np.unique(p) if w[p >= t].sum())
    return total / w[y == 1].sum() if w[y == 1].sum() and w[y == 0].sum() else np.nan


def scores(seed=4):
    rng = np.random.default_rng(seed)
    return [(rep, f"c{rng.integers(0, 6)}", int(rng.random() < 0.4), float(rng.integers(0, 10) / 10)) for rep in ("one", "two") for _ in range(60)]


@pytest.mark.parametrize("chunk", [7, 16_384])
@pytest.mark.parametrize("within", [None, ["rep"]])
def test_replicates_of_three_metrics(spark, monkeypatch, chunk, within):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    rows = [r for r in scores() if r[:2] != ("two", "c3")]
    cut = resampling.chunks(spark.createDataFrame(rows, "rep string, cluster string, y int, p double").repartition(3), ["rep"], within)
    got = {(r["rep"], r["b"]): r for r in resampling.replicate_metrics(cut, ["rep"], replicates=260).collect()}
    assert len(got) == 520
    for rep in ("one", "two"):
        names = sorted({r[1] for r in rows if not within or r[0] == rep})
        y, p = (np.array([r[i] for r in rows if r[0] == rep], float) for i in (2, 3))
        place = np.searchsorted(names, [r[1] for r in rows if r[0] == rep])
        for b, m in enumerate(drawn(len(names), 260)):
            w = m[place]
            want = [area(y, p, w), precision(y, p, w), ((p - y) ** 2 * w).sum() / w.sum()]
            assert [got[rep, b][k] if got[rep, b][k] is not None else np.nan for k in resampling.METRICS] == pytest.approx(want, abs=1e-9, nan_ok=True)


def test_replicates_without_a_class(spark):
    rows = [("one", "a", 1, 0.5), ("one", "b", 1, 0.25)]
    cut = resampling.chunks(spark.createDataFrame(rows, "rep string, cluster string, y int, p double"), ["rep"])
    got = resampling.replicate_metrics(cut, ["rep"], replicates=5).collect()
    assert all(r["auroc"] is None and r["auprc"] is None and r["brier"] is not None for r in got) and len(got) == 5
    assert resampling.replicate_calibration(cut, ["rep"], replicates=5).collect() == []


def solved(x, y, w):
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x])
    for _ in range(60):
        fit = 1 / (1 + np.exp(-beta @ design))
        beta = beta + np.linalg.solve((design * (w * fit * (1 - fit))) @ design.T, design @ (w * (y - fit)))
    return beta


@pytest.mark.parametrize("chunk", [9, 16_384])
def test_calibration_against_a_direct_solution(spark, monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    rows = [r for r in scores(9) if 0 < r[3]] + [("one", "c1", 1, 1.0), ("two", "c2", 0, 1.0)]
    oof = spark.createDataFrame(rows, "rep string, cluster string, y int, p double")
    got = {r["rep"]: r for r in inference.calibration(oof, ["rep"], replicates=30).collect()}
    names = sorted({r[1] for r in rows})
    for rep in ("one", "two"):
        y, p = (np.array([r[i] for r in rows if r[0] == rep], float) for i in (2, 3))
        place = np.searchsorted(names, [r[1] for r in rows if r[0] == rep])
        x = np.log(p.clip(1e-6, 1 - 1e-6) / (1 - p.clip(1e-6, 1 - 1e-6)))
        assert [got[rep]["cox_intercept"], got[rep]["cox_slope"]] == pytest.approx(solved(x, y, np.ones(len(y))).tolist(), abs=1e-6)
        betas = np.array([solved(x, y, m[place]) for m in drawn(len(names), 30)])
        assert [got[rep][f"cox_slope_{s}"] for s in ("lo", "hi")] == pytest.approx(np.percentile(betas[:, 1], [2.5, 97.5]).tolist(), abs=1e-6)
        edges = [i * 0.1 for i in range(10)] + [1.0]

        def ece(w, y=y, p=p, edges=edges):
            parts = [(w[m].sum(), (w * y)[m].sum(), (w * p)[m].sum()) for m in ((p >= a) & (p < b) for a, b in zip(edges, edges[1:], strict=False))]
            return sum(abs(b - c) for _, b, c in parts) / w.sum()

        values = [ece(m[place]) for m in drawn(len(names), 30)]
        assert [got[rep][f"ece_{s}"] for s in ("lo", "hi")] == pytest.approx(np.percentile(values, [2.5, 97.5]).tolist(), abs=1e-9)


def test_units_against_numpy(spark, sf):
    """v8 and v16: each unit's metrics, the interval over its own years, and the test over climate types."""
    oof = queries.unit_scores(spark, sf).toPandas()
    got = {r["unit"]: r for r in queries.QUERIES["v8_unit_evaluation"](spark, sf).collect()}
    assert set(got) == set(oof["unit"])
    for unit, g in oof.groupby("unit"):
        y, p, names = g["y"].to_numpy(), g["p"].to_numpy(), sorted(set(g["cluster"]))
        place = np.searchsorted(names, g["cluster"])
        r = got[unit]
        assert (r["n_test"], r["n_features"]) == (len(g), 132)
        assert r["auroc"] == pytest.approx(area(y, p, np.ones(len(g))), abs=2e-6, nan_ok=True)
        if len(g) >= 5 and 0 < y.mean() < 1:
            values = [area(y, p, m[place]) for m in drawn(len(names), 2000)]
            ends = np.nanpercentile(values, [2.5, 97.5])
            assert r["n_year_clusters"] == len(names)
            assert (r["ci_lo"], r["ci_hi"]) == pytest.approx(tuple(ends), abs=2e-6)
            assert r["beats_chance"] == (ends[0] > 0.5)
        else:
            assert r["n_year_clusters"] == 0 and not r["beats_chance"] and r["ci_lo"] is None
    gradient = queries.QUERIES["v16_climate_gradient"](spark, sf).collect()
    for r in gradient:
        values = [u["auroc"] for u in got.values() if u["climate_type"] == r["climate_type"] and u["auroc"] is not None]
        assert r["n"] == len(values) and r["mean"] == pytest.approx(np.mean(values), abs=2e-6)


def test_lift_over_seeds(spark):
    df = spark.createDataFrame(table(25, 8), COLUMNS)
    oof = evaluate.fit_predict_sets(df, {"base": ["x1"], "all": ["x0", "x1"]}, [], seeds=(0, 1, 2), settings=SMALL, most=40).cache()
    frame = oof.toPandas()
    of = {(s, r): area(g["y"].to_numpy(), g["p"].to_numpy(), np.ones(len(g))) for (s, r), g in frame.groupby(["seed", "rep"])}
    lifts = [of[s, "all"] - of[s, "base"] for s in range(3)]
    assert len(set(lifts)) == 3
    got = {r["measure"]: r for r in inference.stability(inference.lifts(oof, "base", "all"), ["measure"], "value").collect()}
    assert (got["lift"]["mean"], got["lift"]["sd"], got["lift"]["n_seeds"]) == pytest.approx((np.mean(lifts), np.std(lifts, ddof=1), 3))


def test_registered_contrasts(spark, sf):
    """v11, v13, v14 and v15 over the scores."""
    oof = queries.represented(spark, sf).toPandas()
    wide = oof.pivot(index=queries.KEYS, columns="rep", values="p")
    y = oof.drop_duplicates(queries.KEYS).set_index(queries.KEYS)["y"].loc[wide.index].to_numpy()
    got = queries.QUERIES["v14_delong_pairs"](spark, sf).collect()
    assert len({(r["a"], r["b_rep"]) for r in got}) == len(got) == 10
    for r in got:
        assert (r["auc1"], r["auc2"]) == pytest.approx(tuple(area(y, wide[c].to_numpy(), np.ones(len(y))) for c in (r["a"], r["b_rep"])), abs=2e-6)
    units = queries.QUERIES["v11_delong_raw_enriched"](spark, sf).collect()
    for r in units:
        mine = wide.index.get_level_values("unit") == r["unit"]
        assert (r["auc1"], r["auc2"]) == pytest.approx(tuple(area(y[mine], wide[c].to_numpy()[mine], np.ones(mine.sum())) for c in ("enriched", "raw_2col")), abs=2e-6)
        assert r["p_adjusted"] >= r["p_value"] - 1e-6
    trend = queries.comparator.with_cluster(queries.comparator.trend_scores(queries.labels.label(queries.weekly(spark, sf)))).where("score IS NOT NULL").select("cluster", "wn", "score").toPandas()
    both = oof[oof["rep"] == "enriched"].merge(trend, on=["cluster", "wn"])
    got = {r["metric"]: r for r in queries.QUERIES["v15_comparator_contrasts"](spark, sf).collect()}
    if len(both) >= 30:
        ones = np.ones(len(both))
        assert got["auroc"]["n_common"] == len(both) and set(got) == {"auroc", "auprc"}
        assert got["auroc"]["delta"] == pytest.approx(area(both["y"].to_numpy(), both["p"].to_numpy(), ones) - area(both["y"].to_numpy(), both["score"].to_numpy(), ones), abs=2e-6)
    else:
        assert got == {}
    lift = {r["measure"]: r for r in queries.QUERIES["v13_seed_stability"](spark, sf).collect()}
    assert set(lift) == {"raw_2col", "enriched", "lift"} and all(r["n_seeds"] == 5 for r in lift.values())
    assert lift["lift"]["mean"] == pytest.approx(lift["enriched"]["mean"] - lift["raw_2col"]["mean"], abs=3e-6)
    point = metrics.auroc(queries.represented(spark, sf), ["rep"]).toPandas().set_index("rep")["auroc"]
    assert 0 <= point.min() <= point.max() <= 1


def test_running_order_statistics(spark):
    """Levels and ranks of a growing history against sorting it anew, and in time on a long one."""
    import time

    from tidewater.operators import features

    rng = np.random.default_rng(1)
    values = np.where(rng.random(300) < 0.1, np.nan, rng.integers(0, 30, 300)).astype(float)
    levels, ranks = features.earlier_levels(values, 0.9), features.ranks_so_far(values)
    for i, v in enumerate(values):
        before = values[:i][~np.isnan(values[:i])]
        assert levels[i] == (None if not len(before) else pytest.approx(np.quantile(before, 0.9), abs=1e-12))
        upto = values[: i + 1][~np.isnan(values[: i + 1])]
        assert ranks[i] == (None if np.isnan(v) else pytest.approx(((upto < v).sum() + ((upto == v).sum() + 1) / 2) / len(upto)))
    assert features.earlier_levels(np.array([]), 0.9) == []
    long, start = rng.random(100_000), time.perf_counter()
    assert len(features.earlier_levels(long, 0.9)) == len(features.ranks_so_far(long)) == 100_000
    assert time.perf_counter() - start < 60
    rows = [("u", 2000 + i // 50, i % 50, None if np.isnan(v) else float(v), 1.0) for i, v in enumerate(values)]
    panel = spark.createDataFrame(rows, "unit string, yr int, wn int, c double, r double").repartition(3)
    got = {(r["yr"], r["wn"]): r["inter_epidemic_interval"] for r in features.enrich(panel, ["inter_epidemic_interval"]).collect()}
    last = 0
    for i, r in enumerate(rows):
        assert got[r[1], r[2]] == i - last
        if r[3] is not None and levels[i] is not None and r[3] >= levels[i]:
            last = i
