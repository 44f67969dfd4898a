"""Permutation importance against the same thing done in one place."""

from __future__ import annotations

import numpy as np
import pytest
from test_panel import area

from tidewater.operators import forest
from tidewater.plans import queries

NAMES = ["strong", "weak", "noise", "flat", "unknown"]


def table(seed=2, signal=True):
    rng, rows = np.random.default_rng(seed), []
    for yr in range(2000, 2007):
        for wn in range(30 if yr % 2 else 22):
            a, b, c = rng.normal(size=3)
            y = int(a + 0.4 * b + rng.normal() * 0.4 > 0.5) if signal else wn % 2
            rows.append(("u", yr, wn, y, 1, float(a), None if wn % 9 == 0 else float(b), float(c), 1.0, None))
    return rows


SCHEMA = "unit string, yr int, wn int, y int, labelable int, strong double, weak double, noise double, flat double, unknown double"


def test_years_are_dealt_evenly():
    sizes = {2000: 50, 2001: 40, 2002: 40, 2003: 30, 2004: 10, 2005: 10}
    got = forest.deal_years(sizes)
    assert got == {2000: 0, 2002: 1, 2001: 2, 2003: 3, 2005: 3, 2004: 1}
    assert forest.deal_years({2000: 5}) == {2000: 0} and set(forest.deal_years({1: 2, 2: 2}).values()) == {0, 1}


def plain_walk(trees, root, row):
    at = root
    while trees["feature"][at] >= 0:
        at = trees["below"][at] if row[trees["feature"][at]] <= trees["threshold"][at] else trees["above"][at]
    return trees["value"][at]


def test_importance_by_hand(spark):
    """Folds, samples, shuffles, areas and sums, one row at a time; only the trees come from the operator."""
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["feature"]: r["importance"] for r in forest.permutation_importance(df, NAMES, trees=30).collect()}
    years, y = np.array([r[1] for r in rows]), np.array([r[3] for r in rows], float)
    x = np.array([[np.nan if v is None else v for v in r[5:9]] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    folds = forest.deal_years({int(v): int((years == v).sum()) for v in set(years)})
    fold = np.array([folds[v] for v in years])
    want = np.zeros(4)
    for f in range(4):
        blocks = [forest.fit_block(x[fold != f], y[fold != f], n, (0, f, b)) for b, n in enumerate((25, 5))]
        test, label = x[fold == f], y[fold == f]

        def score(rows_, blocks=blocks):
            return np.round([sum(plain_walk(b, r, row) for b in blocks for r in b["roots"]) / 30 for row in rows_], 12)

        ones = np.ones(len(label))
        base = area(label, score(test), ones)
        for k in range(4):
            lost = []
            for turn in range(4):
                moved = test.copy()
                moved[:, k] = test[np.random.default_rng([0, f, 0, k, turn]).permutation(len(test)), k]
                lost.append(base - area(label, score(moved), ones))
            want[k] += np.mean(lost)
    assert set(got) == set(NAMES[:4])
    assert [got[n] for n in NAMES[:4]] == pytest.approx(want.tolist(), abs=1e-9)
    assert got["strong"] > got["weak"] > abs(got["noise"]) and got["flat"] == 0


def test_groups_of_rows_keep_the_ranking(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    got = {r["feature"]: r["importance"] for r in forest.permutation_importance(df, NAMES, trees=30, group=20).collect()}
    assert got["strong"] > got["weak"] > abs(got["noise"]) and got["flat"] == 0


def test_fallback_to_single_areas(spark):
    df = spark.createDataFrame([(*r[:5], 1.0, 1.0, 1.0, 1.0, None) for r in table()], SCHEMA)
    got = forest.predictive_attribution(df, NAMES, trees=5).collect()
    assert {r["method"] for r in got} == {"single"} and all(r["importance"] == 0 for r in got) and len(got) == 4
    assert forest.permutation_importance(df.limit(0), NAMES).collect() == []
    assert forest.permutation_importance(df.where("yr = 2000"), NAMES).collect() == []


def test_g8_ranks_all_features(spark, sf):
    got = queries.QUERIES["g8_permutation_attribution"](spark, sf).collect()
    assert len(got) == 14 and {r["method"] for r in got} == {"permutation"}
    assert [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)
    assert {r["feature"] for r in got} <= {*queries.DOMAIN, *queries.OWN}
