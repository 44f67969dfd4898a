"""Thresholds that leave a year out, against fits of copied rows."""

from __future__ import annotations

import numpy as np
import pytest
from test_panel import area, redraw

from tidewater.operators import trigger
from tidewater.plans import queries


def fitted(x, y):
    """The first threshold of the greatest J, every candidate tried."""
    if len(x) < 20 or y.min() == y.max():
        return None
    marks = np.unique(x)
    if len(marks) > 120:
        at = (len(x) - 1) * np.array([0.02 + i * (0.96 / 99) for i in range(100)])
        s = np.sort(x)
        low, high = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
        marks = np.unique(low + (high - low) * (at - np.floor(at)))
    found = [(round((x[y == 1] >= t).mean() + (x[y == 0] < t).mean() - 1, 12), -t) for t in marks]
    j, t = max(found)
    return -t, (x[y == 1] >= -t).mean(), (x[y == 0] < -t).mean(), j, 100 * (x < -t).mean()


@pytest.mark.parametrize(("per_year", "values"), [(12, 9), (60, 1000), (30, 200), (5, 4)])
def test_less_years_against_copies(per_year, values):
    rng = np.random.default_rng(per_year)
    year = np.repeat(np.arange(2000, 2006), per_year)
    x = rng.integers(0, values, len(year)) / 8
    y = (x / values * 8 + rng.random(len(year)) > 1.1).astype(int)
    y[year == 2003] = 0
    got = {r[0]: r[1:] for r in trigger.thresholds_less_years(x, y, year)}
    want = {f: (int(m.sum()), fit) for f in (None, *range(2000, 2006)) for m in [year != f if f else np.ones(len(year), bool)] if (fit := fitted(x[m], y[m]))}
    assert set(got) == set(want)
    for f, (n, fit) in want.items():
        assert got[f][0] == n and got[f][1:] == pytest.approx(fit, abs=1e-9)


def test_groups_without_a_fit():
    assert trigger.thresholds_less_years(np.arange(30.0), np.zeros(30, int), np.repeat([1, 2], 15)) == []
    assert trigger.thresholds_less_years(np.arange(10.0), np.arange(10) % 2, np.repeat([1, 2], 5)) == []


def test_dynamics_contrast(spark, sf):
    rows = trigger.by_feature(queries.rounded(queries.ready(spark, sf))).cache()
    frame = rows.toPandas()
    pooled = []
    for unit, mine in frame.groupby("unit"):
        kinds = {}
        for kind, g in mine.groupby("kind"):
            scores = {}
            for year in sorted(set(g["yr"])):
                best = None
                for feature, f in g[g["yr"] != year].groupby("feature_ord"):
                    for lead in trigger.LEADS:
                        fit = fitted(f["x"].to_numpy(), f[f"y{lead}"].to_numpy())
                        if fit and (best is None or fit[3] > best[0]):
                            best = (fit[3], feature, lead)
                if best:
                    test = g[(g["yr"] == year) & (g["feature_ord"] == best[1])]
                    scores |= {(year, w): (x, y) for w, x, y in zip(test["wn"], test["x"], test[f"y{best[2]}"], strict=True)}
            kinds[kind] = scores
        if len(kinds) == 2:
            pooled += [(f"{unit}-{k[0]}", kinds[0][k][1], kinds[0][k][0], kinds[1][k][0]) for k in kinds[0] if k in kinds[1]]
    out = queries.dynamics_contrast(rows).collect()
    if len(pooled) < queries.LEAST_PAIRS:
        assert out == []
        return
    names = sorted({r[0] for r in pooled})
    y, a, d = (np.array([r[i] for r in pooled], float) for i in (1, 2, 3))
    place = np.searchsorted(names, [r[0] for r in pooled])
    deltas = np.array([area(y, d, m[place]) - area(y, a, m[place]) for m in redraw(len(names))])
    deltas = deltas[~np.isnan(deltas)]
    (r,) = out
    assert (r["n_common"], r["n_clusters"]) == (len(pooled), len(names))
    ones = np.ones(len(y))
    assert (r["dyn_minus_accum"], r["ci_lo"], r["ci_hi"]) == pytest.approx((area(y, d, ones) - area(y, a, ones), *np.percentile(deltas, [2.5, 97.5])), abs=1e-9)
    assert queries.dynamics_contrast(rows, least=len(pooled) + 1).collect() == []
