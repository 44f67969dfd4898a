"""A whole run, written and read again."""

from __future__ import annotations

from tidewater.operators import boosting
from tidewater.plans import queries, run
from tidewater.sources import panel as source


def test_run(spark, sf, tmp_path):
    out = str(tmp_path)
    run.write_run(spark, sf, out, ("region",), replicates=20, seeds=2, settings=boosting.Settings(rounds=4, leaves=4), trees=4)
    names = {p.name for p in tmp_path.iterdir()}
    assert names == {"enriched", "feature_dictionary", "predictions", "summary", "contrasts", "delong", "calibration", "comparator", "stability", "unit_metrics", "climate_gradient", "rain_thresholds", "dynamics", "ladder", "attribution", "reliability", "separation", "stats"}
    frame = spark.read.parquet(f"{out}/enriched")
    assert sorted(queries.features.feature_columns(frame.drop("level"))) == sorted([*queries.DOMAIN, *queries.OWN])
    assert {r["level"] for r in frame.select("level").distinct().collect()} == {"region"} and frame.count() == queries.weekly(spark, sf).count()
    scores = spark.read.parquet(f"{out}/predictions")
    assert {r["rep"] for r in scores.select("rep").distinct().collect()} == set(queries.catalogue.representations(queries.DOMAIN, queries.OWN))
    pairs = source.read_table(spark, f"{out}/contrasts", "csv", "metric string, a string, b_rep string, delta double, ci_lo double, ci_hi double, p_value double, p_adjusted double, family string, stars string, level string").collect()
    assert len(pairs) == 30 and [(r["a"], r["b_rep"]) for r in pairs if r["family"] == "confirmatory"] == [("enriched", "raw_2col")]
    record = spark.read.json(f"{out}/stats").collect()
    assert len(record) == 1 and len(record[0]["summary"]) == 5 and len(record[0]["contrasts"]) == 30
    ranked = spark.read.csv(f"{out}/attribution", header=True).collect()
    assert len(ranked) == 14
