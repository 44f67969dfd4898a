"""All stages for each level of the panel: features, scores, inference, thresholds, and the tables behind the figures.

``python -m tidewater.plans.run TABLES OUT [LEVEL ...]`` writes a folder ``level=<level>`` for each level,
with a table a result; whoever reads ``OUT`` as one source has the level as a column.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, catalogue, comparator, evaluate, features, forest, inference, labels, metrics, reporting, resampling, trigger
from ..session import clear, configure, materialised, session
from ..sources import panel as source
from . import queries

LEVELS = ("region", "nation")


def results(panel: DataFrame, climates: DataFrame, replicates: int = resampling.REPLICATES, seeds: int = queries.SEEDS, settings: boosting.Settings = boosting.Settings(), trees: int = forest.TREES) -> dict[str, DataFrame]:
    """Name -> table of all that a level's run yields."""
    frame = materialised(queries.modelled_of(panel), "modelled")
    columns = features.feature_columns(frame)
    signature = [c for c in columns if c.startswith("c22")]
    domain = [c for c in columns if c not in signature]
    sets, rungs = catalogue.representations(domain, signature), catalogue.ladder(domain, signature)
    scored = materialised(comparator.with_cluster(evaluate.fit_predict_sets(frame, sets | rungs, [], settings=settings)).drop("seed", "fold"), "scores")
    own = scored.where(F.col("rep").isin(list(sets)))
    enriched = own.where("rep = 'enriched'")
    units = materialised(comparator.with_cluster(evaluate.fit_predict_sets(frame, {"enriched": columns}, ["unit"], settings=settings)).drop("seed", "fold", "rep"), "units")
    unit_rows = materialised(reporting.by_climate(evaluate.summarise(units, ["unit"]).join(inference.unit_intervals(units, ["unit"], replicates=replicates), "unit", "left"), climates), "unit-rows")
    many = evaluate.fit_predict_sets(frame, {k: sets[k] for k in ("raw_2col", "enriched")}, [], seeds=tuple(range(seeds)), settings=settings)
    ready = materialised(trigger.prepared(labels.label(panel)), "ready")
    trend = comparator.trend_scores(labels.label(panel)).where("score IS NOT NULL")
    names = panel.sparkSession.createDataFrame([(i, k) for i, k in enumerate(rungs)], "place int, rep string")
    steps = names.join(metrics.auroc(scored, ["rep"]).join(metrics.auprc(scored, ["rep"]), "rep"), "rep", "left")
    return {
        "enriched": frame,
        "feature_dictionary": catalogue.described(frame, columns),
        "predictions": own,
        "summary": evaluate.summarise(own, ["rep"]),
        "contrasts": queries.adjusted(inference.contrasts(own, replicates=replicates), "raw_2col", "enriched"),
        "delong": queries.delong_pairs(own, []),
        "calibration": inference.calibration(enriched, ["rep"], replicates=replicates),
        "comparator": metrics.auroc(trend.select("y", F.lit("trend").alias("rep"), F.col("score").alias("p")), ["rep"]),
        "stability": inference.stability(inference.lifts(many, "raw_2col", "enriched"), ["measure"], "value"),
        "unit_metrics": unit_rows,
        "climate_gradient": metrics.kruskal(unit_rows.withColumn("measure", F.lit("auroc")), ["measure"], "auroc", "climate_type"),
        "rain_thresholds": trigger.with_median_row(materialised(trigger.unit_rows(ready), "thresholds")),
        "dynamics": queries.dynamics_contrast(materialised(trigger.by_feature(ready), "tall")),
        "ladder": reporting.dips(steps, [], "place", "auroc"),
        "attribution": forest.predictive_attribution(frame, columns, trees=trees),
        "reliability": reporting.reliability(enriched, ["rep"]),
        "separation": reporting.separation(enriched, ["rep"]),
    }


#: Tables of a row a week, in folders; all others are small and go to CSV.
WIDE = {"enriched": [], "predictions": ["rep"]}


def write_run(spark: SparkSession, sf_dir: str, out: str, levels: tuple[str, ...] = LEVELS, **options) -> None:
    """Every level's tables below ``out``, and a nested record of the small ones."""
    for level in levels:
        found = results(source.weekly_panel(configure(spark), sf_dir, level), queries.climates(spark), **options)
        for name, table in found.items():
            source.write_table(table, f"{out}/{name}/level={level}", "parquet" if name in WIDE else "csv", WIDE.get(name))
        read = {name: source.read_table(spark, f"{out}/{name}/level={level}", "csv", found[name].schema) for name in ("summary", "contrasts", "calibration", "stability", "climate_gradient", "dynamics")}
        source.write_table(source.record(read), f"{out}/stats/level={level}", "json")


if __name__ == "__main__":
    spark = session("run")
    try:
        write_run(spark, sys.argv[1], sys.argv[2], tuple(sys.argv[3:]) or LEVELS)
    finally:
        clear(spark)
