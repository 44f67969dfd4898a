"""The weekly panel: one row for each unit, ISO year and ISO week, with a count and a rain series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["unit", "yr", "wn"]
PANEL_SCHEMA = T.StructType(
    [T.StructField("unit", T.StringType()), T.StructField("yr", T.LongType()), T.StructField("wn", T.LongType()), T.StructField("c", T.DoubleType()), T.StructField("r", T.DoubleType())]
)


@dataclass(frozen=True)
class Scale:
    """How a source table becomes a panel: its columns for unit, year, week, count and rain."""

    unit: tuple[str, ...]
    year: str
    week: str
    count: str
    rain: str
    flags: tuple[str, ...] = ()


def panel_of(df: DataFrame, scale: Scale) -> DataFrame:
    """A panel from any table; NaN and infinite values become null, and no unit column means ALL."""
    unit = F.concat_ws("-", *(F.col(c).cast("string") for c in scale.unit)) if scale.unit else F.lit("ALL")
    return df.select(unit.alias("unit"), F.col(scale.year).cast("long").alias("yr"), F.col(scale.week).cast("long").alias("wn"), finite(F.col(scale.count)).alias("c"), finite(F.col(scale.rain)).alias("r"), *scale.flags)


def finite(column: Column) -> Column:
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def first_column(columns: list[str], *candidates: str, prefix: str | None = None) -> str | None:
    """The first column of a list of candidates, or the first with a prefix."""
    if prefix is not None:
        return next((c for c in columns if c.startswith(prefix)), None)
    return next((c for c in candidates if c in columns), None)


def _iso(day: str) -> list[Column]:
    return [F.expr(f"extract(YEAROFWEEK FROM {day})").cast("long").alias("yr"), F.weekofyear(day).cast("long").alias("wn")]


def weekly_panel(spark: SparkSession, sf_dir: str, level: str = "region", rain_scale: float = 20.0) -> DataFrame:
    """Orders a week by customers' region (or nation), and quantity shipped by suppliers' region.

    Both facts are summed to weeks before they meet, so that only the panel is joined.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name" if level == "region" else "n_name").alias("unit"))
    buyers = read("customer").select("c_custkey", F.col("c_nationkey").alias("nation")).join(places, "nation")
    orders = read("orders").select("o_custkey", "o_orderdate").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    cases = orders.groupBy("unit", *_iso("o_orderdate")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    sellers = read("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")).join(places, "nation")
    shipped = read("lineitem").select("l_suppkey", "l_quantity", "l_shipdate").join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    rain = shipped.groupBy("unit", *_iso("l_shipdate")).agg((F.sum("l_quantity") / rain_scale).alias("r"))
    return cases.join(rain, KEYS, "left").select(*KEYS, "c", "r")


def with_flags(panel: DataFrame) -> DataFrame:
    """Deterministic quality flags: 1998 is disturbed, short unit-years end early, some weeks are implausible."""
    from ..functions.windows import whole_year

    return panel.select(
        "*",
        (F.col("yr") == 1998).cast("int").alias("flag_covid"),
        (F.count(F.lit(1)).over(whole_year()) < 40).cast("int").alias("flag_terminal_gap"),
        ((F.col("c").cast("long") * 7 + F.col("wn")) % 17 == 0).cast("int").alias("flag_plausibility"),
    )


def drop_flagged_years(panel: DataFrame, flags: tuple[str, ...] = ("flag_covid", "flag_terminal_gap"), share: float = 0.5) -> DataFrame:
    """Without the years of which ``share`` or more is flagged, one flag after the other on what is left."""
    for flag in flags:
        if flag in panel.columns:
            bad = panel.groupBy("yr").agg(F.avg(flag).alias("_share")).where(F.col("_share") >= share).select("yr")
            panel = panel.join(bad, "yr", "left_anti")
    return panel


def plausible(panel: DataFrame, flag: str = "flag_plausibility") -> DataFrame:
    return panel.where(F.col(flag) == 0) if flag in panel.columns else panel


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, whole: bool = False) -> DataFrame:
    """A saved table: metrics, thresholds, scores, dictionaries. CSV and JSON need their schema, as none is inferred.

    ``whole`` is for JSON files that hold one record over many lines.
    """
    if kind == "parquet":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError(f"{kind} is read with a schema")
    return spark.read.csv(path, header=True, schema=schema) if kind == "csv" else spark.read.json(path, schema=schema, multiLine=whole)


def read_panel(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A saved panel."""
    return read_table(spark, path, kind, PANEL_SCHEMA)


def record(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with an array of structs for each named table of results: the nested record of a run.

    For summaries, which have a row for each representation, contrast or unit.
    """
    rows = [df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.join(F.broadcast(row), F.lit(True))  # one row each
    return out


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """A sink: parquet, CSV with a header, or JSON lines, in folders by the values of ``by``."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    {"parquet": writer.parquet, "csv": lambda p: writer.csv(p, header=True), "json": writer.json}[kind](path)
