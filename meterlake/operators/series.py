"""Operators on daily series (columns ``series``, ``day`` and measures).

Their input has one row per series and active day, so its size is set by the calendar and
the number of providers, not by the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("cost", "tokens")
#: Number of heat classes and the factor between their thresholds (fixed values).
CLASS_COUNT = 7
CLASS_FACTOR = 3
#: Sums over days are few, so they can be decimal: exact, and with room for tokens as well.
EXACT = "decimal(38,12)"


def select_metric(daily: DataFrame, metric: str = "cost") -> DataFrame:
    """Keep one measure as ``value``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return daily.select("series", "day", F.col(metric).cast("double").alias("value"))


def moving_avg_7(values: DataFrame, calendar_days: int | None = None) -> DataFrame:
    """Trailing mean of the last seven rows of each series, fewer at its start.

    Rows are active days. With ``calendar_days`` the series are first put on a dense
    calendar of that length, so the mean is over calendar days.
    """
    if calendar_days is not None:
        values = calendar_grid(values, calendar_days, ("value",)).select("series", "day", "value")
    week = Window.partitionBy("series").orderBy("day").rowsBetween(-6, 0)
    total = F.sum(F.col("value").cast(EXACT)).over(week).cast("double")
    return values.withColumn("moving_avg", total / F.count("value").over(week))


def color_bucket(values: DataFrame) -> DataFrame:
    """Heat class 0..6 of each value, scaled to the largest value of its series.

    Thresholds are the maximum and its repeated thirds; a series without positive values
    is all class 0.
    """
    top = F.max("value").over(Window.partitionBy("series"))
    rows = values.withColumn("_top", top)
    threshold = F.col("_top")
    reached = F.lit(0)
    for _ in range(CLASS_COUNT - 1):
        reached = reached + (F.col("value") >= threshold).cast("int")
        threshold = threshold / F.lit(float(CLASS_FACTOR))
    bucket = F.when(F.col("_top") > 0, reached).otherwise(F.lit(0))
    return rows.withColumn("bucket", bucket).drop("_top")


def panel_totals(daily: DataFrame) -> DataFrame:
    """Cost and tokens of each series over its range."""
    return daily.groupBy("series").agg(
        F.coalesce(F.sum(F.col("cost").cast(EXACT)).cast("double"), F.lit(0.0)).alias("cost"),
        F.sum("tokens").alias("tokens"),
    )


def calendar_grid(
    daily: DataFrame, days: int, measures: tuple[str, ...] = ("cost", "tokens")
) -> DataFrame:
    """Dense cells: every series on the same ``days`` days up to the last active one.

    Each row covers the idle days up to the next row of its series, so no join is needed.
    ``week`` counts calendar weeks from the first cell, ``weekday`` runs from Sunday = 1.
    """
    everything = Window.partitionBy()
    series = Window.partitionBy("series").orderBy("day")
    edges = daily.select(
        "series",
        "day",
        *measures,
        F.max("day").over(everything).alias("last_day"),
        F.lag("day").over(series).alias("previous"),
        F.lead("day").over(series).alias("following"),
    ).withColumn("first_day", F.date_sub("last_day", days - 1))
    begin = F.when(F.col("previous").isNull(), F.col("first_day")).otherwise(
        F.greatest("day", "first_day")
    )
    end = F.coalesce(F.date_sub("following", 1), F.col("last_day"))
    cells = edges.withColumns({"begin": begin, "end": end}).filter(F.col("begin") <= F.col("end"))

    def shown(name: str) -> Column:
        zero = F.lit(0).cast(daily.schema[name].dataType)
        return F.when(F.col("cell") == F.col("day"), F.col(name)).otherwise(zero).alias(name)

    first_sunday = F.date_sub("first_day", F.dayofweek("first_day") - 1)
    return cells.withColumn("cell", F.explode(F.sequence("begin", "end"))).select(
        "series",
        F.col("cell").alias("day"),
        F.call_function("div", F.date_diff("cell", first_sunday), F.lit(7)).alias("week"),
        F.dayofweek("cell").alias("weekday"),
        *[shown(name) for name in measures],
    )
