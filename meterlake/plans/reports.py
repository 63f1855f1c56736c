"""The reports a usage dashboard asks for, one function per page section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.clock import AsOf
from meterlake.functions.text import project_label
from meterlake.operators import breakdowns, daily, series, windows


def summary(events: DataFrame, tz: str, as_of: AsOf = None) -> dict[str, DataFrame]:
    return {
        "kpis": windows.summary_kpis(events, tz, as_of),
        "meta": windows.summary_meta(events),
        "providers": breakdowns.by_provider(events),
    }


def heatmap(
    events: DataFrame,
    tz: str,
    days: int = 365,
    metric: str = "cost",
    as_of: AsOf = None,
    kept: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Daily series, the chosen measure with heat classes and moving average, totals, grid.

    With ``kept`` (:meth:`Warehouse.daily`) no frame scans the facts.
    """
    burn = daily.daily_burn(events, tz, days, as_of, kept=kept)
    values = series.select_metric(burn, metric)
    return {
        "series": burn,
        "heat": series.color_bucket(values),
        "line": series.moving_avg_7(values.filter(F.col("series") == daily.COMBINED)),
        "totals": series.panel_totals(burn),
        "grid": series.calendar_grid(burn, days),
    }


def models(events: DataFrame) -> DataFrame:
    return breakdowns.by_model(events)


def projects(events: DataFrame, limit: int = 30) -> DataFrame:
    return breakdowns.by_project(events, limit).withColumn(
        "label", project_label(F.col("project"))
    )


def sessions(events: DataFrame, limit: int = 25) -> DataFrame:
    return breakdowns.top_sessions(events, limit).withColumn(
        "label", project_label(F.col("project"))
    )


def turns(events: DataFrame, limit: int = 25) -> DataFrame:
    return breakdowns.top_turns(events, limit)


def burn(
    events: DataFrame,
    as_of: AsOf = None,
    limit_5h: int | None = None,
    limit_week: int | None = None,
) -> DataFrame:
    return windows.burn(events, as_of, limit_5h, limit_week)
