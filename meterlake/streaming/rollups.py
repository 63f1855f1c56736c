"""Stream deduplication and windowed roll-ups of a stream of events.

State is bounded by the watermark. Rows later than it are left out of the windows here but
still reach the stored table through :mod:`meterlake.streaming.ingest`; the batch operators
on that table stay the truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import money
from meterlake.functions.clock import check_zone
from meterlake.functions.tokens import total_tokens
from meterlake.operators.breakdowns import CLASSES
from meterlake.operators.windows import gauge


def stream_dedup(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats of an ``event_id`` that arrive within ``delay`` of each other.

    Older repeats are held back by the id check of the ingest sink.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _sums() -> list[Column]:
    """Measures as integer sums: streaming state stays in fixed-width columns."""
    return [
        F.sum(money.micro_part(F.col("cost_usd"))).alias("micro"),
        F.sum(money.pico_part(F.col("cost_usd"))).alias("pico"),
        F.sum(total_tokens()).alias("tokens"),
    ]


def stream_daily(events: DataFrame, tz: str, delay: str = "1 day") -> DataFrame:
    """Finished local days per provider.

    The day is a window over local wall-clock time, so the watermark can close it and free
    its state. Day windows start at midnight UTC, hence the session must run in UTC.
    """
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC"):
        raise ValueError(f"stream_daily needs a session in UTC, not {zone}")
    local = events.withColumn(
        "local_ts", F.from_utc_timestamp("ts", check_zone(tz))
    ).withWatermark("local_ts", delay)
    classes = [F.sum(c).alias(name) for name, c in CLASSES.items()]
    daily = local.groupBy(F.window("local_ts", "1 day"), "provider").agg(*_sums(), *classes)
    return daily.select(
        F.to_date("window.start").alias("day"),
        "provider",
        money.total(F.col("micro"), F.col("pico")).alias("cost"),
        "tokens",
        *CLASSES,
    )


def stream_burn(
    events: DataFrame,
    limit: int,
    window: str = "5 hours",
    slide: str = "15 minutes",
    delay: str = "1 hour",
) -> DataFrame:
    """Tokens and cost of each sliding window with its share of the limit and a hot flag.

    Events are first summed per slide step, so the overlapping windows multiply those sums
    and not the events.
    """
    steps = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", slide).alias("step"))
        .agg(*_sums())
    )
    totals = (
        steps.groupBy(F.window(F.window_time("step"), window, slide).alias("span"))
        .agg(*[F.sum(name).alias(name) for name in ("micro", "pico", "tokens")])
    )
    utilisation = F.col("tokens") / F.lit(limit or None).cast("bigint")
    fill, hot = gauge(utilisation)
    return totals.select(
        F.col("span.start").alias("start"),
        F.col("span.end").alias("end"),
        "tokens",
        money.total(F.col("micro"), F.col("pico")).alias("cost"),
        utilisation.alias("utilization"),
        fill.alias("fill"),
        hot.alias("hot"),
    )
