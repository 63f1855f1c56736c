"""Daily usage in local time, per provider and combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import money
from meterlake.functions.clock import AsOf, before, instant, local_day, trailing
from meterlake.functions.tokens import total_tokens
from meterlake.operators.breakdowns import CLASSES

#: Name of the series over all providers.
COMBINED = "combined"

_SUMS = ("micro", "pico", "tokens", *CLASSES)

#: Seconds of a slot. All time zones differ from UTC by whole slots since 1972, so the local days
#: of any zone are made of whole slots.
SLOT = 900


def slot_of(ts: Column) -> Column:
    """Start of the slot that holds an instant."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(SLOT)))


def _summed(events: DataFrame, time: Column, *keys: str) -> DataFrame:
    """Integer sums by (time, provider, keys)."""
    name = "_time"
    return (
        events.select(
            time.alias(name),
            "provider",
            *keys,
            money.micro_part(F.col("cost_usd")).alias("micro"),
            money.pico_part(F.col("cost_usd")).alias("pico"),
            total_tokens().alias("tokens"),
            *[F.col(c).alias(label) for label, c in CLASSES.items()],
        )
        .groupBy(name, "provider", *keys)
        .agg(*[F.sum(label).alias(label) for label in _SUMS])
    )


def slot_sums(events: DataFrame, *keys: str) -> DataFrame:
    """What daily series in any time zone can be made of: integer sums by slot and provider."""
    return _summed(events, slot_of(F.col("ts")), *keys).withColumnRenamed("_time", "slot")


def _parts(
    events: DataFrame, tz: str, days: int, as_of: AsOf, align_days: bool, kept: DataFrame | None
) -> DataFrame:
    """Integer sums per (local day, provider): the only pass over the facts, or, with ``kept``,
    over the slots; the facts are then read for the slot alone in which the window begins."""
    start = before(instant(as_of), days=days)
    first = local_day(start, tz)

    def aligned(rows: DataFrame, ts: str) -> DataFrame:
        return rows.filter(local_day(F.col(ts), tz) > first) if align_days else rows

    if kept is None:
        rows = aligned(trailing(events, start), "ts")
        return _summed(rows, local_day(F.col("ts"), tz)).withColumnRenamed("_time", "day")
    slot = slot_of(start)
    whole = F.when(slot == start, start).otherwise(slot + F.make_dt_interval(secs=F.lit(SLOT)))
    edge = trailing(events, start).filter(F.col("ts") < whole)
    if "event_date" in events.columns:
        edge = edge.filter(F.col("event_date") <= F.date_add(F.to_date(whole), 1))
    slots = trailing(kept.withColumnRenamed("slot", "ts"), whole)
    slots = slots.select("ts", "provider", *_SUMS).unionByName(
        slot_sums(aligned(edge, "ts")).withColumnRenamed("slot", "ts")
    )
    day = local_day(F.col("ts"), tz).alias("day")
    return aligned(slots, "ts").groupBy(day, "provider").agg(*[F.sum(n).alias(n) for n in _SUMS])


def _measures() -> list[Column]:
    return [
        money.total(F.col("micro"), F.col("pico")).alias("cost"),
        *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in ("tokens", *CLASSES)],
    ]


def daily_by_provider(
    events: DataFrame,
    tz: str,
    days: int = 365,
    as_of: AsOf = None,
    align_days: bool = False,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Cost and tokens per local day and provider over the trailing ``days``.

    The window starts at a moment, so its first day is partial; ``align_days`` leaves that
    partial day out. ``kept`` (:func:`slot_sums` of the same events, stored) gives the same
    series without a scan of the facts.
    """
    parts = _parts(events, tz, days, as_of, align_days, kept)
    return parts.select("day", "provider", *_measures())


def daily_combined(
    events: DataFrame,
    tz: str,
    days: int = 365,
    as_of: AsOf = None,
    align_days: bool = False,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Cost and tokens per local day over all providers."""
    parts = _parts(events, tz, days, as_of, align_days, kept)
    summed = parts.groupBy("day").agg(*[F.sum(name).alias(name) for name in _SUMS])
    return summed.select("day", *_measures())


def daily_burn(
    events: DataFrame,
    tz: str,
    days: int = 365,
    as_of: AsOf = None,
    align_days: bool = False,
    kept: DataFrame | None = None,
) -> DataFrame:
    """All daily series in long form: one per provider and ``combined``.

    The facts are aggregated once; the grouping sets run on the per-day sums, so no fact
    row is duplicated.
    """
    parts = _parts(events, tz, days, as_of, align_days, kept)
    day, provider = F.col("day"), F.col("provider")
    sets = parts.groupingSets([[day, provider], [day]], day, provider).agg(
        F.grouping("provider").alias("all_providers"),
        *[F.sum(name).alias(name) for name in _SUMS],
    )
    series = F.when(F.col("all_providers") == 1, F.lit(COMBINED)).otherwise(provider)
    return sets.select(series.alias("series"), "day", *_measures())
