"""Breakdowns by provider, model, project and session, and the dearest requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import money
from meterlake.functions.tokens import cache_hit_ratio, total_tokens

#: Measures of a breakdown and the columns they sum.
CLASSES = {
    "input": "input_tokens",
    "output": "output_tokens",
    "cache_read": "cache_read_tokens",
    "cache_creation": "cache_creation_tokens",
}


#: Size of a session sketch as a power of two; the standard error is 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 12


def _tokens() -> Column:
    return F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("tokens")


def _cost() -> Column:
    return money.exact_sum(F.col("cost_usd")).alias("cost")


def by_provider(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("provider")
        .agg(_tokens(), _cost(), F.max("ts").alias("last_ts"))
        .orderBy(F.desc("cost"), F.asc_nulls_last("provider"))
    )


def by_model(events: DataFrame) -> DataFrame:
    """Per provider and model, with the cache hit ratio; NULL models show as ``(unknown)``."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in CLASSES.items()]
    totals = events.groupBy("provider", "model").agg(
        F.count("*").alias("events"), _tokens(), _cost(), *sums
    )
    ratio = cache_hit_ratio(F.col("input"), F.col("cache_read"), F.col("cache_creation"))
    return (
        totals.withColumn("model", F.coalesce("model", F.lit("(unknown)")))
        .withColumn("cache_hit_ratio", ratio)
        .orderBy(F.desc("cost"), "provider", "model")
    )


def by_project(events: DataFrame, limit: int = 30) -> DataFrame:
    """The ``limit`` dearest (project, provider) pairs; NULL projects show as ``(none)``.

    Sessions are counted exactly: Spark spreads a hot project over its session ids first.
    """
    totals = events.groupBy("project", "provider").agg(
        F.count("*").alias("events"),
        F.count_distinct("session_id").alias("sessions"),
        _tokens(),
        _cost(),
        F.max("ts").alias("last_ts"),
    )
    return (
        totals.withColumn("project", F.coalesce("project", F.lit("(none)")))
        .orderBy(F.desc("cost"), "project", "provider")
        .limit(limit)
    )


def project_sums(events: DataFrame, *keys: str) -> DataFrame:
    """What totals by project can be made of: integer sums, first and last instant and a mergeable
    sketch of the session ids by project and provider. Sessions without an id do not count."""
    return events.groupBy("project", "provider", *keys).agg(
        F.count("*").alias("events"),
        F.sum(money.micro_part(F.col("cost_usd"))).alias("micro"),
        F.sum(money.pico_part(F.col("cost_usd"))).alias("pico"),
        F.sum(total_tokens()).alias("tokens"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.hll_sketch_agg("session_id", F.lit(SKETCH_BITS)).alias("session_sketch"),
    )


def _merged_sums() -> list[Column]:
    sessions = F.hll_sketch_estimate(F.hll_union_agg("session_sketch"))
    return [
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.coalesce(sessions, F.lit(0)).alias("sessions"),
    ]


def by_project_kept(kept: DataFrame, limit: int = 30) -> DataFrame:
    """:func:`by_project` from stored :func:`project_sums`, in any number of parts; sessions are
    estimated from the merged sketches, all else is exact."""
    totals = kept.groupBy("project", "provider").agg(
        *_merged_sums(),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        money.total(F.sum("micro"), F.sum("pico")).alias("cost"),
        F.max("last_ts").alias("last_ts"),
    )
    return (
        totals.withColumn("project", F.coalesce("project", F.lit("(none)")))
        .orderBy(F.desc("cost"), "project", "provider")
        .limit(limit)
    )


def meta_kept(kept: DataFrame) -> DataFrame:
    """Number of events and sessions (estimated), first and last instant, from the same sums."""
    return kept.agg(*_merged_sums(), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def top_sessions(events: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` dearest sessions with the provider, model and project they began with.

    Ranking needs numbers only, so it stays a hash aggregation. The text columns are then
    looked up for the winners alone: at most ``limit`` rows, broadcast unless the list is very long.
    """
    ranked = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.count("*").alias("turns"),
            _tokens(),
            _cost(),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .orderBy(F.desc("cost"), "session_id")
        .limit(limit)
    )

    def first_given(name: str) -> Column:
        value = F.when(F.col(name).isNotNull(), F.struct("ts", "event_id", name))
        return F.min(value).getField(name).alias(name)

    texts = events.select("session_id", "ts", "event_id", "provider", "model", "project")
    keys = ranked.columns
    return (
        texts.join(ranked, "session_id")
        .groupBy(*keys)
        .agg(*[first_given(name) for name in ("provider", "model", "project")])
        .select("session_id", "provider", "model", "project", *keys[1:])
        .orderBy(F.desc("cost"), "session_id")
    )


def top_turns(events: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` dearest single requests; each partition sends its own top only."""
    return (
        events.orderBy(F.desc_nulls_last("cost_usd"), "event_id")
        .limit(limit)
        .select(
            "provider",
            "model",
            "project",
            "session_id",
            "ts",
            *[F.col(c).alias(name) for name, c in CLASSES.items()],
            total_tokens().alias("tokens"),
            F.col("cost_usd").alias("cost"),
        )
    )
