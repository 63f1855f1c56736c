"""One query per operator, each over the whole ``events`` table of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType
from pyspark.sql.window import Window

from meterlake import schema
from meterlake.checks import logs
from meterlake.checks import usage_view as view
from meterlake.checks.oracle import CUT, RATE_FACTOR
from meterlake.functions.clock import before, instant, utc_ntz
from meterlake.functions.text import project_label
from meterlake.functions.tokens import total_tokens
from meterlake.operators import breakdowns, daily, merge, pricing, rollout, series, windows
from meterlake.operators.assistant import parse_assistant
from meterlake.plans.ingest import ingest, ingest_summary, rows_per_file, stage
from meterlake.plans.reprice import reprice_if_needed
from meterlake.plans.session import configure, scratch_dir
from meterlake.plans.store import Warehouse, metadata_upsert, upsert_ingest_state
from meterlake.sources.files import changed_files, quarantine, read_log_lines
from meterlake.sources.listing import discover_files
from meterlake.sources.rates import default_rates, load_rates
from meterlake.sources.registry import ASSISTANT_LOGS, ROLLOUT_LOGS, SOURCES, Source
from meterlake.sources.tail import tail_source
from meterlake.streaming import rollups
from meterlake.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]

DAYS = 30


def _plain(rows: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock values."""
    shown = [
        utc_ntz(F.col(f.name)).alias(f.name) if isinstance(f.dataType, TimestampType) else f.name
        for f in rows.schema
    ]
    return rows.select(*shown)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price(view.unpriced(spark, sf_dir), default_rates(spark))


def _cut() -> Column:
    return instant(CUT)


def _on_usage(report: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that is a report over the priced usage table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _plain(report(_usage(spark, sf_dir)))

    return query


def _query(build: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _plain(build(spark, sf_dir))

    return query


# -- pricing ------------------------------------------------------------------------------


#: Rows of the long rate table.
MANY_RATES = 100_000


def _many_rates(spark: SparkSession) -> DataFrame:
    """The rates with many more for names that extend listed ones and that no event has."""
    listed = default_rates(spark)
    longer = F.concat(F.lit("claude-opus-4-8-unused-"), F.col("id")).alias("model_prefix")
    zeros = [F.lit(0.0).alias(c) for c in listed.columns[2:]]
    more = spark.range(MANY_RATES).select(F.lit("anthropic").alias("provider"), longer, *zeros)
    return listed.unionByName(more)


def _rate_lookup(rates: Callable[[SparkSession], DataFrame] = default_rates, **bounds: int) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = pricing.rate_lookup(view.unpriced(spark, sf_dir), rates(spark), **bounds)
        return found.select("event_id", "rate.*")

    return build


def _loaded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs at rates that were written as a folder of CSV parts and loaded from there."""
    path = f"{scratch_dir(spark, 'rates')}/rates.csv"
    default_rates(spark).write.option("header", "true").csv(path)
    rates, _ = load_rates(spark, path)
    return pricing.price(view.unpriced(spark, sf_dir), rates).select("event_id", "cost_usd")


def _dearer(spark: SparkSession) -> DataFrame:
    factor = F.lit(RATE_FACTOR)
    rates = default_rates(spark)
    return rates.select(*rates.columns[:2], *[(F.col(f) * factor).alias(f) for f in rates.columns[2:]])


def _two_passes(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The events stored in two passes, of which the second brings the early ones again."""
    warehouse = Warehouse(spark, scratch_dir(spark, "tables"))
    reprice_if_needed(warehouse, default_rates(spark), "first")
    usage = stage(spark, _usage(spark, sf_dir), scratch_dir(spark, "usage"))
    warehouse.append_events(warehouse.new_events(usage.filter(F.col("ts") < _cut()), "first"), "first")
    warehouse.append_events(warehouse.new_events(usage, "second"), "second")
    return warehouse


def _reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = Warehouse(spark, scratch_dir(spark, "reprice"))
    reprice_if_needed(warehouse, default_rates(spark), "first")
    warehouse.append_events(_usage(spark, sf_dir), "all")
    reprice_if_needed(warehouse, _dearer(spark), "second")
    return warehouse.events().select("event_id", "cost_usd")


def _daily_burn_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series from the kept slots, after two passes and a reprice."""
    warehouse = _two_passes(spark, sf_dir)
    reprice_if_needed(warehouse, _dearer(spark), "second")
    return daily.daily_burn(warehouse.events(), view.TZ, DAYS, view.AS_OF, kept=warehouse.daily())


def _by_project_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept project totals, the exact number of sessions and whether the sketch is in its bound."""
    warehouse = _two_passes(spark, sf_dir)
    exact = breakdowns.by_project(warehouse.events()).select("project", "provider", "sessions")
    found = breakdowns.by_project_kept(warehouse.projects()).withColumnRenamed("sessions", "estimate")
    bound = F.col("sessions") * (3 * 1.04 / 2 ** (breakdowns.SKETCH_BITS / 2))
    within = (F.abs(F.col("estimate") - F.col("sessions")) <= bound).alias("within_bound")
    return found.join(exact, ["project", "provider"]).select("*", within).drop("estimate")


# -- parsing ------------------------------------------------------------------------------


def _events(rows: DataFrame) -> DataFrame:
    return rows.select(*schema.PARSED_EVENT.fieldNames())


def _rollout_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rollout.rollout_records(view.rollout_lines(spark, sf_dir))
    carried = rollout.carry_forward(records).filter("is_usage")
    return carried.select("source_file", "line_id", "model", "session_id", "ordinal")


def _first_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dedup_first(parse_assistant(view.transcript_lines(spark, sf_dir)))


def _canonical_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = merge.canonical_union(
        parse_assistant(view.transcript_lines(spark, sf_dir)),
        rollout.parse_rollout(view.rollout_lines(spark, sf_dir)),
    )
    return merge.dedup_first(both).select(
        "event_id", "provider", "tool", total_tokens().alias("tokens")
    )


# -- tables -------------------------------------------------------------------------------


def _append_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = _two_passes(spark, sf_dir).events().filter(F.col("ingest_pass") == "second")
    return added.select("event_id", "event_date")


def _listing(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file").agg(F.sum("id").alias("size"), F.max("ts").alias("mtime"))


def _changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view.base(spark, sf_dir)
    state = _listing(rows.filter(F.col("ts") < _cut())).select(
        "source_file", F.col("size").alias("last_size"), F.col("mtime").alias("last_mtime")
    )
    return changed_files(_listing(rows), state)


def _state_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file").agg(
        F.max("id").alias("last_offset"),
        F.max("ts").alias("last_mtime"),
        F.count("*").alias("last_size"),
        F.count("*").alias("rows"),
        F.max("ts").alias("updated_at"),
    )


def _upsert_ingest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view.base(spark, sf_dir)
    return upsert_ingest_state(
        _state_rows(rows.filter(F.col("ts") < _cut())),
        _state_rows(rows.filter(F.col("ts") >= _cut())),
    )


def _ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view.unpriced(spark, sf_dir)
    listing = rows_per_file(rows, SOURCES.values()).drop("rows")
    new = rows_per_file(rows.filter(F.col("ts") >= _cut()), SOURCES.values())
    return ingest_summary(listing, new)


def _metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = view.base(spark, sf_dir).select(
        F.concat(F.lit("user:"), "user_id").alias("key"),
        F.concat_ws("-", "event_type", "id").alias("value"),
        F.col("ts").alias("updated_at"),
    )
    return metadata_upsert(
        puts.filter(F.col("updated_at") < _cut()), puts.filter(F.col("updated_at") >= _cut())
    )


# -- files --------------------------------------------------------------------------------


def _user_of_path() -> Column:
    return F.regexp_extract("source_file", r"(\d+)\.jsonl$", 1).cast("bigint")


def _folder_of_path() -> Column:
    return F.element_at(F.split("source_file", "/"), -2)


def _write_plain(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_dir(spark, "plain")
    logs.write_logs(logs.plain_files(spark, sf_dir), root)
    return root


def _discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = discover_files(spark, "claude", _write_plain(spark, sf_dir), "*.jsonl")
    return files.select(_folder_of_path().alias("folder"), _user_of_path().alias("user_id"), "size")


def _read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _write_plain(spark, sf_dir)
    files = discover_files(spark, "claude", root, "*.jsonl").select("source_file")
    paths = [r.source_file for r in files.collect()]
    lines = read_log_lines(spark, paths)
    order = Window.partitionBy("source_file").orderBy("block_start", "line_id")
    numbered = lines.withColumn("position", F.row_number().over(order))
    return numbered.select(_user_of_path().alias("user_id"), "position", "value")


def _stored(warehouse: Warehouse) -> DataFrame:
    return warehouse.events().select("event_id", "cost_usd", total_tokens().alias("tokens"))


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = logs.GrowingLogs(spark, sf_dir)
    grown.grow(2)
    warehouse = Warehouse(spark, scratch_dir(spark, "ingest"))
    ingest(spark, warehouse, grown.roots, default_rates(spark), "first")
    return _stored(warehouse)


def _ingest_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over files that grow; each event with the number of its pass."""
    grown = logs.GrowingLogs(spark, sf_dir)
    warehouse = Warehouse(spark, scratch_dir(spark, "ingest"))
    number = F
    for stage in range(3):
        grown.grow(stage)
        found = ingest(spark, warehouse, grown.roots, default_rates(spark), "first")
        number = number.when(F.col("ingest_pass") == found.ingest_pass, F.lit(stage + 1))
    return warehouse.events().select("event_id", "cost_usd", total_tokens().alias("tokens"), number.alias("pass"))


def _ingest_odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass and a stream find below folders with odd names."""
    grown = logs.GrowingLogs(spark, sf_dir)
    grown.grow(2, ["claude"])
    found = []
    for way in ("batch", "stream"):
        warehouse = Warehouse(spark, scratch_dir(spark, way))
        if way == "batch":
            ingest(spark, warehouse, {"claude": grown.roots["claude"]}, default_rates(spark))
        else:
            _drain(warehouse, ASSISTANT_LOGS, grown)
        files = warehouse.events().groupBy(_folder_of_path().alias("folder"), "source_file")
        each = files.agg(F.count("*").alias("n"), F.sum(total_tokens()).alias("t"))
        found.append(
            each.groupBy("folder")
            .agg(F.count("*").alias("files"), F.sum("n").alias("events"), F.sum("t").alias("tokens"))
            .withColumn("way", F.lit(way))
        )
    return found[0].unionByName(found[1])


# -- streams ------------------------------------------------------------------------------


def _run(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there, into a table."""
    spark = stream.sparkSession
    folder = scratch_dir(spark, label)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option(
        "path", f"{folder}/rows"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _tail_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = logs.GrowingLogs(spark, sf_dir)
    grown.grow(2)
    roots = {s.name: (grown.roots[s.name], s.glob) for s in (ASSISTANT_LOGS, ROLLOUT_LOGS)}
    lines = _run(tail_source(spark, roots).filter("mark IS NULL").drop("mark", "is_open"), "tail")
    mine = F.col("source") == ASSISTANT_LOGS.name
    both = merge.canonical_union(parse_assistant(lines.filter(mine)), rollout.parse_rollout(lines.filter(~mine)))
    return merge.dedup_first(both).select("event_id", total_tokens().alias("tokens"))


def _drain(warehouse: Warehouse, source: Source, grown: logs.GrowingLogs) -> None:
    """Take what a source has now, in micro-batches."""
    rates = default_rates(warehouse.spark)
    checkpoint = f"{warehouse.root}/checkpoint-{source.name}"
    root = grown.roots[source.name]
    stream_ingest(warehouse.spark, warehouse, source, root, rates, checkpoint, None).awaitTermination()


def _streamed(spark: SparkSession, sf_dir: str, sources: list[Source], rewritten: bool = False) -> Warehouse:
    """The logs as a stream took them, after each third of the events."""
    grown = logs.GrowingLogs(spark, sf_dir, rewritten)
    warehouse = Warehouse(spark, scratch_dir(spark, "stream"))
    for stage in range(3):
        grown.grow(stage, [s.name for s in sources])
        for source in sources:
            _drain(warehouse, source, grown)
    return warehouse


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(_streamed(spark, sf_dir, [ASSISTANT_LOGS, ROLLOUT_LOGS]))


def _stream_rollout_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts that grow, some of them written anew, as a stream reads them."""
    events = _events(_streamed(spark, sf_dir, [ROLLOUT_LOGS], rewritten=True).events())
    return events.withColumn("source_file", F.concat(F.lit("/logs/"), F.substring_index("source_file", "/", -1)))


def _stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, [ASSISTANT_LOGS, ROLLOUT_LOGS]).summary()
    batch = (F.dense_rank().over(Window.partitionBy("source").orderBy("ingest_pass")) - 1).alias("batch")
    return rows.select(*[c for c in rows.columns if c != "ingest_pass"], batch)


def _stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, [ASSISTANT_LOGS, ROLLOUT_LOGS], rewritten=True).rejects()
    name = F.substring_index("source_file", "/", -1).alias("file")
    return rows.groupBy(name, "reason").agg(F.count("*").alias("lines"))


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view.event_stream(spark, sf_dir)
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return _run(rollups.stream_dedup(copies).select("event_id", "ts"), "dedup")


def _priced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price(view.event_stream(spark, sf_dir), default_rates(spark))


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(rollups.stream_daily(_priced_stream(spark, sf_dir), view.TZ), "daily")


def _stream_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(rollups.stream_burn(_priced_stream(spark, sf_dir), view.LIMIT_5H), "burn")


# -- reports ------------------------------------------------------------------------------


def _burn(columns: list[str]) -> Query:
    return _on_usage(
        lambda u: windows.burn(u, view.AS_OF, view.LIMIT_5H, view.LIMIT_WEEK).select(*columns)
    )


def _daily(step: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_usage(lambda u: step(daily.daily_burn(u, view.TZ, DAYS, view.AS_OF)))


def _values(step: Callable[[DataFrame], DataFrame]) -> Query:
    return _daily(lambda d: step(series.select_metric(d, "cost")))


def _some_windows(usage: DataFrame) -> DataFrame:
    now = instant(view.AS_OF)
    return windows.window_totals(
        usage,
        {
            "last_12h": F.col("ts") >= before(now, hours=12),
            "last_3d": F.col("ts") >= before(now, days=3),
            "never": F.col("ts") < instant("1990-01-01"),
        },
    )


def queries() -> dict[str, Query]:
    unpriced = view.unpriced
    return {
        "pricing_key": _query(
            lambda s, d: unpriced(s, d).select("event_id", pricing.pricing_key().alias("rate_key"))
        ),
        "rate_lookup": _query(_rate_lookup()),
        "rate_lookup_book": _query(_rate_lookup(_many_rates)),
        "rate_lookup_joined": _query(_rate_lookup(max_broadcast=0)),
        "event_cost": _on_usage(lambda u: u.select("event_id", "cost_usd")),
        "load_rates": _query(_loaded_rates),
        "reprice": _query(_reprice),
        "parse_assistant": _query(
            lambda s, d: _events(parse_assistant(view.transcript_lines(s, d)))
        ),
        "parse_rollout": _query(
            lambda s, d: _events(rollout.parse_rollout(view.rollout_lines(s, d)))
        ),
        "rollout_carry": _query(_rollout_carry),
        "dedup_first": _query(_first_transcripts),
        "canonical_union": _query(_canonical_union),
        "total_tokens": _query(
            lambda s, d: unpriced(s, d).select("event_id", total_tokens().alias("tokens"))
        ),
        "append_new_events": _query(_append_new_events),
        "changed_files": _query(_changed_files),
        "upsert_ingest_state": _query(_upsert_ingest_state),
        "ingest_summary": _query(_ingest_summary),
        "metadata_upsert": _query(_metadata_upsert),
        "quarantine": _query(
            lambda s, d: quarantine(view.transcript_lines(s, d)).select(
                "source_file", "line_id", "reason"
            )
        ),
        "discover_files": _query(_discover_files),
        "read_log_lines": _query(_read_log_lines),
        "ingest": _query(_ingest),
        "ingest_append": _query(_ingest_append),
        "ingest_odd_paths": _query(_ingest_odd_paths),
        "window_totals": _on_usage(_some_windows),
        "summary_kpis": _on_usage(lambda u: windows.summary_kpis(u, view.TZ, view.AS_OF)),
        "summary_meta": _query(lambda s, d: windows.summary_meta(unpriced(s, d))),
        "burn_windows": _on_usage(lambda u: windows.burn_windows(u, view.AS_OF)),
        "limit_utilisation": _burn(["block_5h_utilization", "week_utilization"]),
        "burn_rate": _burn(["tokens_per_hour_24h", "cost_per_hour_24h"]),
        "forecast_30d": _burn(
            ["forecast_tokens", "forecast_cost", "daily_avg_tokens", "daily_avg_cost"]
        ),
        "hours_to_limit": _burn(["hours_to_limit"]),
        "gauge": _burn(["block_5h_fill", "block_5h_hot", "week_fill", "week_hot"]),
        "by_provider": _on_usage(breakdowns.by_provider),
        "by_model": _on_usage(lambda u: breakdowns.by_model(u).drop("cache_hit_ratio")),
        "cache_hit_ratio": _on_usage(
            lambda u: breakdowns.by_model(u).select("provider", "model", "cache_hit_ratio")
        ),
        "by_project": _on_usage(breakdowns.by_project),
        "project_label": _query(
            lambda s, d: unpriced(s, d)
            .select("project")
            .distinct()
            .withColumn("label", project_label(F.col("project")))
        ),
        "top_sessions": _on_usage(breakdowns.top_sessions),
        "top_turns": _on_usage(breakdowns.top_turns),
        "daily_by_provider": _on_usage(
            lambda u: daily.daily_by_provider(u, view.TZ, DAYS, view.AS_OF)
        ),
        "daily_combined": _on_usage(lambda u: daily.daily_combined(u, view.TZ, DAYS, view.AS_OF)),
        "daily_burn": _daily(lambda d: d),
        "select_metric": _daily(lambda d: series.select_metric(d, "tokens")),
        "moving_avg_7": _values(series.moving_avg_7),
        "moving_avg_7_tokens": _daily(
            lambda d: series.moving_avg_7(series.select_metric(d, "tokens"))
        ),
        "daily_burn_kept": _query(_daily_burn_kept),
        "by_project_sketch": _query(_by_project_sketch),
        "color_bucket": _values(series.color_bucket),
        "panel_totals": _daily(series.panel_totals),
        "calendar_grid": _daily(lambda d: series.calendar_grid(d, DAYS)),
        "tail_source": _query(_tail_source),
        "stream_ingest": _query(_stream_ingest),
        "stream_rollout_carry": _query(_stream_rollout_carry),
        "stream_summary": _query(_stream_summary),
        "stream_rejects": _query(_stream_rejects),
        "stream_dedup": _query(_stream_dedup),
        "stream_daily": _query(_stream_daily),
        "stream_burn": _query(_stream_burn),
    }
