"""One ingest pass: changed log files to new rows of the fact table."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import schema
from meterlake.operators.merge import canonical_union, dedup_first
from meterlake.operators.pricing import price
from meterlake.operators.rollout import carry_state
from meterlake.plans.reprice import RepriceResult, reprice_if_needed
from meterlake.plans.session import scratch_dir
from meterlake.plans.store import Warehouse, new_pass_id
from meterlake.sources.files import changed_files, not_blank
from meterlake.sources.listing import discover_files
from meterlake.sources.ranges import read_ranges
from meterlake.sources.registry import SOURCES, Source

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class IngestResult:
    ingest_pass: str
    #: source, files_scanned, files_with_new_rows, events_inserted
    summary: DataFrame
    #: rejected lines (schema REJECT)
    rejects: DataFrame
    pricing: RepriceResult


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rows_per_file(rows: DataFrame, sources: Iterable[Source]) -> DataFrame:
    """Number of rows by (source, source_file), one aggregation."""
    source = reduce(
        lambda chain, s: chain.when(F.col("tool") == s.tool, F.lit(s.name)), sources, F
    )
    return rows.groupBy(source.alias("source"), "source_file").agg(F.count("*").alias("rows"))


def ingest_summary(
    listing: DataFrame, new_rows: DataFrame, sources: Iterable[str] = ()
) -> DataFrame:
    """Per source: files scanned, files that gave new rows, events inserted.

    ``new_rows`` is the output of :func:`rows_per_file`. Sources named here have a row even
    without files.
    """
    counted = (
        listing.join(new_rows, ["source", "source_file"], "left")
        .groupBy("source")
        .agg(
            F.count("*").alias("files_scanned"),
            F.count("rows").alias("files_with_new_rows"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("events_inserted"),
        )
    )
    names = [(name,) for name in sources]
    if not names:
        return counted
    every = listing.sparkSession.createDataFrame(names, "source string")
    return every.join(counted, "source", "left").na.fill(0)


def stage(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Write rows to a shared folder and read them back: cuts lineage, gives sizes."""
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def resume_points(listing: DataFrame, state: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Changed files with the byte to read on from (``start``), else 0.

    A file that became shorter is read again from its first byte. With ``carry`` (files whose
    records depend on earlier ones) so is a file that changed without growing, and one whose
    carried state is not that of the stored offset.
    """
    changed = changed_files(listing, state)
    known = state.select("source_file", "last_offset", "last_size")
    found = changed.join(known, "source_file", "left")
    grown = F.col("size") >= F.col("last_size")
    if carry is not None:
        held = carry.select("source_file", F.col("last_offset").alias("_carried"))
        found = found.join(held, "source_file", "left")
        grown = (F.col("size") > F.col("last_size")) & (F.col("_carried") == F.col("last_offset"))
    start = F.coalesce(F.when(grown, F.col("last_offset")), F.lit(0).cast("bigint"))
    return found.select("source", "source_file", "size", "mtime", start.alias("start"))


def unread_files(records: DataFrame) -> DataFrame:
    """(source_file, failure): files of which some range could not be read."""
    failed = records.filter(F.col("mark.failure").isNotNull())
    return failed.groupBy("source_file").agg(F.min("mark.failure").alias("failure"))


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("source_file"), "source_file", "left_anti")


def reject_rows(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reason").isNotNull()).select(*schema.REJECT.fieldNames())


@dataclass(frozen=True)
class SourcePass:
    """What one source gives to a pass."""

    listing: DataFrame
    #: Files that were read, with size and mtime as listed.
    read: DataFrame
    records: DataFrame
    events: DataFrame
    #: State of contextual files after the pass, without offset.
    carry: DataFrame | None


def _read_source(
    spark: SparkSession, source: Source, root: str, state: DataFrame, carry: DataFrame, folder: str
) -> SourcePass:
    listing = discover_files(spark, source.name, root, source.glob)
    carry = carry if source.contextual else None
    files = stage(spark, resume_points(listing, state, carry), f"{folder}/files-{source.name}")
    lines = not_blank(read_ranges(files))
    records = stage(spark, source.records(lines), f"{folder}/records-{source.name}")
    unread = unread_files(records).collect()
    if unread:
        # It stays changed and is tried again in the next pass.
        for row in unread[:20]:
            log.warning("%s: not read: %s: %s", source.name, row.source_file, row.failure)
        left_out = unread_files(records)
        records, files = without_files(records, left_out), without_files(files, left_out)
    if carry is None:
        return SourcePass(listing, files, records, source.events(records), None)
    resumed = files.filter(F.col("start") > 0).select("source_file")
    seed = stage(
        spark,
        carry.select(*schema.CARRY.fieldNames()).join(resumed, "source_file", "left_semi"),
        f"{folder}/seed-{source.name}",
    )
    return SourcePass(listing, files, records, source.events(records, seed), carry_state(records, seed))


def ingest(
    spark: SparkSession,
    warehouse: Warehouse,
    roots: dict[str, str],
    rates: DataFrame,
    pricing_hash: str | None = None,
    sources: dict[str, Source] = SOURCES,
) -> IngestResult:
    """Read what was added below ``roots`` (source name to folder) and append new events.

    Each file is read on from the byte where the last pass ended; what its records carry
    forward is stored with that byte. The JSON text is parsed once, into staged narrow records;
    everything after reads those. Costs are brought up to date first. Repeating a pass, or
    running it again after a failure, adds nothing twice: ids already stored are left out.
    """
    pricing = reprice_if_needed(warehouse, rates, pricing_hash)
    if pricing_hash is None:
        warehouse.forget_rates()
    ingest_pass, version = new_pass_id(), warehouse.version()
    folder = scratch_dir(spark, f"ingest-{ingest_pass}")
    state, carry = warehouse.ingest_state(version), warehouse.carry(version)
    chosen = [s for s in sources.values() if s.name in roots]
    if not chosen:
        raise ValueError(f"no known source in {sorted(roots)}, expected {sorted(sources)}")
    passes = [_read_source(spark, s, roots[s.name], state, carry, folder) for s in chosen]

    batch = price(dedup_first(canonical_union(*[p.events for p in passes])), rates)
    batch = stage(spark, batch, f"{folder}/events")
    warehouse.append_events(warehouse.new_events(batch, ingest_pass, version), ingest_pass, version)

    written = warehouse.events(version).filter(F.col("ingest_pass") == ingest_pass)
    counts = rows_per_file(written, sources.values())
    read = _union([p.read for p in passes])
    carries = [p.carry for p in passes if p.carry is not None]
    if carries:
        after = _union([p.read for p in passes if p.carry is not None]).join(
            _union(carries), "source_file", "left"
        )
        warehouse.append_carry(
            after.withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))
            .withColumn("last_offset", F.col("size"))
            .withColumn("updated_at", F.current_timestamp()),
            version,
        )
    warehouse.append_state(
        read.join(counts, ["source", "source_file"], "left").select(
            "source_file",
            F.col("size").alias("last_offset"),
            F.col("mtime").alias("last_mtime"),
            F.col("size").alias("last_size"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.current_timestamp().alias("updated_at"),
        ),
        ingest_pass,
        version,
    )
    summary = ingest_summary(_union([p.listing for p in passes]), counts, [s.name for s in chosen])
    rejects = _union([reject_rows(p.records) for p in passes])
    return IngestResult(ingest_pass, summary, rejects, pricing)
