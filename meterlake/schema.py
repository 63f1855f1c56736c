"""Fixed schemas of the engine's tables, never inferred."""

from pyspark.sql.types import (
    BinaryType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TEXT, _COUNT, _USD, _INSTANT, _DAY = (
    StringType(),
    LongType(),
    DoubleType(),
    TimestampType(),
    DateType(),
)


def _table(*columns: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns])


#: A log file as listed.
LISTING = _table(("source", _TEXT), ("source_file", _TEXT), ("size", _COUNT), ("mtime", _INSTANT))

#: One line of a log file. ``block_start`` and ``line_id`` order the lines of a file.
LINES = _table(
    ("source_file", _TEXT), ("block_start", _COUNT), ("line_id", _COUNT), ("value", _TEXT)
)

#: A usage event as the parsers produce it, before pricing.
PARSED_EVENT = _table(
    ("event_id", _TEXT),
    ("provider", _TEXT),
    ("tool", _TEXT),
    ("request_id", _TEXT),
    ("session_id", _TEXT),
    ("model", _TEXT),
    ("ts", _INSTANT),
    ("input_tokens", _COUNT),
    ("output_tokens", _COUNT),
    ("cache_creation_tokens", _COUNT),
    ("cache_read_tokens", _COUNT),
    ("cache_create_5m", _COUNT),
    ("cache_create_1h", _COUNT),
    ("reasoning_tokens", _COUNT),
    ("web_search_requests", _COUNT),
    ("web_fetch_requests", _COUNT),
    ("service_tier", _TEXT),
    ("project", _TEXT),
    ("git_branch", _TEXT),
    ("source_file", _TEXT),
)

#: The canonical fact table.
USAGE_EVENT = StructType([*PARSED_EVENT.fields, StructField("cost_usd", _USD)])

#: USAGE_EVENT as stored, with the ingest pass that wrote the row and its UTC date, the
#: partition column.
STORED_EVENT = StructType(
    [*USAGE_EVENT.fields, StructField("ingest_pass", _TEXT), StructField("event_date", _DAY)]
)

#: Which rewrite of its date a stored row belongs to, a partition column below the date.
GENERATION = StructField("generation", IntegerType())

#: Kept sums by quarter of an hour, and by project.
KEPT_DAILY = StructType(
    [
        *_table(
            ("slot", _INSTANT),
            ("provider", _TEXT),
            ("ingest_pass", _TEXT),
            *[(n, _COUNT) for n in ("micro", "pico", "tokens", "input", "output", "cache_read", "cache_creation")],
            ("written_at", _INSTANT),
            ("event_date", _DAY),
        ).fields,
        GENERATION,
    ]
)
KEPT_PROJECTS = StructType(
    [
        *_table(
            ("project", _TEXT),
            ("provider", _TEXT),
            ("ingest_pass", _TEXT),
            *[(n, _COUNT) for n in ("events", "micro", "pico", "tokens")],
            ("first_ts", _INSTANT),
            ("last_ts", _INSTANT),
            ("session_sketch", BinaryType()),
            ("written_at", _INSTANT),
            ("event_date", _DAY),
        ).fields,
        GENERATION,
    ]
)

#: Ids of the facts by hash bucket, and slices of each bucket's bitmap.
LEDGER_IDS = StructType([StructField("event_id", _TEXT), StructField("bucket", IntegerType())])
LEDGER_MAPS = StructType(
    [StructField("bucket", IntegerType()), StructField("slice", IntegerType()), StructField("bits", BinaryType())]
)

#: One row per log file: how far it was read and how many rows it has given.
INGEST_STATE = _table(
    ("source_file", _TEXT),
    ("last_offset", _COUNT),
    ("last_mtime", _INSTANT),
    ("last_size", _COUNT),
    ("rows", _COUNT),
    ("updated_at", _INSTANT),
)

#: INGEST_STATE as appended by each pass.
INGEST_STATE_LOG = StructType([*INGEST_STATE.fields, StructField("ingest_pass", _TEXT)])

#: Key/value log; the newest row of a key is its value.
METADATA = _table(("key", _TEXT), ("value", _TEXT), ("updated_at", _INSTANT))

#: Rates in USD per million tokens; a NULL prefix is the provider's default.
RATES = _table(
    ("provider", _TEXT),
    ("model_prefix", _TEXT),
    ("input", _USD),
    ("output", _USD),
    ("cache_write_5m", _USD),
    ("cache_write_1h", _USD),
    ("cache_read", _USD),
)

#: A rejected log line.
REJECT = StructType([*LINES.fields, StructField("reason", _TEXT)])

#: REJECT as stored.
STORED_REJECT = StructType([*REJECT.fields, StructField("ingest_pass", _TEXT)])

#: What a rollout file carries forward from one pass, or micro-batch, to the next.
CARRY = _table(
    ("source_file", _TEXT),
    ("model", _TEXT),
    ("session_id", _TEXT),
    ("cwd", _TEXT),
    ("ordinal", _COUNT),
)

#: CARRY as stored: it holds for the bytes of the file before ``last_offset``.
STORED_CARRY = StructType(
    [*CARRY.fields, StructField("last_offset", _COUNT), StructField("updated_at", _INSTANT)]
)

#: What one micro-batch read and gave.
SUMMARY = _table(
    ("ingest_pass", _TEXT),
    ("source", _TEXT),
    ("files_scanned", _COUNT),
    ("files_with_new_rows", _COUNT),
    ("events_inserted", _COUNT),
    ("lines_rejected", _COUNT),
    ("files_unread", _COUNT),
)
