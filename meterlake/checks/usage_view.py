"""A usage table and raw log lines derived from the ``events`` table.

Integer arithmetic only, so Spark and plain SQL compute the same values. ``id`` below is
``events.event_id``. Whole table, every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import schema

AS_OF = "2024-01-30 12:00:00"
TZ = "America/New_York"
LIMIT_5H = 2_000_000
LIMIT_WEEK = 20_000_000

#: Model by ``id % 7``, per provider.
CLAUDE_MODELS = (
    "claude-opus-4-8",
    "claude-opus-4-8",
    "claude-sonnet-4-6-20260101",
    "claude-haiku-4-5",
    "claude-something-new",
    "llama3",
    None,
)
OPENAI_MODELS = (
    "gpt-5.3-codex",
    "gpt-5.3-codex",
    "gpt-5.4-mini-2026-01-01",
    "gpt-4o",
    "o3",
    "unknown-x",
    None,
)


def _id() -> Column:
    return F.col("id")


def _by_modulo(values: tuple) -> str:
    quoted = [f"'{v}'" if v else "CAST(NULL AS STRING)" for v in values]
    return f"element_at(array({', '.join(quoted)}), CAST(id % {len(values)} AS INT) + 1)"


def usage_columns(events: DataFrame) -> DataFrame:
    """Usage columns of the ``events`` table, unpriced, plus ``id`` and ``user_id``."""
    raw = events.selectExpr(
        "event_id AS id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "user_id",
        "event_type",
        "event_id % 3 < 2 AS is_claude",
    )
    return raw.selectExpr(
        "id",
        "user_id",
        "event_type",
        "concat('ev:', id) AS event_id",
        "if(is_claude, 'claude', 'openai') AS provider",
        "if(is_claude, 'claude-code', 'codex-cli') AS tool",
        "concat('req', id) AS request_id",
        "if(id % 50 <> 0, concat('s', user_id, '-', event_type), NULL) AS session_id",
        f"if(is_claude, {_by_modulo(CLAUDE_MODELS)}, {_by_modulo(OPENAI_MODELS)}) AS model",
        "ts",
        "(id * 37) % 2000 AS input_tokens",
        "(id * 53) % 1500 AS output_tokens",
        "if(is_claude, (id * 71) % 3000, 0L) AS cache_creation_tokens",
        "(id * 97) % 20000 AS cache_read_tokens",
        "if(is_claude AND id % 4 <> 0, (id * 71) % 3000, 0L) AS cache_create_5m",
        "if(is_claude AND id % 4 = 0, (id * 71) % 3000, 0L) AS cache_create_1h",
        "if(is_claude, 0L, (id * 13) % 400) AS reasoning_tokens",
        "id % 5 AS web_search_requests",
        "id % 3 AS web_fetch_requests",
        "if(is_claude, 'standard', NULL) AS service_tier",
        "if(user_id % 12 <> 0, concat('/home/u/p', user_id % 12), NULL) AS project",
        "'main' AS git_branch",
        "concat('/logs/u', user_id, '.jsonl') AS source_file",
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet")
    return usage_columns(stream.parquet(sf_dir)).select(*schema.PARSED_EVENT.fieldNames())


def unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view in the schema of parsed events."""
    return base(spark, sf_dir).select(*schema.PARSED_EVENT.fieldNames())


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores before the text work, if the table has fewer files than cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines of the claude events: sibling copies, odd numbers, torn lines.

    Per event 1 + id % 3 copies. Variations by ``id``: request id missing (% 11 = 0),
    message id missing (% 13 = 0), other record type (% 23 = 0), no timestamp (% 29 = 0),
    all counts zero (% 17 = 0), input as text (% 5 = 0), output as fraction (% 7 = 1), no
    cache split (% 6 = 1), split without total (% 10 = 2), basic timestamp (% 8 = 3), first
    copy torn (% 19 = 0), second copy an array (% 31 = 0).
    """
    rows = _spread(base(spark, sf_dir).filter(F.col("provider") == "claude"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), (1 + _id() % 3).cast("int"))))
    idle = _id() % 17 == 0

    def count(name: str) -> Column:
        return F.when(idle, F.lit(0)).otherwise(F.col(name))

    split = F.struct(
        F.col("cache_create_5m").alias("ephemeral_5m_input_tokens"),
        F.col("cache_create_1h").alias("ephemeral_1h_input_tokens"),
    )
    usage = F.struct(
        count("input_tokens").alias("input_tokens"),
        count("output_tokens").alias("output_tokens"),
        F.when(_id() % 10 != 2, count("cache_creation_tokens")).alias("cache_creation_input_tokens"),
        count("cache_read_tokens").alias("cache_read_input_tokens"),
        F.when(_id() % 6 != 1, split).alias("cache_creation"),
        F.struct("web_search_requests", "web_fetch_requests").alias("server_tool_use"),
        "service_tier",
    )
    basic = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    record = F.to_json(
        F.struct(
            F.when(_id() % 23 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("type"),
            F.concat_ws("-", F.lit("uuid"), "id", "copy").alias("uuid"),
            F.when(_id() % 11 != 0, F.col("request_id")).alias("requestId"),
            F.col("session_id").alias("sessionId"),
            F.when(_id() % 29 != 0, F.when(_id() % 8 == 3, basic).otherwise(_stamp(F.col("ts")))).alias(
                "timestamp"
            ),
            F.col("project").alias("cwd"),
            F.col("git_branch").alias("gitBranch"),
            F.struct(
                F.when(_id() % 13 != 0, F.concat(F.lit("msg"), "id")).alias("id"),
                "model",
                usage.alias("usage"),
            ).alias("message"),
        )
    )
    number = '"input_tokens":([0-9]+)'
    fraction = '"output_tokens":([0-9]+)'
    torn = (_id() % 19 == 0) & (F.col("copy") == 1)
    array = (_id() % 31 == 0) & (F.col("copy") == 2)
    line = F.col("line")
    return (
        rows.select("id", "copy", "source_file", record.alias("line"))
        .withColumn("line", _varied(_id() % 5 == 0, F.regexp_replace(line, number, '"input_tokens":"$1"')))
        .withColumn("line", _varied(_id() % 7 == 1, F.regexp_replace(line, fraction, '"output_tokens":$1.9')))
        .withColumn("line", _varied(torn, F.left(line, F.length(line) - 4)))
        .withColumn("line", _varied(array, F.concat(F.lit("["), line, F.lit("]"))))
        .select(
            "source_file",
            (F.col("copy") * 1000).cast("bigint").alias("block_start"),
            (_id() * 10 + F.col("copy")).alias("line_id"),
            # As lines of a file would be: nothing is pushed below a generator's output.
            F.explode(F.array(line)).alias("value"),
        )
    )


def _varied(condition: Column, variant: Column) -> Column:
    return F.when(condition, variant).otherwise(F.col("line"))


def rollout_file() -> Column:
    """One rollout file per user; every third has no session id in its name."""
    padded = F.lpad(F.col("user_id").cast("string"), 12, "0")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), padded)
    return F.when(
        F.col("user_id") % 3 == 0, F.concat(F.lit("/logs/rollout-u"), "user_id", F.lit(".jsonl"))
    ).otherwise(F.concat(F.lit("/logs/rollout-2024-01-01T00-00-00-"), uuid, F.lit(".jsonl")))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout lines of the openai events, in blocks of 500 ids.

    Up to three lines per event: a session record (id % 10 = 0, its id empty if id % 20 =
    0), a model record (id % 4 = 0), and the usage record, whose running totals must be
    ignored. Counts are zero where id % 17 = 0; cached exceeds the input at times; text
    where id % 5 = 0.
    """
    rows = _spread(base(spark, sf_dir).filter(F.col("provider") == "openai"))
    stamp = _stamp(F.col("ts"))

    def tagged(kind: str, payload: Column) -> Column:
        return F.to_json(
            F.struct(F.lit(kind).alias("type"), stamp.alias("timestamp"), payload.alias("payload"))
        )

    def count(value: Column) -> Column:
        return F.when(_id() % 17 == 0, F.lit(0)).otherwise(value)

    meta = tagged(
        "session_meta",
        F.struct(
            F.when(_id() % 20 == 0, F.lit("")).otherwise(F.concat(F.lit("m"), "id")).alias("id"),
            F.col("project").alias("cwd"),
        ),
    )
    context = tagged("turn_context", F.struct("model", F.col("project").alias("cwd")))
    usage = tagged(
        "event_msg",
        F.struct(
            F.lit("token_count").alias("type"),
            F.struct(
                F.struct(
                    count(F.col("input_tokens")).alias("input_tokens"),
                    F.col("cache_read_tokens").alias("cached_input_tokens"),
                    count(F.col("output_tokens")).alias("output_tokens"),
                    F.col("reasoning_tokens").alias("reasoning_output_tokens"),
                ).alias("last_token_usage"),
                F.struct(
                    (_id() * 1000).alias("input_tokens"), (_id() * 500).alias("output_tokens")
                ).alias("total_token_usage"),
            ).alias("info"),
        ),
    )
    as_text = F.regexp_replace(usage, '"reasoning_output_tokens":([0-9]+)', '"reasoning_output_tokens":"$1"')
    usage = F.when(_id() % 5 == 0, as_text).otherwise(usage)
    lines = F.array(
        F.when(_id() % 10 == 0, F.struct(F.lit(0).alias("k"), meta.alias("value"))),
        F.when(_id() % 4 == 0, F.struct(F.lit(1).alias("k"), context.alias("value"))),
        F.struct(F.lit(2).alias("k"), usage.alias("value")),
    )
    return (
        rows.withColumn("line", F.explode(F.array_compact(lines)))
        .select(
            rollout_file().alias("source_file"),
            (F.floor(_id() / 500) * 100000).cast("bigint").alias("block_start"),
            (_id() * 10 + F.col("line.k")).alias("line_id"),
            F.col("line.value").alias("value"),
        )
    )
