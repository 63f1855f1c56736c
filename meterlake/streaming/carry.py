"""What rollout files carry forward on a stream, as state kept by file.

A micro-batch brings some more records of a file. Its model, session, directory and running
number so far are an entry of the state; a file that is read from its first byte starts over, as
the markers of the source say, whether or not its first records are of use. An entry goes when a
file has been quiet for longer than the source remembers it, for then it is read from the start
again. A stream can begin with the state that batch passes stored.

The key is a hash group of files, its state a map by file: the records of all files of a group are
carried through together, so a batch of many small files costs by its records and not a frame
a file. The records of one group in one batch meet in one task: they are narrow, and the source
bounds the bytes of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterlake import schema
from meterlake.operators.rollout import session_of_name

PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
#: Keyed state with expiry needs this store, which also spills to disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Hash groups of files. State is stored by group, so a checkpoint holds for this number alone.
GROUPS = 1024

_FILE = StructType([StructField("source_file", StringType())])
_STATE = StructType(
    [
        StructField("model", StringType()),
        StructField("session", StringType()),
        StructField("cwd", StringType()),
        StructField("ordinal", LongType()),
    ]
)
_CARRIED = {"model": "model_set", "session": "session_set", "carried_cwd": "cwd"}
_MARK = {"read_to": "bigint", "restarted": "boolean", "failure": "string"}


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def carry_files(rows: pd.DataFrame, held: dict[str, tuple]) -> tuple[pd.DataFrame, dict[str, tuple]]:
    """The records of some files in one batch with what they inherit, and the state of each after
    them. ``held`` is the state before; files that are not there, or begin anew, have none."""
    rows = rows.sort_values(["source_file", "line_id"], kind="stable").reset_index(drop=True)
    files = rows["source_file"].to_numpy(object)
    first = np.flatnonzero(np.append(True, files[1:] != files[:-1]))
    last = np.append(first[1:], len(rows)) - 1
    place = np.repeat(np.arange(len(first)), last - first + 1)
    anew = rows["restarted"].eq(True).groupby(place).any()
    none = (None, None, None, 0)
    before = [none if new else held.get(file, none) for file, new in zip(files[first], anew)]
    after = []
    for k, (name, given) in enumerate(_CARRIED.items()):
        values = rows[given].astype("string").groupby(place).ffill()
        begun = pd.Series([b[k] for b in before], dtype="string").take(place).reset_index(drop=True)
        rows[name] = values.fillna(begun).astype(object).where(lambda v: v.notna(), None)
        after.append([_text(v) for v in rows[name].to_numpy(object)[last]])
    so_far = rows["is_usage"].eq(True).astype("int64").groupby(place).cumsum().to_numpy()
    rows["ordinal"] = so_far + np.array([int(b[3]) for b in before], np.int64)[place]
    after.append(rows["ordinal"].to_numpy()[last].tolist())
    return rows, dict(zip(files[first], zip(*after)))


def carry_through(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """The records of one file in one batch with what they inherit, and the state after them."""
    found, after = carry_files(rows.assign(source_file=""), {} if held is None else {"": held})
    return found.drop(columns="source_file"), after[""]


class RolloutCarry(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("carry", _FILE, _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        records = pd.concat(list(rows))
        if records.empty:
            return
        anew = set(records.loc[records["restarted"].eq(True), "source_file"])
        found = {file: self.state.getValue((file,)) for file in records["source_file"].unique() if file not in anew}
        carried, after = carry_files(records, {file: tuple(held) for file, held in found.items() if held is not None})
        for file, state in after.items():
            self.state.updateValue((file,), state)
        yield carried.drop(columns="file_group")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        columns = [initialState[c] for c in ("source_file", "model", "session_id", "cwd", "ordinal")]
        for file, model, session, cwd, ordinal in zip(*columns):
            self.state.updateValue((file,), (_text(model), _text(session), _text(cwd), int(ordinal)))

    def close(self) -> None:
        """Nothing is held open."""


def _group() -> Column:
    return F.pmod(F.xxhash64("source_file"), F.lit(GROUPS)).cast("int").alias("file_group")


def carried_stream(records: DataFrame, idle: float, initial: DataFrame | None = None) -> DataFrame:
    """The records of a stream with ``model``, ``session_id``, ``carried_cwd`` and ``ordinal``, and
    with ``session``, the session if one was announced.

    ``initial`` (schema ``CARRY``) is the state the first batch begins with.
    """
    flat = records.select(
        *[c for c in records.columns if c not in ("ts", "mark")],
        F.unix_micros("ts").alias("ts"),
        *[F.col(f"mark.{name}").alias(name) for name in _MARK],
        F.col("mark").isNotNull().alias("marks"),
        _group(),
    )
    out = StructType(
        [
            *[field for field in flat.schema.fields if field.name != "file_group"],
            *[StructField(name, StringType()) for name in _CARRIED],
            StructField("ordinal", LongType()),
        ]
    )
    carried = flat.groupBy("file_group").transformWithStateInPandas(
        statefulProcessor=RolloutCarry(int(2 * idle * 1000) + 1),
        outputStructType=out,
        outputMode="Append",
        timeMode="ProcessingTime",
        initialState=None if initial is None else initial.select("*", _group()).groupBy("file_group"),
    )
    mark = F.when(F.col("marks"), F.struct(*_MARK))
    return carried.select(
        *[c for c in out.fieldNames() if c not in ("ts", "marks", *_MARK)],
        F.timestamp_micros("ts").alias("ts"),
        mark.alias("mark"),
        F.coalesce("session", session_of_name()).alias("session_id"),
    )


def carry_of_marks(carried: DataFrame) -> DataFrame:
    """What each file carries after a batch (schema ``CARRY`` and ``last_offset``): the last marker
    of a file stands after all its records."""
    held = F.struct(F.col("mark.read_to").alias("last_offset"), "model", F.col("session").alias("session_id"),
                    F.col("carried_cwd").alias("cwd"), "ordinal")
    last = carried.filter(F.col("mark").isNotNull()).groupBy("source_file").agg(F.max_by(held, "line_id").alias("held"))
    return last.select(*[c if c == "source_file" else f"held.{c}" for c in schema.CARRY.fieldNames()], "held.last_offset")


class state_store:
    """Streams started inside keep their state in ``PROVIDER``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER_SETTING, None)
        self.spark.conf.set(PROVIDER_SETTING, PROVIDER)

    def __exit__(self, *error) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER_SETTING)
        else:
            self.spark.conf.set(PROVIDER_SETTING, self.before)
