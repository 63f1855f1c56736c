"""Listing of log folders in tasks.

Folders are rows. A task lists those it was dealt and what it finds below them, up to a number of
folders; the folders it has not come to are dealt again, to all tasks. So a wide or deep tree
is spread over the cluster after the first round, and a small one takes one job. Every file
counts: hidden ones, empty ones, and names with glob characters.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meterlake.plans.session import scratch_dir
from meterlake.sources.local import local_table
from meterlake.sources.ranges import locate, plain_root

#: Folders one task lists before it hands back the rest.
FOLDERS = 256

_FOUND = "path string, is_folder boolean, size bigint, mtime timestamp"
_FOLDER = StructType([StructField("path", StringType())])


def entries(path: str) -> list[tuple[str, bool, int, dt.datetime | None]]:
    """(path, is folder, size, mtime) of what is directly in a folder; a file is itself.

    Nothing if it does not exist, or has gone since it was found.
    """
    from pyarrow import fs

    filesystem, inner = locate(path)
    own = filesystem.get_file_info(inner)
    if own.type == fs.FileType.NotFound:
        return []
    infos = [own]
    if own.type == fs.FileType.Directory:
        infos = filesystem.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    kinds = (fs.FileType.File, fs.FileType.Directory)
    return [
        (prefix + i.path, i.type == fs.FileType.Directory, max(i.size or 0, 0), i.mtime)
        for i in infos
        if i.type in kinds
    ]


def _list_some(glob: str, most: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = deque(p for b in batches for p in b.column("path").to_pylist())
        listed = 0
        while folders and listed < most:
            found = entries(folders.popleft())
            listed += 1
            folders.extend(path for path, is_folder, _, _ in found if is_folder)
            files = [f for f in found if not f[1] and fnmatch.fnmatchcase(f[0].rsplit("/", 1)[-1], glob)]
            yield _as_batch(files)
        yield _as_batch([(path, True, 0, None) for path in folders])

    return work


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["path", "is_folder", "size", "mtime"]
    )


def discover_files(
    spark: SparkSession, source: str, root: str, glob: str, folders_per_task: int = FOLDERS
) -> DataFrame:
    """Every file below ``root`` whose name fits ``glob``, with size and mtime (schema ``LISTING``).

    A missing root is empty; a root that is a file is that file. Letters of the glob count as
    they are. What cannot be listed stops the pass.
    """
    tasks = spark.sparkContext.defaultParallelism
    frontier = local_table(spark, [(plain_root(root),)], _FOLDER)
    rounds = []
    while True:
        path = scratch_dir(spark, "listing")
        frontier.mapInArrow(_list_some(glob, folders_per_task), _FOUND).write.parquet(path)
        found = spark.read.schema(_FOUND).parquet(path)
        rounds.append(found.filter(~F.col("is_folder")))
        rest = found.filter("is_folder").select("path")
        if rest.isEmpty():
            break
        frontier = rest.repartition(tasks)
    return reduce(DataFrame.union, rounds).select(
        F.lit(source).alias("source"), F.col("path").alias("source_file"), "size", "mtime"
    )
