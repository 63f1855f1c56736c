"""Exact top-k search by inner product, with vectors in buckets of like length.

Components are quantised to integers, floor(256 x), so products are exact. A bucket holds
vectors whose lengths differ by less than a fifth. For a query with the k-th best score
``theta`` so far, a vector of a bucket whose longest has length l can only enter the list if
its cosine reaches theta / (|q| l), the local threshold of the bucket:

* above 1 the bucket is pruned as a whole, before any of it is shipped;
* a low threshold says little about direction: vectors are taken by descending length, up to
  the first that is too short, and multiplied in one block;
* a high one bounds the angle: on the query's largest coordinates the unit vector must lie in
  an interval, and only vectors inside all of these are multiplied.

Thresholds come from a first round over the bucket that promises most, and rise while a task
goes on. Buckets are cut into groups of a fixed size, queries into blocks; a pair of block and
group is the unit of work, so neither a hot bucket nor many queries meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import partitions, staged

#: Bytes of one packed row of vectors and of one block of queries.
CHUNK_BYTES, BLOCK_BYTES = 1 << 20, 1 << 18
#: Bytes of the vectors of one group, which a task may hold at a time.
GROUP_BYTES = 8 << 20
#: Bytes of vectors a packing task holds, over all buckets.
HELD_BYTES = 32 << 20
#: Length classes for each doubling of the length.
CLASSES = 4
#: From this local cosine threshold on, coordinates prune; how many of them.
COSINE, COORDINATES = 0.6, 8
#: Products below this are exact in doubles.
EXACT = float(2**53)
EDGE = 2**63 - 1
#: Slack of bounds that are worked out in doubles.
SLACK = 1e-9

_PACKED = "dim int, cls int, longest double, need double, n int, ids array<long>, thetas array<double>, matrix binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, cls, length, cells) of every vector that takes part: the quantised components
    as packed doubles, the length and its class. Not those that are null or hold null or
    non-finite components."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(256.0 * flat)
            ends = np.cumsum(np.maximum(sizes, 0))
            rows: dict[str, list] = {"id": [], "dim": [], "cls": [], "length": [], "cells": []}
            for i, (vec_id, size, end) in enumerate(zip(batch.column("id").to_pylist(), sizes, ends)):
                cells = flat[end - max(size, 0) : end]
                if size < 0 or not np.isfinite(cells).all():
                    continue
                largest = float(np.abs(cells).max(initial=0.0))
                length = float(largest * np.sqrt(np.sum((cells / largest) ** 2))) if largest else 0.0
                rows["id"].append(vec_id)
                rows["dim"].append(size)
                rows["cls"].append(length_class(length))
                rows["length"].append(length)
                rows["cells"].append(cells.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["id"], pa.int64()),
                    pa.array(rows["dim"], pa.int32()),
                    pa.array(rows["cls"], pa.int32()),
                    pa.array(rows["length"], pa.float64()),
                    pa.array(rows["cells"], pa.binary()),
                ],
                names=list(rows),
            )

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return source.mapInArrow(work, "id long, dim int, cls int, length double, cells binary")


def length_class(length: float) -> int:
    """Bucket of a length: ``CLASSES`` for each doubling; vectors of zeros stand apart."""
    if length == 0:
        return -10_000
    return 10_000 if np.isinf(length) else int(np.floor(np.log2(length) * CLASSES))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, dim, cls, length, cells, theta) as rows of about ``size`` bytes of vectors of one
    dimension and class, the longest first. ``need`` is the least length that any query of the
    row still asks for, -1 if it cannot say."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        total = 0

        def flush(key: tuple) -> pa.RecordBatch:
            mine = sorted(held.pop(key), key=lambda r: -r[1])
            needs = [t / n if t > 0 and n > 0 else np.inf if t > 0 else -1.0 for _, n, _, t in mine]
            values = [[key[0]], [key[1]], [mine[0][1]], [min(needs)], [len(mine)], [[r[0] for r in mine]],
                      [[r[3] for r in mine]], [b"".join(r[2] for r in mine)]]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int64()),
                     pa.list_(pa.float64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)],
                names=["dim", "cls", "longest", "need", "n", "ids", "thetas", "matrix"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["dim"], row["cls"])
                mine = held.setdefault(key, [])
                mine.append((row["id"], row["length"], row["cells"], row["theta"]))
                total += len(row["cells"]) + 64
                if len(mine) * (8 * row["dim"] + 64) >= size:
                    total -= len(mine) * (8 * row["dim"] + 64)
                    yield flush(key)
                elif total >= HELD_BYTES:
                    for key in list(held):
                        yield flush(key)
                    total = 0
        for key in list(held):
            yield flush(key)

    return rows.mapInArrow(work, _PACKED)


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(n, dim)


def products(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in whole numbers, those
    beyond a long as the nearest one."""
    if exact:
        return queries @ vectors.T
    found = np.empty((len(queries), len(vectors)), object)
    whole = [[int(x) for x in row] for row in vectors]
    for i, query in enumerate([int(x) for x in row] for row in queries):
        for j, row in enumerate(whole):
            found[i, j] = max(-EDGE - 1, min(EDGE, sum(a * b for a, b in zip(query, row))))
    return found


class Bucket:
    """Packed vectors of one class, the longest first."""

    def __init__(self, ids: list, matrix: np.ndarray) -> None:
        self.named = np.array([i is not None for i in ids])
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.matrix = matrix
        self.lengths = _lengths(matrix)
        self._unit: np.ndarray | None = None

    def unit(self) -> np.ndarray:
        """Unit vectors, a row for each coordinate."""
        if self._unit is None:
            scale = np.where(self.lengths > 0, self.lengths, 1.0)
            self._unit = np.ascontiguousarray((self.matrix / scale[:, None]).T)
        return self._unit


def _lengths(matrix: np.ndarray) -> np.ndarray:
    largest = np.abs(matrix).max(1, initial=0.0)
    scale = np.where(largest > 0, largest, 1.0)
    return largest * np.sqrt(((matrix / scale[:, None]) ** 2).sum(1))


class Block:
    """Queries with their best candidates so far."""

    def __init__(self, ids: list[int], matrix: np.ndarray, thetas: list, k: int, cosine: float) -> None:
        self.ids, self.matrix, self.k, self.cosine = np.array(ids, np.int64), matrix, k, cosine
        self.lengths = _lengths(matrix)
        # Only a positive threshold can prune; one step down, as large whole numbers are rounded.
        self.theta = np.array([np.nextafter(t, -np.inf) if t > 0 else -np.inf for t in thetas])
        #: (score, id, whether it has one) of the best, in order.
        self.best: list[list[tuple]] = [[] for _ in ids]

    def local(self, bucket: Bucket) -> np.ndarray:
        """The cosine that a vector of the bucket needs for each query; -1 asks for nothing."""
        reach = self.lengths * bucket.lengths[0]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            cosine = np.where(self.theta > 0, self.theta / reach, -1.0)
        return np.where(np.isnan(cosine), -1.0, cosine)

    def search(self, bucket: Bucket) -> None:
        exact = bool(self.lengths.max(initial=0.0) * bucket.lengths[0] < EXACT)
        local = self.local(bucket)
        alive = local <= 1 + SLACK
        by_angle = alive & (local >= self.cosine)
        by_length = np.flatnonzero(alive & ~by_angle)
        if len(by_length):
            self._by_length(by_length, bucket, exact)
        for row in np.flatnonzero(by_angle):
            self._by_coordinates(row, local[row], bucket, exact)

    def _by_length(self, rows: np.ndarray, bucket: Bucket, exact: bool) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.theta[rows] > 0, self.theta[rows] / self.lengths[rows], -1.0)
        least = float(np.nan_to_num(need.min(), nan=-1.0)) * (1 - SLACK)
        n = int(np.searchsorted(-bucket.lengths, -least, side="right"))
        if not n:
            return
        scores = products(self.matrix[rows], bucket.matrix[:n], exact)
        # The query itself may be among the first, so one more than asked for.
        at = n - self.k - 1
        floor = np.partition(scores, at, axis=1)[:, at] if at > 0 else np.full(len(rows), -np.inf)
        for row, found, low in zip(rows, scores, floor):
            at = np.flatnonzero(found >= max(low, self.theta[row]))
            self._take(row, at, found[at], bucket)

    def _by_coordinates(self, row: int, local: float, bucket: Bucket, exact: bool) -> None:
        query = self.matrix[row] / self.lengths[row]
        angle = np.arccos(min(1.0, local))
        unit = bucket.unit()
        inside = np.arange(len(bucket.ids))
        for c in np.argsort(-np.abs(query))[:COORDINATES]:
            own = np.arccos(np.clip(query[c], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)), np.cos(max(0.0, own - angle))
            values = unit[c][inside]
            inside = inside[(values >= low - SLACK) & (values <= high + SLACK)]
        if len(inside):
            scores = products(self.matrix[[row]], bucket.matrix[inside], exact)[0]
            fits = scores >= self.theta[row]
            self._take(row, inside[fits], scores[fits], bucket)

    def _take(self, row: int, at: np.ndarray, scores: np.ndarray, bucket: Bucket) -> None:
        others = ~(bucket.named[at] & (bucket.ids[at] == self.ids[row]))
        at, scores = at[others], scores[others]
        if not len(at):
            return
        # By score, then rows without an id last, then by id: there may be many ties, as of copies.
        order = np.lexsort((bucket.ids[at], ~bucket.named[at], -scores))[: self.k]
        found = [(scores[i], int(bucket.ids[at[i]]), bool(bucket.named[at[i]])) for i in order]
        best = sorted([*self.best[row], *found], key=lambda x: (-x[0], not x[2], x[1]))[: self.k]
        self.best[row] = best
        if len(best) == self.k:
            # One step down, as large whole numbers are rounded.
            self.theta[row] = max(self.theta[row], np.nextafter(float(best[-1][0]), -np.inf))

    def rows(self) -> pa.RecordBatch:
        flat = [(int(q), x) for q, best in zip(self.ids, self.best) for x in best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([q for q, _ in flat], pa.int64()),
                pa.array([i if named else None for _, (_, i, named) in flat], pa.int64()),
                pa.array([int(s) for _, (s, _, _) in flat], pa.int64()),
            ],
            names=["query", "id", "score"],
        )


def _meet(blocks: DataFrame, groups: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the best of each block's queries in each of ``groups`` it may need."""
    spark = blocks.sparkSession
    n_groups, n_blocks = max(1, groups.count()), max(1, blocks.count())
    # Copies of a group for several blocks to use at a time, only where groups are few.
    copies = max(1, min(n_blocks, -(-partitions(spark) // n_groups)))
    salt = F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int")
    wanted = (
        blocks.select("block", "dim", "need")
        .join(groups.select("dim", F.struct("cls", "part", "longest").alias("group")), "dim")
        .filter(F.col("group.longest") >= F.col("need") * (1 - SLACK))
        .groupBy("block")
        .agg(F.collect_list("group").alias("groups"))
    )
    units = (
        blocks.join(wanted, "block")
        .withColumn("group", F.explode("groups"))
        .select("block", "dim", "group.cls", "group.part", salt.alias("salt"),
                F.col("ids").alias("queries"), "thetas", F.col("matrix").alias("sought"))
    )
    spread = chunks.join(groups.select("dim", "cls", "part"), ["dim", "cls", "part"], "left_semi").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )
    pairs = units.join(
        spread.select("dim", "cls", "part", "salt", "ids", "matrix").hint("merge"), ["dim", "cls", "part", "salt"]
    ).select("block", "dim", "queries", "thetas", "sought", "ids", "matrix")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a block and group come one after the other; if not, only thresholds suffer.
        current, block = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] != current:
                    if block:
                        yield block.rows()
                    current = row["block"]
                    sought = _matrix(row["sought"], len(row["queries"]), row["dim"])
                    block = Block(row["queries"], sought, row["thetas"], k, COSINE)
                block.search(Bucket(row["ids"], _matrix(row["matrix"], len(row["ids"]), row["dim"])))
        if block:
            yield block.rows()

    return pairs.mapInArrow(work, "query long, id long, score long")


def top_products(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of highest integer inner product for each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those with
    the query's id. Ties go to the smaller id, rows without an id last. Vectors that are null
    or hold null or non-finite components take no part (non-finite also once multiplied by
    256); those of unlike length have no product. Vectors of zeros, and empty ones among
    themselves, score 0. Repeated rows are candidates each; of queries with one id the
    smallest vector is asked for. Scores beyond a long count as the nearest one. An empty table gives an empty result; other columns are not read.
    """
    rows = staged(quantised(vectors, id_col, vector_col), "vectors")
    chunks = packed(rows.withColumn("theta", F.lit(-1.0)), CHUNK_BYTES)
    chunks = chunks.select("dim", "cls", "longest", "n", "ids", "matrix", F.xxhash64("ids", "matrix").alias("deal"))
    chunks = staged(chunks, "chunks")
    sizes = chunks.groupBy("dim", "cls").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.length("matrix")) / GROUP_BYTES)).cast("int").alias("parts")
    )
    chunks = chunks.join(sizes, ["dim", "cls"]).withColumn("part", F.pmod("deal", "parts").cast("int"))
    chunks = staged(chunks.drop("deal", "parts"), "groups")
    groups = staged(
        chunks.groupBy("dim", "cls", "part").agg(F.max("longest").alias("longest"), F.sum("n").alias("n")), "summary"
    )
    # The first round takes, for each dimension, the group of most vectors and greatest lengths.
    promise = F.struct((F.col("longest") * F.least("n", F.lit(1024))).alias("p"), "cls", "part")
    first = groups.groupBy("dim").agg(F.max(promise).alias("best")).select("dim", "best.cls", "best.part")
    first = staged(groups.join(first, ["dim", "cls", "part"], "left_semi"), "first")
    # Of queries that share an id the smallest.
    smallest = F.min(F.struct("cells", "dim", "length", "cls")).alias("v")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(smallest)
    asked = staged(asked.select("id", "v.dim", "v.cls", "v.length", "v.cells"), "queries")

    def blocks(queries: DataFrame) -> DataFrame:
        made = packed(queries, BLOCK_BYTES)
        return staged(made.withColumn("block", F.xxhash64("ids", "dim")), "blocks")

    opening = staged(_meet(blocks(asked.withColumn("theta", F.lit(-1.0))), first, chunks, k), "opening")
    lists = opening.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") == k)
    known = lists.select(F.col("query").alias("id"), F.col("score").cast("double").alias("theta"))
    ready = asked.join(known, "id", "left").na.fill(-1.0, ["theta"])
    others = groups.join(first, ["dim", "cls", "part"], "left_anti")
    # Ordered by the length they still ask for, so that a block wants few groups.
    sought = F.when(F.col("theta") > 0, F.col("theta") / F.col("length")).otherwise(F.lit(-1.0))
    ready = ready.withColumn("theta", F.when(F.col("theta") > 0, F.col("theta")).otherwise(F.lit(-1.0)))
    ready = ready.sortWithinPartitions(sought.desc()).select("id", "dim", "cls", "length", "cells", "theta")
    rest = _meet(blocks(ready), staged(others, "others"), chunks, k)
    ranked = opening.union(staged(rest, "rest")).withColumn("rank", F.row_number().over(_order()))
    return ranked.filter(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score"
    )


def _order():
    return Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
