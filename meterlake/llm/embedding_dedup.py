"""Embedding near-dedup (operator 1): spherical k-means cells and blocked cosine products.

Equal vectors are one class from the start. Centres are fitted on a bounded sample; every class
lives in the cell of its nearest centre and visits the cells whose centre is little farther, by a
margin for each two centres that leaves no link out, see ``reach``. The classes of a cell are dealt
to blocks, each one row of a stored table. Two blocks are compared if a vector of one visits the
cell of the other, and then only such vectors, in matrix products. Blocks meet in a product of the
table with itself, read by the tasks: no vector is written more than once, however many cells
it visits. A task holds its part of the table and two blocks. What it returns grows with its
vectors, not with its pairs: a count of links for each vector, and for each two blocks links that
hold their groups together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import BATCH_BYTES, components, remove_folder, settings, staged, store
from meterlake.plans.session import scratch_dir

#: Vectors the centres are fitted on, vectors aimed at per cell, most centres, rounds of k-means.
SAMPLE, CELL, MAX_CELLS, ROUNDS = 20_000, 512, 4096, 10
#: Added to the margins: more than what rounding takes from a cosine.
EPSILON = 1e-7
#: Vectors whose centres are worked out at once.
BLOCK = 1024
#: Vectors of a block, and most of the other block that meet it in one product.
RESIDENTS, VISITORS = 1024, 4096

_BLOCKS = (
    "block long, cell int, data binary, sizes array<int>, nodes array<long>, copies array<long>, "
    "own array<long>, lows array<long>, visits array<int>, keys array<binary>"
)
#: What a task needs of a block.
_MET = ("block", "cell", "data", "sizes", "nodes", "copies", "lows")


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, none of them all zero, scaled to length 1."""
    values = values.astype(float)
    values /= np.abs(values).max(1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def packed_vectors(
    dtype: np.dtype,
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors as packed numbers with a digest of their direction; null where there is none."""

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            # A null among the numbers comes as one that is not finite.
            numbers = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
            packed, keys = [], []
            for first, end in zip(np.append(0, ends[:-1]), ends):
                values = numbers[first:end].astype(float)
                size = np.abs(values).max() if len(values) else 0.0
                if not (np.isfinite(size) and size > 0):
                    packed.append(None)
                    keys.append(None)
                    continue
                values /= size
                packed.append(numbers[first:end].tobytes())
                keys.append(hashlib.sha256((values / np.sqrt(values @ values)).tobytes()).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(packed, pa.binary()), pa.array(keys, pa.binary())],
                names=["id", "vector", "key"],
            )

    return described


def unpack(vectors: Iterable[bytes], width: int, dtype: np.dtype) -> np.ndarray:
    """Packed vectors as unit rows, shorter ones padded with zeros."""
    data = b"".join(v.ljust(dtype.itemsize * width, b"\0") for v in vectors)
    return unit_rows(np.frombuffer(data, dtype).reshape(-1, width))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres; the first ``k`` distinct rows start, an empty cell keeps its centre."""
    centres = vectors[:k].copy()
    for _ in range(rounds):
        cell = nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    parts = [(vectors[i : i + rows] @ centres.T).argmax(1) for i in range(0, len(vectors), rows)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def reach(centres: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """Cosine by which each centre may be farther than ``home``'s to be visited: one row per home.

    For unit vectors u, v of homes A, B the shortfalls (u.A - u.B) and (v.B - v.A) add up to
    (u - v).(A - B), at most |u - v| |A - B|, and |u - v| is sqrt(2 - 2 cos). So with half of
    that as margin at least one of two linked vectors visits the other's cell.
    """
    own = (centres * centres).sum(1)
    squares = own[home][:, None] + own - 2 * (centres[home] @ centres.T)
    widest = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    return np.sqrt(np.maximum(squares, 0)) * widest + EPSILON


def links_of(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, row of y) whose cosine in double precision is at least ``threshold``.

    A product in single precision sorts out what is farther below than it can be wrong.
    """
    found = []
    low = threshold - (x.shape[1] + 4) * 2.0**-22
    short = x.astype(np.float32)
    for first in range(0, len(y), VISITORS):
        part = y[first : first + VISITORS]
        near = short @ part.astype(np.float32).T >= low
        count = np.count_nonzero(near)
        if count * 8 > near.size:
            row, col = np.nonzero(x @ part.T >= threshold)
        elif count:
            row, col = np.nonzero(near)
            true = np.einsum("ij,ij->i", x[row], part[col]) >= threshold
            row, col = row[true], col[true]
        else:
            continue
        found.append((row, col + first))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(part) for part in zip(*found))


def lowest(row: np.ndarray, col: np.ndarray, low_a: np.ndarray, low_b: np.ndarray) -> tuple:
    """The smallest label that each row and column of some links reaches over them."""
    linked = np.zeros((len(low_a), len(low_b)), bool)
    linked[row, col] = True
    most = np.iinfo(np.int64).max
    while linked.size:
        new_a = np.minimum(low_a, np.where(linked, low_b, most).min(1))
        new_b = np.minimum(low_b, np.where(linked, new_a[:, None], most).min(0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    return low_a, low_b


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    cell_size: int = CELL,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """One row (id, n_links, component_id, kept) per vector.

    Two vectors link if their cosine, in double precision, is at least ``threshold``; equal
    vectors always do. ``component_id`` is the smallest id reachable by links, ``kept`` marks it.
    Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing;
    nor do vectors of unlike length. A row without an id takes no part in links and is kept, with
    a null component. Rows that share an id are one node; each counts as a vector. Other columns
    are not read. An empty table gives an empty result.

    Pairs are searched in cells, see the module; no link is left out. With ``max_cells`` in use,
    cells grow with the table, and the work with their square; what is stored does not.
    """
    # Shuffled rows are not needed once a step is stored.
    with settings(vectors.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return _near_duplicates(vectors, threshold, id_col, vector_col, sample, cell_size, max_cells)


def _near_duplicates(
    vectors: DataFrame, threshold: float, id_col: str, vector_col: str, sample: int, cell_size: int, max_cells: int
) -> DataFrame:
    spark = vectors.sparkSession
    types = dict(vectors.dtypes)
    id_type = types[id_col]
    single = types[vector_col] == "array<float>"
    dtype = np.dtype(np.float32 if single else np.float64)
    described = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"),
    ).mapInArrow(packed_vectors(dtype), "id long, vector binary, key binary")
    rows = staged(described.select("id", "key"), "vectors")
    folder = scratch_dir(spark, "classes")
    classes = store(
        described.filter("key IS NOT NULL AND id IS NOT NULL")
        .groupBy("key")
        .agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        folder,
    )
    width, n = classes.agg(F.max(F.length("vector")), F.count("*")).first()
    width = (width or 0) // dtype.itemsize
    drawn = classes.orderBy("key").limit(sample).select("vector").collect()
    k = int(min(max_cells, max(1, -(-n // cell_size)), max(1, len(drawn))))
    units = unpack([r.vector for r in drawn], width, dtype) if drawn else np.zeros((0, 0))
    centres = spherical_kmeans(units, k) if drawn else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(centres)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            home = nearest(unpack(batch.column("vector").to_pylist(), width, dtype), shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int32()), *batch.columns], names=["cell", *batch.schema.names]
            )

    placed = classes.mapInArrow(settle, "cell int, key binary, node long, copies long, vector binary")
    # At most max_cells rows, so small enough to send to all.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / RESIDENTS).cast("int").alias("chunks"))
    dealt = F.pmod(F.xxhash64("key"), F.coalesce("chunks", F.lit(1))).cast("int")

    def block(key: tuple, group: pa.Table) -> pa.Table:
        cell, chunk = (k.as_py() for k in key)
        vectors_ = group.column("vector").to_pylist()
        x = unpack(vectors_, width, dtype)
        lengths = np.array([len(v) // dtype.itemsize for v in vectors_])
        nodes, copies = (group.column(c).to_numpy() for c in ("node", "copies"))
        row, col = links_of(x, x, threshold)
        true = (row != col) & (lengths[row] == lengths[col])
        row, col = row[true], col[true]
        own = np.zeros(len(x), np.int64)
        np.add.at(own, row, copies[col])
        lows, _ = lowest(row, col, nodes, nodes)
        cosines = x @ shared.value.T
        seen = cosines >= cosines[:, [cell]] - reach(shared.value, np.array([cell]), threshold)
        found = {
            "block": cell << 32 | chunk, "cell": cell, "data": b"".join(vectors_), "sizes": lengths, "nodes": nodes,
            "copies": copies, "own": own, "lows": lows, "visits": np.flatnonzero(seen.any(0)),
            "keys": group.column("key").to_pylist(),
        }
        return pa.Table.from_pylist([found], schema=_BLOCK_SCHEMA)

    blocks = staged(
        placed.join(F.broadcast(sizes), "cell", "left")
        .withColumn("chunk", dealt)
        .drop("chunks")
        .groupBy("cell", "chunk")
        .applyInArrow(block, _BLOCKS),
        "blocks",
    )
    remove_folder(spark, folder)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        last = None
        for batch in batches:
            for at in range(len(batch)):
                # A block meets many others in a row.
                if last is None or last["block"] != batch.column("a_block")[at].as_py():
                    last = _met(batch, "a_", at, width, dtype)
                a, b = last, _met(batch, "b_", at, width, dtype)
                x, y = a["units"], b["units"]
                ends = shared.value[[a["cell"], b["cell"]]]
                margin = reach(ends, np.array([0]), threshold)[0, 1]
                # Of two linked vectors at least one visits the other's cell.
                out, back = x @ ends.T, y @ ends.T
                out, back = out[:, 1] >= out[:, 0] - margin, back[:, 0] >= back[:, 1] - margin
                met = []
                for i, j in ((out, np.ones(len(y), bool)), (~out, back)):
                    i, j = np.flatnonzero(i), np.flatnonzero(j)
                    if len(i) and len(j):
                        row, col = links_of(x[i], y[j], threshold)
                        met.append((i[row], j[col]))
                row, col = (np.concatenate(part) for part in zip(*met)) if met else (np.zeros(0, int),) * 2
                true = a["sizes"][row] == b["sizes"][col]
                row, col = row[true], col[true]
                if not len(row):
                    continue
                for one, other, mine, theirs in ((a, b, row, col), (b, a, col, row)):
                    held = totals.setdefault(one["block"], np.zeros(len(one["nodes"]), np.int64))
                    np.add.at(held, mine, other["copies"][theirs])
                labels_a, i = np.unique(a["lows"][row], return_inverse=True)
                labels_b, j = np.unique(b["lows"][col], return_inverse=True)
                lows = np.concatenate(lowest(i, j, labels_a, labels_b))
                yield _found(src=np.concatenate([labels_a, labels_b]), dst=lows)
        for number, links in totals.items():
            place = np.flatnonzero(links)
            yield _found(block=np.full(len(place), number), place=place, links=links[place])

    sides = [blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in (*_MET, "visits")]) for side in "ab"]
    visited = F.array_contains("a_visits", F.col("b_cell")) | F.array_contains("b_visits", F.col("a_cell"))
    pairs = sides[0].join(sides[1].hint("shuffle_replicate_nl"), (F.col("a_block") < F.col("b_block")) & visited)
    at_once = max(1, BATCH_BYTES // max(1, 2 * RESIDENTS * width * dtype.itemsize))
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(at_once)}):
        found = staged(
            pairs.select(*[f"{side}_{c}" for side in "ab" for c in _MET]).mapInArrow(
                compare, "block long, place int, links long, src long, dst long"
            ),
            "links",
        )
    members = F.explode(F.arrays_zip("keys", "nodes", "copies", "own", "lows", F.sequence(F.lit(0), F.size("keys") - 1).alias("place")))
    members = staged(blocks.select("block", members.alias("member")).select("block", "member.*"), "members")
    links = found.filter("block IS NOT NULL").groupBy("block", "place").agg(F.sum("links").alias("met"))
    per_class = members.join(links, ["block", "place"], "left").select(
        F.col("keys").alias("key"), "copies", (F.col("own") + F.coalesce("met", F.lit(0))).alias("links")
    )
    groups = components(
        found.filter("src IS NOT NULL")
        .select("src", "dst")
        .union(members.select("nodes", "lows"))
        .union(
            rows.filter("key IS NOT NULL AND id IS NOT NULL")
            .join(members.select(F.col("keys").alias("key"), "nodes"), "key")
            .filter("id <> nodes")
            .select("id", "nodes")
        )
    )
    own = F.col("key").isNotNull() & F.col("id").isNotNull()
    return (
        rows.withColumn("key", F.when(own, F.col("key")))
        .join(per_class, "key", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").cast(id_type).alias(id_col),
            F.coalesce(F.col("links"), F.lit(0)).alias("links"),
            F.coalesce(F.col("copies") - 1, F.lit(0)).alias("others"),
            F.when(own, F.coalesce("component", "id")).otherwise(F.col("id")).cast(id_type).alias("component_id"),
        )
        .select(
            id_col,
            (F.col("links") + F.col("others")).alias("n_links"),
            "component_id",
            F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


_BLOCK_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("cell", pa.int32()),
        ("data", pa.binary()),
        ("sizes", pa.list_(pa.int32())),
        *[(name, pa.list_(pa.int64())) for name in ("nodes", "copies", "own", "lows")],
        ("visits", pa.list_(pa.int32())),
        ("keys", pa.list_(pa.binary())),
    ]
)
_FOUND_SCHEMA = pa.schema(
    [("block", pa.int64()), ("place", pa.int32()), ("links", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())]
)


def _met(batch: pa.RecordBatch, side: str, at: int, width: int, dtype: np.dtype) -> dict:
    """One block of a pair, with its unit vectors."""
    found = {c: batch.column(f"{side}{c}")[at] for c in _MET}
    held = {c: found[c].values.to_numpy() for c in ("sizes", "nodes", "copies", "lows")}
    held |= {c: found[c].as_py() for c in ("block", "cell")}
    data = np.frombuffer(found["data"].as_buffer(), dtype)
    if (held["sizes"] == width).all():
        return held | {"units": unit_rows(data.reshape(-1, width))}
    values = np.zeros((len(held["sizes"]), width), dtype)
    values[np.arange(width) < held["sizes"][:, None]] = data
    return held | {"units": unit_rows(values)}


def _found(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND_SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND_SCHEMA)
