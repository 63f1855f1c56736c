"""Repeated windows across documents: what suffix-array and recompression dedup share.

A document is a sequence of units (bytes or words). Each window of a fixed length has an anchor
in it that follows from its content alone, so equal windows have equal anchors wherever they
stand. Successive windows with the same anchor form a segment. Segments are dealt by their
anchor's name, packed many to a row. Equal segments are settled by their digest; segments that
differ but may share a window (they agree on enough units left or right of the anchor) go, with
their units, through an exact comparison of windows. What is covered comes back per document.

Copies within one batch are settled there, so a passage that many documents hold sends a row
per batch and not per document.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import LAST_ID, partitions, slices, staged
from meterlake.llm.jaccard_join import mix

#: Bytes of text whose segments one task compares.
TASK_BYTES = 24 << 20
#: Bytes of text cut into segments at once; the arrays for it are about 100 times as large.
CUT_BYTES = 1 << 20
#: An odd factor (fixed value) and its inverse, for rolling names modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Kind(NamedTuple):
    """What is compared.

    ``units(text)`` gives the sequence, ``anchors(units, rolling, begins, sizes, starts)`` the
    place and name of the anchor of each window start, ``earlier(units, places, order)`` which of the windows at
    some places equal one of smaller order. ``left`` units before the anchor, or ``window - left + 1`` from it
    on, are common to any two segments that share a window. With ``within`` a later window of
    the same document is a repeat as well.
    """

    window: int
    left: int
    within: bool
    units: Callable[[str | None], np.ndarray]
    anchors: Callable[..., tuple[np.ndarray, np.ndarray]]
    earlier: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Rolling:
    """Names of stretches of a sequence, by prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        powers, inverse = np.full(n, FACTOR, np.uint64), np.full(n, INVERSE, np.uint64)
        powers[:1], inverse[:1] = 1, 1
        np.cumprod(powers, out=powers)
        np.cumprod(inverse, out=inverse)
        self.inverse = inverse
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * powers[:-1], out=self.sums[1:])

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def scatter(units: np.ndarray) -> np.ndarray:
    """Units as well-spread 64-bit values."""
    return mix(units.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): rows of the same id and text share a key."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "key", F.xxhash64("id", F.col("text").isNull(), "text")
    )


def packed(rows: DataFrame) -> DataFrame:
    """The texts compressed for a shuffle; null stays null."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("key"),
                    pa.array([None if t is None else squeeze(t.encode()) for t in texts], pa.binary()),
                ],
                names=["id", "key", "packed"],
            )

    return rows.select("id", "key", "text").mapInArrow(pack, "id long, key long, packed binary")


def unpacked(column: pa.Array) -> list[str | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return [None if p is None else expand(p).decode() for p in column.to_pylist()]


def covered_units(spans: Iterable[bytes], size: int) -> np.ndarray:
    """Mask of the units that the packed (begin, end) spans cover."""
    change = np.zeros(size + 1, np.int64)
    for blob in spans:
        begin, end = pickle.loads(blob)
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def _by_owner(owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns split by owner."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    edges = np.flatnonzero(np.diff(owner)) + 1
    parts = [np.split(c[order], edges) for c in columns]
    for i, first in enumerate(np.concatenate([[0], edges]) if len(owner) else []):
        yield int(owner[first]), [p[i] for p in parts]


def _joined_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begin) - 1]])
    return begin[new].astype(np.int64), reach[last].astype(np.int64)


def _repeated(digest: np.ndarray, order: np.ndarray, within: bool) -> np.ndarray:
    """Which segments an equal one of smaller order precedes; ``order`` sorts the rows."""
    _, inverse = np.unique(digest, return_inverse=True)
    if within:
        first = np.full(inverse.max(initial=-1) + 1, len(digest))
        np.minimum.at(first, inverse, np.arange(len(digest)))
        return np.arange(len(digest)) != first[inverse]
    least = np.full(inverse.max(initial=-1) + 1, LAST_ID, np.int64)
    np.minimum.at(least, inverse, order)
    return order > least[inverse]


def segments(kind: Kind, sequences: list[np.ndarray]) -> dict[str, np.ndarray]:
    """All segments of some documents: owner (document number), start, count, digest, name of
    the anchor, and the names ``left`` and ``right`` of it (0: too near the edge)."""
    sizes = np.array([len(s) for s in sequences])
    begins = np.cumsum(sizes) - sizes
    units = np.concatenate(sequences)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = (begins + sizes)[owner] if len(units) else np.zeros(0, np.int64)
    starts = np.flatnonzero(ends - np.arange(len(units)) >= kind.window)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return dict.fromkeys(("owner", "start", "count"), empty) | dict.fromkeys(
            ("digest", "name", "left", "right"), empty.astype(np.uint64)
        )
    rolling = Rolling(scatter(units))
    place, name = kind.anchors(units, rolling, begins, sizes, starts)
    new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(place) != 0) | (name[1:] != name[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin, place, name = starts[first], place[first], name[first]
    raw, width = memoryview(units.tobytes()), units.itemsize
    upto = begin + count - 1 + kind.window
    digest = np.fromiter(
        (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((begin * width).tolist(), (upto * width).tolist(), strict=True)),
        np.uint64,
        len(begin),
    )
    doc = owner[begin]
    low, high = begins[doc], begins[doc] + sizes[doc]
    sides = []
    for a, b in ((place - kind.left, place), (place, place + kind.window - kind.left + 1)):
        inside = (a >= low) & (b <= high)
        names = rolling.names(np.where(inside, a, 0), np.where(inside, b, 0))
        sides.append(np.where(inside, mix(names ^ name) >> np.uint64(32) | np.uint64(1), np.uint64(0)))
    return {
        "owner": doc, "start": begin - low, "count": count, "digest": digest, "name": name,
        "left": sides[0], "right": sides[1],
    }


def repeated_spans(rows: DataFrame, kind: Kind) -> DataFrame:
    """(key, spans): per document, packed (begin, end) unit spans of windows that occur earlier.

    ``rows`` are (id, key, text). Rows without an id come last in the order of documents.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // TASK_BYTES))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CUT_BYTES):
            ids = np.array([LAST_ID if i is None else i for i in batch.column("id").to_pylist()], np.int64)
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column("text").to_pylist()
            # Repeated rows are one document; documents in their order.
            rank = [i for i in np.lexsort((keys, ids)).tolist()]
            rank = [i for n, i in enumerate(rank) if not n or keys[rank[n - 1]] != keys[i] or ids[rank[n - 1]] != ids[i]]
            ids, keys = ids[rank], keys[rank]
            found = segments(kind, [kind.units(texts[i]) for i in rank])
            doc = found["owner"]
            again = _repeated(found["digest"], ids[doc], kind.within)
            out: dict[int, dict] = {}
            for d, (begin, count) in _by_owner(doc[again], found["start"][again], found["count"][again]):
                spans = _joined_spans(begin, begin + count - 1 + kind.window)
                out.setdefault(int(keys[d]) % parts, {}).setdefault("spans", []).append((int(keys[d]), *spans))
            fresh = ~again
            task = (mix(found["name"][fresh]) % np.uint64(parts)).astype(np.int64)
            columns = [found[c][fresh] for c in ("owner", "start", "count", "digest", "left", "right")]
            for part, (o, s, c, d, left, right) in _by_owner(task, *columns):
                docs, index = np.unique(o, return_inverse=True)
                out.setdefault(part, {})["segments"] = (
                    ids[docs], keys[docs], index.astype(np.uint32), s.astype(np.uint32), c.astype(np.uint32),
                    d, left.astype(np.uint32), right.astype(np.uint32),
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int32()), pa.array([pickle.dumps(b, 5) for b in out.values()], pa.binary())],
                names=["part", "blob"],
            )

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        blobs = [pickle.loads(b) for b in group.column("blob").to_pylist()]
        out = [(k, False, (b, e)) for blob in blobs for k, b, e in blob.get("spans", [])]
        held = [b["segments"] for b in blobs if "segments" in b]
        if held:
            ids, keys = (np.concatenate([h[n][h[2]] for h in held]) for n in (0, 1))
            start, count, digest, left, right = (np.concatenate([h[n] for h in held]) for n in range(3, 8))
            order = np.lexsort((start, keys, ids))
            # Repeated rows are one document, also if they came in several batches.
            a, b = order[1:], order[:-1]
            order = order[np.append(True, (ids[a] != ids[b]) | (keys[a] != keys[b]) | (start[a] != start[b]))]
            ids, keys, start, count, digest, left, right = (c[order] for c in (ids, keys, start, count, digest, left, right))
            start, count = start.astype(np.int64), count.astype(np.int64)
            again = _repeated(digest, ids, kind.within)
            _, docs = np.unique(keys, return_inverse=True)
            for d, (k, begin, n) in _by_owner(docs[again], keys[again], start[again], count[again]):
                out.append((int(k[0]), False, _joined_spans(begin, begin + n - 1 + kind.window)))
            asked = np.zeros(len(ids), bool)
            rest = np.flatnonzero(~again)
            for side in (left[rest], right[rest]):
                differ = _varied(side, digest[rest] if kind.within else ids[rest])
                asked[rest] |= (side != 0) & differ
            for d, (k, begin, n) in _by_owner(docs[asked], keys[asked], start[asked], count[asked]):
                out.append((int(k[0]), True, (begin, n)))
        return pa.table(
            {
                "key": pa.array([o[0] for o in out], pa.int64()),
                "asked": pa.array([o[1] for o in out], pa.bool_()),
                "part": pa.array([key[0].as_py()] * len(out), pa.int32()),
                "spans": pa.array([pickle.dumps(o[2], 5) for o in out], pa.binary()),
            }
        )

    first = staged(
        rows.select("id", "key", "text")
        .mapInArrow(cut, "part int, blob binary")
        .groupBy("part")
        .applyInArrow(settle, "key long, asked boolean, part int, spans binary"),
        "segments",
    )

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed"):
            out: dict[int, list] = {}
            ids, keys = batch.column("id").to_pylist(), batch.column("key").to_pylist()
            for doc, key, text, asks in zip(ids, keys, unpacked(batch.column("packed")), batch.column("asks").to_pylist(), strict=True):
                units = kind.units(text)
                for ask in asks:
                    begin, count = pickle.loads(ask["spans"])
                    taken = [units[b : b + n - 1 + kind.window] for b, n in zip(begin.tolist(), count.tolist(), strict=True)]
                    out.setdefault(ask["part"], []).append(
                        (LAST_ID if doc is None else doc, key, begin, count, np.concatenate(taken))
                    )
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int32()), pa.array([pickle.dumps(b, 5) for b in out.values()], pa.binary())],
                names=["part", "blob"],
            )

    def compare(_: tuple, group: pa.Table) -> pa.Table:
        # Repeated rows are one document.
        held = {h[1]: h for b in group.column("blob").to_pylist() for h in pickle.loads(b)}
        held = sorted(held.values(), key=lambda h: (h[0], h[1]))
        begin, count = (np.concatenate([h[n] for h in held]) for n in (2, 3))
        doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        units = np.concatenate([h[4] for h in held])
        length = count - 1 + kind.window
        base = np.cumsum(length) - length
        row = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        places = base[row] + inner
        if kind.within:
            # In the order of documents and of places in them.
            at = begin[row] + inner
            order = np.empty(len(row), np.int64)
            order[np.lexsort((at, doc[row]))] = np.arange(len(row))
        else:
            order = np.array([h[0] for h in held])[doc[row]]
        hit = np.flatnonzero(kind.earlier(units, places, order))
        out = []
        for d, (b,) in _by_owner(doc[row[hit]], begin[row[hit]] + inner[hit]):
            out.append((int(held[d][1]), _joined_spans(b, b + kind.window)))
        return pa.table(
            {
                "key": pa.array([o[0] for o in out], pa.int64()),
                "spans": pa.array([pickle.dumps(o[1], 5) for o in out], pa.binary()),
            }
        )

    asks = first.filter("asked").groupBy("key").agg(F.collect_list(F.struct("part", "spans")).alias("asks"))
    second = staged(
        packed(rows)
        .join(asks, "key")
        .mapInArrow(fetch, "part int, blob binary")
        .groupBy("part")
        .applyInArrow(compare, "key long, spans binary"),
        "windows",
    )
    # A document's spans are bounded by its length.
    return (
        first.filter("NOT asked").select("key", "spans").union(second).groupBy("key").agg(F.collect_list("spans").alias("spans"))
    )


def _varied(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which rows have a group with more than one value."""
    _, inverse = np.unique(group, return_inverse=True)
    first = np.zeros(inverse.max(initial=-1) + 1, value.dtype)
    first[inverse] = value
    varied = np.zeros(len(first), bool)
    varied[inverse[value != first[inverse]]] = True
    return varied[inverse]
