"""N-gram Jaccard join (operator 6): a grouped prefix join over word shingles.

Shingles are put in one order over the whole corpus, rare ones first. Two sets that are similar
enough share a shingle among the first few of each, the prefix. Equal sets are one set; sets with
the same prefix and size form a group, and only groups are indexed. Groups that share a prefix
shingle, pass the size filter and the positional filter are expanded and their members verified
on whole sets.

Only components are asked for, so lists of many similar texts need not give all their pairs, see
``linking_pairs``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import WORD, ascii_lower, components, linking_pairs, may_hold, partitions, slices, staged

#: Counters for the order of shingles; a fixed size, so they can be sent to all tasks. More
#: shingles share a counter in a larger corpus, which coarsens the order and loses no pair.
COUNTERS, PARTS = 1 << 20, 64
#: Bytes of prefix shingles that one task gathers.
INDEX_BYTES = 16 << 20
#: Words whose hash a task remembers, and whole sets it keeps while judging pairs.
MAX_WORDS, RECENT = 500_000, 256
_WORD = re.compile(WORD)


class WordHashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles of a lower-cased text.

    With fewer words than ``size`` the whole sequence is the one shingle; without words none.
    """
    words = _WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    names = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        names = mix(names * np.uint64(0x9E3779B97F4A7C15) + each[k : len(each) - width + 1 + k])
    return np.unique(names)


def _sets(batch: pa.RecordBatch, size: int, hashes: WordHashes) -> list[np.ndarray]:
    return [shingles(t, size, hashes) for t in batch.column("text").to_pylist()]


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often each counter's shingles occur, over all texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros(COUNTERS, np.int64), WordHashes()
        for batch in slices(batches, "text"):
            for found in _sets(batch, size, hashes):
                np.add.at(counts, (found & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        parts = counts.astype(np.uint32).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(PARTS), pa.int32()),
                pa.array([int(counts.sum() % PARTS)] * PARTS, pa.int32()),
                pa.array([p.tobytes() for p in parts], pa.binary()),
            ],
            names=["part", "salt", "counts"],
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in group.counts)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"part": [group.part.iloc[0]], "salt": [0], "counts": [total.tobytes()]})

    kind = "part int, salt int, counts binary"
    parts = texts.select("text").mapInArrow(count, kind)
    # Twice, so that no task adds up the counters of all tasks.
    summed = parts.groupBy("part", "salt").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind)
    rows = sorted(summed.collect(), key=lambda r: r.part)
    if not rows:
        return np.zeros(COUNTERS, np.uint32)
    return np.frombuffer(b"".join(bytes(r.counts) for r in rows), np.uint32)


def similar_components(
    docs: DataFrame,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row (id, n_shingles, component_id) per document.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Two documents link if
    ``den * intersection >= num * union`` of their sets of ``size``-word shingles; a document
    with fewer words has its whole sequence as one shingle. ``component_id`` is the smallest id
    reachable by links, itself included. A null text or one without words has an empty set and
    links with nothing. Rows that share an id are one node; a null id is never the smallest, and
    a component of such rows alone is null. Other columns are not read. An empty table gives an
    empty result. Shingles and sets are told apart by 64-bit names.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), ascii_lower(F.col(text_col)).alias("text")
    ).withColumn("key", F.xxhash64("id", "text"))
    order = spark.sparkContext.broadcast(shingle_counts(texts, size))

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            sets = _sets(batch, size, hashes)
            prefixes = []
            for found in sets:
                keep = len(found) + (num * -len(found)) // den + 1 if len(found) else 0
                counts = order.value[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]
                prefixes.append(found[np.lexsort((found, counts))[:keep]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_name(s) for s in sets], pa.int64()),
                    pa.array([_name(p, len(s)) for p, s in zip(prefixes, sets, strict=True)], pa.int64()),
                    pa.array([p.tobytes() for p in prefixes], pa.binary()),
                ],
                names=["id", "key", "n", "sid", "gid", "prefix"],
            )

    rows = staged(texts.mapInArrow(sort, "id long, key long, n long, sid long, gid long, prefix binary"), "prefixes")
    members = staged(
        rows.filter("n > 0")
        .groupBy("sid", "n")
        .agg(F.min("id").alias("low"), F.min("key").alias("key"), F.min("gid").alias("gid")),
        "sets",
    )
    index = _shared_lists(rows, members)
    links = linking_pairs(
        index, _fits(num, den), lambda pairs: _verified(pairs, texts, members, size, num, den)
    )
    found = components(links)
    named = members.join(found.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "low", F.coalesce("component", "sid").alias("component")
    )
    # Rows that share an id are one node: join their sets' components by that id as well.
    lows = named.groupBy("component").agg(F.min("low").alias("least"))
    per_set = named.join(lows, "component").select("sid", "least")
    joined = rows.join(per_set, "sid", "left").select(
        "id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("least")
    )
    return _same_ids(joined).select(
        F.col("id").cast(id_type).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("least").cast(id_type).alias("component_id"),
    )


def _same_ids(rows: DataFrame) -> DataFrame:
    """Joins the components of rows that share an id."""
    split = (
        rows.filter("id IS NOT NULL AND least IS NOT NULL")
        .groupBy("id")
        .agg(F.min("least").alias("src"), F.max("least").alias("dst"))
        .filter("src <> dst")
    )
    if split.isEmpty():
        return rows
    all_pairs = rows.select(F.col("id").alias("src"), F.col("least").alias("dst"))
    merged = components(all_pairs.filter("src IS NOT NULL AND dst IS NOT NULL"))
    return rows.join(merged.withColumnRenamed("node", "least"), "least", "left").select(
        "id", "n", F.coalesce("component", "least").alias("least")
    )


def _name(found: np.ndarray, size: int = 0) -> int:
    digest = blake2b(found.tobytes(), digest_size=8, salt=size.to_bytes(8, "little"))
    return int.from_bytes(digest.digest(), "little", signed=True)


def _shared_lists(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(token, sid, n, pos) of the prefix shingles that more than one group has, and of the
    groups that have more than one member.

    The index is dealt by token, packed many entries to a row; a batch sends a group once.
    """
    entries = rows.agg(F.sum(F.length("prefix"))).first()[0] or 0
    parts = max(partitions(rows.sparkSession), -(-entries // INDEX_BYTES))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids, first = np.unique(batch.column("gid").to_numpy(), return_index=True)
            prefixes = batch.column("prefix").take(pa.array(first)).to_pylist()
            found = [np.frombuffer(p, np.uint64) for p in prefixes]
            if not found:
                continue
            sizes = np.array([len(f) for f in found])
            tokens = np.concatenate(found)
            group = np.repeat(np.arange(len(found), dtype=np.uint32), sizes)
            pos = (np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            n = batch.column("n").to_numpy()[first]
            task = (mix(tokens) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            cuts = np.flatnonzero(np.diff(task[order])) + 1
            pieces = [p for p in np.split(order, cuts) if len(p)]
            blobs = []
            for piece in pieces:
                own, local = np.unique(group[piece], return_inverse=True)
                blobs.append(pickle.dumps((tokens[piece], gids[own], n[own], local.astype(np.uint32), pos[piece]), 5))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task[p[0]] for p in pieces], pa.int32()), pa.array(blobs, pa.binary())],
                names=["part", "blob"],
            )

    def several(group: pa.Table) -> pa.Table:
        held = [pickle.loads(b) for b in group.column("blob").to_pylist()]
        tokens = np.concatenate([h[0] for h in held])
        gids, n = (np.concatenate([h[c][h[3]] for h in held]) for c in (1, 2))
        pos = np.concatenate([h[4] for h in held])
        order = np.lexsort((gids, tokens))
        tokens, gids, n, pos = tokens[order], gids[order], n[order], pos[order]
        new_token = np.append(True, tokens[1:] != tokens[:-1])
        fresh = new_token | np.append(True, gids[1:] != gids[:-1])
        tokens, gids, n, pos, new_token = tokens[fresh], gids[fresh], n[fresh], pos[fresh], new_token[fresh]
        size = np.diff(np.append(np.flatnonzero(new_token), len(tokens)))
        keep = np.repeat(size > 1, size)
        return pa.table(
            {
                "token": tokens[keep].astype(np.int64), "gid": gids[keep], "n": n[keep],
                "pos": pos[keep].astype(np.int32),
            }
        )

    shared = staged(
        rows.filter("n > 0")
        .select("gid", "n", "prefix")
        .mapInArrow(deal, "part int, blob binary")
        .groupBy("part")
        .applyInArrow(several, "token long, gid long, n long, pos int"),
        "index",
    )
    within = (
        members.groupBy("gid", "n")
        .agg(F.count("*").alias("members"))
        .filter("members > 1")
        .select(F.col("gid").alias("token"), "gid", "n", F.lit(0).alias("pos"))
    )
    return staged(
        shared.union(within).join(members.select("gid", "sid"), "gid").select("token", "sid", "n", "pos"),
        "lists",
    )


def _fits(num: int, den: int) -> Callable:
    """Size filter and positional filter of two sets at their first common prefix shingle."""

    def fits(one: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
        need = F.ceil((one("n") + other("n")) * num / F.lit(num + den) - 1e-9)
        size = F.least(one("n"), other("n")) * den >= F.greatest(one("n"), other("n")) * num
        return size & (F.least(one("n") - one("pos"), other("n") - other("pos")) >= need)

    return fits


def _verified(pairs: DataFrame, texts: DataFrame, members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs that link, judged on the whole sets, made again from one text of each.

    Texts travel compressed, which takes a third of the room of the sets; texts of no pair are
    left where they are. They are found by a hash of id and text, so that sets which only rows
    without an id hold are judged too.
    """
    sids = pairs.select(F.col("src").alias("sid")).union(pairs.select("dst")).distinct()
    wanted = staged(
        members.join(sids, "sid", "left_semi").select("key", "sid"),
        "wanted",
    )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text"):
            texts = [squeeze(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.binary())], names=["key", "packed"])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, expand = WordHashes(), zstandard.ZstdDecompressor().decompress

        @lru_cache(RECENT)
        def whole(packed: bytes) -> np.ndarray:
            return shingles(expand(packed).decode(), size, hashes)

        for batch in batches:
            keep = []
            for src, dst, a, b in zip(*(batch.column(c).to_pylist() for c in ("src", "dst", "a", "b")), strict=True):
                x, y = whole(a), whole(b)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                similar = den * both >= num * (len(x) + len(y) - both)
                # Texts that share a hash may bring one of another set.
                keep.append(similar and _name(x) == src and _name(y) == dst)
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    found = staged(
        may_hold(texts.filter("text IS NOT NULL"), wanted, "key")
        .filter("listed")
        .select("key", "text")
        .mapInArrow(pack, "key long, packed binary")
        .join(wanted, "key")
        .groupBy("sid")
        .agg(F.first("packed").alias("packed")),
        "texts",
    )
    a = found.select(F.col("sid").alias("src"), F.col("packed").alias("a"))
    b = found.select(F.col("sid").alias("dst"), F.col("packed").alias("b"))
    return pairs.join(b, "dst").join(a, "src").select("src", "dst", "a", "b").mapInArrow(judge, "src long, dst long")
