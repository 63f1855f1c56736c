"""Ranked lexical search for a batch of items, by hashed max-sketches.

A document's impact for a term depends on how often it holds the term and on its own length.
The impacts of a document are folded into a sketch of ``CELLS`` numbers: a term's cell is a
hash, a cell keeps the largest impact. An item's weights, added up by cell, times the sketch is
then never less than its score, and one matrix product gives these bounds for a block of
documents and all items. Documents are scored exactly by descending bound, until the bound
falls below the item's k-th best score so far.

Two passes: the first cuts the texts into terms, once, and keeps the counts of those terms that
some item holds; lengths and document frequencies come from it. The second reads these
narrow rows. Items are taken in batches of bounded size, so what is sent to the tasks is too.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from meterlake.llm.common import BATCH_BYTES, slices, staged

#: Cells of a sketch.
CELLS = 512
#: Most bytes of terms, and items, of one batch.
TERM_BYTES, ITEMS = 8 << 20, 2048
#: Bytes of text cut into terms at a time, and documents of one block.
PIECE = 1 << 20
BLOCK = 1024

# The bytes that are no part of a term, A-Z, and the numbers of the score.
_APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_APART + _UPPER, b" " * len(_APART) + _UPPER.lower())
SCALE, SATURATION, FIXED, BY_LENGTH = 1_000_000_000, 8, 10, 90


def terms_of(text: str | None, piece: int) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: a long text is cut between terms.

    Every byte of a character beyond ASCII is above 0x7F, so bytes and characters agree on what
    a term is.
    """
    if not text:
        return
    folded = text.encode().translate(_FOLD)
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + piece)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n: int, n_docs: int, n_terms: int) -> int:
    """How much a document of ``n`` terms counts as long."""
    return FIXED + (BY_LENGTH * n * n_docs) // n_terms


def counted(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with terms: ``terms`` are positions in the
    sorted ``vocabulary``, ascending; terms outside it count in ``n`` only."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: i for i, term in enumerate(shared.value)}
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, ns, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, counts = 0, Counter()
                for part in terms_of(text, PIECE):
                    n += len(part)
                    counts.update(filter(place.__contains__, part))
                if n:
                    found = sorted((place[t], c) for t, c in counts.items())
                    ids.append(doc_id)
                    ns.append(n)
                    terms.append([t for t, _ in found])
                    tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(ns, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<long>")


class Batch:
    """Items as lists of weighted terms, and their weights by sketch cell."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, cells: int = CELLS) -> None:
        self.terms = [np.array(t, np.int64) for t in items]
        self.weights = [weights[t] for t in self.terms]
        # Consecutive terms fall into different cells.
        self.cell = (np.arange(len(weights)) * 2_654_435_761) % cells
        self.by_cell = np.zeros((cells, len(items)))
        for j, t in enumerate(self.terms):
            np.add.at(self.by_cell[:, j], self.cell[t], self.weights[j])


class Leaders:
    """The best documents of every item so far: (-score, whether it lacks an id, id)."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.best: list[list[tuple]] = [[] for _ in range(n_items)]
        #: A score that a document needs to enter; 0 does not count.
        self.theta = np.ones(n_items)

    def offer(self, item: int, score: int, doc_id: int | None) -> None:
        best = self.best[item]
        bisect.insort(best, (-score, doc_id is None, doc_id or 0))
        del best[self.k :]
        if len(best) == self.k:
            self.theta[item] = -best[-1][0]


def search_block(batch: Batch, leaders: Leaders, ids: list, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> int:
    """Bring ``leaders`` up to date with the documents of one block; ``starts`` are the places
    of each in ``terms`` and ``impacts``. Returns how many scores were worked out."""
    rows = np.repeat(np.arange(len(ids)), np.diff(starts))
    sketch = np.zeros(len(ids) * len(batch.by_cell))
    np.maximum.at(sketch, rows * len(batch.by_cell) + batch.cell[terms], impacts)
    bounds = sketch.reshape(len(ids), -1) @ batch.by_cell
    scored = 0
    for item in np.flatnonzero((bounds >= leaders.theta).any(0)):
        own, own_weights = batch.terms[item], batch.weights[item]
        mine = bounds[:, item]
        at = np.flatnonzero(mine >= leaders.theta[item])
        for doc in at[np.argsort(-mine[at], kind="stable")]:
            if mine[doc] < leaders.theta[item]:
                break
            here = slice(starts[doc], starts[doc + 1])
            there = terms[here]
            place = np.minimum(np.searchsorted(there, own), len(there) - 1)
            held = there[place] == own
            score = int((own_weights[held] * impacts[here][place[held]]).sum())
            scored += 1
            if score >= leaders.theta[item]:
                leaders.offer(item, score, ids[doc])
    return scored


def _ranked(narrow: DataFrame, rows: list[Row], vocabulary: list[bytes], k: int) -> DataFrame:
    """(item_id, doc_id, score) of each task's best documents for the items of one batch."""
    spark = narrow.sparkSession
    n_docs, n_terms = narrow.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(narrow.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    place = {term: i for i, term in enumerate(vocabulary)}
    item_ids = [r.item_id for r in rows]
    items = [sorted(place[bytes(t)] for t in r.terms) for r in rows]
    shared = spark.sparkContext.broadcast((items, weights))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = Batch(*shared.value)
        leaders = Leaders(len(item_ids), k)
        for part in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            starts = np.concatenate([[0], np.cumsum(part.column("terms").value_lengths().to_numpy())])
            terms = part.column("terms").flatten().to_numpy().astype(np.int64)
            tfs = part.column("tfs").flatten().to_numpy()
            lengths = [damping(n, n_docs, n_terms) for n in part.column("n").to_pylist()]
            spread = np.repeat(np.array(lengths, np.int64), np.diff(starts))
            impacts = (SCALE * tfs) // (1000 * tfs + SATURATION * spread)
            search_block(batch, leaders, part.column("doc_id").to_pylist(), starts, terms, impacts)
        flat = [(i, x) for i, best in enumerate(leaders.best) for x in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([item_ids[i] for i, _ in flat], pa.int64()),
                pa.array([None if lacks else doc for _, (_, lacks, doc) in flat], pa.int64()),
                pa.array([-score for _, (score, _, _) in flat], pa.int64()),
            ],
            names=["item_id", "doc_id", "score"],
        )

    held = narrow.filter(F.size("terms") > 0)
    return held.mapInArrow(work, "item_id long, doc_id long, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
    A document scores the sum of weight times impact over the item's terms, once each, in
    whole numbers; the README gives the formula. Ties go to the smaller id, a document
    without one last. Each row is a document, also a repeated one. A text that is null or
    holds no term is none and does not count. Items that share an id, a null one too, are
    one item with the terms of all. Items without terms, and empty tables, give no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                for part in terms_of(text, PIECE):
                    terms = sorted(set(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"]
                    )

    source = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    by_item = staged(
        source.mapInArrow(cut, "item_id long, term binary")
        .distinct()
        .groupBy("item_id")
        .agg(F.collect_list("term").alias("terms"), F.sum(F.length("term") + 32).alias("bytes")),
        "items",
    )
    size, n_items = by_item.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    batches = max(1, -(-int(size) // TERM_BYTES), -(-n_items // ITEMS))
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(batches))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for number in range(batches):
        rows = by_item.filter(dealt == number).select("item_id", "terms").collect()
        if not rows:
            continue
        vocabulary = sorted({bytes(t) for r in rows for t in r.terms})
        narrow = staged(counted(docs, vocabulary, id_col, text_col), "terms")
        found = found.union(staged(_ranked(narrow, rows, vocabulary, k), "ranked"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
    )
