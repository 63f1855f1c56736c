"""Collocations by dynamic itemset counting.

The corpus is staged as coded blocks of words, dealt to ``SHARDS`` shards that are scanned in a
circle. Phrases of all lengths are counted side by side: words from the start, a longer phrase
from the scan after both its parts (all but the last word, all but the first) reached the
threshold. Each is counted for exactly one full circle, so its count is exact, and the circle
ends when every phrase that was activated has completed it.

Which phrases reached the threshold, and in which scan, is a table of one byte a cell, two cells
a phrase, of a fixed size. Two phrases may share cells: then one is activated that need not be, or
earlier than need be, at the same scan everywhere, and still counted for one full circle. So a
full table costs work, never a result. Phrases are named by 128 bits, and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.llm.common import remove_folder, staged
from meterlake.plans.session import scratch_dir

SHARDS = 4
#: A part of a shard that is looked at before the rest of it.
DEALS = 16
LONGEST = 5
#: Words of a block, and bytes of text cut into words at a time.
BLOCK = 1 << 18
PIECE = 1 << 20
#: Words that a task holds in blocks not yet full, over all languages.
HELD = 1 << 20
#: Phrases that a task keeps in mind, so as not to write them out again: 16 bytes each.
WRITTEN = 1 << 22
#: Cells of the table of reached phrases, as a power of two; bits of one bitmap of them.
CELL_BITS, MAP_BITS = 24, 1 << 15

# What ends a piece, what parts words, A-Z.
_ENDS, _GAPS, _UPPER = b".,;:!?\n\x0b\x0c\r", b"\t ", bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_ENDS + _GAPS + _UPPER, b"." * len(_ENDS) + b" " * len(_GAPS) + _UPPER.lower())
#: An end, as a word: no word holds one. Its code in a block is 0.
_END = b"."

_STEP_LOW, _STEP_HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

BLOCK_SCHEMA = "lang string, starts int, n_words long, words binary, codes binary, deal int"
COUNT_SCHEMA = "len int, start int, hi long, lo long, n long"


class _Coder(dict):
    """Words as numbers in order of appearance; an end is 0."""

    def __init__(self) -> None:
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Buffer:
    """Words of one language that wait to become a block."""

    def __init__(self) -> None:
        self.coder, self.codes, self.n = _Coder(), [], 0

    def add(self, words: list[bytes]) -> None:
        self.codes.append(np.fromiter(map(self.coder.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def block(self, whole: bool) -> tuple[dict, list[bytes]]:
        """The block, and the words the next one begins with: where the text goes on, its last
        words are only there for phrases that begin before them."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        words = list(self.coder)
        starts = len(codes) if whole else max(0, len(codes) - LONGEST + 1)
        row = {
            "starts": starts,
            "n_words": int(np.count_nonzero(codes[:starts])),
            "words": b" ".join(words),
            "codes": codes.tobytes(),
        }
        return row, [words[c] for c in codes[starts:]]


def words_of(text: str, piece: int) -> Iterator[list[bytes]]:
    """Words and ends of a text, some at a time; a long text is cut between words."""
    folded = text.encode().translate(_FOLD)
    start = 0
    while start < len(folded):
        ends = [p for p in (folded.find(b" ", start + piece), folded.find(_END, start + piece)) if p >= 0]
        end = min(ends, default=len(folded))
        yield folded[start:end].replace(_END, b" . ").split()
        start = end


def coded_blocks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """The texts as blocks of coded words (``BLOCK_SCHEMA``) with their shard; a block holds words
    of one language, an end after each piece and each text."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Buffer] = {}
        number = TaskContext.get().partitionId()

        def flush(lang: str, whole: bool) -> pa.RecordBatch:
            nonlocal number
            row, left = held.pop(lang).block(whole)
            if left:
                held[lang] = _Buffer()
                held[lang].add(left)
            number += 1
            row = {"lang": lang, **row, "deal": number // SHARDS % DEALS, "shard": number % SHARDS}
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            for i in range(len(batch)):
                text, lang = batch.column("text")[i].as_py(), batch.column("lang")[i].as_py()
                if not text:
                    continue
                for words in words_of(text, PIECE):
                    buffer = held.setdefault(lang, _Buffer())
                    buffer.add(words)
                    if buffer.n >= BLOCK:
                        yield flush(lang, whole=False)
                held.setdefault(lang, _Buffer()).add([_END])
                if sum(b.n for b in held.values()) >= HELD:
                    for waiting in list(held):
                        yield flush(waiting, whole=True)
        for waiting in list(held):
            yield flush(waiting, whole=True)

    source = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")
    )
    return source.mapInArrow(work, f"{BLOCK_SCHEMA}, shard int")


def _names(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each word."""
    flat = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), np.uint64).reshape(-1, 2)
    return flat[:, 0].copy(), flat[:, 1].copy()


def reached(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The scan after which each name counts as reached, plus one; 0 where it has not been."""
    mask = np.uint64(len(table) - 1)
    one, other = table[(low & mask).astype(np.int64)], table[(high & mask).astype(np.int64)]
    return np.where((one > 0) & (other > 0), np.maximum(one, other), 0)


class Walk:
    """The phrases of a block, by length: where they begin, their names, when they were activated.

    A phrase is looked at only if both its parts have been reached.
    """

    def __init__(self, lang: str, words: bytes, codes: bytes, table: np.ndarray) -> None:
        self.table = table
        self.words = words.split(b" ")
        self.codes = np.frombuffer(codes, np.int32)
        self.word_low, self.word_high = _names(self.words)
        seed_low, seed_high = _names([b"lang " + lang.encode()])
        self.low = seed_low * _STEP_LOW + self.word_low
        self.high = seed_high * _STEP_HIGH + self.word_high

    def lengths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, places, low, high, activated, reached), words first."""
        at = np.flatnonzero(self.codes)
        low, high = self.low[self.codes[at]], self.high[self.codes[at]]
        since = np.zeros(len(at), np.int64)
        seen = reached(self.table, self.low, self.high)[self.codes[at]].astype(np.int64)
        yield 1, at, low, high, since, seen
        for length in range(2, LONGEST + 1):
            # Both parts stand one after the other and have been reached.
            joined = np.flatnonzero((at[1:] == at[:-1] + 1) & (seen[1:] > 0) & (seen[:-1] > 0))
            since = np.maximum(seen[joined], seen[joined + 1])
            at = at[joined]
            last = self.codes[at + length - 1]
            low = low[joined] * _STEP_LOW + self.word_low[last]
            high = high[joined] * _STEP_HIGH + self.word_high[last]
            seen = reached(self.table, low, high).astype(np.int64)
            seen = np.where(seen > 0, np.maximum(seen, since), 0)
            yield length, at, low, high, since, seen

    def text(self, at: int, length: int) -> bytes:
        return b" ".join(self.words[c] for c in self.codes[at : at + length])


def _distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each name, and how often it stands there; a name may come twice, rarely."""
    order = np.argsort(low, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _sent(spark: SparkSession, table: np.ndarray) -> Broadcast:
    """The table for all tasks, compressed: most of it is zeros."""
    return spark.sparkContext.broadcast(pa.compress(table.tobytes(), codec="zstd", asbytes=True))


def _received(shared: Broadcast, cell_bits: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(shared.value, 1 << cell_bits, codec="zstd", asbytes=True), np.uint8)


def count_shard(blocks: DataFrame, shared: Broadcast, scan: int) -> DataFrame:
    """Counts (``COUNT_SCHEMA`` and the language) of the phrases active in this scan, by block."""
    bits = CELL_BITS

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _received(shared, bits)
        for row in (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist()):
            walk = Walk(row["lang"], row["words"], row["codes"], table)
            for length, at, low, high, since, _ in walk.lengths():
                counting = (at < row["starts"]) & (scan < since + SHARDS)
                low, high, since = low[counting], high[counting], since[counting]
                place, n = _distinct(low, high)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["lang"]] * len(n), pa.string()),
                        pa.array(np.full(len(n), length, np.int32)),
                        pa.array(since[place].astype(np.int32)),
                        pa.array(high[place].view(np.int64)),
                        pa.array(low[place].view(np.int64)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["lang", "len", "start", "hi", "lo", "n"],
                )

    return blocks.mapInArrow(work, f"lang string, {COUNT_SCHEMA}")


def _with_cells(table: np.ndarray, names: DataFrame, value: int) -> np.ndarray:
    """The table with the cells of ``names`` set to ``value`` where they are not set yet. What comes
    to the driver is a bitmap of the cells, two megabytes at most."""
    mask = (1 << CELL_BITS) - 1
    cells = names.select(F.explode(F.array(*[F.col(c).bitwiseAND(F.lit(mask)) for c in ("lo", "hi")])).alias("cell"))
    maps = (
        cells.groupBy(F.floor(F.col("cell") / MAP_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("cell", F.lit(MAP_BITS))).alias("bits"))
        .collect()
    )
    table = table.copy()
    for bucket, bits in maps:
        held = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: len(table)]
        part = table[int(bucket) * MAP_BITS :][: len(held)]
        part[(held[: len(part)] > 0) & (part == 0)] = value
    return table


def _counts(spark: SparkSession, folder: str, threshold: int) -> DataFrame:
    """Exact counts of the phrases that reach the threshold, of all lengths."""
    table = np.zeros(1 << CELL_BITS, np.uint8)
    blocks = spark.read.schema(f"{BLOCK_SCHEMA}, shard int").parquet(folder)
    running = spark.createDataFrame([], f"lang string, {COUNT_SCHEMA}")
    scan, last, former = 0, 0, None
    while scan < last + SHARDS:
        shard = blocks.filter(F.col("shard") == scan % SHARDS)
        shared = _sent(spark, table)
        rows = running.unionByName(count_shard(shard, shared, scan))
        # Those that have come full circle below the threshold are done with.
        rows = rows.groupBy("lang", "len", "start", "hi", "lo").agg(F.sum("n").alias("n"))
        rows = rows.filter((F.col("n") >= threshold) | (F.col("start") + SHARDS > scan + 1))
        path = scratch_dir(spark, "counts")
        rows.write.option("compression", "snappy").parquet(path)
        running = spark.read.schema(rows.schema).parquet(path)
        shared.destroy()
        if former:
            remove_folder(spark, former)
        former = path
        parts = running.filter((F.col("n") >= threshold) & (F.col("len") < LONGEST))
        found = _with_cells(table, parts, scan + 1)
        if (found != table).any():
            last = scan + 1
        table = found
        scan += 1
    return running.filter(F.col("n") >= threshold).select("lang", "len", "hi", "lo", F.col("n").alias("f"))


def _texts(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(lang, len, hi, lo, phrase) of all ``names``, and a few others.

    One place of each will do. So a small part of the blocks is gone through first, then more, and
    only phrases that have not been met are written out.
    """
    spark, bits = blocks.sparkSession, CELL_BITS
    frequent = _with_cells(np.zeros(1 << bits, np.uint8), names, 1)
    first = (F.col("shard") == 0) & (F.col("deal") == 0)
    parts = [first, (F.col("shard") == 0) & (F.col("deal") > 0), *[F.col("shard") == n for n in range(1, SHARDS)]]
    found = []
    for part in parts:
        left = names
        for texts in found:
            left = left.join(texts, ["lang", "len", "hi", "lo"], "left_anti")
        table = np.where(_with_cells(np.zeros(1 << bits, np.uint8), left, 1) > 0, frequent + 1, frequent)
        if not (table > 1).any():
            break
        shared = _sent(spark, table)
        found.append(staged(_written_out(blocks.filter(part), shared, bits).distinct(), "texts"))
        shared.destroy()
    if not found:
        return names.withColumn("phrase", F.lit("")).limit(0)
    # One that only shared cells with others may have been written out again.
    return reduce(DataFrame.union, found).distinct()


def _holds(written: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which names stand in ``written``, sorted by the first half; of those that share it, one is seen."""
    if not written.size:
        return np.zeros(len(low), bool)
    at = np.minimum(np.searchsorted(written[0], low), written.shape[1] - 1)
    return (written[0][at] == low) & (written[1][at] == high)


def _written_out(blocks: DataFrame, shared: Broadcast, bits: int) -> DataFrame:
    """The phrases that the table wants written out, once a task, or again once it has written ``WRITTEN``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _received(shared, bits)
        mask = np.uint64(len(table) - 1)
        written = np.zeros((2, 0), np.uint64)
        for row in (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist()):
            walk = Walk(row["lang"], row["words"], row["codes"], table)
            for length, at, low, high, _, seen in walk.lengths():
                wanted = np.flatnonzero(seen > 0)
                cells = [table[(x[wanted] & mask).astype(np.int64)] for x in (low, high)]
                wanted = wanted[(cells[0] > 1) & (cells[1] > 1)]
                at, low, high = at[wanted], low[wanted], high[wanted]
                place, _ = _distinct(low, high)
                # Names hold the language and, but for chance, the length.
                place = place[~_holds(written, low[place], high[place])]
                held = np.concatenate([written[:, : max(0, WRITTEN - len(place))], [low[place], high[place]]], axis=1)
                written = held[:, np.argsort(held[0], kind="stable")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["lang"]] * len(place), pa.string()),
                        pa.array(np.full(len(place), length, np.int32)),
                        pa.array(high[place].view(np.int64)),
                        pa.array(low[place].view(np.int64)),
                        pa.array([walk.text(i, length).decode() for i in at[place]], pa.string()),
                    ],
                    names=["lang", "len", "hi", "lo", "phrase"],
                )

    return blocks.mapInArrow(work, "lang string, len int, hi long, lo long, phrase string")


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates at their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = (
        phrases.filter("len > 1")
        .withColumn("words", words)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
        .select(
            "lang", "phrase", F.col("f").alias("a"), "k",
            F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
            F.array_join(F.slice("words", F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("rest"),
        )
    )
    parts = phrases.select("lang", "phrase", "f")
    cuts = (
        cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
    )

    whole = {c: f"cast({c} AS decimal(19,0))" for c in "alrn"}
    score = F.expr("(1000 * {a} * {n}) DIV ({l} * {r})".format(**whole))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    found = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest)
    return found.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")


def _covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the count of the commonest phrase one word longer that holds it. If a
    longer one has as many, so has one between, and that is a candidate too."""
    words = F.split("phrase", " ")
    parts = F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("len") - 1), " "),
        F.array_join(F.slice(words, F.lit(2), F.col("len") - 1), " "),
    )
    longer = phrases.filter("len > 2").select("lang", F.explode(parts).alias("phrase"), "f")
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mine_phrases(
    docs: DataFrame,
    threshold: int = 100,
    top: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    Words are runs of anything but spaces and tabs inside a piece, with A-Z lower-cased; pieces
    end at ``.,;:!?`` and line ends. Candidates are phrases of 2 to 5 words that stand at least
    ``threshold`` times inside pieces. Of the cuts into a first part (``l`` times) and a rest
    (``r`` times) the one with the lowest score, floor(1000 a n / (l r)), counts, of equal ones the
    first; ``n`` are all words of the language. A candidate inside a longer one that is as
    frequent is dropped. Ties are ranked by ``a``, then by the bytes of the phrase.

    Null texts hold no words, a null language is ``und``. Repeated rows count each. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "blocks")
    coded_blocks(docs, lang_col, text_col).write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    blocks = spark.read.schema(f"{BLOCK_SCHEMA}, shard int").parquet(folder)
    counts = _counts(spark, folder, threshold)
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    texts = _texts(blocks, counts.select("lang", "len", "hi", "lo"))
    phrases = staged(counts.join(texts, ["lang", "len", "hi", "lo"]).select("lang", "phrase", "len", "f"), "phrases")
    kept = (
        _scored(phrases, totals)
        .join(_covered(phrases), ["lang", "phrase"], "left")
        .filter(F.coalesce("most", F.lit(0)) < F.col("a"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(best).cast("long"))
        .filter(F.col("rank") <= top)
        .select(F.col("lang").alias(lang_col), "rank", "phrase", "a", "l", "r", "n", "score")
    )
