"""Substring dedup (operator 10): repeated word sequences found by recompression.

A text's words are rewritten in rounds. A round first names runs of one symbol, then pairs: every
symbol is left or right by its name, and a left one followed by a right one becomes one symbol. A
name is a function of what it stands for, so all tasks give the same names without talking to
each other, and equal stretches of words get equal symbols except near their ends. Each window
of words is met by the longest symbol that must be in its interior whatever stands around it
(the least name of equals); windows then meet by that symbol and are compared, see ``repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import WORD, slices
from meterlake.llm.jaccard_join import WordHashes, mix
from meterlake.llm.repeats import Kind, Rolling, covered_units, keyed, packed, repeated_spans, unpacked

#: Rounds of runs and pairs.
ROUNDS = 2
_WORD = re.compile(WORD)
_HASHES = WordHashes()


def word_names(text: str | None) -> np.ndarray:
    words = _WORD.findall(text or "")
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


class Level:
    """Symbols of a batch after some steps: name, first word and document; and for each window
    the symbols [low, high) that its content alone determines."""

    def __init__(self, name: np.ndarray, first: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.first, self.doc, self.low, self.high = name, first, doc, low, high

    def _merged(self, start: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Level:
        return Level(name, self.first[start], self.doc[start], low, high)

    def runs(self) -> Level:
        """Runs of one symbol become one. The first and the last run that a window sees may go
        on outside, so they are no longer determined."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(self.name))).astype(np.uint64)
        name = self.name[start]
        name = np.where(length > 1, mix(name * np.uint64(3) + length), name)
        index = np.cumsum(new) - 1
        end = len(new) - 1
        return self._merged(
            start, name, index[np.minimum(self.low, end)] + 1, index[np.clip(self.high - 1, 0, end)]
        )

    def pairs(self, seed: int) -> Level:
        """A left symbol and the right one after it become one. At a window's edges a right
        symbol may have a partner before it and a left one behind it."""
        left = mix(self.name + np.uint64(seed)) & np.uint64(1) == 1
        second = np.zeros(len(left), bool)
        second[1:] = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])
        start = np.flatnonzero(~second)
        name = self.name[start].copy()
        has = np.append(second[1:], False)[start]
        name[has] = mix(mix(name[has]) * np.uint64(5) + self.name[start[has] + 1])
        index = np.cumsum(~second) - 1
        end = len(left) - 1
        low, last = np.minimum(self.low, end), np.clip(self.high - 1, 0, end)
        return self._merged(start, name, index[low] + ~left[low], index[last] + ~left[last])


def interior_symbols(
    units: np.ndarray, rolling: Rolling, begins: np.ndarray, sizes: np.ndarray, starts: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """First word and name of the symbol that the window at each start is met by.

    It comes from the last round that leaves a window a determined symbol; a window that never
    has one, as in long runs, is met by the name of all its words.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = starts.copy()
    name = rolling.names(starts, starts + window)
    level = Level(mix(units), np.arange(len(units)), doc, starts, starts + window)
    alive = np.ones(len(starts), bool)
    for step in range(2 * ROUNDS):
        level = level.pairs(step) if step % 2 else level.runs()
        alive &= level.low < level.high
        if not alive.any():
            break
        width = np.minimum(np.diff(np.append(level.first, len(units))), 255).astype(np.uint64)
        # Length, 24 bits of the name, then the place: the leftmost wins among equals.
        number = np.arange(len(level.name)).astype(np.uint64)
        shown = mix(level.name + np.uint64(step)) >> np.uint64(40) << np.uint64(32)
        rank = (np.uint64(255) - width << np.uint64(56)) | shown | number
        low, high = level.low[alive], level.high[alive]
        best = np.full(len(low), np.uint64(2**64 - 1))
        table, reach = rank, 1
        size = high - low
        while True:
            fits = (size >= reach) & (size < 2 * reach)
            best[fits] = np.minimum(table[low[fits]], table[high[fits] - reach])
            if 2 * reach > size.max():
                break
            table = np.minimum(table[:-reach], table[reach:])
            reach *= 2
        chosen = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place[alive] = level.first[chosen]
        name[alive] = mix(level.name[chosen] + np.uint64(step + 1))
    return place, name


def kind_of(window: int) -> Kind:
    def anchors(units, rolling, begins, sizes, starts):
        return interior_symbols(units, rolling, begins, sizes, starts, window)

    def earlier(units: np.ndarray, places: np.ndarray, order: np.ndarray) -> np.ndarray:
        # Two independent names of 64 bits stand for the words of a window.
        one, two = Rolling(mix(units)), Rolling(mix(units ^ np.uint64(0xD1B54A32D192ED03)))
        a, b = one.names(places, places + window), two.names(places, places + window)
        rank = np.lexsort((order, b, a))
        new = np.ones(len(rank), bool)
        new[1:] = (a[rank][1:] != a[rank][:-1]) | (b[rank][1:] != b[rank][:-1])
        found = np.zeros(len(rank), bool)
        found[rank] = ~new
        return found

    return Kind(window, window // 2, True, word_names, anchors, earlier)


def remove_repeats(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, n_words, n_removed, kept) per document.

    Words are runs of anything but ASCII white space, unchanged. Every word covered by a window
    of ``window`` words whose sequence also starts earlier (in a document with a smaller id, or
    before it in the same one) goes; windows are judged on the input. ``kept`` are the other
    words joined by single spaces; a null text has none. Rows that share an id but not the text
    are documents of their own in a fixed order; repeated rows are one document and get the same
    result. Rows without an id come last. Other columns are not read. An empty table gives an
    empty result. Words are told apart by 64-bit names, windows by 128.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, kind_of(window))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed"):
            sizes, removed, kept = [], [], []
            for text, found in zip(unpacked(batch.column("packed")), batch.column("spans").to_pylist(), strict=True):
                words = _WORD.findall(text or "")
                sizes.append(len(words))
                if found:
                    gone = covered_units(found, len(words)).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                removed.append(sizes[-1] - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return (
        packed(rows)
        .join(spans, "key", "left")
        .select("id", "packed", "spans")
        .mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
        .withColumn("id", F.col("id").cast(id_type))
        .withColumnRenamed("id", id_col)
    )
