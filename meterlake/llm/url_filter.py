"""URL filters (operator 5): all wildcard rules run at once in a bit-parallel automaton.

Each rule becomes two globs over the canonical URL (lower-cased host, then path): the host
itself and any subdomain. The globs are packed one after the other into Shift-And masks of as
many 64-bit words as they need; one step over a byte is a shift with carry, an AND with the
byte's mask and an OR of the states that a ``*`` keeps alive. A batch of URLs steps together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import ascii_lower

#: Bytes of padded URLs that step together.
BLOCK_BYTES = 4 << 20


class Rule(NamedTuple):
    """``action`` for URLs of ``host`` and its subdomains whose path starts with ``path``.

    ``*`` in the host stands for any run without a slash, in the path for any run.
    """

    action: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


class ShiftAnd:
    """Globs as masks: ``step`` for literal bytes, ``stay`` for the runs of ``*``."""

    def __init__(self, rules: Sequence[Rule]):
        # The longest rule first, the earlier one among equals.
        self.rules = sorted(rules, key=lambda r: -len(r.label.encode()))
        globs = []
        for number, rule in enumerate(self.rules):
            for prefix in (b"", b"*."):
                globs.append((number, prefix + rule.host.encode(), rule.path.encode() + b"*"))
        bits = sum(1 + len((h + p).replace(b"*", b"")) for _, h, p in globs)
        self.words = max(1, -(-bits // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.ends = []  # (rule, word, mask) of each glob's last state
        self.open_ends = np.zeros(self.words, np.uint64)
        at = 0
        for number, host, path in globs:
            self._set(self.start, at)
            for part, whole in ((host, False), (path, True)):
                for byte in part:
                    if byte == ord("*"):
                        self._set(self.stay[:], at, None if whole else ord("/"))
                    else:
                        at += 1
                        self._set(self.step[byte], at)
            self.ends.append((number, at // 64, np.uint64(1 << (at % 64))))
            self._set(self.open_ends, at)
            at += 1

    @staticmethod
    def _set(masks: np.ndarray, at: int, but: int | None = None) -> None:
        word, bit = at // 64, np.uint64(1 << (at % 64))
        if masks.ndim == 1:
            masks[word] |= bit
            return
        masks[:, word] |= bit
        if but is not None:
            masks[but, word] &= ~bit

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """Number of the best rule of each URL, -1 if none fits."""
        found = np.full(len(urls), -1, np.int64)
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # URLs of like length share a block, so padding stays small.
            longest = max(1, 2 * int(lengths[order[at]]), 64)
            upto = int(np.searchsorted(lengths[order], longest, "right"))
            block = order[at : min(upto, at + max(1, BLOCK_BYTES // longest))]
            found[block] = self._match([urls[i] for i in block], lengths[block])
            at += len(block)
        return found

    def _match(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        width = int(lengths.max(initial=0))
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in urls), np.uint8)
        text = text.reshape(len(urls), width).T
        live = np.tile(self.start, (len(urls), 1))
        last = live.copy() if not width else np.zeros_like(live)
        last[lengths == 0] = self.start
        one, top = np.uint64(1), np.uint64(63)
        for i in range(width):
            moved = live << one
            moved[:, 1:] |= live[:, :-1] >> top
            byte = text[i]
            live = (moved & self.step[byte]) | (live & self.stay[byte])
            done = lengths == i + 1
            last[done] = live[done]
            if not (live & ~self.open_ends).any():
                # Only open ends are alive: they stay as they are on any further byte.
                rest = lengths > i + 1
                last[rest] = live[rest]
                break
        best = np.full(len(urls), len(self.rules), np.int64)
        for number, word, mask in self.ends:
            best = np.where(last[:, word] & mask, np.minimum(best, number), best)
        return np.where(best == len(self.rules), -1, best)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row (id, host, path, rule, verdict) per page; the longest rule that fits wins.

    URLs that no rule fits get a null rule and the ``default`` verdict, so do null URLs and
    URLs without ``://`` (host and path empty). Of equally long rules the first listed wins.
    Ids may be null or repeated: every input row gives a row. Other columns are not read. An
    empty table gives an empty result.
    """
    rules = list(rules)
    if any("/" in r.host for r in rules):
        raise ValueError("a host cannot hold a slash")
    parts = pages.select(
        F.col(id_col).alias(id_col),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    id_type = dict(parts.dtypes)[id_col]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(rules)
        labels = [r.label for r in automaton.rules]
        actions = [r.action for r in automaton.rules]
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            best = automaton.match([(h + p).encode() for h, p in zip(hosts, paths, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    batch.column("host"),
                    batch.column("path"),
                    pa.array([labels[b] if b >= 0 else None for b in best], pa.string()),
                    pa.array([actions[b] if b >= 0 else default for b in best], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    schema = f"`{id_col}` {id_type}, host string, path string, rule string, verdict string"
    return parts.mapInArrow(judge, schema)
