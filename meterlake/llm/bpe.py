"""Byte-level BPE (operator 4): encoding by a lazily determinised transducer, and decoding.

A token sequence is the BPE result of its bytes exactly if every neighbouring pair of tokens is
the BPE result of the pair's bytes. The nondeterministic transducer reads a byte at a time; a
state is (last token, bytes of the next one so far), and a token is closed only where it fits its
predecessor. Since every prefix has one result, the live states differ only in where the open
token began, at most a longest token back. The subset construction runs on demand: a
deterministic state keeps, per hypothesis, the tokens not yet common to all, and emits a token
as soon as all agree on it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import slices

#: Entries kept of the deterministic machine, of pairs judged and of whole pieces. They bound
#: memory only: without room a piece is encoded anew.
MAX_STATES, MAX_PAIRS, MAX_PIECES, LONGEST_KEPT = 100_000, 400_000, 600_000, 48
#: Rank of a merge that does not happen.
NEVER = 1 << 62
#: Pieces taken from a text at a time, and characters of a text that is split at spaces.
PIECES = 200_000
#: A pattern (fixed value) no match of which runs over a space that follows anything but white
#: space, so that texts can be split there first.
SPACE_FIRST = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
_SPACE_AFTER_SPACE = regex.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64, a space and the rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Transducer:
    """The encoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._edges: dict[bytes, tuple | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.finals: list[tuple[int, ...] | None] = []
        self.numbers: dict[tuple, int] = {}
        self.asked: set[tuple[int, int]] = set()
        self._number(((b"", b"", ()),))

    def _anew(self, number: int) -> int:
        kept = self.states[number]
        self._clear()
        return self._number(kept)

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.finals.append(None)
        return self.numbers[state]

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """BPE by its definition, for short strings: the lowest rank merges first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            pairs = enumerate(zip(parts, parts[1:], strict=False))
            best = min(((self.ranks[p + q], i) for i, (p, q) in pairs if p + q in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _sides(self, token: bytes) -> tuple | None:
        """What stands at the token's two ends while it is merged: (left, right) lists of
        (bytes, rank of the merge that swallows them), from single bytes to the token.
        None for a token that merging its own bytes does not give."""
        if token not in self._edges:
            found = None
            if len(token) == 1:
                found = (((token, NEVER),), ((token, NEVER),))
            else:
                parts = self.merge(token, 2)
                if len(parts) == 2 and parts[0] + parts[1] in self.ranks:
                    left, right = self._sides(parts[0]), self._sides(parts[1])
                    if left and right:
                        rank = self.ranks[token]
                        found = (
                            (*left[0][:-1], (parts[0], rank), (token, NEVER)),
                            (*right[1][:-1], (parts[1], rank), (token, NEVER)),
                        )
            self._edges[token] = found
        return self._edges[token]

    def _closes(self, last: bytes, part: bytes) -> bool:
        """Whether ``part`` is a token that may follow ``last``: no merge crosses the border.

        Both ends grow in order of rank; a pair across the border merges if its rank comes
        before the merges that would swallow its halves (of equal ranks the left one first).
        """
        pair = (last, part)
        known = self._fits.get(pair)
        if known is not None:
            return known
        sides = self._sides(part)
        fits = sides is not None
        if fits and last:
            ends, starts, a, b = self._sides(last)[1], sides[0], 0, 0
            while True:
                (left, swallows_left), (right, swallows_right) = ends[a], starts[b]
                rank = self.ranks.get(left + right, NEVER)
                if rank < swallows_left and rank <= swallows_right and rank < NEVER:
                    fits = False
                    break
                if swallows_left == swallows_right == NEVER:
                    break
                if swallows_left <= swallows_right:
                    a += 1
                else:
                    b += 1
        if len(self._fits) >= MAX_PAIRS:
            self._fits.clear()
        self._fits[pair] = fits
        return fits

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        after = []
        add = bytes([byte])
        for last, part, pending in self.states[number]:
            if part + add in self.prefixes:
                after.append((last, part + add, pending))
            if part in self.ranks and self._closes(last, part):
                after.append((part, add, (*pending, self.ranks[part])))
        first, shared = after[0][2], 0
        while shared < len(first) and all(p[shared : shared + 1] == first[shared : shared + 1] for _, _, p in after):
            shared += 1
        state = tuple(sorted((last, part, p[shared:]) for last, part, p in after))
        move = (self._number(state), first[:shared])
        self.moves[number][byte] = move
        return move

    def _final(self, number: int) -> tuple[int, ...]:
        ends = [
            (*pending, self.ranks[part])
            for last, part, pending in self.states[number]
            if part in self.ranks and self._closes(last, part)
        ]
        if len(ends) != 1:
            raise ValueError("the rank table has no single result for a string")
        self.finals[number] = ends[0]
        return ends[0]

    def _tokens(self, piece: bytes, start: int, least: int) -> list[bytes]:
        """Tokens from a place on of at least so many bytes, the shortest first."""
        found, end, ranks, prefixes = [], start + max(1, least), self.ranks, self.prefixes
        while end <= len(piece):
            part = piece[start:end]
            if part not in prefixes:
                break
            if part in ranks:
                found.append(part)
            end += 1
        return found

    def _rest(self, number: int, piece: bytes, at: int) -> list[int]:
        """Ids from a state on without determinising: the hypotheses depth first, the longest
        token before shorter ones. One path reaches the end; what failed is not tried twice."""
        failed: set[tuple[int, bytes]] = set()
        size, closes = len(piece), self._closes
        for last, part, pending in sorted(self.states[number], key=lambda h: -len(h[1])):
            start = at - len(part)
            path = [(start, last, self._tokens(piece, start, len(part)))]
            while path:
                start, last, options = path[-1]
                while options:
                    token = options.pop()
                    if closes(last, token):
                        break
                else:
                    failed.add((start, last))
                    path.pop()
                    continue
                end = start + len(token)
                if end == size:
                    tokens = [*(step[1] for step in path[1:]), token]
                    return [*pending, *map(self.ranks.__getitem__, tokens)]
                if (end, token) not in failed:
                    path.append((end, token, self._tokens(piece, end, 1)))
        raise ValueError("the rank table has no single result for a string")

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, moves, short = 0, self.moves, len(piece) <= LONGEST_KEPT
        for at, byte in enumerate(piece):
            move = moves[state].get(byte)
            if move is None:
                # The machine grows where a path is taken again; elsewhere the hypotheses
                # carry on by themselves. A full machine starts anew from its present state.
                if short and (len(self.states) >= MAX_STATES or (state, byte) not in self.asked):
                    if len(self.asked) < MAX_PAIRS:
                        self.asked.add((state, byte))
                    return out + self._rest(state, piece, at)
                if len(self.states) >= 2 * MAX_STATES:
                    state, moves = self._anew(state), self.moves
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        end = self.finals[state]
        out += self._final(state) if end is None else end
        return out


class Pieces(dict):
    """Piece to packed ids, filled on demand."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Spaced(dict):
    """What stands between two single spaces, to the packed ids of its pieces with the space
    before it."""

    def __init__(self, pieces: Pieces, pattern: regex.Pattern):
        super().__init__()
        self.pieces, self.pattern = pieces, pattern

    def __missing__(self, part: str) -> bytes:
        packed = b"".join([self.pieces[p] for p in self.pattern.findall(" " + part)])
        if len(part) <= LONGEST_KEPT:
            if len(self) >= MAX_PIECES // 2:
                self.clear()
            self[part] = packed
        return packed


def _utf8_table() -> list[list[int]]:
    """States of a UTF-8 reader: 0 between characters, -1 refused.

    1-3: that many continuation bytes to come; 4-7: the second byte is bounded, after
    E0, ED, F0, F4 (the shortest form, no surrogates, no more than U+10FFFF).
    """
    table = [[-1] * 256 for _ in range(8)]
    lead = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE1, 0xEC, 2), (0xEE, 0xEF, 2), (0xF1, 0xF3, 3)]
    lead += [(0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)]
    for low, high, state in lead:
        table[0][low : high + 1] = [state] * (high + 1 - low)
    bounds = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2)}
    bounds |= {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    for state, (low, high, then) in bounds.items():
        table[state][low : high + 1] = [then] * (high + 1 - low)
    return table


_UTF8 = _utf8_table()
_BEYOND_ASCII = regex.compile(rb"[\x80-\xff]+")


class Utf8Reader:
    """Incremental decoder: bytes in, whole characters out, an unfinished one is held back."""

    def __init__(self):
        self.held, self.state = b"", 0

    def feed(self, data: bytes) -> bytes:
        """The bytes of all characters complete by now; raises if the bytes are not UTF-8."""
        data = self.held + data
        state, complete = 0, len(data)
        if not data.isascii():
            for run in _BEYOND_ASCII.finditer(data):
                if state:
                    raise ValueError("an ASCII byte inside a character")
                for at, byte in enumerate(run.group(), run.start()):
                    if state == 0:
                        complete = at
                    state = _UTF8[state][byte]
                    if state < 0:
                        raise ValueError(f"byte {byte:#x} cannot stand here")
                if state and run.end() < len(data):
                    raise ValueError("an ASCII byte inside a character")
            if state == 0:
                complete = len(data)
        self.state, self.held = state, data[complete:]
        return data[:complete]

    def close(self) -> None:
        if self.held:
            raise ValueError("the bytes end inside a character")


class Encoder:
    """Splits texts by a pattern and encodes each match by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(Transducer(ranks))
        self.spaced = Spaced(self.pieces, self.pattern)
        self.breaks_at_spaces = pattern == SPACE_FIRST

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if self.breaks_at_spaces and len(text) <= PIECES and not _SPACE_AFTER_SPACE.search(text):
            first, *parts = text.split(" ")
            ids = [self.pieces[p] for p in self.pattern.findall(first)]
            return b"".join(ids + [self.spaced[p] for p in parts])
        out, found = [], []
        for match in self.pattern.finditer(text):
            found.append(match.group())
            if len(found) == PIECES:
                out.append(b"".join([self.pieces[p] for p in found]))
                found = []
        out.append(b"".join([self.pieces[p] for p in found]))
        return b"".join(out)


def decode_ids(ids: bytes, bytes_of: list[bytes]) -> bytes:
    """UTF-8 bytes of packed ids, checked by the incremental reader chunk by chunk."""
    reader, out = Utf8Reader(), []
    numbers = np.frombuffer(ids, "<u4")
    for start in range(0, len(numbers), PIECES):
        chunk = numbers[start : start + PIECES].tolist()
        out.append(reader.feed(b"".join([bytes_of[i] for i in chunk])))
    reader.close()
    return b"".join(out)


@cache
def _machine(packed: bytes, pattern: str) -> tuple[Encoder, list[bytes]]:
    """Kept by a Python worker from task to task."""
    lines = (line.split() for line in packed.splitlines() if line.strip())
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return Encoder(ranks, pattern), by_id


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, n_tokens, ids, decoded) per document.

    ``ids`` are the token ids as little-endian unsigned 32-bit integers, ``decoded`` the UTF-8
    bytes decoded from them again. A null or empty text has no tokens. Ids of documents may be
    null or repeated: every input row gives a row. Other columns are not read. An empty table
    gives an empty result. Texts are taken piece by piece, so a long one needs memory for
    itself and its ids only. The rank file, read by the driver, is sent to the tasks.
    """
    with open(ranks_path, "rb") as file:
        packed = docs.sparkSession.sparkContext.broadcast(file.read())
    id_type = dict(docs.dtypes)[id_col]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, by_id = _machine(packed.value, pattern)
        for batch in slices(batches, "text"):
            ids = [encoder.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([decode_ids(i, by_id) for i in ids], pa.binary()),
                ],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).mapInArrow(
        encode, f"`{id_col}` {id_type}, n_tokens long, ids binary, decoded binary"
    )
