"""SimHash with DataFrame expressions, shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A 64-bit sum counts four bits of the fingerprint, in lanes 16 bits wide. One bit of a lane
#: stays free for the comparison with the half, one so that sums stay positive.
WIDTH, SUMS, MARK = 16, 16, 14
_ONES = sum(1 << (WIDTH * lane) for lane in range(64 // WIDTH))
_BYTES, _EVEN = 0x0101010101010101, 0x00FF00FF00FF00FF
#: Features whose counts a lane can hold, and those a lane of 8 bits can.
MOST, FEW = (1 << MARK) - 1, 127
#: Features whose counts a lane of 8 bits can hold with a bit free for the comparison.
LEAST = 63


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it. A
    column made by ``withColumn`` would be put in for each reference, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _lanes(hashes: Column) -> list[Column]:
    """Counts over at most FEW hashes, in lanes 8 bits wide: half the sums for each hash. Each
    sum is a plain number of its own; a struct of them would be made anew for each hash."""
    zero, ones = F.lit(0).cast("long"), F.lit(_BYTES)

    def lane(k: int) -> Column:
        return F.aggregate(hashes, zero, lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(ones))

    return [lane(k) for k in range(8)]


def _narrow(hashes: Column) -> Column:
    counted = F.struct(*[lane.alias(f"s{k}") for k, lane in enumerate(_lanes(hashes))])
    return F.struct(F.size(hashes).cast("long").alias("n"), counted.alias("c"))


def _short(hashes: Column) -> Column:
    """Fingerprint of at most LEAST hashes, in narrow lanes alone: a free bit marks the half."""
    lift = (F.lit(LEAST).cast("long") - F.floor(F.size(hashes) / 2)) * F.lit(_BYTES)
    parts = []
    for k, lane in enumerate(_lanes(hashes)):
        mark = (lane + lift).bitwiseAND(F.lit(_BYTES * (LEAST + 1)))
        parts.append(F.shiftrightunsigned(mark, 6 - k) if k <= 6 else F.shiftleft(mark, k - 6))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fingerprint(sums: Column) -> Column:
    """The bits that more than half of the features have; ``sums`` are s0, s1, ... and n."""
    lift = (F.lit(MOST).cast("long") - F.floor(sums["n"] / 2)) * F.lit(_ONES)
    marks = [(sums[f"s{k}"] + lift).bitwiseAND(F.lit(_ONES << MARK)) for k in range(SUMS)]
    parts = [
        F.shiftrightunsigned(m, MARK - k) if k <= MARK else F.shiftleft(m, k - MARK)
        for k, m in enumerate(marks)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _vote(hashes: Column) -> Column:
    names = [f"s{k}" for k in range(SUMS)]
    zero = F.struct(*[F.lit(0).cast("long").alias(s) for s in (*names, "n")])
    starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FEW).cast("int"))
    parts = F.transform(starts, lambda c: let(F.slice(hashes, c * FEW + 1, F.lit(FEW)), _narrow))

    def add(sums: Column, part: Column) -> Column:
        wide = [part["c"][f"s{k}"].bitwiseAND(F.lit(_EVEN)) for k in range(8)]
        wide += [F.shiftrightunsigned(part["c"][f"s{k}"], 8).bitwiseAND(F.lit(_EVEN)) for k in range(8)]
        counted = [(sums[s] + w).alias(s) for s, w in zip(names, wide, strict=True)]
        return F.struct(*counted, (sums["n"] + part["n"]).alias("n"))

    return F.aggregate(parts, zero, add, fingerprint)


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of an array of hashes. Arrays longer than a lane can count vote in
    chunks, and the chunks' fingerprints vote again."""

    def voted(all_: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / MOST).cast("int"))
        voted_each = F.transform(chunks, lambda c: let(F.slice(all_, c * MOST + 1, F.lit(MOST)), _vote))
        return (
            F.when(F.size(all_) <= LEAST, _short(all_))
            .when(F.size(all_) <= MOST, _vote(all_))
            .otherwise(let(voted_each, _vote))
        )

    return let(hashes, voted)


def block(f: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(f, offset).bitwiseAND(F.lit((1 << width) - 1))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))
