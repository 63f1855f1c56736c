"""Longest-prefix lookup as a search in disjoint intervals.

The strings that begin with a prefix are an interval of the byte order, and the intervals of two
prefixes are nested or apart. So a set of prefixes cuts all strings into intervals that each have
one longest prefix. The cuts are worked out once, on the driver, from a configuration table; the
rows meet them in a broadcast join on a key and find theirs by bisection, inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

_LAST, _SURROGATES = 0x10FFFF, (0xD800, 0xE000)


@dataclass(frozen=True)
class Book:
    """What holds for the texts under one key."""

    #: For rows without a text.
    default: Any
    #: (start, value), ascending, from the empty text on: the value holds up to the next start.
    marks: list[tuple[str, Any]]


def after(prefix: str) -> str | None:
    """The least text above all that begin with ``prefix``; None if there is none."""
    while prefix:
        code = ord(prefix[-1])
        prefix = prefix[:-1]
        if code < _LAST:
            code += 1
            return prefix + chr(_SURROGATES[1] if code == _SURROGATES[0] else code)
    return None


def flatten(prefixes: dict[str, Any], default: Any) -> Book:
    """Value of the longest prefix of any text, as disjoint intervals."""
    marks: list[tuple[str, Any]] = [("", default)]
    held: list[tuple[str | None, Any]] = [(None, default)]

    def mark(start: str, value: Any) -> None:
        if marks[-1][0] == start:
            marks.pop()
        marks.append((start, value))

    def close(upto: str | None) -> None:
        while len(held) > 1 and held[-1][0] is not None and (upto is None or held[-1][0] <= upto):
            end, _ = held.pop()
            mark(end, held[-1][1])

    for prefix in sorted(prefixes):
        close(prefix)
        mark(prefix, prefixes[prefix])
        held.append((after(prefix), prefixes[prefix]))
    while len(held) > 1:
        close(None)
        if len(held) > 1:  # an interval without an end
            held.pop()
    return Book(default, marks)


def combine(one: Book, other: Book, value: Callable[[Any, Any], Any]) -> Book:
    """``value`` of what two books say about each text; neighbours that agree are one interval."""
    marks: list[tuple[str, Any]] = []
    left, right = dict(one.marks), dict(other.marks)
    a = b = None
    for start in sorted(left.keys() | right.keys()):
        a, b = left.get(start, a), right.get(start, b)
        found = value(a, b)
        if not marks or marks[-1][1] != found:
            marks.append((start, found))
    return Book(value(one.default, other.default), marks)


def find(
    rows: DataFrame, books: dict[str, Book], key: str, text: str, kind: DataType, absent: Any, name: str
) -> DataFrame:
    """Add ``name``: the value of ``text`` in the book of ``key``, ``absent`` without a book.

    The join is a broadcast one, so the number of marks must be bounded by the caller. The
    search takes one projection per doubling of the longest book, all in one compiled stage.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    columns = StructType(
        [
            StructField("_book_key", StringType()),
            StructField("_starts", ArrayType(StringType())),
            StructField("_values", ArrayType(kind)),
            StructField("_default", kind),
        ]
    )
    listed = [
        list(books),
        [[start for start, _ in book.marks] for book in books.values()],
        [[value for _, value in book.marks] for book in books.values()],
        [book.default for book in books.values()],
    ]
    arrays = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(listed, columns)]
    table = spark.createDataFrame(pa.table(arrays, columns.fieldNames()), columns)
    found = rows.join(F.broadcast(table), F.col(key) == F.col("_book_key"), "left")
    found = found.withColumn("_place", F.lit(0))
    longest = max((len(book.marks) for book in books.values()), default=1)
    for step in reversed(range((longest - 1).bit_length())):
        half = F.lit(1 << step)
        ahead = F.get("_starts", F.col("_place") + half) <= F.col(text)
        found = found.withColumn("_place", F.col("_place") + F.when(ahead, half).otherwise(F.lit(0)))
    hit = F.when(F.col(text).isNotNull(), F.get("_values", F.col("_place")))
    value = F.coalesce(hit, F.col("_default"), _literal(absent, kind))
    return found.withColumn(name, value).drop(*columns.fieldNames(), "_place")


def _literal(value: Any, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value.values(), kind)])
    return F.lit(value).cast(kind)
