"""Reading schema-less JSON log lines.

Only the fields that are asked for are materialised. Numbers are read as VARIANT and cast,
because the logs may hold them as text, fractions, booleans or null (``"12"``, ``3.9`` -> 3,
``true`` -> 1), where a numeric JSON schema gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text forms of values that count as "nothing there".
_EMPTY = ("", "[]", "{}")

_STRICT = {"allowSingleQuotes": "false"}


def _in_array(value: Column) -> Column:
    return F.concat(F.lit("["), value, F.lit("]"))


def parse(lines: DataFrame, fields: str) -> DataFrame:
    """Add ``record``, a struct of ``fields`` (DDL), NULL where the line is no JSON object.

    The line is parsed as the one element of an array: the parser would otherwise accept
    an object followed by anything else, such as the torn begin of the next line.
    """
    parsed = F.from_json(_in_array(F.col("value")), f"ARRAY<STRUCT<{fields}>>", _STRICT)
    whole = F.when(F.size("_parsed") == 1, F.get("_parsed", F.lit(0)))
    return lines.withColumn("_parsed", parsed).withColumn("record", whole).drop("_parsed")


def reject_reason() -> Column:
    """Why a line has no ``record``, NULL where it has one."""
    is_json = F.try_parse_json(_in_array(F.col("value"))).isNotNull()
    return F.when(
        F.col("record").isNull(),
        F.when(is_json, F.lit("not_an_object")).otherwise(F.lit("not_json")),
    )


def filled(text: Column) -> Column:
    """A text, NULL where it is empty."""
    return F.nullif(text, F.lit(""))


#: No request has more tokens than this: a larger count is no count. Sums of counts up to it,
#: and their cost, stay far inside a BIGINT.
MAX_COUNT = 10**12


def count(number: Column) -> Column:
    """A VARIANT as a whole number; missing, null, empty and absurd ones count as 0."""
    whole = F.try_variant_get(number, "$", "bigint")
    usable = whole.between(F.lit(-MAX_COUNT), F.lit(MAX_COUNT))
    return F.when(usable, whole).otherwise(F.lit(0).cast("bigint"))


def any_bad_count(*numbers: Column) -> Column:
    """True where one of the VARIANTs holds something that is no count of MAX_COUNT or less.

    A null or empty value is no number either but counts as 0, so the few lines with an
    unread value get a closer look.
    """

    def bad(number: Column) -> Column:
        text = F.try_variant_get(number, "$", "string")
        whole = F.try_variant_get(number, "$", "bigint")
        unread = whole.isNull() | ~whole.between(F.lit(-MAX_COUNT), F.lit(MAX_COUNT))
        return F.coalesce(unread & text.isNotNull() & ~text.isin(*_EMPTY), F.lit(False))

    unread = F.lit(False)
    for number in numbers:
        whole = F.try_variant_get(number, "$", "bigint")
        unread = unread | (
            number.isNotNull()
            & (whole.isNull() | ~whole.between(F.lit(-MAX_COUNT), F.lit(MAX_COUNT)))
        )
    return unread & F.exists(F.array(*numbers), bad)


def may_hold(value: Column, *words: str) -> Column:
    """Cheap test on the raw text that never misses a record with one of ``words``.

    JSON can spell a letter only literally or as ``\\uXXXX``, so a line with neither the
    word nor such an escape cannot hold it. Lines that are not a closed object pass too:
    they are torn and belong to the rejects.
    """
    test = F.lit(False)
    for word in words:
        test = test | value.contains(word)
    return test | value.contains("\\u") | ~F.rtrim(value).endswith("}")


def is_mark(rows: DataFrame) -> Column:
    """Whether a row is no line but marks a byte range that was read."""
    return F.col("mark").isNotNull() if "mark" in rows.columns else F.lit(False)


def range_columns(rows: DataFrame) -> list[str]:
    """Columns of lines read by byte range that parsed records keep."""
    return [c for c in ("is_open", "mark") if c in rows.columns]


def keep(rows: DataFrame, condition: Column) -> DataFrame:
    """Filter on parsed fields, after parsing.

    Spark would push the condition below the projection it refers to and so parse every
    line twice. It never does that across a projection that reads the task's position.
    """
    placed = rows.withColumn("_task", F.spark_partition_id())
    return placed.filter(condition & (F.col("_task") >= 0)).drop("_task")


#: The ISO-8601 forms that are accepted, extended and basic.
_DAY = r"\d{4}(-\d{2}(-\d{2})?)?"
_TIME = r"\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?"
_ZONE = r"(Z|z|[+-]\d{2}(:?\d{2})?)?"
_EXTENDED = rf"^{_DAY}$|^\d{{4}}-\d{{2}}-\d{{2}}[T ]{_TIME}{_ZONE}$"
_BASIC = rf"^\d{{8}}([T ]\d{{2}}(\d{{2}}(\d{{2}}([.,]\d{{1,9}})?)?)?{_ZONE})?$"
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?($|[T ].*$)"
_END_OF_DAY = r"^(\d{4}-\d{2}-\d{2})[T ]24:00((?::00(?:[.,]0+)?)?(?:[Zz]|[+-].*)?)$"
#: Zone after hours or minutes, which the default parser does not take.
_SHORT_FORMAT = "yyyy-MM-dd'T'HH[:mm][XXX][X]"
_BASIC_FORMAT = "yyyyMMdd['T'HH[mm[ss[.SSSSSSSSS]]]][XXX][X]"
#: The spellings that nearly all lines have; none of the rewriting below touches them.
_USUAL = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):\d{2}:\d{2}(\.\d{1,9})?Z$"
_USUAL_BASIC = r"^\d{8}T\d{6}Z$"


def iso_timestamp(value: Column) -> Column:
    """Instant of an ISO-8601 text, NULL if it is none; without a zone it is UTC.

    Extended (``2026-06-18T12:00:00.5Z``) and basic (``20260618T120000Z``) forms and their
    mixture, week dates, date only, hour only, 24:00, and offsets with or without a colon.
    The usual spellings are read at once, the others rewritten first: in a lambda, for Spark
    would work out for every row what the rewriting has in common with the rest.
    """
    return (
        F.when(value.rlike(_USUAL), _extended_instant(value))
        .when(value.rlike(_USUAL_BASIC), F.try_to_timestamp(value, F.lit(_BASIC_FORMAT)))
        .otherwise(F.element_at(F.transform(F.array(value), _any_instant), 1))
    )


def _any_instant(value: Column) -> Column:
    given = _plain_time(_week_as_day(value))
    midnight = F.regexp_replace(given, _END_OF_DAY, "$1T00:00$2")
    instant = _iso_instant(midnight)
    # 24:00 is the first instant of the next day.
    return F.when(given.rlike(_END_OF_DAY), instant + F.expr("INTERVAL 1 DAY")).otherwise(instant)


def _plain_time(value: Column) -> Column:
    """An extended date with a basic time gets the colons of an extended one."""
    return F.regexp_replace(
        F.regexp_replace(value, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3"),
        r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(?=[Zz+-]|$)",
        "$1:$2",
    )


def _week_as_day(value: Column) -> Column:
    """A week date (``2026-W25-4``, ``2026W254``, day 1 if left out) as a calendar date."""
    year, week, day, rest = (
        F.regexp_extract(value, _WEEK, n) for n in (1, 2, 3, 4)
    )
    first = F.trunc(F.to_date(F.concat(year, F.lit("-01-04"))), "week")
    number = F.coalesce(F.nullif(day, F.lit("")).cast("int"), F.lit(1))
    shown = F.date_add(first, (week.cast("int") - 1) * 7 + number - 1)
    return F.when(value.rlike(_WEEK), F.concat(shown.cast("string"), rest)).otherwise(value)


def _iso_instant(value: Column) -> Column:
    marks = F.translate(value, ", z", ".TZ")
    colon_offset = F.regexp_replace(marks, r"([+-]\d{2})(\d{2})$", "$1:$2")
    extended = F.when(value.endswith("Z"), marks).otherwise(colon_offset)
    return F.when(value.rlike(_EXTENDED), _extended_instant(extended)).when(
        value.rlike(_BASIC), F.try_to_timestamp(marks, F.lit(_BASIC_FORMAT))
    )


def _extended_instant(value: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit(_SHORT_FORMAT)))
