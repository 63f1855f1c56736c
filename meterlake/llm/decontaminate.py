"""Benchmark decontamination (operator 2): SimHash of item-sized windows, native functions only.

A window of a document as long as a benchmark item can be similar to it only if the two share a
word shingle, so windows around shared shingles are the ones to fingerprint. Fingerprints of
windows and items meet by blocks: within the radius at least one of five blocks differs in at
most a fifth of it, and the items' side lists all such values of its blocks, so no pair within
the radius is missed. What is left is compared on the shingles themselves, counted as often as
they occur.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import may_hold, staged
from meterlake.llm.simhash import block, distance, let, simhash

#: Bits in which fingerprints may differ, and (offset, width) of the blocks. Windows that are
#: 80 % alike differ in about 10 of the 64 bits, in more than 19 about once in a thousand.
RADIUS = 19
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of the items' side that may be sent to all tasks; larger ones are shuffled.
MOST_SENT = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of the shingles in order; empty with fewer words."""

    def cut(w: Column) -> Column:
        last = F.size(w) - size + 1
        found = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<bigint>"))

    return let(words, cut)


def common_weight(a: Column, b: Column) -> Column:
    """Sum over the shingles of two lists of the smaller number of occurrences."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda total, x: total
        + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _sent(rows: DataFrame) -> DataFrame:
    """Marked for sending to all tasks if its counted size allows that."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def _near_blocks(items: DataFrame) -> DataFrame:
    """(b, value, item, m, f, shingles): every value within reach of each block of each item."""
    most = RADIUS // len(BLOCKS)
    masks = [
        F.array(*[F.lit(sum(1 << i for i in bits)).cast("long") for n in range(most + 1) for bits in combinations(range(width), n)])
        for _, width in BLOCKS
    ]
    parts = [
        items.select(
            F.lit(b).alias("b"),
            block(F.col("f_item"), offset, width).alias("own"),
            F.explode(masks[b]).alias("mask"),
            "item", "m_item", "f_item",
        )
        for b, (offset, width) in enumerate(BLOCKS)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.select("b", F.col("own").bitwiseXOR(F.col("mask")).alias("value"), "item", "m_item", "f_item")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.withColumn("key", F.xxhash64(F.col("id").cast("long"), "text"))


def matches(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row (id, item, start_word, similarity, key) per document and item it holds.

    Words are lower-cased runs of letters and digits. A document holds an item if one of its
    windows with as many words (the whole document, if it is shorter) is similar: common
    ``size``-word shingles over all shingles of both, each counted as often as it occurs, is at
    least ``num / den``. An item with fewer words has its whole sequence as its one shingle.
    ``similarity`` is that of the best window, ``start_word`` where the first such window
    begins. Texts that are null or without words match nothing. Repeated documents and items
    each match for themselves; ids may be null. Other columns are not read. Empty tables give an
    empty result.
    """
    rows = _keyed(docs, id_col, text_col)
    wanted = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words"))
    wanted = staged(wanted.filter(F.size("words") > 0), "items")
    # At most ``size`` different lengths of shingles.
    lengths = [r.k for r in wanted.select(F.least(F.size("words"), F.lit(size)).alias("k")).distinct().collect()]
    kinds = dict(rows.dtypes)
    found = rows.sparkSession.createDataFrame(
        [], f"id {kinds['id']}, item {dict(wanted.dtypes)['item']}, start_word int, similarity double, key long"
    )
    for k in sorted(lengths):
        own = wanted.filter(F.least(F.size("words"), F.lit(size)) == k)
        own = staged(own.select("item", shingles(F.col("words"), k).alias("sh_item")), "item-shingles")
        found = found.union(_matches(rows, own, k, num, den))
    return found


def _matches(rows: DataFrame, items: DataFrame, k: int, num: int, den: int) -> DataFrame:
    told = (
        items.select(F.explode("sh_item").alias("shingle"), F.size("sh_item").alias("m")).distinct()
    )
    # The number of shingles comes with each, so the array is worked out once.
    counted = let(
        shingles(words_of(F.col("text")), k),
        lambda sh: F.transform(sh, lambda x: F.struct(F.size(sh).alias("n"), x.alias("shingle"))),
    )
    hits = (
        rows.filter("text IS NOT NULL")
        .select("key", F.posexplode(counted).alias("pos", "each"))
        .select("key", "pos", "each.n", "each.shingle")
        .join(_sent(told), "shingle")
        .select("key", "n", "pos", "m")
    )
    starts = F.sequence(
        F.greatest(F.col("pos") - F.col("m") + 1, F.lit(0)),
        F.greatest(F.least(F.col("pos"), F.col("n") - F.col("m")), F.lit(0)),
    )
    # Bounded by the length of the document times the different lengths of items.
    places = staged(
        hits.select("key", "m", F.explode(F.when(F.col("pos") - F.col("m") + 1 <= F.greatest(F.col("n") - F.col("m"), F.lit(0)), starts)).alias("s"))
        .distinct()
        .groupBy("key")
        .agg(F.collect_list(F.struct("m", "s")).alias("places")),
        "places",
    )
    prints = staged(
        _windows(rows, places, k).select("key", "m", "s", simhash(F.col("win")).alias("f")), "windows"
    )
    marked = items.withColumn("m_item", F.size("sh_item")).withColumn("f_item", simhash(F.col("sh_item")))
    marked = staged(marked, "item-fingerprints")
    blocks = [F.struct(F.lit(b).alias("b"), block(F.col("f"), *at).alias("value")) for b, at in enumerate(BLOCKS)]
    most = RADIUS // len(BLOCKS)
    near = [
        distance(block(F.col("f"), *at), block(F.col("f_item"), *at)) <= most for at in BLOCKS
    ]
    # A pair is taken at the first of its blocks that meet.
    first = F.coalesce(*[F.when(n, F.lit(b)) for b, n in enumerate(near)])
    reach = staged(_near_blocks(marked.drop("sh_item")), "blocks")
    met = staged(
        prints.select("*", F.explode(F.array(*blocks)).alias("at"))
        .select("*", F.col("at.b").alias("b"), F.col("at.value").alias("value"))
        .join(_sent(reach), ["b", "value"])
        .filter((F.col("m") == F.col("m_item")) & (distance(F.col("f"), F.col("f_item")) <= RADIUS))
        .filter(F.col("b") == first)
        .groupBy("key")
        .agg(F.collect_list(F.struct("m", "s", "item", "f_item")).alias("places")),
        "met",
    )
    told_items = _sent(marked.select(F.col("item").alias("item_"), F.col("f_item").alias("f_"), "sh_item"))
    same = F.col("item").eqNullSafe(F.col("item_")) & (F.col("f_item") == F.col("f_"))
    both = (
        _windows(rows, met, k)
        .join(told_items, same)
        .withColumn("common", common_weight(F.col("win"), F.col("sh_item")))
        .withColumn("total", F.size("win") + F.size("sh_item") - F.col("common"))
    )
    return (
        both.filter(F.col("common") * den >= F.col("total") * num)
        .withColumn("similarity", F.col("common") / F.col("total"))
        .groupBy("id", "item", "key")
        .agg(F.min("s").alias("start_word"), F.max("similarity").alias("similarity"))
        .select("id", "item", "start_word", "similarity", "key")
    )


def _windows(rows: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The windows (id, key, win, and the columns of their place) of some documents."""
    return (
        may_hold(rows, places, "key")
        .filter("listed")
        .join(places, "key")
        .select(
            "id",
            "key",
            F.explode(
                let(
                    shingles(words_of(F.col("text")), k),
                    lambda sh: F.transform(
                        "places",
                        lambda p: F.struct(p.alias("place"), F.slice(sh, p["s"] + 1, p["m"]).alias("win")),
                    ),
                )
            ).alias("each"),
        )
        .select("id", "key", "each.place.*", "each.win")
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents, with all their columns, that hold no item; see ``matches``."""
    held = staged(matches(docs, items, id_col=id_col, text_col=text_col, **options).select("key").distinct(), "held")
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"),
    )
    marked = may_hold(rows, held, "key")
    kept = marked.filter("NOT listed").select("row").union(
        marked.filter("listed").join(held, "key", "left_anti").select("row")
    )
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
