"""Helpers shared by the operators: words, staged tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.plans.session import scratch_dir

#: A word is a run of anything but ASCII white space (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows without an id count as the last document.
LAST_ID = 2**63 - 1

#: Bytes of text in one Arrow batch that an operator returns.
BATCH_BYTES = 8 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def staged(rows: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage."""
    return store(rows, scratch_dir(rows.sparkSession, label))


def store(rows: DataFrame, path: str) -> DataFrame:
    """The rows written to a new folder and read back, for folders that are removed later."""
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What runs inside runs with these settings of the session."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def slices(
    batches: Iterable[pa.RecordBatch], sized: str, size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``sized`` holds about ``size`` bytes; rows stay whole."""
    for batch in batches:
        column = batch.column(sized)
        if not len(column):
            continue
        step = max(1, int(len(column) * size / max(1, column.nbytes)))
        for start in range(0, len(column), step):
            yield batch.slice(start, step)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the width for rows dealt by a derived key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src, dst): one row (node, component) per node.

    ``component`` is the smallest node reachable. Nodes are longs; self loops and repeated
    edges are allowed. Alternating large-star and small-star steps, each a minimum per node
    and a join, so that no task holds the neighbours of a hub; every round is a written
    table. Empty input gives an empty result.
    """
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    nodes = edges.filter("src <> dst")
    links = staged(
        nodes.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "links",
    )
    mark = _mark(links)
    while True:
        links = staged(_star_round(links), "links")
        after = _mark(links)
        if after == mark:
            break
        mark = after
    loops = edges.select(F.col("src").alias("u"), F.col("src").alias("v"))
    roots = links.select(F.col("v").alias("u"), "v")
    return (
        links.union(roots).union(loops).groupBy("u").agg(F.min("v").alias("component"))
    ).withColumnRenamed("u", "node")


def _star_round(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lower, "u")
    return (
        small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .union(lower.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _mark(links: DataFrame) -> tuple:
    """Count and order-free digest of the links."""
    return tuple(
        links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    )


#: Bits of the bitmap that holds which keys occur; a fixed size (1 MB), so it can be sent to
#: all tasks. With very many keys it lets more rows pass, never fewer.
KEY_BITS, MAP_BITS = 1 << 23, 1 << 15


def may_hold(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with a boolean ``listed``: whether ``key`` may occur in ``keys``.

    False is certain, so rows that a join would not meet need no shuffle.
    """
    place = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    bucket, bit = F.floor(place / MAP_BITS), F.pmod(place, F.lit(MAP_BITS))
    maps = keys.groupBy(bucket.alias("bucket_")).agg(F.bitmap_construct_agg(bit).alias("bits_"))
    byte = F.conv(F.hex(F.expr("substring(bits_, cast(byte_ as int) + 1, 1)")), 16, 10).cast("int")
    return (
        rows.withColumn("bucket_", bucket)
        .withColumn("byte_", F.floor(bit / 8))
        .withColumn("shift_", F.pmod(bit, F.lit(8)).cast("int"))
        .join(F.broadcast(maps), "bucket_", "left")
        .withColumn("listed", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, shift_)")) != 0, F.lit(False)))
        .drop("bucket_", "byte_", "shift_", "bits_")
    )


#: Rounds that compare one member of each list with the others.
STAR_ROUNDS = 3


def linking_pairs(
    lists: DataFrame,
    fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verified: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Verified links (src, dst) that hold together the components of all true links.

    ``lists`` are (token, sid, ...): members that share a token may link. ``fits(one, other)``
    says of two members' columns whether they can; ``verified`` keeps the true ones of some
    pairs (src, dst). A token of many similar members would give all their pairs, so some
    rounds first compare one member of each list with the rest. Lists that are one component
    are done; the last round compares what is still apart, each with each. Tokens count as
    ranked by ``pos``, where the lists have it, else by themselves.
    """
    spark = lists.sparkSession
    extra = [c for c in lists.columns if c not in ("token", "sid")]
    links = tested = spark.createDataFrame([], "src long, dst long")
    left_open = lists.withColumn("comp", F.col("sid"))
    for round_ in range(STAR_ROUNDS + 1):
        if left_open.isEmpty():
            break
        apart = F.col("comp_1") < F.col("comp")
        if round_ == STAR_ROUNDS:
            # Members with several tokens in common meet under the first of them only. Tokens
            # of lists that are done cannot be common to members that are apart.
            by_rank = Window.partitionBy("sid").orderBy("pos" if "pos" in extra else "token", "token")
            before = F.collect_list("token").over(by_rank.rowsBetween(Window.unboundedPreceding, -1))
            left_open = left_open.withColumn("before", before)
            extra = [*extra, "before"]
            apart &= ~F.arrays_overlap("before", "before_1")
        one = left_open.select(*[F.col(c).alias(f"{c}_1") for c in ("token", "sid", "comp", *extra)])
        if round_ < STAR_ROUNDS:
            member = F.struct(*[c for c in one.columns if c != "token_1"])
            one = one.groupBy("token_1").agg(
                F.min_by(member, F.xxhash64("sid_1", F.lit(round_))).alias("member")
            ).select("token_1", "member.*")
            apart = F.col("comp_1") != F.col("comp")
        pairs = staged(
            left_open.join(
                one,
                (F.col("token") == F.col("token_1")) & apart & fits(lambda c: F.col(f"{c}_1"), lambda c: F.col(c)),
            )
            .select(F.least("sid_1", "sid").alias("src"), F.greatest("sid_1", "sid").alias("dst"))
            .distinct()
            .join(tested, ["src", "dst"], "left_anti"),
            "pairs",
        )
        tested = tested.union(pairs)
        links = links.union(staged(verified(pairs), "verified"))
        if round_ == STAR_ROUNDS:
            break
        found = components(links).withColumnRenamed("node", "sid")
        now = lists.join(found, "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
        apart_still = (
            now.groupBy("token")
            .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .filter("lo <> hi")
            .select("token")
        )
        left_open = staged(
            now.join(apart_still, "token", "left_semi").select("token", "sid", *extra, "comp"), "lists"
        )
    return links
