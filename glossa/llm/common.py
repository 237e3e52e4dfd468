"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut

#: Rows of one group that are numbered in one task, and the least number of parts a group is dealt to.
ROWS_PER_PART = 200_000
LEAST_PARTS = 64


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows, of at most ``row_bytes`` each, stay below ``limit``.

    Beyond the limit Spark joins by a shuffle; the result is the same.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def gapless(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, in no particular order.

    A group is dealt by a hash of ``order`` to many parts; each part is
    numbered by itself and shifted by the rows of the parts before it, so a
    group may hold any share of all rows. ``df`` is evaluated twice: hand over
    a written table. Numbers depend on the rows alone.
    """
    parts = max(LEAST_PARTS, df.count() // ROWS_PER_PART)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        dealt.groupBy(group, "_part")
        .agg(F.count("*").alias("_n"))
        .select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    within = Window.partitionBy(group, "_part").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(within))
        .join(base, [group, "_part"])
        .withColumn(name, F.col("_base") + F.col("_row") - 1)
        .drop("_part", "_row", "_base")
    )


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node it reaches.

    Large-star and small-star steps by joins with per-node minima. A step
    shuffles thin rows only and no neighbourhood is ever collected. Every
    round is written out, which cuts the lineage, and rounds go on until no
    edge changes.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
    mark = digest(stars)
    for _ in range(rounds):
        pairs = both(stars)
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a node join the smallest node around it.
        large = pairs.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below it join the smallest of them.
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        stars, before = cut(small), mark
        mark = digest(stars)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
