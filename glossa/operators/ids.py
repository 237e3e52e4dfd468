"""Positions in a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within its partition in 33 bits


def dense_ids(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Add ``name`` = 0-based rank by ``order_by``, whose values must be unique.

    Range-partition, sort, number the rows of each partition, then shift each
    partition by the number of rows before it. The sorted rows are written out
    so that counts and numbers come from one and the same partitioning. The
    offsets have one row per partition, so they may be broadcast.
    """
    cols = [F.col(c) for c in order_by]
    tagged = cut(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", _ROW_BITS)
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = tagged.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_part", "_mid", "_offset")
    )


def with_previous(df: DataFrame, order_by: list[str], value: str, name: str, default) -> DataFrame:
    """Add ``name`` = ``value`` of the row before in the total order, as an equi-join on the rank."""
    ranked = dense_ids(df, order_by, "_rank")
    shifted = ranked.select((F.col("_rank") + 1).alias("_rank"), F.col(value).alias(name))
    return (
        ranked.join(shifted, "_rank", "left")
        .withColumn(name, F.coalesce(name, F.lit(default).cast(df.schema[value].dataType)))
        .drop("_rank")
    )


def top_k(df: DataFrame, group: str, order_by: list, k: str, k_max: int, rank: str = "rank") -> DataFrame:
    """Rows with rank <= ``k`` within ``group``, where ``k`` is a column of at most ``k_max``.

    A literal bound lets Spark keep only so many rows per group and task before
    the shuffle. Spark does that below a threshold; groups that want more are
    first cut down in 256 salted parts, so that no task sorts all of a group
    with a k in the thousands. Each group goes its way by its own k, whatever
    the others want. A k near the size of a group asks for a sorted list of
    that group, and one task makes it.
    """
    spark = df.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k_max >= threshold:
        small = top_k(df.filter(F.col(k) < threshold), group, order_by, k, threshold - 1, rank)
        df = df.filter(F.col(k) >= threshold)
        salt = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(256))
        part = Window.partitionBy(group, "_salt").orderBy(*order_by)
        df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(part))
        df = df.filter(F.col("_r") <= F.col(k)).drop("_salt", "_r")
        ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order_by)))
        return small.unionByName(ranked.filter(F.col(rank) <= F.col(k)))
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order_by)))
    return ranked.filter((F.col(rank) <= F.lit(k_max)) & (F.col(rank) <= F.col(k)))
