"""Ranks and running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import materialize


def ranked(df: DataFrame, order: list[Column | str], rank: str = "rank", sums: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds the 0-based rank of each row in ``order`` (columns of ``df``, with directions), and for each entry of ``sums`` the
    sum of that column over all rows before.

    Rows are cut into ranges of the order, each range is ranked by its own task, and the totals of the ranges before (one
    row a range) are added. The ranged rows are written once, so that ranges are the same in all passes. Rows that are equal
    in the order share a range: give a unique order.
    """
    sums = sums or {}
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    total = x.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{a}") for a, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = total.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *(F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_s_{a}") for a in sums))
    own = Window.partitionBy("_range").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, -1)
    x = x.select("*", (F.row_number().over(own) - 1).cast("long").alias("_r"), *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_o_{a}") for a, c in sums.items()))
    x = x.join(F.broadcast(starts), "_range")
    return x.select(*df.columns, (F.col("_r") + F.col("_n0")).alias(rank), *((F.col(f"_o_{a}") + F.col(f"_s_{a}")).alias(a) for a in sums))


def ranked_within(df: DataFrame, by: str, order: list[Column | str], rank: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """``ranked`` inside of each group of ``by``: a hot group is spread over many ranges. Nulls of ``by`` are one group."""
    sums = sums or {}
    x = ranked(df, [F.asc(by), *order], rank, sums)
    first = x.groupBy(F.col(by).alias("_by")).agg(F.min(rank).alias("_n0"), *(F.min_by(a, rank).alias(f"_s_{a}") for a in sums))
    x = x.join(first, F.equal_null(F.col(by), F.col("_by")))
    return x.select(*df.columns, (F.col(rank) - F.col("_n0")).alias(rank), *((F.col(a) - F.col(f"_s_{a}")).alias(a) for a in sums))
