"""Places of rows in an order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.session import materialize


def group_key(column: str) -> Column:
    """A string that is never null and keeps values apart: null is empty, others stand behind a sign."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column)))


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``pos``, the place from 0 in the row's group, and ``n``, the rows of the group.

    ``group`` must not be null. Rows are sorted over all partitions by range and
    numbered where they stand; what meets per group is one count of each partition.
    Rows that ``order`` cannot tell apart are dealt out by where they were read, so
    many equal rows do not land together.
    """
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    # Written before it is sorted: the sort reads its input twice, to sample and to deal out.
    told = materialize(told, f"{name}-rows")
    placed = told.orderBy(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, f"{name}-order").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    upto = Window.partitionBy(group).orderBy("_part")
    before = parts.select(
        group, "_part", "_first", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    found = placed.join(before, [group, "_part"])
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")
