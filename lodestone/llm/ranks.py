"""Ranks over a whole table without one task that sees it all.

Rows are dealt by ranges of the order, sorted inside each range and numbered as
they are written; the counts of the ranges, one small row each, then turn these
numbers into ranks. Ranges are cut by sampled quantiles of the rows, so neither
a hot value nor many small ones fill a range as long as the order tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.storage import materialise

IN_RANGE = 33


def with_row(rows: DataFrame, name: str) -> DataFrame:
    """Written rows with ``row``, a number of their own: it tells equal rows apart in an order."""
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), name)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Written rows with ``_at``: the number of their range, and their place in it."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(placed.withColumn("_at", F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``rank``, from 1, in the order given. ``rows`` should be a written table, as it is read twice."""
    placed = numbered(rows, order, name).withColumn("_range", F.shiftright("_at", IN_RANGE))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    # Written, so that its size is known: it is broadcast only if it is small.
    counts = materialise(counts, f"{name}-ranges")
    inside = F.col("_at").bitwiseAND(F.lit((1 << IN_RANGE) - 1))
    return placed.join(counts, "_range").withColumn("rank", F.col("_before") + inside + 1).drop("_range", "_at", "_before")
