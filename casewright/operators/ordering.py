"""Total order at any size: places by range partitions and the running counts of partitions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import checkpointed


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds the place (from 1, gapless) of every row in the order of the given columns.

    Rows are range-partitioned and sorted inside their partitions; a partition's
    first place is the count of all rows in the partitions before it. No task
    sorts more than its range. End the order with a column that tells rows apart:
    equal rows meet in one range and come in any order. The sorted table is
    checkpointed; only one row for each partition is summed in one task.
    """
    at, part = f"_{name}_at", f"_{name}_part"
    held = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    held = held.withColumn(part, F.shiftright(at, 33))  # the id's upper bits number the partition, the lower 33 the row in it
    counts = held.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(part, before.alias("_before"))
    return held.join(F.broadcast(starts), part).withColumn(name, F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop("_before", at, part)


def numbered_within(df: DataFrame, groups: list[str], *order: Column | str, name: str = "place") -> DataFrame:
    """The place (from 1) of every row within its group; a group may hold any share of the rows, as none is one task's."""
    held = checkpointed(numbered(df, *groups, *order, name="_overall"))
    first = held.groupBy(*(F.col(g).alias(f"_{g}") for g in groups)).agg(F.min("_overall").alias("_first"))
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups))
    return held.join(first, same).withColumn(name, F.col("_overall") - F.col("_first") + 1).drop("_first", "_overall", *(f"_{g}" for g in groups))
