"""Aggregates over time intervals without pairs, by a tree of time buckets (hour, minute, second).

Points are merged by exact time, then by second, minute and hour. What lies
between an interval's end and the next whole bucket comes from running
aggregates among the at most sixty parts of the bucket above; whole hours come
from one row each. No task sorts more than the different times of one second,
sixty buckets, or the hours of one key, however many events fall together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from casewright.session import checkpointed

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


@dataclass(frozen=True)
class Merge:
    """An aggregate whose results can be merged: over rows (in a group or a window), and over columns."""

    aggregate: Callable[[Column], Column]
    columns: Callable[..., Column]
    tidy: Callable[[Column], Column] = lambda c: c

    def rows(self, column: Column) -> Column:
        return self.tidy(self.aggregate(column))

    def over(self, column: Column, window: WindowSpec) -> Column:
        return self.tidy(self.aggregate(column).over(window))


SUM = Merge(F.sum, lambda *c: reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0)) for x in c)))
LEAST = Merge(F.min, F.least)
#: Of arrays that hold few different values.
UNION = Merge(F.collect_set, lambda *c: F.array_distinct(F.flatten(F.array_compact(F.array(*c)))), lambda c: F.array_distinct(F.flatten(c)))


def micros(time: Column | str) -> Column:
    return F.unix_micros(time)


def _start(size: int) -> Column:
    """The begin of the bucket that a time lies in."""
    return F.col("at") - F.pmod("at", F.lit(size))


def _level(merged: DataFrame, keys: list[str], merges: dict[str, Merge], bucket: str, parent: str | None) -> DataFrame:
    """One row for each bucket with the values of the buckets before (b_) and after it (a_) in its parent."""
    above = [parent] if parent else []
    rows = merged.groupBy(*keys, *above, bucket).agg(*(m.rows(F.col(n)).alias(n) for n, m in merges.items()))
    w = Window.partitionBy(*keys, *above).orderBy(bucket)
    if parent:
        frames = {"b": w.rowsBetween(Window.unboundedPreceding, -1), "a": w.rowsBetween(1, Window.unboundedFollowing)}
    else:
        frames = {"b": w.rowsBetween(Window.unboundedPreceding, -1), "a": w.rangeBetween(-23 * HOUR, -HOUR)}  # all hours before, and those of the day before
    return rows.select(*keys, bucket, *(m.over(F.col(n), f).alias(f"{side}_{bucket}_{n}") for side, f in frames.items() for n, m in merges.items()))


def _tree(points: DataFrame, asked: DataFrame, keys: list[str], merges: dict[str, Merge]) -> DataFrame:
    """asked (keys, at and flags) with, for each value x: up_x and down_x (to the begin and end of the hour, the time itself in both), open_x (up_x without it), day_x (the 23 whole hours before the hour), ahead_x (all hours before)."""
    flags = [c for c in asked.columns if c not in (*keys, "at")]
    both = points.select(*keys, "at", *merges, *(F.lit(False).alias(f) for f in flags)).unionByName(asked.select(*keys, "at", *(F.lit(None).cast(points.schema[n].dataType).alias(n) for n in merges), *flags))
    times = both.groupBy(*keys, "at").agg(*(m.rows(F.col(n)).alias(n) for n, m in merges.items()), *(F.max(f).alias(f) for f in flags))
    times = checkpointed(times.withColumns({"second": _start(SECOND), "minute": _start(MINUTE), "hour": _start(HOUR)}))
    w = Window.partitionBy(*keys, "hour", "minute", "second").orderBy("at")
    frames = {"up": w.rowsBetween(Window.unboundedPreceding, 0), "open": w.rowsBetween(Window.unboundedPreceding, -1), "down": w.rowsBetween(0, Window.unboundedFollowing)}
    out = times.select("*", *(m.over(F.col(n), f).alias(f"{side}_at_{n}") for side, f in frames.items() for n, m in merges.items()))
    out = out.where(reduce(lambda a, b: a | b, (F.col(f) for f in flags)))
    for bucket, parent in (("second", "minute"), ("minute", "hour"), ("hour", None)):
        out = out.join(_level(times, keys, merges, bucket, parent), [*keys, bucket])
    columns = []
    for n, m in merges.items():
        before, after = ([F.col(f"{side}_{b}_{n}") for b in ("second", "minute")] for side in ("b", "a"))
        columns += [m.columns(F.col(f"up_at_{n}"), *before).alias(f"up_{n}"), m.columns(F.col(f"open_at_{n}"), *before).alias(f"open_{n}"), m.columns(F.col(f"down_at_{n}"), *after).alias(f"down_{n}")]
        columns += [F.col(f"a_hour_{n}").alias(f"day_{n}"), F.col(f"b_hour_{n}").alias(f"ahead_{n}")]
    return out.select(*keys, "at", *flags, *columns)


def day_windows(points: DataFrame, asked: DataFrame, keys: list[str], merges: dict[str, Merge]) -> DataFrame:
    """For each asked (keys, begin) the merged values of the points from begin to begin + 24 hours, both ends included.

    points: keys, at (microseconds) and the values. open_x leaves out the points
    of the last instant. A value is null (a sum 0) where no point lies inside.
    """
    begins = asked.select(*keys, "begin").distinct()
    ends = begins.select(*keys, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(True).alias("begins")), F.struct((F.col("begin") + DAY).alias("at"), F.lit(False).alias("begins")))).alias("e"))
    found = _tree(points, ends.select(*keys, "e.at", F.col("e.begins").alias("begins"), (~F.col("e.begins")).alias("ends")), keys, merges)
    first = found.where("begins").select(*keys, F.col("at").alias("begin"), *(F.col(f"down_{n}") for n in merges))
    last = found.where("ends").select(*keys, (F.col("at") - DAY).alias("begin"), *(F.col(f"{side}_{n}") for side in ("up", "open", "day") for n in merges))
    out = first.join(last, [*keys, "begin"])
    whole = [m.columns(F.col(f"down_{n}"), F.col(f"day_{n}"), F.col(f"up_{n}")).alias(n) for n, m in merges.items()]
    return out.select(*keys, "begin", *whole, *(m.columns(F.col(f"down_{n}"), F.col(f"day_{n}"), F.col(f"open_{n}")).alias(f"open_{n}") for n, m in merges.items()))


def counts_before(points: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """For each asked (keys, at) the number of points (keys, at) at or before it (upto) and before it (below)."""
    ones = points.select(*keys, "at", F.lit(1).cast("long").alias("n"))
    found = _tree(ones, asked.select(*keys, "at", F.lit(True).alias("asked")).distinct(), keys, {"n": SUM})
    whole = F.coalesce("ahead_n", F.lit(0))
    return found.select(*keys, "at", (F.col("up_n") + whole).alias("upto"), (F.col("open_n") + whole).alias("below"))
