"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in blocks (by a hash of the row). How many rows of block p go to shard
s in a uniformly random permutation follows a multivariate hypergeometric law
given the block and shard sizes; that small matrix is drawn exactly, block by
block. Each block is permuted locally and cut at its line of the matrix, the
cuts are exchanged, and each shard is permuted again. Data moves through
DataFrame operations only; the driver handles the matrix, never the rows: one
line of a number for each shard for every rows_per_block rows, so a trillion
rows make a million lines.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import free_name


def _stirling_error(n: int) -> float:
    """log n! less Stirling's (n + 1/2) log n - n + log(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    square = float(n) * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / square) / square) / square) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without loss of digits where x is near the mean."""
    v = (x - mean) / (x + mean)
    if abs(v) >= 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def _binomial(x: int, n: int, p: float) -> float:
    """The chance of x in n trials, by Loader's saddle-point expansion, which keeps its digits at any size."""
    if x == 0 or x == n:
        return math.exp(n * (math.log1p(-p) if x == 0 else math.log(p))) if n else 1.0
    away = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return math.exp(away) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def hypergeometric_chance(marked: int, good: int, total: int, drawn: int) -> float:
    """The chance of so many of `good` marked among `total` in a uniform sample of `drawn`."""
    if drawn in (0, total):
        return 1.0
    p = drawn / total
    return _binomial(marked, good, p) * _binomial(drawn - marked, total - good, p) / _binomial(drawn, total, p)


def draw_hypergeometric(rng: random.Random, good: int, total: int, drawn: int) -> int:
    """How many of `good` marked among `total` are in a uniform sample of `drawn`; exact in its law up to double precision.

    Starts at the mode and walks outwards in the order of probability, so the
    work is a few standard deviations. The chances add up to 1 within 1e-9 at
    10^12 rows.
    """
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    at_mode = hypergeometric_chance(mode, good, total, drawn)
    left = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (total - good - drawn + up + 1))
            up += 1
            if (left := left - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (total - good - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            if (left := left - p_down) <= 0:
                return down
    return mode


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """For each block the rows it sends to each shard; lines add up to block sizes, columns to shard sizes."""
    rng, open_places, matrix = random.Random(seed), list(shard_sizes), []
    for rows in block_sizes:
        line, places = [], sum(open_places)
        for s, free in enumerate(open_places):
            n = draw_hypergeometric(rng, free, places, rows)
            line.append(n)
            rows, places = rows - n, places - free
            open_places[s] -= n
        matrix.append(line)
    return matrix


def shard_rows(df: DataFrame, n_shards: int, seed: int = 1, rows_per_block: int = 1_000_000, least_blocks: int = 48) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (0 to the shard's size - 1), a uniform shuffle.

    Shard sizes differ by one at most. All columns are kept; where the input
    already has a column shard or slot, the new one gets underscores appended.
    Rows may hold nulls and may repeat: equal rows take different places, and
    which of them takes which cannot be told apart. An empty table gives no
    rows. The same rows and seed give the same result on any cluster and after
    any loss of executors, as blocks and orders come from hashes of the rows.
    Columns that Spark cannot hash (maps) must be left out.
    """
    spark, names = df.sparkSession, df.columns
    shard, slot = free_name("shard", names), free_name("slot", names)
    block, place, cut = (free_name(n, [*names, shard, slot]) for n in ("block", "place", "cut"))
    first, second = (F.xxhash64(F.lit(f"{seed}/{step}"), *(F.col(f"`{n}`") for n in names)) for step in ("first", "second"))
    total = df.count()
    n_blocks = max(least_blocks, -(-total // rows_per_block))
    own_block = F.pmod(F.xxhash64(F.lit(f"{seed}/block"), *(F.col(f"`{n}`") for n in names)), F.lit(n_blocks)).cast("int")

    sizes = {r[0]: r[1] for r in df.groupBy(own_block.alias(block)).count().collect()}
    blocks = sorted(sizes)
    shares = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([sizes[b] for b in blocks], shares, seed)
    cuts = [(b, s, sum(line[:s]), sum(line[: s + 1])) for b, line in zip(blocks, matrix, strict=True) for s in range(n_shards) if line[s]]
    lines = spark.createDataFrame(cuts, f"`{block}` int, `{shard}` int, low long, high long")
    by_block = lines.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("high", shard))).alias(cut))

    order = Window.partitionBy(block).orderBy(first, second)
    dealt = df.withColumn(block, own_block).withColumn(place, F.row_number().over(order)).join(by_block, block)
    goes_to = F.element_at(F.filter(cut, lambda c: c["high"] >= F.col(place)), 1)[shard]
    dealt = dealt.withColumn(shard, goes_to).drop(cut, place)

    # The second permutation sorts each shard by a random key. The key's leading part is a bucket of the shard, so no task sorts a whole shard.
    buckets = max(1, -(-n_blocks // n_shards))
    bucket, before = block, free_name("before", [*names, shard, slot, block])
    key = F.xxhash64(F.lit(f"{seed}/last"), second)
    dealt = dealt.withColumn(bucket, F.pmod(F.shiftrightunsigned(key, 20), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(shard, bucket).count()
    running = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum("count").over(running), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(key, first))
    placed = dealt.withColumn(slot, inside).join(starts, [shard, bucket])
    return placed.select(*(F.col(f"`{n}`") for n in names), F.col(shard).cast("int").alias(shard), (F.col(before) + F.col(slot) - 1).cast("long").alias(slot))
