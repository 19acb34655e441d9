import random
from collections import Counter

from casewright.llm.sharding import communication_matrix, draw_hypergeometric, hypergeometric_chance, shard_rows


def test_matrix_adds_up():
    blocks, shards = [5, 0, 17, 40, 1], [21, 21, 21]
    matrix = communication_matrix(blocks, shards, 3)
    assert [sum(line) for line in matrix] == blocks
    assert [sum(column) for column in zip(*matrix, strict=True)] == shards


def test_draws_follow_the_law():
    from math import comb

    rng, n = random.Random(5), 20_000
    seen = Counter(draw_hypergeometric(rng, 6, 15, 7) for _ in range(n))
    for k in range(7):
        expected = comb(6, k) * comb(9, 7 - k) / comb(15, 7)
        assert abs(seen[k] / n - expected) < 0.015


def test_exact_sizes_and_slots(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(7, "text 7")] * 40 + [(None, None), (None, None)]
    out = shard_rows(spark.createDataFrame(rows, "doc_id long, shard string"), 7, rows_per_block=50, least_blocks=4)
    assert out.columns == ["doc_id", "shard", "shard_", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter(rows)
    sizes = Counter(r.shard_ for r in got)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard_ == s) == list(range(sizes[s]))


def test_same_rows_same_place_whatever_the_partitions(spark):
    df = spark.range(300).selectExpr("id", "id % 3 AS k")
    places = [{r.id: (r.shard, r.slot) for r in shard_rows(d, 5).collect()} for d in (df, df.repartition(9))]
    assert places[0] == places[1]


def test_looks_uniform(spark):
    got = shard_rows(spark.range(4000), 4, rows_per_block=500).collect()
    halves = Counter((r.shard, r.id < 2000) for r in got)
    assert all(abs(halves[s, True] - 500) < 100 for s in range(4))
    early = sum(r.id < 2000 for r in got if r.slot < 500)
    assert abs(early - 1000) < 150


def test_fewer_rows_than_shards_and_none(spark):
    assert sorted(r.slot for r in shard_rows(spark.range(3), 24).collect()) == [0, 0, 0]
    assert shard_rows(spark.range(0), 24).count() == 0


def test_places_equal_a_plain_version(spark):
    """The same draws, cuts and permutations row by row in Python; only the hashes are Spark's."""
    from pyspark.sql import functions as F

    n_shards, seed, blocks, per_block = 5, 1, 6, 100
    df = spark.createDataFrame([(i, f"text {i % 70}") for i in range(550)] + [(9, "text 9")] * 30, "doc_id long, text string")
    keys = [F.xxhash64(F.lit(f"{seed}/{step}"), "doc_id", "text").alias(step) for step in ("first", "second", "block")]
    rows = [r.asDict() for r in df.select("doc_id", "text", *keys, F.xxhash64(F.lit(f"{seed}/last"), F.xxhash64(F.lit(f"{seed}/second"), "doc_id", "text")).alias("last")).collect()]
    for r in rows:
        r["block"] %= blocks
    sizes = {b: sum(r["block"] == b for r in rows) for b in range(blocks)}
    shares = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([sizes[b] for b in range(blocks)], shares, seed)
    for b in range(blocks):
        own = sorted((r for r in rows if r["block"] == b), key=lambda r: (r["first"], r["second"]))
        for r, s in zip(own, [s for s in range(n_shards) for _ in range(matrix[b][s])], strict=True):
            r["shard"] = s
    buckets = -(-blocks // n_shards)
    want = Counter()
    for s in range(n_shards):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: (((r["last"] & (1 << 64) - 1) >> 20) % buckets, r["last"], r["first"]))
        want.update((r["doc_id"], r["text"], s, i) for i, r in enumerate(own))
    got = shard_rows(df, n_shards, seed, rows_per_block=per_block, least_blocks=4).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == want


def test_query_digests(spark, tmp_path):
    import zlib

    from casewright.llm import queries

    texts = ["", None, "é漢", "plain " * 3000] + [f"t{i}" for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op4_sharding(spark, str(tmp_path)).collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None) and 0 <= r.shard < 24


def test_chances_keep_their_digits():
    from fractions import Fraction
    from math import comb

    for good, total, drawn in ((6, 15, 7), (1, 2, 1), (40, 100, 3), (500, 1200, 700), (3, 1000, 999)):
        for k in range(max(0, drawn - total + good), min(good, drawn) + 1):
            exact = float(Fraction(comb(good, k) * comb(total - good, drawn - k), comb(total, drawn)))
            assert abs(hypergeometric_chance(k, good, total, drawn) - exact) <= 1e-12 * exact + 1e-300
    for total in (10**9, 10**12):
        good, drawn = total // 24, 1_000_000
        mode = drawn * good // total
        p = sum_of = hypergeometric_chance(mode, good, total, drawn)
        for step in (1, -1):
            k, p = mode, hypergeometric_chance(mode, good, total, drawn)
            while p > 1e-18:
                ratio = (good - k) * (drawn - k) / ((k + 1) * (total - good - drawn + k + 1)) if step == 1 else k * (total - good - drawn + k) / ((good - k + 1) * (drawn - k + 1))
                k, p = k + step, p * ratio
                sum_of += p
        assert abs(sum_of - 1) < 1e-9
