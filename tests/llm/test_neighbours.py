import math

import numpy as np

from casewright.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, rank string"


def rows_of(n, dims, rng):
    return [(i, [float(x) for x in rng.normal(size=dims).astype(np.float32)], "x") for i in range(n)]


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(queries, rows, k):
    found = {}
    for q, v in queries.items():
        scored = []
        for i, w, _ in rows:
            if i is not None and i != q and usable(w) and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, w, strict=True):
                    total += (a - b) * (a - b)
                scored.append((math.sqrt(total), i))
        found[q] = sorted(scored)[:k]
    return found


def collected(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.score, r.vec_id))
    return found


def test_equals_brute_force_with_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(400, 16, rng)
    rows += [(1000 + i, rows[i][1], "copy") for i in range(60)] + [(7, rows[7][1], "again")]
    rows += [(2000, None, "n"), (2001, [], "e"), (2002, [0.0] * 16, "z"), (2003, [float("nan")] + [1.0] * 15, "nan"), (2004, [None] + [1.0] * 15, "null"), (2005, [1.0] * 3, "dims"), (None, [1.0] * 16, "no id")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collected(nearest(df.where("vec_id % 20 = 0"), df, k=10, grid=(2, 3)))
    queries = {i: v for i, v, _ in rows if i is not None and i % 20 == 0 and usable(v)}
    assert got == {q: v for q, v in brute(queries, rows, 10).items() if v}


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, [2.0, 2.0], "b"), (2, [1.0, 3.0], "c")], SCHEMA)
    assert collected(nearest(df.where("vec_id = 0"), df, k=10)) == {0: [(1.0, 1), (1.0, 2)]}
    assert nearest(df.limit(0), df).count() == 0
    assert nearest(df, df.limit(0)).count() == 0
