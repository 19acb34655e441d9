import hashlib
import math

import numpy as np
import pytest

from casewright.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Every round by full scans: (id, code, error, label error) of each row, and the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        found = []
        for c in cut:
            nearest = [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            found.append(nearest)
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]]) for r, f, e in zip(kept, found, errors, strict=True)]
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def collected(df, **how):
    found = codes.compress(df, **how)
    rows = codes.with_label_error(found.codes).select("id", codes.code_text(), "error", "label_error").collect()
    return sorted(map(tuple, rows), key=str), found.digest()


@pytest.mark.parametrize("share", [0.0, 0.2, 2.0])
def test_equals_full_scans(spark, monkeypatch, share):
    monkeypatch.setattr(codes, "REFRESH_SHARE", share)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.05 * rng.normal(size=16)).astype(np.float32)], None if i % 7 == 0 else i % 3, "x") for i in range(500)]
    rows += [(1000 + i, rows[i][1], 1, "copy") for i in range(40)] + [(7, rows[8][1], 2, "again"), (None, rows[3][1], 0, "no id")]
    rows += [(2000, None, 1, "n"), (2001, [], 1, "e"), (2002, [0.0] * 16, 1, "zero"), (2003, [float("nan")] + [1.0] * 15, 1, "nan"), (2004, [None] + [1.0] * 15, 1, "null"), (2005, [float("-inf")] * 16, 1, "inf"), (2006, [1.0] * 8, 1, "length")]
    assert collected(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


def test_bounds_save_scans_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-4096, 4096, (3000, 4))
    x[:1500] = x[0] + rng.integers(-50, 50, (1500, 4))
    history = [x[:16].copy()[None]]
    code, _, low = codes.scan(x, history[0][0])
    stamp, scans = np.zeros(len(x), np.int16), []
    for _ in range(8):
        history.append(history[-1].copy())
        for k in range(16):
            if (code == k).any():
                history[-1][0, k] = x[code == k].sum(axis=0) // (code == k).sum()
        settled = codes.Assigner(history).settle(0, x, code, low, stamp)
        right, own, _ = codes.scan(x, history[-1][0])
        assert (settled[0] == right).all() and (settled[1] == own).all()
        code, low, stamp = settled[0], settled[2], settled[3]
        scans.append(settled[4])
        for s in set(stamp.tolist()):  # every bound holds for all other entries as of now
            rows = np.flatnonzero(stamp == s)
            d = np.sqrt(codes.squared_distances(x[rows], history[-1][0]))
            np.put_along_axis(d, code[rows][:, None], np.inf, axis=1)
            assert (low[rows] - codes.Assigner(history).drift[0, s, code[rows]] <= d.min(axis=1) + 1e-6).all()
    assert scans[-1] < len(x) / 2


def test_net_displacement_is_not_the_sum_of_steps():
    there = np.array([[[0, 0], [100, 0]]])
    away = np.array([[[0, 0], [160, 0]]])
    drift = codes.Assigner([there, away, there]).drift[0]
    assert drift[0].tolist() == [0, 0] and drift[1].tolist() == [60, 0]


def test_few_vectors_empty_table_and_decoding(spark):
    rows = [(i, [float(i * j) for j in range(8)], 0, "x") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(df, parts=4, rounds=2) == plain(rows, parts=4, rounds=2)
    found = codes.compress(df, parts=4, rounds=2)
    decoded = codes.decode(found.codes, found.codebooks).orderBy("id").collect()
    assert [r.vector for r in decoded] == [r[1] for r in rows]
    assert collected(df.limit(0)) == ([], hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(df, parts=3)


def test_large_components_are_exact_or_refused():
    x = np.array([[1 << 27, 3]])
    assert codes.squared_distances(x, np.array([[(1 << 27) - 1, 1]])).tolist() == [[5]]
    with pytest.raises(ValueError, match="too large"):
        codes.squared_distances(np.array([[1 << 40, 0]]), x)


def test_labels_with_many_rows_do_not_meet(spark, monkeypatch):
    import casewright.llm.common as common

    df = spark.createDataFrame([(i, None if i % 2 else i % 5, i) for i in range(100)], "id long, label int, error long")
    wanted = sorted(map(tuple, codes.with_label_error(df).collect()), key=str)
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    assert sorted(map(tuple, codes.with_label_error(df).collect()), key=str) == wanted
    assert {(r[1], r[3]) for r in wanted} >= {(None, sum(range(1, 100, 2)))}
