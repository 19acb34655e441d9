import hashlib
import math
import re
import zlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from casewright.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = st.lists(st.none() | st.text(alphabet="aAbZ9é漢 -\n\x00{[", max_size=60), max_size=6)


def features(text, most):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def read(texts, most):
    words, found = [0] * len(texts), [[] for _ in texts]
    for parts in resampling.gathered((t if t is None else t.encode() for t in texts), most):
        runs = resampling.runs_of(parts, most)
        table = resampling.intern(runs.data, runs.starts, runs.lengths, 10_000)
        grams = [runs.data[a : a + n].tobytes() for a, n in zip(runs.starts, runs.lengths, strict=True)]
        assert len(set(table.slot_of.tolist())) == len(set(grams))
        for gram, slot, part in zip(grams, table.slot_of, runs.part, strict=True):
            assert table.bucket[slot] == zlib.crc32(gram) % 10_000
            assert table.count[slot] == grams.count(gram)
            found[parts.rows[part]].append(gram.decode())
        for row, n in zip(parts.rows, runs.n_words, strict=True):
            words[row] += n
    return words, [sorted(f) for f in found]


@settings(deadline=None, max_examples=150)
@given(TEXTS, st.integers(1, 3), st.sampled_from([3, 20, 1 << 21]))
def test_runs_and_slots_equal_plain_ones(texts, most, piece):
    before, resampling.PIECE_BYTES = resampling.PIECE_BYTES, piece
    try:
        words, found = read(texts, most)
    finally:
        resampling.PIECE_BYTES = before
    wanted = [features(t, most) for t in texts]
    assert words == [n for n, _ in wanted] and found == [sorted(f) for _, f in wanted]


@settings(deadline=None)
@given(st.lists(st.binary(max_size=70), min_size=1, max_size=8))
def test_hashes_are_xxh64(slices):
    import numpy as np

    data = np.frombuffer(b"".join(slices) + b" ", np.uint8)
    lengths = np.array([len(s) for s in slices])
    starts = np.cumsum(lengths) - lengths
    assert resampling.hash_slices(data, resampling.windows(data), starts, lengths).tolist() == [xxhash.xxh64_intdigest(s) for s in slices]


def test_equal_keys_with_other_bytes_get_other_slots(monkeypatch):
    import numpy as np

    monkeypatch.setattr(resampling, "hash_slices", lambda data, ahead, starts, lengths: np.full(len(starts), 5, np.uint64))
    data = np.frombuffer(b"aa ab aa " + b"x" * 40 + b" " + b"x" * 39 + b"y ", np.uint8)
    table = resampling.intern(data, np.array([0, 3, 6, 9, 50]), np.array([2, 2, 2, 40, 40]), 10)
    assert table.slot_of[0] == table.slot_of[2] and len(set(table.slot_of.tolist())) == 4


def plain_draw(docs, target, percent, most=1, buckets=10_000):
    def counts(texts):
        n = {}
        for t in texts:
            for f in features(t, most)[1]:
                b = zlib.crc32(f.encode()) % buckets
                n[b] = n.get(b, 0) + 1
        return n, sum(n.values())

    (s, all_s), (t, all_t) = counts(x for _, x in docs), counts(target)
    rows = []
    for key, text in docs:
        n, found = features(text, most)
        gains = [math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("most", [1, 2])
def test_draw_equals_brute_force(spark, most):
    words = ["The", "of", "x" * 50, "neuron", "Ünder", "naïve", "42"]
    docs = [(i, " ".join(words[(i * j) % 7] for j in range(i % 60)) + "\n") for i in range(300)]
    docs += [(400, None), (401, ""), (402, " -- "), (403, "word " * 200_000), (5, docs[5][1]), (None, docs[59][1])]
    target = ["neuron of the neuron", None, "42 neuron"]
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in docs], "doc_id long, text string, dsir_words string, dsir_rank int").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    gain = resampling.gains(resampling.bucket_counts(df, most_words=most), resampling.bucket_counts(goal, most_words=most))
    weighed = resampling.weigh_documents(df, gain, most_words=most)
    assert weighed.columns == ["doc_id", "text", "dsir_words", "dsir_rank", "dsir_features", "dsir_words_", "dsir_weight"]
    drawn = resampling.draw(weighed.drop("text"), 10, words_col="dsir_words_")
    got = sorted((tuple(r) for r in drawn.select("doc_id", "dsir_features", "dsir_words_", "dsir_weight", "dsir_score", "dsir_rank_").collect()), key=str)
    assert got == plain_draw(docs, target, 10, most)
    kept = resampling.resample(df, goal, 10, most_words=most).orderBy("dsir_rank_").collect()
    assert [r.dsir_rank_ for r in kept] == list(range(1, len(kept) + 1)) and kept[0].text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    for docs, goal in ((none, some), (some, none), (none, none)):
        gain = resampling.gains(resampling.bucket_counts(docs), resampling.bucket_counts(goal))
        rows = resampling.draw(resampling.weigh_documents(docs, gain), 50).collect()
        assert [r.dsir_rank for r in rows] == [None] * len(rows) and len(rows) == docs.count()
