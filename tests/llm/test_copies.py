import random

import numpy as np
import pandas as pd

from casewright.llm import copies, simhash


def plain_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def documents(seed=3):
    """Groups of documents with edits of many sizes, so that similarities run from 0.5 to 1."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.randint(8, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    return list(enumerate(texts)) + [(900, None), (901, ""), (902, texts[5].upper())]


def test_groups_equal_brute_force(spark):
    rows = documents()
    sets = {i: plain_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    prints = {i: simhash.shingle_fingerprint(t and t.encode(), 5) for i, t in rows}
    assert sum((prints[a] ^ prints[b]).bit_count() > 6 for a, b in links) > 20  # such as the radius alone would lose
    assert any((prints[a] ^ prints[b]).bit_count() <= 6 for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) < 0.8)
    label = {i: i for i in sets}
    for _ in range(10):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.id: r.component for r in copies.near_duplicates(docs, 0.8).collect()} == label
    assert {r.doc_id for r in copies.keep_one_per_group(docs, 0.8).collect()} == {i for i, c in label.items() if i == c}


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, "x")], "doc_id long, text string")
    got = sorted(((r.id, r.component) for r in copies.near_duplicates(docs, 0.8).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 7), (None, 5), (None, None)]
    assert copies.keep_one_per_group(docs, 0.8).count() == 4  # rows without an id stay; of the repeated row one is left
    assert copies.near_duplicates(docs.limit(0), 0.8).count() == 0


def test_pipeline_stage_drops_copies_beyond_the_radius(spark):
    import corpus_pipeline

    rows = [(i, t, "xx", "s", 0) for i, t in documents()]
    sets = {i: plain_set(t) for i, t, *_ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_copies(spark, docs, "").collect()}
    assert not [(a, b) for a in kept for b in kept if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert all(any(jaccard(sets[i], sets[j]) >= 0.8 for j in sets if j != i) for i in sets.keys() - kept)


def by_brute_force(rows):
    sets = {i: plain_set(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    for _ in range(len(sets)):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label
    return label


def test_large_components_are_verified_by_joins(spark, monkeypatch):
    """Templates below 0.8, copies above it, and chains of small steps, all as one component of candidates."""
    monkeypatch.setattr(copies, "TASK_SETS", 0)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    shared, texts = [rng.choice(words) for _ in range(120)], []
    for i in range(60):  # a template with a part of each one's own: similarity about 0.7
        texts.append(" ".join(shared + [f"own{i}x{j}" for j in range(22)]))
    copy = [rng.choice(words) for _ in range(150)]
    for i in range(60):  # near copies
        other = list(copy)
        other[rng.randrange(150)] = f"new{i}"
        texts.append(" ".join(other))
    chain = [rng.choice(words) for _ in range(120)]
    for i in range(40):  # neighbours are similar, ends are not
        chain[3 * i : 3 * i + 3] = [f"c{i}a", f"c{i}b", f"c{i}c"]
        texts.append(" ".join(chain))
    passages = [[rng.choice(words) for _ in range(25)] for _ in range(12)]
    for _ in range(60):  # combinations of the same passages
        texts.append(" ".join(w for k in sorted(rng.sample(range(12), 9)) for w in passages[k]))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = by_brute_force(rows)
    assert len(set(wanted.values())) > 70
    monkeypatch.setattr(copies, "_candidates", lambda nodes, radius, shards: nodes.crossJoin(nodes.agg(copies.F.min("node").alias("b"))).select(copies.F.col("node").alias("a"), "b"))
    assert {r.id: r.component for r in copies.near_duplicates(docs, 0.8).collect()} == wanted


def test_components_that_take_a_task_too_long_are_verified_by_joins(spark, monkeypatch):
    rows = documents(seed=4)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = by_brute_force(rows)
    for work in (0, 3000):
        monkeypatch.setattr(copies, "TASK_WORK", work)
        assert {r.id: r.component for r in copies.near_duplicates(docs, 0.8).collect()} == wanted


def test_work_of_a_wide_radius_grows_like_the_fingerprints(spark):
    """Rows that move are radius + 1 for each fingerprint at any number; the links equal brute force, dense clusters included."""
    rng = np.random.default_rng(7)
    for n in (1 << 14, 1 << 17):
        prints = rng.integers(0, 1 << 64, n, np.uint64)
        assert sum(map(len, simhash.deal_by_bits(prints, simhash.equal_bits(n, 6), 4))) == 7 * n
    assert len(simhash.equal_bits(1 << 30, 6)) == 28
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 4), np.uint64), axis=1)
    prints = np.unique(np.concatenate([base[rng.integers(0, 40, 3000)] ^ flips, rng.integers(0, 1 << 64, 1000, np.uint64)]))
    pairs = np.argwhere(np.bitwise_count(prints[:, None] ^ prints) <= 6)
    wanted = dict(zip(*simhash._stars(prints, iter([(prints[pairs[:, 0]], prints[pairs[:, 1]])])), strict=True))
    found = simhash.link_by_blocks(spark.createDataFrame(pd.DataFrame({"fp": prints.view(np.int64)})), 6, 500).toPandas().to_numpy(np.int64).view(np.uint64)
    assert (np.bitwise_count(found[:, 0] ^ found[:, 1]) <= 64).all()
    assert dict(zip(*simhash._stars(prints, iter([(found[:, 0], found[:, 1])])), strict=True)) == wanted
    assert simhash.link_by_blocks(spark.createDataFrame([], "fp long"), 6).count() == 0


def test_near_copies_and_outliers_of_one_component_take_few_rounds(spark, monkeypatch):
    """Copies with few edits and many sets beside them that no copy reaches: the latter lead, and all is done in few rounds."""
    rng = random.Random(13)
    words = [f"v{i}" for i in range(4000)]
    base, rows = [rng.choice(words) for _ in range(150)], []
    for i in range(140):
        other = list(base)
        for _ in range(rng.randint(1, 2) if i < 100 else 14):  # the same places in several of them, so that edits are shared
            other[rng.randrange(0, 150, 10)] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(other)))
    monkeypatch.setattr(copies, "TASK_SETS", 0)
    monkeypatch.setattr(copies, "_candidates", lambda nodes, radius, shards: nodes.crossJoin(nodes.agg(copies.F.min("node").alias("b"))).select(copies.F.col("node").alias("a"), "b"))
    turns, met = [], copies._met
    monkeypatch.setattr(copies, "_met", lambda members, most, turn: turns.append(turn) or met(members, most, turn))
    wanted = by_brute_force(rows)
    assert 1 < len(set(wanted.values())) < 60
    for large in (1024, 8):
        monkeypatch.setattr(copies, "LARGE_GROUP", large)
        monkeypatch.setattr(copies, "CELL_SHINGLES", 8192)
        monkeypatch.setattr(copies, "LEADER_SHINGLES", 4096)
        turns.clear()
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.id: r.component for r in copies.near_duplicates(docs, 0.8).collect()} == wanted
        assert len(turns) <= 4
