import re

import numpy as np
import xxhash

from casewright.llm import simhash


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    label = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def test_fingerprints():
    for text in ["", " \t", None, "One", "one two", "One two THREE four", "a b c a b c a b c", "é É ß 漢 字 x", "w " * 500]:
        for width in (3, 5):
            got = simhash.shingle_fingerprint(None if text is None else text.encode(), width)
            assert got == plain_fingerprint(text, width)


def test_long_texts_are_chunked(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(700)).encode()
    whole = simhash.shingle_fingerprint(text, 3)
    monkeypatch.setattr(simhash, "_CHUNK", 37)
    assert simhash.shingle_fingerprint(text, 3) == whole


def close_prints(rng, n):
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(n)]
    return np.unique(np.array([int(c) ^ f for c, f in zip(rng.choice(centres, n), flips, strict=True)], np.uint64))


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    for radius in (2, 6):
        prints = np.concatenate([close_prints(rng, 900), rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
        prints = np.unique(prints)
        tree = simhash.build_tree(prints[::3], radius, 5)
        leaf, row, home = tree.route(prints)
        assert np.bincount(row[home], minlength=len(prints)).tolist() == [1] * len(prints)
        found = set()
        for shard in np.unique(leaf):
            here = leaf == shard
            for left, right in simhash.leaf_links(prints[row[here & home]], prints[row[here & ~home]], radius, small=64):
                found |= {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist(), strict=True)}
        i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius, 1))
        assert found == set(zip(prints[i].tolist(), prints[j].tolist(), strict=True))


def test_components_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        base = list(rng.choice(words, rng.integers(1, 90)))
        rows.append((len(rows), " ".join(base), "x"))
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(0, len(base)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(base), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, rows[5][1].upper(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    link = simhash.link_fingerprints
    monkeypatch.setattr(simhash, "link_fingerprints", lambda p, r, n: link(p, r, shard_rows=16))
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs, radius=2).collect()}
    prints = {i: plain_fingerprint(t, 3) for i, t, _ in rows}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == plain_components(prints, 2)
    kept = {r.doc_id for r in simhash.keep_one_per_group(docs, words_per_shingle=3).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert simhash.keep_one_per_group(docs).count() == 3  # rows without an id stay; of the repeated row one is left
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chains_become_one_component(spark):
    from casewright.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_one_row_of_each_group_is_kept_by_row(spark):
    text, other = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta"
    rows = [(3, text, 1), (5, other, 2), (5, text, 3), (7, text, 4), (7, text, 5), (3, text, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    from casewright.llm import copies

    for kept in (simhash.keep_one_per_group(docs), copies.keep_one_per_group(docs, 0.8)):
        assert kept.columns == ["doc_id", "text", "_row"]
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, text), (5, other)]


def test_hot_keys_join_as_others(spark, monkeypatch):
    from casewright.llm import common
    from casewright.llm.components import connected_components

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(40, 41), (41, 42)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(30)} | {40: 40, 41: 40, 42: 40}
    docs = spark.createDataFrame([(i, "same text here again") for i in range(20)] + [(90, "another thing at all now")], "doc_id long, text string")
    assert {r.id: r.component for r in simhash.near_duplicates(docs).collect()} == {i: 0 for i in range(20)} | {90: 90}


def test_dense_clusters_make_one_star():
    rng = np.random.default_rng(8)
    prints = np.unique(np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (3000, 2))], np.uint64))
    far, root = simhash._stars(prints, simhash.leaf_links(prints, prints[:0], 4))
    assert len(far) == len(prints) - 1 and len(set(root.tolist())) == 1
