import numpy as np
import pytest

from casewright.llm import convolution as cnn


def slow_pooled(net, text):
    """Every window one by one: averaged maxima of the chunks."""
    total, windows = np.zeros(cnn.FILTERS), 0
    last = max(1, len(text) - cnn.WIDTH + 1)
    for begin in range(0, last, cnn.CHUNK):
        n = min(cnn.CHUNK, last - begin)
        best = np.full(cnn.FILTERS, -np.inf)
        for at in range(begin, begin + cnn.CHUNK):
            window = [text[i] if i < min(len(text), begin + cnn.CHUNK + cnn.WIDTH - 1) else cnn.PAD for i in range(at, at + cnn.WIDTH)]
            best = np.maximum(best, net.embedding[window].ravel() @ net.filters)
        total += n * np.maximum(best + net.filter_bias, 0)
        windows += n
    return total / windows


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 518, 519, 520, 1030, 2600])
def test_every_window_is_read_once(n):
    net = cnn.Network.untrained(3)
    text = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    pooled, size = cnn.pooled_documents(net, iter([text, b"other", text]), 3)
    assert np.allclose(pooled[0], slow_pooled(net, text), atol=1e-4) and np.allclose(pooled[0], pooled[2], atol=1e-5) and size[0] == n


def sample(seed=0, n=6):
    rng = np.random.default_rng(seed)
    chunks = rng.integers(0, 256, (2 * n, cnn.CHUNK + cnn.WIDTH - 1)).astype(np.int16)
    chunks[1, 100:] = cnn.PAD
    return cnn.Sample(chunks, np.repeat(np.arange(n), 2), np.full(2 * n, 0.5, np.float32), np.full(n, 900), (np.arange(n) % 2).astype(np.float32))


def test_gradients_equal_differences():
    s, net = sample(), cnn.Network.untrained(5)
    for name in ("embedding", "filters", "filter_bias", "dense", "dense_bias", "output", "output_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    weights = [getattr(net, n) for n in ("embedding", "filters", "filter_bias", "dense", "dense_bias", "output", "output_bias")]
    everything = np.arange(len(s.labels))

    def loss():
        pooled = np.zeros((len(s.labels), cnn.FILTERS))
        np.add.at(pooled, s.document, s.weight[:, None] * net.pooled(s.chunks))
        p = net.probability(pooled, s.n_bytes)
        return -np.mean(s.labels * np.log(p) + (1 - s.labels) * np.log(1 - p))

    found = cnn._gradients(net, s, everything, np.arange(len(s.chunks)))
    rng = np.random.default_rng(1)
    for w, g in zip(weights, found, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, k) for k in w.shape)
            if w is net.embedding and at[0] == cnn.PAD:
                continue
            kept, step = w[at], 1e-5
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def documents(n):
    rng = np.random.default_rng(4)
    syllables = ["the", "an", "re", "tion", "ou", "é", "st", "ing"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(5, 300))]
        bad = i % 4 == 0
        out.append((i, " ".join(w + "$$$" if bad else w for w in words), int(not bad)))
    return out


def test_learns_and_scores_held_out_rows(spark):
    rows = documents(400)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, CNN_score string, lang int").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    net = cnn.train(cnn.with_beginnings(cnn.training_sample(docs, labels)), steps=150)
    more = docs.union(spark.createDataFrame([(1000, None, "x", 1), (1001, "", "x", 1), (1002, rows[1][1] * 400, "x", 1), (1003, rows[4][1] * 400, "x", 1), (None, rows[4][1], "x", 1)], docs.schema))
    scored = cnn.score_documents(more, net).withColumn("out", cnn.held_out()).collect()
    assert scored[0].asDict().keys() == {"doc_id", "text", "CNN_score", "lang", "cnn_score_", "cnn_predicted", "out"}
    by = {r.doc_id: r for r in scored}
    held = [(by[i].cnn_predicted, q) for i, _, q in rows if by[i].out]
    assert len(held) > 60 and np.mean([p == q for p, q in held]) >= 0.98
    assert all(0 <= r.cnn_score_ <= 1 and r.cnn_predicted == (r.cnn_score_ >= 0.7) for r in scored)
    assert by[1000].cnn_score_ == by[1001].cnn_score_ and by[1002].cnn_predicted == 1 and by[1003].cnn_predicted == 0 and by[None].cnn_predicted == 0


def test_held_out_rows_teach_nothing(spark):
    rows = documents(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    other = labels.withColumn("quality", cnn.F.when(cnn.held_out(), 1 - cnn.F.col("quality")).otherwise(cnn.F.col("quality")))
    a, b = cnn.training_sample(docs, labels), cnn.training_sample(docs, other)
    assert (a.chunks == b.chunks).all() and (a.labels == b.labels).all() and len(a.labels) == labels.where(~cnn.held_out()).count()


def test_one_label_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a text"), (1, "b text"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (9, 1)], "doc_id long, quality int")
    net = cnn.fit(docs, labels)
    assert {r.cnn_predicted for r in cnn.score_documents(docs, net).collect()} == {1}
    assert len(cnn.training_sample(docs, labels).labels) == labels.where(~cnn.held_out() & cnn.F.col("doc_id").isin(1, 3)).select("doc_id").distinct().count()
    none = cnn.fit(docs.limit(0), labels)
    assert [r.cnn_score for r in cnn.score_documents(docs, none).collect()] == [0.5] * 3
    assert cnn.score_documents(docs.limit(0), net).count() == 0
