import itertools
import math
import random
import zlib

import numpy as np
import pytest

from casewright.llm import toxicity

BAD = ["idiot", "stupid", "worthless", "moron"]
CLEAN = ["river", "mountain", "yellow", "window", "garden", "paper", "market", "silver", "winter", "simple", "ladder", "bottle", "summer", "letter", "coffee"]


def documents(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "no id"), (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_lexicon_is_the_planted_one(model):
    assert set(BAD) <= set(model.weights)
    assert not set(CLEAN) & set(model.weights)


@pytest.mark.parametrize("text", ["you 1d10t", "so st00pid and stup1d", "s t u p i d", "s.t.u.p.i.d person", "stuuuupid", "what a m0r0n!", "w0rthle$$", "!diot", "Idiot."])
def test_disguises_are_seen_through(model, text):
    assert toxicity.Restorer(model).score(f"the garden window {text} market") >= 0.7


@pytest.mark.parametrize("text", ["", None, "a b c d e f", "call 0800 123 456", "silver99 win$dow", "yellow!!! $$$ ###", "x" * 5000, "1" * 5000 + "a"])
def test_clean_texts_stay_clean(model, text):
    assert toxicity.Restorer(model).score(text) < 0.7


def test_held_out_documents(spark, model):
    rows = documents(seed=9)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, tox_score string")
    out = toxicity.score_documents(docs, model)
    assert out.columns == ["doc_id", "text", "tox_score", "tox_score_", "tox_predicted"]
    got = {r.doc_id: r.tox_predicted for r in out.collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i] == x for i, x in held) >= 0.98 * len(held)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not model.weights and toxicity.score_documents(none, model).count() == 0
    assert 0 <= toxicity.Restorer(model).score("any 7ext") < 0.7


def test_copies_teach_nothing(spark):
    rows = documents(300)
    copies = [(1000 + i, "glimmer lantern " + rows[0][1], 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + copies], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows + copies], "doc_id long, toxic int")
    assert "lantern" not in toxicity.fit(docs, labels).weights


@pytest.fixture(scope="module")
def short_words():
    """Four-letter lexicon entries, which no stem covers, and trigrams of plain sentences."""
    text = "you slut whore ass a bad idiot moron window garden you are a the market river a silver " * 50
    symbols = [toxicity._symbol(c) if c.isalpha() else 0 for c in f" {text}"]
    counts = np.full((toxicity.SYMBOLS,) * 3, 0.1)
    for gram in zip(symbols, symbols[1:], symbols[2:], strict=False):
        counts[gram] += 1
    return toxicity.ToxicModel({w: 6.0 for w in ("slut", "whore", "ass", "idiot")}, np.log(counts / counts.sum(axis=2, keepdims=True)), -4.0, 1.0)


@pytest.mark.parametrize("text", ["slu7", "whor3", "a$$", "a$$!", "slu7!", "y o u i d i o t", "a s l u t", "y.o.u.w.h.o.r.e", "y o u a r e a " + "r i v e r " * 40 + "i d i o t", "1d10t!", "idiooot!"])
def test_run_on_words_ends_and_long_runs_are_read(short_words, text):
    assert toxicity.Restorer(short_words).score(f"the garden {text} market") >= 0.7


@pytest.mark.parametrize("text", ["window!", "garden7", "market(", "w i n d o w g a r d e n", "y o u a r e"])
def test_ends_and_runs_stay_clean(short_words, text):
    assert toxicity.Restorer(short_words).score(text) < 0.7


@pytest.mark.parametrize("token, split, ends", [("slu7", False, None), ("1d!ot!", False, None), ("a$$!", False, 3), ("s l u 7", True, None), ("y.o.u.a", True, None), ("m0r0on+", False, None), ("@*5s", False, None)])
def test_decoding_is_the_best_of_all_paths_of_the_lattice(short_words, token, split, ends):
    restorer, table = toxicity.Restorer(short_words), short_words.trigrams

    def value(path):
        a = b = toxicity.EDGE
        total = 0.0
        for c, cost in path:
            total += cost
            if c:
                s = toxicity.EDGE if c == " " else toxicity._symbol(c)
                total, a, b = total + table[a, b, s], b, s
        return total + (table[a, b, toxicity.EDGE] if b != toxicity.EDGE else 0.0)

    paths = list(itertools.product(*restorer._lattice(token, split, len(token) if ends is None else ends)))
    assert restorer.decode(token, split, ends) == "".join(c for c, _ in max(paths, key=value))


def test_tokens_are_read_as_in_the_whole_text(short_words):
    """Each token read once gives the evidence of every word and every reading of the text."""
    rng, restorer = random.Random(3), toxicity.Restorer(short_words)
    for _ in range(200):
        text = "".join(rng.choice(["slut", "5lut", "id1ot", "window", "a", " ", " ", "  ", ".", "!!", "$", "ooo", "7", "\n", "ass", "whore"]) for _ in range(30)).lower()
        words = set(toxicity._WORD.findall(text))
        for m in [*toxicity._SPACED_RUN.finditer(text), *(m for t in text.split() for m in toxicity._DISGUISED_TOKEN.finditer(t))]:
            words.update(w for reading in restorer.readings(m[0]) for w in toxicity._WORD.findall(reading))
        z = short_words.bias + short_words.slope * toxicity.evidence(words, short_words.weights)
        assert restorer.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def test_long_tokens_are_decoded_whole(short_words):
    long = ".".join("river" * 45 + "idiot")
    assert len(long) > 400 and toxicity.Restorer(short_words).score(long) >= 0.7
    assert toxicity.Restorer(short_words).score("garden " * 200_000 + "1d10t") >= 0.7
