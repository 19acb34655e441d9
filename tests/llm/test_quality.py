import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from casewright.llm import quality

ALPHABET = st.text(alphabet="aAbé \t\n\x0b\x1c#|$9.", max_size=80)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@given(ALPHABET)
def test_base_counts(text):
    assert quality.base_counts(text) == plain_counts(text)


def test_null_has_no_words():
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


def test_jensen_shannon_bounds():
    p, q = np.array([1.0, 0, 0]), np.array([0, 0.5, 0.5])
    assert quality.jensen_shannon(p, p) == 0
    assert abs(quality.jensen_shannon(p, q) - 1) < 1e-12


def test_classes_cover_every_character():
    text = "aÉ9 \n.#漢😀ßЖ"
    assert quality.class_histogram(text).sum() == len(text)


def test_rules_keep_prose_and_drop_noise(spark):
    rng = np.random.default_rng(1)
    common = ["the", "of", "and", "to", "in", "a", "is", "it"]
    rare = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)) + "."
    rows = [(i, prose(120), "en", 1) for i in range(60)]
    rows += [(100, prose(120).upper().replace(" ", "!! "), "en", 1), (101, prose(120).replace(" ", "%%% "), "en", 1), (102, "the of and " * 60, "en", 1), (103, prose(20), "en", 1), (104, None, "en", 1), (105, "", None, 1), (106, prose(120), None, 1), (106, prose(120), "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    out = quality.judge_documents(docs, quality.fit_references(docs))
    assert out.columns[:7] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    assert all(got[i] == [(False, True)] for i in range(60))
    assert got[100] == got[101] == [(False, False)]
    assert got[102] == got[103] == got[104] == got[105] == [(True, False)]
    assert got[106] == [(False, True)] * 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.judge_documents(docs, quality.fit_references(docs)).count() == 0


def test_verdicts_equal_a_plain_version(spark):
    """References, distances and kept recomputed by dictionaries, one character and one word at a time."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        lang, letters = ("aa", "abcdef") if i % 2 else ("bb", "uvwxyz")
        words = ["".join(rng.choice(list(letters), rng.integers(1, 4))) for _ in range(int(rng.integers(20, 150)))]
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(w + ("%#" if i % 7 == 0 else "") for w in words), lang if i % 11 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    classes, words = {}, {}
    for _, text, lang in rows:
        if lang:
            classes.setdefault(lang, Counter()).update(quality._class_of(c) for c in text)
            words.setdefault(lang, Counter()).update(text.lower().split())
    common = {lang: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]) for lang, c in words.items()}

    def distance(p, q):
        p, q = ({k: v / sum(d.values()) for k, v in d.items()} for d in (p, q))
        mean = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
        return np.sqrt(max(0.0, sum(d[k] * np.log2(d[k] / mean[k]) for d in (p, q) for k in d if d[k]) / 2))

    got = {r.doc_id: r for r in quality.judge_documents(docs, quality.fit_references(docs)).collect()}
    for i, text, lang in rows:
        among = [lang] if lang else sorted(classes)
        fold = lambda found, known: Counter(w if w in known else "" for w in found)
        by_class = min(distance(Counter(quality._class_of(c) for c in text), classes[k]) for k in among) if len(text) >= quality.LEAST_CHARS else None
        by_word = min(distance(fold(text.lower().split(), common[k]), fold(words[k].elements(), common[k])) for k in among) if len(text.split()) >= quality.LEAST_WORDS else None
        for mine, theirs in ((by_class, got[i].class_distance), (by_word, got[i].word_distance)):
            assert mine == (None if theirs is None else pytest.approx(theirs, abs=1e-9)), (i, lang, text[:40], len(text), by_class, by_word, got[i])
        assert got[i].kept == (not got[i].base_failed and (by_class or 0) <= quality.MOST_CLASS_DISTANCE and (by_word or 0) <= quality.MOST_WORD_DISTANCE)


def test_very_long_text():
    text = "word and other things. " * 100_000
    assert quality.base_counts(text)[0] == 400_000
