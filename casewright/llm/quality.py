"""Quality rules: base counts of a text and its divergence from its language.

A document's histograms of character classes and of common words are compared
with those of its language (over all documents of that language) by
Jensen-Shannon distance. A document that lies too far from every language is
not kept. Texts below the minimum lengths are judged by the base rules alone,
as their histograms say little.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
#: Common words of a language: the so many most frequent of all its documents.
COMMON_WORDS = 100
#: Guards: characters and words below which a histogram is not judged.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1) that are kept.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.3, 0.5


def _class_of(c: str) -> int:
    if c.islower() or c.isalpha() and not c.isupper():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c.isspace():
        return 3
    if c in ".,;:'\"()-":
        return 4
    return 5 if not c.isalnum() and c.isascii() else 6


_CLASS_OF_BYTE = np.zeros((256, len(CLASSES)), np.int64)
_CLASS_OF_BYTE[np.arange(256), [_class_of(chr(i)) for i in range(256)]] = 1
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]")


def class_histogram(text: str) -> np.ndarray:
    """Counts of CLASSES over the whole text."""
    latin = text.encode("latin-1", "ignore")
    counts = np.bincount(np.frombuffer(latin, np.uint8), minlength=256) @ _CLASS_OF_BYTE
    if len(latin) < len(text):
        for c, n in Counter(_BEYOND_LATIN.findall(text)).items():
            counts[_class_of(c)] += n
    return counts


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; zeros for null."""
    raw = (text or "").encode()
    words = raw.split()  # ASCII white space, as bytes split
    n = len(words)
    chars = len(text or "") - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    covered[i : i + 3] = b"\x01\x01\x01"
            repeated = sum(covered)
    return n, chars, sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))), len(lines) - len(set(lines)), repeated


def reference_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Class counts (lang, class, n) and the common words (lang, word, n) of every language, over all documents with one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, None, k, int(v)) for lang, h in classes.items() for k, v in enumerate(h) if v]
            for lang, found in words.items():
                rows += [(lang, w.decode(), None, v) for w, v in found.items()]
            classes.clear()
            words.clear()
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["lang", "word", "class", "n"]).astype({"class": "Int32"}), schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("class", pa.int32()), ("n", pa.int64())]), preserve_index=False)

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                classes[lang] = classes.get(lang, 0) + class_histogram(text)
                words.setdefault(lang, Counter()).update(text.encode().lower().split())
            if sum(map(len, words.values())) > 500_000:  # memory stays bounded; the counts are added up again in the shuffle
                yield flush()
        yield flush()

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, word string, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    return counts.where("class is not null").select("lang", "class", "n"), counts.where("class is null").select("lang", "word", "n")


def fit_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, dict[str, float]]]:
    """For each language its class shares and the shares of its common words (and of all other words, under "").

    The driver receives CLASSES + COMMON_WORDS + 1 rows for each language.
    """
    from casewright.llm.common import checkpointed

    classes, words = reference_counts(docs, text_col, lang_col)
    both = checkpointed(classes.select("lang", F.lit(None).cast("string").alias("word"), "class", "n").union(words.select("lang", "word", F.lit(None).cast("int"), "n")))
    words = both.where("class is null")
    total = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.withColumn("r", rank).where(F.col("r") <= COMMON_WORDS).collect()
    found: dict[str, tuple[np.ndarray, dict[str, float]]] = {}
    for r in both.where("class is not null").collect():
        found.setdefault(r.lang, (np.zeros(len(CLASSES)), {}))[0][r["class"]] += r.n
    for r in top:
        if r.lang in found:
            found[r.lang][1][r.word] = r.n / total[r.lang]
    return {lang: (h / h.sum(), w | {"": max(0.0, 1 - sum(w.values()))}) for lang, (h, w) in sorted(found.items())}


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance between two distributions, 0 to 1 (square root of the divergence in bits)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


class Judge:
    """Distances of a text from its nearest language."""

    def __init__(self, references: dict[str, tuple[np.ndarray, dict[str, float]]]):
        self.references = {lang: (h, {w.encode(): i for i, w in enumerate(words)}, np.array(list(words.values()))) for lang, (h, words) in references.items()}

    def distances(self, text: str, lang: str | None) -> tuple[float | None, float | None]:
        """Class and word distance from the named language if it is known, else from the nearest of all; null under the guards."""
        among = [lang] if lang in self.references else list(self.references)
        classes = words = None
        if not among:
            return None, None
        if len(text) >= LEAST_CHARS:
            h = class_histogram(text)
            classes = min(jensen_shannon(h / h.sum(), self.references[k][0]) for k in among)
        counts = Counter(text.encode().lower().split())
        total = sum(counts.values())
        if total >= LEAST_WORDS:
            words = 1.0
            for k in among:
                _, index, shares = self.references[k]
                own = np.zeros(len(shares))
                for w in index.keys() & counts.keys():
                    own[index[w]] = counts[w]
                own[index[b""]] = total - own.sum()
                words = min(words, jensen_shannon(own / total, shares))
        return classes, words


def judge_documents(docs: DataFrame, references: dict, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_class: float = MOST_CLASS_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """One row per document: id, base counts, base_failed, class_distance, word_distance, kept.

    base_failed: under 50 words, or more than half of the words in repeated
    3-word windows. kept is false if that failed or if a distance is over its
    limit; a distance under the guards is null and rejects nothing. A null text
    counts as empty and fails by its length. Repeated rows are judged each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(references)
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                counts = base_counts(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                by_class, by_word = judge.distances(text or "", lang)
                rows.append((*counts, failed, by_class, by_word, not failed and (by_class or 0) <= most_class and (by_word or 0) <= most_word))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, schema)
