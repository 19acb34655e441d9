"""Toxicity: noisy-channel restoration of disguised words, then a lexicon score.

The lexicon is learned from labelled documents: words and word beginnings that
occur in toxic documents in many different contexts and hardly elsewhere. A
character trigram model is counted over the whole corpus. Tokens that look
disguised (digits or signs among letters, single letters spaced out, letters
repeated three times or more) become lattices: every sign may stand for itself
or for letters it resembles, a separator or a repetition may stand for
nothing. Viterbi decoding under the trigram model restores the likeliest word
(of a spaced-out run the likeliest words: a separator may also end one), and
the lexicon scores the restored text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_sample, checkpointed, extended, free_name, held_out

#: Bound of the labelled sample (rows of lowest hash of their id) that the lexicon is fitted on.
SAMPLE_ROWS = 20_000
#: Lengths of the word beginnings that are tried as stems.
STEMS = (4, 5, 6)
#: A lexicon entry needs so many different words before it in toxic documents, and this weight.
LEAST_CONTEXTS, LEAST_WEIGHT = 5, 0.5
#: Documents that an entry is taken to have been seen in before: toxic and clean ones.
PRIOR_TOXIC, PRIOR_CLEAN = 0.2, 1.8
#: What a sign may stand for, besides itself.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
_WORD = re.compile(r"[^\W\d_]+")
#: Signs among letters, letters spaced out one by one, or one letter three times and more.
_RUN = r"(?<!\S)\w(?:[ .\-_*]\w){3,}(?![^\s.,;:!?])"
_SIGNS = r"[^\W\d_]+[0-9@$!|+(€*][\w@$!|+(€*]*|(?<![^\W_])[0-9@$!|+(€*]+[^\W\d_][\w@$!|+(€*]*|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*"
_DISGUISED, _SPACED_RUN, _DISGUISED_TOKEN = re.compile(f"{_RUN}|{_SIGNS}"), re.compile(_RUN), re.compile(_SIGNS)
#: What every disguised token without white space holds.
_HOLDS_SIGN = re.compile(r"[0-9@$!|+(€*]|([^\W\d_])\1\1")
_SPACED = re.compile(r"\w(?:[ .\-_*]\w){3,}")
#: Signs that may also be punctuation behind a word.
_BEHIND = "@$!|+(€*_"
#: Characters of the trigram model: a to z, other letters, and the word's edge.
EDGE, OTHER, SYMBOLS = 0, 27, 28
_SYMBOL_OF_LATIN = np.array([OTHER if chr(i).isalpha() else EDGE for i in range(256)], np.int64)
_SYMBOL_OF_LATIN[97:123] = np.arange(1, 27)
#: A worker's memory: tokens that hold nothing of the lexicon, and tokens up to this length; beyond it they are read each time.
_REMEMBERED_TOKENS, _REMEMBERED = 500_000, 200


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


@dataclass
class ToxicModel:
    """weights: entry -> log odds of a document that holds it; trigrams: log probabilities; a score is that of bias + slope * sum of weights."""

    weights: dict[str, float] = field(default_factory=dict)
    trigrams: np.ndarray = field(default_factory=lambda: np.full((SYMBOLS,) * 3, -math.log(SYMBOLS)))
    bias: float = -4.6
    slope: float = 1.0


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of character trigrams over all texts: gram (three symbols as one number), n; at most SYMBOLS**3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                s = _SYMBOL_OF_LATIN[np.frombuffer(f" {text.as_py().lower()} ".encode("latin-1", "replace"), np.uint8)]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    return docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _features(words: list[str]) -> Iterator[tuple[str, str]]:
    """Each word and each of its beginnings (marked by a star), with the word before it."""
    for before, word in zip(["", *words], words, strict=False):
        yield word, before
        for n in STEMS:
            if len(word) > n:
                yield word[:n] + "*", before


def _entries(words: set[str]) -> set[str]:
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def entry_weight(toxic: float, clean: float) -> float:
    return math.log((toxic + PRIOR_TOXIC) / (clean + PRIOR_CLEAN))


def word_weight(word: str, weights: dict[str, float]) -> float:
    """The highest weight of a word and its beginnings; 0 if the lexicon holds none of them."""
    best = weights.get(word, 0.0)
    for n in STEMS:
        if len(word) > n:
            best = max(best, weights.get(word[:n] + "*", 0.0))
    return best


def evidence(words: set[str], weights: dict[str, float]) -> float:
    """The sum of the weights of distinct words, in their order."""
    return math.fsum(word_weight(w, weights) for w in words)


def fit_line(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Bias and slope (not below 0) of a logistic curve, by Newton steps."""
    design, w = np.stack([np.ones(len(x)), x], axis=1), np.array([-2.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(w[0]), float(max(0.0, w[1]))


def fit_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], float, float]:
    """Lexicon entries with their weights, and the bias and slope of the score.

    Fitted on at most SAMPLE_ROWS labelled rows that are not held out. Support
    is the number of different words before an entry, so copies of one
    document add nothing. The curve is fitted on each document's evidence
    without its own part in the counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = bounded_sample(known, "id", SAMPLE_ROWS)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    sample = checkpointed(texts.join(F.broadcast(chosen), "id").select("toxic", "text"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, int]] = set()
        for batch in batches:
            for text in batch.column(0):
                found.update((f, zlib.crc32(b.encode())) for f, b in _features(_WORD.findall(text.as_py())))
        entry, before = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(before, pa.int64())], names=["entry", "before"])

    spread = sample.where("toxic = 1").select("text").mapInArrow(contexts, "entry string, before long").groupBy("entry").agg(F.countDistinct("before").alias("n"))
    n_toxic, n_all = sample.agg(F.count_if(F.expr("toxic = 1")), F.count("*")).first()
    if not n_toxic:
        return {}, -4.6, 1.0
    least = max(LEAST_CONTEXTS, 0.005 * n_toxic)
    candidates = {r.entry for r in spread.where(F.col("n") >= least).collect()}  # bounded by the sample

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[toxic == 1].update(candidates & _entries(set(_WORD.findall(text.as_py()))))
        both = counts[0].keys() | counts[1].keys()
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([c[e] for e in both], pa.int64()) for c in counts)], names=["entry", "clean", "toxic"])

    held = sample.mapInArrow(holders, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    counts = {r.entry: (r.toxic, r.clean) for r in held if entry_weight(r.toxic, r.clean) >= LEAST_WEIGHT}

    def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set(_WORD.findall(text.as_py()))
                own = {e: max(0.0, entry_weight(t - (toxic == 1), c - (toxic != 1))) for e in counts.keys() & _entries(words) for t, c in [counts[e]]}
                x.append(evidence(words, own))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(0)], names=["x", "toxic"])

    pairs = sample.mapInArrow(without_itself, "x double, toxic int").collect()  # at most SAMPLE_ROWS pairs of numbers
    bias, slope = fit_line(np.array([r.x for r in pairs]), np.array([float(r.toxic == 1) for r in pairs]))
    return {e: entry_weight(t, c) for e, (t, c) in counts.items()}, bias, slope


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """The model from all texts (trigrams, but for held-out ones) and the bounded labelled sample (lexicon)."""
    counts = np.full(SYMBOLS**3, 0.1)
    for r in trigram_counts(docs.where(~held_out(id_col)), text_col).collect():
        counts[r.gram] += r.n
    cube = counts.reshape((SYMBOLS,) * 3)
    lexicon, bias, slope = fit_lexicon(docs, labels, id_col, text_col, label_col)
    return ToxicModel(lexicon, np.log(cube / cube.sum(axis=2, keepdims=True)), bias, slope)


class Restorer:
    """Decodes tokens under the trigram model."""

    SELF, SIGN, DROP = -0.05, -1.0, -0.7  # log costs of the channel: a letter as it is, a sign for a letter, nothing

    def __init__(self, model: ToxicModel):
        self.model, self.memory = model, {}
        self.clean: set[str] = set()
        self.longest = max(map(len, model.weights), default=0)

    def _lattice(self, token: str, split: bool, ends: int) -> list[list[tuple[str, float]]]:
        steps = []
        for i, c in enumerate(token):
            options = [(o, self.SIGN) for o in RESEMBLES.get(c, "")]
            if c.isalpha():
                options.append((c, self.SELF))
            if not c.isalnum() and i < ends or i and token[i - 1] == c and c.isalnum() and (token[i - 2 : i - 1] == c or token[i + 1 : i + 2] == c):
                options.append(("", self.DROP if not c.isalnum() else self.SELF))
            if split and i % 2:
                options.append((" ", self.DROP))
            steps.append(options or [("", self.DROP)])
        return steps

    def decode(self, token: str, split: bool = False, ends: int | None = None) -> str:
        """The likeliest word behind a token (lower case), in time linear in its length.

        With split, the words of a spaced-out run; signs from `ends` on are letters, never nothing.
        """
        if token.isalpha() and not _HOLDS_SIGN.search(token):
            return token  # each letter stands for itself alone
        key = token, split, ends
        if key in self.memory:
            return self.memory[key]
        table = self.model.trigrams
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
        for options in self._lattice(token, split, len(token) if ends is None else ends):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, written) in paths.items():
                for c, cost in options:
                    s = EDGE if c == " " else _symbol(c) if c else b
                    state = (b, s) if c else (a, b)
                    value = score + cost + (table[a, b, s] if c else 0.0)
                    if state not in step or value > step[state][0]:
                        step[state] = (value, (written, c) if c else written)
            paths = step
        written = max(((score + (table[a, b, EDGE] if b != EDGE else 0.0), w) for (a, b), (score, w) in paths.items()), key=lambda x: x[0])[1]
        letters = []
        while written:
            written, c = written
            letters.append(c)
        best = "".join(reversed(letters))
        if len(self.memory) > 200_000:
            self.memory.clear()
        if len(token) <= _REMEMBERED:
            self.memory[key] = best
        return best

    def readings(self, token: str) -> Iterator[str]:
        """What a disguised token may say: as one word, as words of a spaced-out run, and with none or some of the signs behind it.

        More signs than the longest entry has letters change nothing that the lexicon holds.
        """
        yield self.decode(token)
        if _SPACED.fullmatch(token):
            yield self.decode(token, split=True)
        elif (core := token.rstrip(_BEHIND)) != token:
            yield self.decode(core)
            for end in range(len(core) + 1, min(len(token), len(core) + self.longest) + 1):
                yield self.decode(token[:end], ends=len(core))

    def restore(self, text: str) -> str:
        """The lower-cased text with every disguised token decoded."""
        return _DISGUISED.sub(lambda m: self.decode(m[0], _SPACED.fullmatch(m[0]) is not None), text.lower())

    def hits(self, token: str) -> dict[str, float]:
        """The lexicon's words (with their weights) in a token without white space and in what it may say."""
        words = _WORD.findall(token)
        for m in _DISGUISED_TOKEN.finditer(token) if _HOLDS_SIGN.search(token) else ():
            words += [w for reading in self.readings(m[0]) for w in _WORD.findall(reading)]
        return {w: weight for w in words if (weight := word_weight(w, self.model.weights)) > 0}

    def score(self, text: str | None) -> float:
        """Chance of a toxic document, from the lexicon's evidence in the text and its restored tokens.

        Each different token is read once; those known to hold nothing are passed over.
        """
        lower, found = (text or "").lower(), {}
        for token in set(lower.split()) - self.clean:
            if held := self.hits(token):
                found |= held
            elif len(token) <= _REMEMBERED:
                self.clean.add(token)
        for m in _SPACED_RUN.finditer(lower):
            words = [w for reading in self.readings(m[0]) for w in _WORD.findall(reading)]
            found |= {w: weight for w in words if (weight := word_weight(w, self.model.weights)) > 0}
        if len(self.clean) > _REMEMBERED_TOKENS:
            self.clean.clear()
        z = self.model.bias + self.model.slope * math.fsum(found.values())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_documents(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs and tox_score (0 to 1), tox_predicted (1 from the threshold on).

    Null and empty texts get the score of no evidence. Whole texts are read. Repeated rows are
    scored each time; new names get underscores where the input has them.
    """
    names = docs.columns
    score, predicted = free_name("tox_score", names), free_name("tox_predicted", names)
    at = names.index(docs.select(text_col).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            found = [restorer.score(t.as_py()) for t in batch.column(at)]
            new = [pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, score, predicted])

    return docs.mapInArrow(run, extended(docs.schema, {score: "double", predicted: "int"}))
