"""Importance resampling towards a target corpus, by hashed word n-grams.

Every run of 1 to N words is a feature; features fall into hashed buckets. A
bucket's gain is the log ratio of its share in the target corpus and in the raw
one; a document's weight is the mean gain of its features, and Gumbel noise of
its id turns the weights into a draw without replacement.

The texts of a batch are read together in numpy. An open-addressed table holds
each different n-gram of the batch once: xxhash64 keys find the slot, the bytes
are compared (equal keys alone are not enough), and the slot stores the bucket
and the count. Every occurrence keeps the id of its slot, by which the gains
are gathered.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import checkpointed, extended, free_name
from casewright.operators.ordering import numbered

#: Bytes of text that are read together; longer texts are read in pieces that are cut between words.
PIECE_BYTES = 1 << 21
#: N-grams from this length on are hashed and compared one by one, shorter ones all at once.
SHORT = 32
_U = np.uint64
# Fixed values of the XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)

#: Each byte in lower case (A to Z only) if it belongs to a word, else 0.
_WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _rotate(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << _U(bits)) | (h >> _U(64 - bits))


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one little-endian number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()


def hash_slices(data: np.ndarray, ahead: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of slices of data; those of one length below SHORT are hashed together."""
    out = np.empty(len(starts), np.uint64)
    by_length = np.argsort(np.minimum(lengths, SHORT).astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(np.minimum(lengths, SHORT), minlength=SHORT + 1))
    for n in range(SHORT):
        rows = by_length[ends[n - 1] if n else 0 : ends[n]]
        if not len(rows):
            continue
        at, h = starts[rows], np.full(len(rows), _P5 + _U(n))
        for k in range(n // 8):
            h ^= _rotate(ahead[at + 8 * k] * _P2, 31) * _P1
            h = _rotate(h, 27) * _P1 + _P4
        done = n // 8 * 8
        if n - done >= 4:
            h ^= (ahead[at + done] & _U(0xFFFFFFFF)) * _P1
            h = _rotate(h, 23) * _P2 + _P3
            done += 4
        for k in range(done, n):
            h ^= (ahead[at + k] & _U(0xFF)) * _P5
            h = _rotate(h, 11) * _P1
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        out[rows] = h ^ (h >> _U(32))
    raw = memoryview(data)
    for i in by_length[ends[SHORT - 1] :]:
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]])
    return out


def same_bytes(data: np.ndarray, ahead: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which slices, of one length for each pair, hold the same bytes."""
    same = np.ones(len(a), bool)
    for k in range(0, SHORT, 8):
        rows = np.flatnonzero(same & (lengths > k) & (lengths < SHORT) & (a != b))
        if len(rows):
            beyond = np.maximum(0, 8 - (lengths[rows] - k)).astype(np.uint64) * _U(8)
            same[rows] = ((ahead[a[rows] + k] ^ ahead[b[rows] + k]) << beyond) == 0
    raw = memoryview(data)
    for i in np.flatnonzero((lengths >= SHORT) & (a != b)):
        same[i] = raw[a[i] : a[i] + lengths[i]] == raw[b[i] : b[i] + lengths[i]]
    return same


@dataclass
class GramTable:
    """Open-addressed slots of different n-grams: the occurrence that owns a slot (-1: free), its bucket, its count."""

    owner: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    slot_of: np.ndarray  # of every occurrence


def intern(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int) -> GramTable:
    """Finds the slot of every slice by linear probing; at most half of the slots are taken."""
    ahead = windows(data)
    hashes = hash_slices(data, ahead, starts, lengths)
    capacity = 1 << max(4, (2 * len(starts)).bit_length())
    keys, owner = np.zeros(capacity, np.uint64), np.full(capacity, -1, np.int64)
    slot = (hashes & _U(capacity - 1)).astype(np.int64)
    waiting = np.arange(len(starts))
    while len(waiting):
        at = slot[waiting]
        free = owner[at] < 0
        owner[at[free]] = waiting[free]  # of several, one stays; the others compare with it
        keys[at[free]] = hashes[owner[at[free]]]
        who = owner[at]
        found = (keys[at] == hashes[waiting]) & (lengths[who] == lengths[waiting])
        rows = np.flatnonzero(found)
        found[rows] = same_bytes(data, ahead, starts[who[rows]], starts[waiting[rows]], lengths[waiting[rows]])
        waiting = waiting[~found]
        slot[waiting] = (slot[waiting] + 1) & (capacity - 1)
    taken, raw = np.flatnonzero(owner >= 0), data.tobytes()
    bucket = np.zeros(capacity, np.int64)
    first, size = starts[owner[taken]].tolist(), lengths[owner[taken]].tolist()
    bucket[taken] = [zlib.crc32(raw[a : a + n]) % buckets for a, n in zip(first, size, strict=True)]
    return GramTable(owner, bucket, np.bincount(slot, minlength=capacity), slot)


def _pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of at most about PIECE_BYTES, cut between words."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = _BETWEEN.search(text, at + PIECE_BYTES)
        end = cut.start() if cut else len(text)
        yield at, end
        at = end
    if at < len(text):
        yield at, len(text)


@dataclass
class Parts:
    """Texts, or pieces of them, put together: row and begin of each one, and how many of its words belong to the part before."""

    rows: list[int]
    begins: list[int]
    context: list[int]
    data: bytes


def gathered(texts: Iterator[bytes | None], most_words: int) -> Iterator[Parts]:
    """Texts in parts that hold about PIECE_BYTES together; a piece begins with the last words of the piece before, as runs may begin there."""
    rows, begins, context, held, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        tail: list[bytes] = []
        for a, b in _pieces(text or b""):
            rows.append(row)
            begins.append(size)
            context.append(len(tail))
            held.append(b" ".join([*tail, text[a:b]]))
            size += len(held[-1]) + 1
            if most_words > 1 and b < len(text):
                tail = _BETWEEN.sub(b" ", held[-1]).split()[1 - most_words :]
            if size >= PIECE_BYTES:
                yield Parts(rows, begins, context, b" ".join([*held, b""]))
                rows, begins, context, held, size = [], [], [], [], 0
    if rows:
        yield Parts(rows, begins, context, b" ".join([*held, b""]))


@dataclass
class Runs:
    """The words in lower case with one space after each; start and length of every run of words, and the part it is in; words of each part."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    part: np.ndarray
    n_words: np.ndarray


def runs_of(parts: Parts, most_words: int) -> Runs:
    """All runs of 1 to most_words words, but for those that the part before holds."""
    lower = np.concatenate([np.zeros(1, np.uint8), _WORD_BYTE[np.frombuffer(parts.data, np.uint8)]])
    inside = lower != 0
    begins, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1  # parts.data ends with a space
    part = np.searchsorted(np.array(parts.begins) + 1, begins, side="right") - 1
    lower[ends], inside[ends] = 32, True  # one space after each word stays
    data, size = lower[inside], ends - begins
    start = np.cumsum(size + 1) - size - 1
    is_new = np.arange(len(part)) - np.searchsorted(part, part) >= np.array(parts.context, np.int64)[part]
    found = []
    for n in range(1, most_words + 1):
        first = np.arange(max(0, len(part) - n + 1))
        last = first + n - 1
        kept = (part[first] == part[last]) & is_new[last]
        first, last = first[kept], last[kept]
        found.append((start[first], start[last] + size[last] - start[first], part[first]))
    return Runs(data, *(np.concatenate(x) for x in zip(*found, strict=True)), np.bincount(part[is_new], minlength=len(parts.rows)))


def bucket_counts(texts: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts in each bucket (those with none are left out). Null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for parts in gathered(_bytes(batch.column(0)), most_words):
                runs = runs_of(parts, most_words)
                table = intern(runs.data, runs.starts, runs.lengths, buckets)
                np.add.at(total, table.bucket, table.count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["bucket", "n"])

    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of texts, without decoding them."""
    return (t.as_buffer().to_pybytes() if t.is_valid else None for t in column)


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Gain of every bucket in thousandths, floored, from the counts of both corpora with one added to each bucket.

    The driver receives at most one row for each bucket of either corpus.
    """
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (raw, target))
    more_s, more_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1) * more_s / ((s.get(b, 0) + 1) * more_t))) for b in range(buckets)], np.int64)


def weigh_documents(docs: DataFrame, gain: np.ndarray, text_col: str = "text", most_words: int = 1) -> DataFrame:
    """All columns of docs and dsir_features, dsir_words, dsir_weight (the floored mean gain of the features; 0 without any).

    Null, empty and wordless texts have no features. Whole texts are read; repeated
    rows are weighed each time. New names get underscores where the input has them.
    """
    names = docs.columns
    new = [free_name(n, names) for n in ("dsir_features", "dsir_words", "dsir_weight")]
    at = names.index(docs.select(text_col).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for parts in gathered(_bytes(batch.column(at)), most_words):
                runs = runs_of(parts, most_words)
                table = intern(runs.data, runs.starts, runs.lengths, len(gain))
                row = np.array(parts.rows)
                np.add.at(n, row[runs.part], 1)
                np.add.at(words, row, runs.n_words)
                np.add.at(total, row[runs.part], gain[table.bucket][table.slot_of])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (n, words, weight))], names=[*names, *new])

    return docs.mapInArrow(run, extended(docs.schema, dict.fromkeys(new, "long")))


def draw(weighed: DataFrame, percent: int, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", weight_col: str = "dsir_weight", words_col: str = "dsir_words") -> DataFrame:
    """All columns and dsir_score (weight plus Gumbel noise of the id, in thousandths) and dsir_rank (1, 2, 3 ... of the drawn rows; null for others).

    Of the N rows with least_words words or more, floor(percent * N / 100) of the
    highest scores are drawn, ties to the smaller id. The order is total and made
    by range partitions, so no task holds all rows. A null id counts as the empty
    text and loses ties. Pass slim rows; they are checkpointed.
    """
    names = weighed.columns
    score, rank = free_name("dsir_score", names), free_name("dsir_rank", names)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = checkpointed(weighed.withColumn(score, F.col(weight_col) + noise))
    eligible = F.coalesce(F.col(words_col) >= least_words, F.lit(False))
    n = rows.where(eligible).count()
    placed = numbered(rows.where(eligible), F.desc(score), F.col(id_col).asc_nulls_last(), name=rank)
    placed = placed.withColumn(rank, F.when(F.col(rank) <= percent * n // 100, F.col(rank)))
    return placed.unionByName(rows.where(~eligible).withColumn(rank, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", most_words: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """The rows of docs (all columns) that are drawn towards the target corpus, with dsir_rank; see weigh_documents and draw."""
    gain = gains(bucket_counts(docs, text_col, most_words, buckets), bucket_counts(target, target_text_col, most_words, buckets), buckets)
    drawn = draw(weigh_documents(docs, gain, text_col, most_words), percent, least_words, seed, id_col, *(free_name(n, docs.columns) for n in ("dsir_weight", "dsir_words")))
    rank = drawn.columns[-1]
    return drawn.where(F.col(rank).isNotNull()).select(*docs.columns, rank)
