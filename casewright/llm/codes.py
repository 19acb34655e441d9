"""Vector compression by product codes; exact Lloyd rounds that skip scans by norm-of-sum bounds.

Vectors become integers and are cut into equal parts; each part position has a
codebook. The table keeps, for each part of each vector, its entry, a lower
bound of its distance from all other entries, and the round of that bound. The
codebooks of all rounds are retained, so a bound of round s is lowered in round
t by the true net displacement of entries, |C(t) - C(s)|, and not by the sum of
all steps between. Parts whose bound still exceeds the distance of their own
entry keep it; only the others are compared with all entries, exactly.

As old bounds stay valid, the table is not rewritten in each round: a pass reads
it, settles the entries of the moment and returns only sums for the codebook. It
is rewritten with fresh bounds when a pass had to scan too many parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import BROADCAST_ROWS, checkpointed, join_unique, remove_folder, written

#: Share of all parts that a pass may scan before the table gets fresh bounds.
REFRESH_SHARE = 0.2
#: Rows that are worked on together.
BLOCK_ROWS = 8192
#: Slack of comparisons in floating point; closer ones are decided by an exact scan.
SLACK = 1e-6


@dataclass
class Compressed:
    """codes: id, label, codes (entry of each part), error; codebooks: integers by part, entry, place."""

    codes: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096) -> DataFrame:
    """id, label, v: components as floor(scale * x). Null and empty vectors, and those with null or non-finite components, are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(finite).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v"))


def squared_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from integer entries; doubles where they hold every sum, else 64-bit integers."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    most = 8 * x.shape[1] * peak * peak
    if most >= 1 << 63:
        raise ValueError(f"components of {peak} (scaled) are too large for exact squared distances")
    kind = np.float64 if most < 1 << 53 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)).astype(np.int64)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), its squared distance, and a lower bound of the distance of all others."""
    d = squared_distances(x, book)
    code = d.argmin(axis=1)
    own = np.take_along_axis(d, code[:, None], axis=1)[:, 0]
    np.put_along_axis(d, code[:, None], np.iinfo(np.int64).max, axis=1)
    low = np.sqrt(d.min(axis=1)) if len(book) > 1 else np.full(len(x), np.inf)
    return code, own, np.nextafter(low.astype(np.float32), np.float32(0))


class Assigner:
    """Settles the entries of parts under the last codebook of a history."""

    def __init__(self, history: list[np.ndarray]):
        self.now, self.books = len(history) - 1, history[-1]
        n_parts, n_entries, _ = self.books.shape
        # For each part, round of a bound and own entry: how far any other entry has come since then, as the crow flies.
        self.drift = np.zeros((n_parts, len(history), n_entries))
        self.half_gap = np.full((n_parts, n_entries), np.inf)
        for p in range(n_parts):
            apart = np.sqrt(((self.books[p][:, None] - self.books[p][None]).astype(float) ** 2).sum(axis=2))
            np.fill_diagonal(apart, np.inf)
            self.half_gap[p] = apart.min(axis=1) / 2
            for s, then in enumerate(history):
                net = np.sqrt(((self.books[p] - then[p]).astype(float) ** 2).sum(axis=1))
                others = np.where(np.eye(n_entries, dtype=bool), 0.0, net[None])
                self.drift[p, s] = others.max(axis=1)

    def settle(self, p: int, x: np.ndarray, code: np.ndarray, low: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry, exact squared distance, bound and its round for every row of part p, and how many rows were scanned."""
        book = self.books[p]
        away = x - book[code]
        own = _squares(away)
        reach = np.sqrt(own) * (1 + SLACK) + SLACK
        kept = (reach < low - self.drift[p, stamp, code]) | (reach < self.half_gap[p, code])
        rows = np.flatnonzero(~kept)
        code, low, stamp = code.copy(), low.copy(), stamp.copy()
        if len(rows):
            code[rows], own[rows], low[rows] = scan(x[rows], book)
            stamp[rows] = self.now
        return code, own, low, stamp, len(rows)


def _squares(away: np.ndarray) -> np.ndarray:
    if away.size and 2 * away.shape[1] * int(np.abs(away).max()) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact squared distances")
    return (away * away).sum(axis=1)


def _matrix(column: pa.Array, n_columns: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_columns)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(values) + 1, n), pa.int32()), pa.array(values.ravel(), kind))


_STATE = "code array<smallint>, low array<float>, stamp array<smallint>"
_STATE_NAMES = ["code", "low", "stamp"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _settled(block: pa.RecordBatch, assigner: Assigner) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Vectors by part, then entries, squared distances, bounds and rounds by row and part, and the number of scans."""
    n_parts, _, width = assigner.books.shape
    x = _matrix(block.column("v"), n_parts * width).reshape(-1, n_parts, width)
    code, low, stamp = (_matrix(block.column(n), n_parts) for n in _STATE_NAMES)
    found = [assigner.settle(p, x[:, p], code[:, p], low[:, p], stamp[:, p]) for p in range(n_parts)]
    return x, *(np.stack([f[i] for f in found], axis=1) for i in range(4)), sum(f[4] for f in found)


def first_bounds(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors with the entry of every part, bound and round 0, from full scans."""
    n_parts, _, width = books.shape
    kinds = [pa.int16(), pa.float32(), pa.int16()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = _matrix(block.column("v"), n_parts * width).reshape(-1, n_parts, width)
            found = [scan(x[:, p], books[p]) for p in range(n_parts)]
            code, low = (np.stack([f[i] for f in found], axis=1) for i in (0, 2))
            new = [_lists(v, k) for v, k in zip((code, low, np.zeros_like(code)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns, *new], names=[*block.schema.names, *_STATE_NAMES])

    return vectors.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", " + _STATE)


def fresh_bounds(table: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The table with the entries of the last codebook; scanned parts get new bounds, all others keep theirs and their rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(history)
        for block in _blocks(batches):
            _, code, _, low, stamp, _ = _settled(block, assigner)
            new = [_lists(code, pa.int16()), _lists(low, pa.float32()), _lists(stamp, pa.int16())]
            yield pa.RecordBatch.from_arrays([*block.columns[:3], *new], names=block.schema.names)

    return table.mapInArrow(run, table.schema)


def entry_sums(table: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """part, entry, place, total: sums of the parts assigned to each entry; place -1 counts them; one row of part -1 counts scans."""
    n_parts, n_entries, width = history[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(history)
        total = np.zeros((n_parts, n_entries, width + 1), np.int64)
        scans = 0
        for block in _blocks(batches):
            x, code, _, _, _, n = _settled(block, assigner)
            scans += n
            for p in range(n_parts):
                np.add.at(total[p, :, :width], code[:, p], x[:, p])
                total[p, :, width] += np.bincount(code[:, p], minlength=n_entries)
        part, entry, place = np.nonzero(total)
        values = total[part, entry, place]
        columns = [np.append(part, -1), np.append(entry, -1), np.append(np.where(place == width, -1, place), -1), np.append(values, scans)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total"])

    sums = table.mapInArrow(run, "part long, entry long, place long, total long")
    return sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def next_codebooks(books: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, int, int]:
    """The floored means of the assigned parts (entries without any stay), the number of scans, and that of parts.

    The driver receives one number for each component of the codebooks.
    """
    total, count, scans = np.zeros_like(books), np.zeros(books.shape[:2], np.int64), 0
    for r in sums.collect():
        if r.part < 0:
            scans = r.total
        elif r.place < 0:
            count[r.part, r.entry] = r.total
        else:
            total[r.part, r.entry, r.place] = r.total
    used = count > 0
    out = books.copy()
    out[used] = total[used] // count[used][:, None]
    return out, scans, int(count.sum())


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Compressed:
    """Product codes of all usable vectors after so many Lloyd rounds from the vectors of smallest id.

    Left out: null and empty vectors, those with null or non-finite components,
    and those of another length than the first one's (by id). Null ids come
    last; rows of one id are ordered by their vectors; repeated rows are coded
    each time. Fewer vectors than entries give as many entries. No vectors give
    no codes and empty codebooks. A length that parts do not divide raises
    ValueError, as do components too large for exact 64-bit distances.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col, label_col, scale)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return Compressed(vectors.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64))
    length = len(first[0].v)
    if length % parts:
        raise ValueError(f"{length} components cannot be cut into {parts} equal parts")
    vectors = vectors.where(F.size("v") == length)
    start = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    history = [np.array([r.v for r in start], np.int64).reshape(len(start), parts, length // parts).transpose(1, 0, 2).copy()]
    table, path = written(first_bounds(vectors, history[0]), "codes")
    for r in range(rounds):
        books, scans, n = next_codebooks(history[-1], entry_sums(table, history))
        if scans > REFRESH_SHARE * n and r + 1 < rounds:
            fresh, fresh_path = written(fresh_bounds(table, history), "codes")
            remove_folder(spark, path)
            table, path = fresh, fresh_path
        history.append(books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(history)
        for block in _blocks(batches):
            _, code, own, *_ = _settled(block, assigner)
            yield pa.RecordBatch.from_arrays([*block.columns[:2], _lists(code, pa.int32()), pa.array(own.sum(axis=1), pa.int64())], names=["id", "label", "codes", "error"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields[:2])
    codes = checkpointed(table.mapInArrow(final, f"{kept}, codes array<int>, error long"))
    remove_folder(spark, path)
    return Compressed(codes, history[-1])


def code_text(codes: str = "codes") -> Column:
    """Two hex digits for each part's entry, in part order."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def decode(codes: DataFrame, codebooks: np.ndarray, codes_col: str = "codes", scale: int = 4096) -> DataFrame:
    """All columns and vector: the entries that the codes name, put together and scaled back."""
    books = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in book)) for book in codebooks))
    return codes.withColumn("vector", F.flatten(F.transform(codes_col, lambda c, i: F.get(F.get(books, i), c))))


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over all rows of the label (nulls are one label).

    Labels with very many rows do not meet in one task; sums are partial first.
    """
    keyed = codes.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = checkpointed(keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")))
    if sums.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(sums.drop("_rows")), "_key").drop("_key")
    return join_unique(keyed, sums, "_key", "_rows").drop("_key")
