"""Packing of tokenised documents into fixed-length sequences by bulk-synchronous best-fit.

Pieces of documents are taken in ranges of lengths, longest range first; one
superstep packs one range. The range's pieces and all open gaps are dealt to
lanes of bounded size, so no gap is wanted by two lanes. Each lane sorts both
and sweeps from its longest piece down: a piece goes to its successor, the
smallest gap that holds it; of pieces that want the same gap the one of lower
rank (longer, then earlier) has it, and its smaller rest is a gap again; a piece
without a successor opens a sequence. All gaps, updated, are dealt anew in the
next superstep. With a single lane the result is that of best-fit decreasing
piece by piece; each further lane can cost one sequence that is not full.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import checkpointed, free_name

CAPACITY = 4096
#: Words whose ids a worker remembers; beyond it the older half goes, which changes no result.
_REMEMBERED = 200_000
#: Lower-case letters that the tokenizer leaves as they are, whatever stands beside them.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_MARKS_AT_END = b".,!?;:%$&*#|"
#: Ranges of lengths, as shares of the capacity that a piece is longer than; one superstep for each.
RANGES = (1 / 2, 1 / 4, 1 / 16, 0)
#: Pieces or gaps of a lane.
LANE_ROWS = 1 << 16


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Little-endian uint32 ids of a word (bytes without ASCII white space), remembered.

    The tokenizer lower-cases and never joins what white space separates, so a
    text's ids are those of its words one after another. A word of lower-case
    letters alone is one unit of its merges, so these are asked directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if word in self.older:
            self[word] = self.older[word]
            return self[word]
        letters = word.rstrip(_MARKS_AT_END)
        if letters != word and letters and 97 <= letters[-1] <= 122:  # marks after a letter are tokens of their own
            ids = self[letters] + self[word[len(letters) :]]
        elif _LETTERS.fullmatch(text := word.decode()):
            ids = array("I", [t.id for t in self.merge(text if text.isascii() else word.decode("latin-1").translate(self.letters))]).tobytes()
        else:
            ids = array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= _REMEMBERED:  # two generations: what is still in use moves over from the older one
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").lower().split()))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One memory for each worker process; it serves all its tasks."""
    return WordIds(path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and end_id, cut only if longer than capacity."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            out: list[list] = [[] for _ in schema.split(", ")]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                data = words.text(text.as_py()) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    values = (key, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32))
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def sweep(lengths: list[int], gaps: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit of pieces (longest first) into gaps: for each piece the number of its gap and its distance from the gap's end, and all gaps as they are left.

    New sequences are numbered after the given gaps, in the order of opening.
    """
    left, sizes, holders = list(gaps), [], {}

    def put(size: int, number: int) -> None:
        if size:
            if size not in holders:
                insort(sizes, size)
                holders[size] = []
            holders[size].append(number)

    for number, size in enumerate(left):
        put(size, number)
    chosen, before_end = [], []
    for length in lengths:
        at = bisect_left(sizes, length)
        if at < len(sizes):
            size = sizes[at]
            number = holders[size].pop()
            if not holders[size]:
                del holders[size], sizes[at]
        else:
            size, number = capacity, len(left)
            left.append(capacity)
        chosen.append(number)
        before_end.append(size)
        left[number] = size - length
        put(size - length, number)
    return chosen, before_end, left


def _superstep(pieces: DataFrame, gaps: DataFrame, lanes: int, step: int, capacity: int) -> DataFrame:
    """Rows row, sequence_id, offset of one range's pieces (row, length), and rows null, sequence_id, offset of all open gaps after it."""
    sequences = step << 58

    def run(key: tuple, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        p, g = p.sort_values(["length", "row"], ascending=[False, True]), g.sort_values(["sequence_id"], ascending=False)
        number, before_end, left = sweep(p["length"].tolist(), (capacity - g["offset"]).tolist(), capacity)
        opened = sequences + (key[0] << 34) + np.arange(len(left) - len(g), dtype=np.int64)
        ids = np.concatenate([g["sequence_id"].to_numpy(np.int64), opened])
        placed = pd.DataFrame({"row": p["row"].astype("Int64").to_numpy(), "sequence_id": ids[np.array(number, np.int64)], "offset": capacity - np.array(before_end, np.int64)})
        rest = capacity - np.array(left, np.int64)
        still = rest < capacity
        open_gaps = pd.DataFrame({"row": pd.array([None] * int(still.sum()), "Int64"), "sequence_id": ids[still], "offset": rest[still]})
        return pd.concat([placed.astype({"row": "Int64"}), open_gaps])

    lane = lambda c: F.pmod(F.xxhash64(c, F.lit(step)), F.lit(lanes)).alias("lane")
    dealt = pieces.select(lane("row"), "row", "length").groupBy("lane")
    return dealt.cogroup(gaps.select(lane("sequence_id"), "sequence_id", "offset").groupBy("lane")).applyInPandas(run, "row long, sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows with length (1 to capacity); other columns are kept.

    Sequences hold at most `capacity` tokens, gapless from offset 0. A piece of
    full length is a sequence by itself. Repeated rows are packed each time. An
    empty table gives no rows; clashing names take underscores. pieces is read
    once. The driver sees counts of pieces and gaps for each range of lengths.
    """
    names = pieces.columns
    row, sequence, offset = (free_name(n, names) for n in ("_row", "sequence_id", "offset"))
    numbered = checkpointed(pieces.withColumn(row, F.monotonically_increasing_id()))
    slim = numbered.select(F.col(row).alias("row"), "length")
    bounds = [int(capacity * share) for share in RANGES]
    step = F.lit(len(bounds) - 1)
    for i, bound in reversed(list(enumerate(bounds))):
        step = F.when(F.col("length") > bound, i).otherwise(step)
    counts = {r.step: r.n for r in slim.where(F.col("length") < capacity).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    gaps = pieces.sparkSession.createDataFrame([], "sequence_id long, offset long")
    placed = slim.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for i in sorted(counts):
        own = slim.where((F.col("length") < capacity) & (step == i))
        lanes = -(-max(counts[i], gaps.count()) // lane_rows)
        out = checkpointed(_superstep(own, gaps, lanes, i + 1, capacity))
        placed, gaps = placed.union(out.where("row is not null")), out.where("row is null").select("sequence_id", "offset")
    placed = placed.select(F.col("row").alias(row), F.col("sequence_id").alias(sequence), F.col("offset").alias(offset))
    return numbered.join(placed, row).select(*(F.col(f"`{n}`") for n in names), sequence, offset)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Ids are taken as long; null ids
    are kept as null, repeated documents are packed each time, and other
    columns are ignored. The texts are tokenised once, into a checkpoint of
    the small rows.
    """
    return pack(tokenized_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), capacity)


def packed_sequences(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, doc_ids and token_ids in order; a group is one sequence, so it is bounded."""
    pieces = tokenized_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids=True)
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return pack(pieces, capacity).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), rows.alias("r")).select("sequence_id", "n_tokens", F.col("r.doc_id").alias("doc_ids"), F.flatten("r.ids").alias("token_ids"))
