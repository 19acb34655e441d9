"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The pieces of a model file form a lattice over each word. Distinct words of
equal length advance together: at every end position, substrings of every
length are looked up at once by probing sorted hashes of the pieces, and
vectorised maxima store the backpointers. In a unigram model a path's value is
the sum of its scores. In a BPE model only paths that the merges could have
left behind count: a sequence of pieces is what the merges give exactly if
every two neighbours are (a merge over a border depends on the two pieces at
it alone), so a piece may follow another only if their text merges back to
just these two, and exactly one piece remains for each end. Characters without
a piece fall back to byte pieces, so that decoding gives back the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casewright.llm.common import extended, free_name

SPACE = "▁"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: What stands before a word's first piece, and in place of a character without one.
START, UNKNOWN = -2, -1
#: Words remembered by a worker; beyond it the older half goes, which changes no result.
_REMEMBERED = 300_000
#: Pairs of pieces are remembered in 2**_PAIR_BITS places.
_PAIR_BITS = 21
_LINES = re.compile(r"(\n)")
_MARKS_AT_END = ".,!?;:%$&*#|"


@dataclass
class Pieces:
    """A model's pieces: sorted hashes of their beginnings with ids (-1 if no piece) and scores, byte ids, and the score of an unknown character.

    merges is the score of each piece of a BPE model, None for a unigram model.
    """

    hashes: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    unknown: float
    texts: list[str]
    byte_of: dict[int, int]
    merges: dict[str, float] | None = None

    def __post_init__(self) -> None:
        self.halves: dict[str, tuple[str, str] | None] = {}
        if self.merges is not None:
            self._undo_tables()
            self.pairs, self.allowed = np.full(1 << _PAIR_BITS, -1), np.zeros(1 << _PAIR_BITS, bool)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        byte_of = {i: int(t[3:5], 16) for i, t in enumerate(texts) if model.is_byte(i)}
        usual = [i for i in range(len(texts)) if i not in byte_of and not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i)]
        if any(SPACE in texts[i].lstrip(SPACE) for i in usual):
            raise ValueError("pieces that hold a space after another character are not supported")
        if len(byte_of) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        starts = sorted({texts[i][:n] for i in usual for n in range(1, len(texts[i]) + 1)})
        keys = _hash_texts(starts)
        order = np.argsort(keys)
        if (np.diff(keys[order]) == 0).any():
            raise ValueError("two beginnings of pieces share a hash")
        own = {texts[i]: i for i in usual}
        ids = np.array([own.get(t, -1) for t in starts], np.int32)
        scores = np.array([model.get_score(own[t]) if t in own else -np.inf for t in starts])
        byte_ids = np.zeros(256, np.int32)
        for i, b in byte_of.items():
            byte_ids[b] = i
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
        merges = {texts[i]: model.get_score(i) for i in usual} if spec.model_type == spec.BPE else None
        return cls(keys[order], ids[order], scores[order], max(map(len, own)), byte_ids, float(min(map(model.get_score, usual))) - 10.0, texts, byte_of, merges)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted table and whether the hash is there."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The pieces that the merges of a BPE model leave of a short text (or make of it until so few are left): best score first, then leftmost."""
        parts = list(text)
        while len(parts) > stop:
            score, at = max((self.merges.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if score == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def may_follow(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each piece may stand after the one before it in a BPE encoding.

        Answers are remembered in a table of fixed size, in which a later pair takes the place of an earlier one.
        """
        keys = (before.astype(np.int64) + 2) << 32 | ids
        slots = ((keys.view(np.uint64) * _PRIME) >> np.uint64(64 - _PAIR_BITS)).view(np.int64)
        answers, missing = self.allowed[slots], np.flatnonzero(self.pairs[slots] != keys)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            fresh = self._mergeable((new >> 32) - 2, new & 0xFFFFFFFF)
            answers[missing] = fresh[back]
            places = slots[missing[first]]
            self.pairs[places], self.allowed[places] = new, fresh  # of two new pairs that meet in one place the last one stays, in both tables
        return answers

    def _undo_tables(self) -> None:
        """For each piece its rank among the merges and the two pieces that its last merge joined, and the rank of each pair's merge."""
        size, ids = len(self.texts), {t: i for i, t in enumerate(self.texts) if t in self.merges}
        self.rank, self.usable = np.full(size, -1.0), np.zeros(size, bool)
        self.left_half, self.right_half = np.full(size, -1), np.full(size, -1)
        self.is_merge = np.zeros(size, bool)
        over: dict[int, float] = {}
        for text, i in ids.items():
            self.is_merge[i] = True
            halves = self._halves_of(text)
            self.usable[i] = halves is not None
            if len(text) > 1:
                self.rank[i] = -self.merges[text]
                if halves is not None:
                    self.left_half[i], self.right_half[i] = (ids.get(h, -1) for h in halves)
                for n in range(1, len(text)):
                    if text[:n] in ids and text[n:] in ids:
                        over[ids[text[:n]] << 32 | ids[text[n:]]] = -self.merges[text]
        order = sorted(over)
        self.over_keys, self.over_ranks = np.array([*order, np.iinfo(np.int64).max]), np.array([*(over[k] for k in order), np.inf])

    def _halves_of(self, text: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece last; empty for one character, None if the merges never make it."""
        if text not in self.halves:
            parts = self.merged(text, stop=2)
            self.halves[text] = ("", "") if len(text) == 1 else tuple(parts) if len(parts) == 2 and "".join(parts) in self.merges else None
        return self.halves[text]

    def _mergeable(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Undoes the merges of all pairs at their borders, latest first: no earlier merge may lie over a border."""
        answers = self.usable[ids] & ((before < 0) | self.is_merge[before])
        at = np.flatnonzero(answers & (before >= 0))
        left, right, limit = before[at], ids[at], np.full(len(at), np.inf)
        while len(at):
            keys = left << 32 | right
            place = np.searchsorted(self.over_keys, keys)
            early = (self.over_keys[place] == keys) & (self.over_ranks[place] < limit)
            answers[at[early]] = False
            by_left = self.rank[left] > self.rank[right]
            by_right = ~by_left & (self.rank[right] >= 0)  # at equal scores the merge further left is first
            limit = np.where(by_left, self.rank[left], np.where(by_right, self.rank[right] + 0.5, limit))
            left, right = np.where(by_left, self.right_half[left], left), np.where(by_right, self.left_half[right], right)
            more = ~early & (by_left | by_right)
            at, left, right, limit = at[more], left[more], right[more], limit[more]
        return answers


def _extend(state: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of substrings one character longer."""
    mixed = (state ^ (codes + np.uint64(1))) * _PRIME
    return mixed ^ (mixed >> np.uint64(29))


def _hash_texts(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        by_length.setdefault(len(t), []).append(i)
    for length, members in by_length.items():
        codes = np.frombuffer("".join(texts[i] for i in members).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)
        state = np.zeros(len(members), np.uint64)
        for column in codes.T:
            state = _extend(state, column)
        out[members] = state
    return out


def viterbi(words: list[str], pieces: Pieces) -> list[np.ndarray]:
    """Ids of each word."""
    return [np.frombuffer(ids, np.int32) for ids in viterbi_bytes(words, pieces)]


def viterbi_bytes(words: list[str], pieces: Pieces, cells: int = 1 << 22) -> list[bytes]:
    """Ids of each word, as bytes of int32; words of equal length are one batch (split if it would pass `cells` characters)."""
    out = [b""] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, members in by_length.items():
        if not length:
            continue
        step = max(1, cells // length)
        for start in range(0, len(members), step):
            part = members[start : start + step]
            codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), length).astype(np.uint64)
            for i, ids in zip(part, _batch(codes, pieces), strict=True):
                out[i] = ids
    return out


def _batch(codes: np.ndarray, pieces: Pieces) -> list[bytes]:
    n, length = codes.shape
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.zeros((n, length + 1), np.int32)  # start of the last piece
    token = np.full((n, length + 1), UNKNOWN, np.int32)  # its id
    token[:, 0] = START
    longest = min(pieces.longest, length)
    rows = np.arange(n)
    # Substrings that are still the beginning of some piece: their row, start and hash. All others are dropped at once.
    row, start, state = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    for end in range(1, length + 1):
        row, start, state = np.concatenate([row, rows]), np.concatenate([start, np.full(n, end - 1)]), np.concatenate([state, np.zeros(n, np.uint64)])
        state = _extend(state, codes[row, end - 1])
        at, alive = pieces.find(state)
        row, start, state, at = row[alive], start[alive], state[alive], at[alive]
        ids = pieces.ids[at]
        is_piece = ids >= 0
        single = np.zeros(n, bool)
        single[row[is_piece & (start == end - 1)]] = True
        if pieces.merges is not None:
            is_piece[is_piece] = pieces.may_follow(token[row[is_piece], start[is_piece]], ids[is_piece])
        first = max(0, end - longest)
        value = np.full((n, end - first), -np.inf)
        value[row[is_piece], start[is_piece] - first] = best[row[is_piece], start[is_piece]] + pieces.scores[at[is_piece]]
        found = np.full((n, end - first), UNKNOWN, np.int32)
        found[row[is_piece], start[is_piece] - first] = ids[is_piece]
        value[:, -1] = np.where(single, value[:, -1], best[:, end - 1] + pieces.unknown)
        pick = value.argmax(axis=1)  # the longest piece wins a tie
        best[:, end] = value[rows, pick]
        back[:, end] = first + pick
        token[:, end] = found[rows, pick]
    steps = []
    ends = np.full(n, length)
    rows = np.arange(n)
    while ends.any():
        steps.append(np.where(ends > 0, token[rows, ends], START))
        ends = np.where(ends > 0, back[rows, ends], 0)
    table = np.stack(steps[::-1], axis=1)
    used = table != START
    data, stops = table[used].astype(np.int32).tobytes(), (4 * used.sum(axis=1).cumsum()).tolist()
    found = [data[i:j] for i, j in zip([0, *stops], stops, strict=False)]
    for row in np.flatnonzero((table == UNKNOWN).any(axis=1)).tolist():
        found[row] = _with_bytes(np.frombuffer(found[row], np.int32).tolist(), codes[row], pieces)
    return found


def _with_bytes(tokens: list[int], codes: np.ndarray, pieces: Pieces) -> bytes:
    """A word's ids, with the byte pieces of its unknown characters in their places."""
    ids: list[int] = []
    at = 0
    for t in tokens:
        if t == UNKNOWN:
            ids += [int(pieces.byte_ids[b]) for b in chr(int(codes[at])).encode()]
            at += 1
        else:
            ids.append(t)
            at += len(pieces.texts[t])
    return np.array(ids, np.int32).tobytes()


def split_words(text: str) -> list[str]:
    """The text with a space in front and spaces as SPACE, cut before each run of spaces; no piece spans a cut."""
    if "  " not in text and not text.startswith(" ") and SPACE not in text:
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
    parts = text.replace(" ", SPACE).split(SPACE)
    words, run = [], SPACE
    for i, part in enumerate(parts):
        if part or i == len(parts) - 1:
            words.append(run + part)
            run = SPACE
        else:
            run += SPACE
    return words


class Encoder:
    """Encodes and decodes texts, remembering the ids of words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.memory, self.ends = pieces, {}, {}
        self.older: dict[str, bytes] = {}
        self.cut_lines = not any("\n" in t for t in pieces.texts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null or empty texts."""
        split = [split_words(t) if t else [] for t in texts]
        if self.cut_lines:  # no piece spans a character that has none
            split = [[p for w in words for p in (_LINES.split(w) if "\n" in w else (w,)) if p] if "\n" in (t or "") else words for words, t in zip(split, texts, strict=True)]
        if len(self.memory) > _REMEMBERED:  # two generations: what is still in use moves over from the older one
            self.older, self.memory, self.ends = self.memory, {}, {}
        new = set().union(*split).difference(self.memory)
        again = new & self.older.keys()
        self.memory.update((w, self.older[w]) for w in again)
        self._learn(new - again)
        return [np.frombuffer(b"".join(map(self.memory.__getitem__, words)), np.int32) for words in split]

    def _learn(self, new: set[str]) -> None:
        """Encodes words. A word with marks at its end is put together from its two parts where the pieces at the border allow it."""
        cores = [(w, w.rstrip(_MARKS_AT_END)) for w in new] if self.pieces.merges is not None else []
        cut = {w: len(core) for w, core in cores if len(core) < len(w) and core[-1:].isalpha()}
        parts = {p for w, i in cut.items() for p in (w[:i], w[i:])}
        whole = list({p for p in parts | (new - cut.keys()) if p not in self.memory and p not in self.ends})
        found = dict(zip(whole, viterbi_bytes(whole, self.pieces), strict=True))
        ends = {w[i:] for w, i in cut.items()}
        for word, ids in found.items():
            (self.ends if word in ends else self.memory)[word] = ids
        words = list(cut)
        left = [self.memory[w[: cut[w]]] for w in words]
        right = [self.ends[w[cut[w] :]] for w in words]
        border = np.array([(int.from_bytes(a[-4:], "little"), int.from_bytes(b[:4], "little")) for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
        apart = self.pieces.may_follow(border[:, 0], border[:, 1]) if words else []
        joined = [w for w, ok in zip(words, apart, strict=True) if not ok]
        self.memory.update((w, a + b) for w, a, b, ok in zip(words, left, right, apart, strict=True) if ok)
        self.memory.update(zip(joined, viterbi_bytes(joined, self.pieces), strict=True))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: byte pieces are joined, SPACE is a space, and the space in front goes."""
        texts, byte_of, out, run = self.pieces.texts, self.pieces.byte_of, [], bytearray()
        for i in ids.tolist():
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(texts[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def encoder(model_path: str) -> Encoder:
    """One encoder for each worker process; what it remembers serves all its tasks."""
    return Encoder(Pieces.load(model_path))


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs and piece_ids (array of int), n_pieces.

    Null and empty texts have no ids. Whole texts are encoded. Repeated rows
    are encoded each time; new names get underscores where the input has them.
    """
    names = docs.columns
    ids, count = free_name("piece_ids", names), free_name("n_pieces", names)
    at = names.index(docs.select(text_col).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            found: list[np.ndarray] = []
            for start in range(0, batch.num_rows, 256):
                found += own.encode(batch.column(at).slice(start, 256).to_pylist())
            sizes = np.array([len(f) for f in found], np.int64)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes)], names=[*names, ids, count])

    return docs.mapInArrow(run, extended(docs.schema, {ids: "array<int>", count: "long"}))


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids") -> DataFrame:
    """All columns of encoded and piece_text; null ids give a null text, no ids an empty one."""
    names = encoded.columns
    new, at = free_name("piece_text", names), names.index(encoded.select(ids_col).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            texts = [None if ids.as_py() is None else own.decode(np.array(ids.as_py(), np.int32)) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, new])

    return encoded.mapInArrow(run, extended(encoded.schema, {new: "string"}))
