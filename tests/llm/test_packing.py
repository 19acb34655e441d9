import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from casewright.llm import packing
from casewright.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = ["", "it's John's...  DON'T!! x!!y a%b c***d é!! 12,3. don't. 'tis", "Hello, world.", "the cat " * 700, "ABC. abc, ABC! ÀÉ", None, "\u3000wide\u00a0space\x1cend", "word " * 4095]


def test_ids_equal_the_tokenizer():
    tokenizer, own = Tokenizer.from_file(PATH), packing.word_ids(PATH)
    for text in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.text(text and text.encode()), "<u4").tolist() == ids


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweeps_give_best_fit():
    """Range by range, with the gaps that the range before left, one lane gives as many sequences as best-fit piece by piece."""
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [rng.choice([1, 2, 3, rng.randint(1, 50), rng.randint(20, 100), 100]) for _ in range(rng.randint(1, 200))]
        filled, gaps = Counter(), []
        for low, high in [(50, 100), (25, 50), (6, 25), (0, 6)]:
            own = sorted((n for n in lengths if low < n <= high), reverse=True)
            number, before_end, left = packing.sweep(own, gaps, 100)
            for n, at, size in zip(own, number, before_end, strict=True):
                assert filled[at] == 100 - size and n <= size
                filled[at] += n
            assert all(filled[i] == 100 - g for i, g in enumerate(left))
            gaps = left
        assert sum(filled.values()) == sum(lengths)
        assert len(filled) == one_by_one(lengths, 100)


def check_places(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_many_lanes_and_repeated_rows(spark):
    rng = random.Random(5)
    lengths = [rng.choice([100, 1, rng.randint(1, 99), rng.randint(1, 12)]) for _ in range(3000)]
    pieces = spark.createDataFrame([(7, 0, n, "x") for n in lengths] + [(None, 0, 50, None)] * 500, "doc_id long, piece int, length long, OFFSET string").repartition(5)
    for lane_rows in (10_000, 400):
        got = packing.pack(pieces, 100, lane_rows)
        assert got.columns == ["doc_id", "piece", "length", "OFFSET", "sequence_id", "offset_"]
        rows = got.withColumnRenamed("OFFSET", "x").withColumnRenamed("offset_", "offset").collect()
        assert Counter((r.doc_id, r.length) for r in rows) == Counter([(7, n) for n in lengths] + [(None, 50)] * 500)
        found, best = check_places(rows, 100), one_by_one(lengths + [50] * 500, 100)
        assert found == best if lane_rows > 4000 else best <= found <= best + 4 * 10


def test_documents_are_packed_whole(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(i, "some words " * (i % 90), "x") for i in range(10, 400)] + [(11, "some words " * 11, "x"), (None, "nobody", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(6)
    got = packing.pack_documents(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    found = check_places(got, 4096)
    assert found == one_by_one([r.length for r in got], 4096)
    whole = packing.packed_sequences(docs, PATH).collect()
    assert len(whole) == found and all(len(r.token_ids) == r.n_tokens <= 4096 for r in whole)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
