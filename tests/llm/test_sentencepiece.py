import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from casewright.llm import sentencepiece as own
from casewright.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


TEXTS = ["", " ", "  two  spaces ", "The quick, brown fox!!!", "über Straße", "漢字かな", "emoji 😀😀x", "a\tb\n\nc", "1234 5678", "x" * 5000, "the,.!? the... ***", "aaaaaaaaaaaaaaaaaaaaaa", " lead", "trail "]


def test_equals_the_library(library):
    encoder = own.encoder(PATH)
    for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert encoder.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aehinorstd T,.!'-\n1é漢ж "), max_size=60))
def test_equals_the_library_on_random_texts(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = own.encoder(PATH).encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert own.encoder(PATH).decode(ids) == text


def test_unigram_value_is_the_best_path():
    pieces = own.Pieces.load(PATH)
    pieces.merges = None  # the same lattice, scored by sums
    scores = {t: s for t, s in zip([pieces.texts[i] for i in pieces.ids if i >= 0], pieces.scores[pieces.ids >= 0], strict=True)}
    for word in ["▁hello", "▁tokenizer", "▁anewwordhere"]:
        best = [0.0] + [-1e18] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max((best[s] + scores[word[s:end]] for s in range(max(0, end - 16), end) if word[s:end] in scores), default=-1e18)
        ids = own.viterbi([word], pieces)[0]
        assert sum(scores[pieces.texts[i]] for i in ids) == best[-1]


def test_documents_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (3, TEXTS[3], "x")], "doc_id long, text string, piece_ids string")
    encoded = own.encode_documents(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "piece_ids", "piece_ids_", "n_pieces"]
    rows = own.decode_documents(encoded, PATH, "piece_ids_").collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.piece_text == (r.text or "") and r.n_pieces == len(r.piece_ids_)
        assert r.piece_ids_ == library.encode(r.text or "")
    assert own.encode_documents(docs.limit(0), PATH).count() == 0


def test_pairs_that_share_a_place_keep_their_own_answers(monkeypatch, library):
    """A memory of four places for all pairs changes no id."""
    monkeypatch.setattr(own, "_PAIR_BITS", 2)
    encoder = own.Encoder(own.Pieces.load(PATH))
    texts = ["the tokenizer splits unusual words like thheanouing, erbleenst and undgestberber!!!", *TEXTS]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text)
        encoder.memory.clear()
