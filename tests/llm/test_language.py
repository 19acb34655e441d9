import random
import zlib

import pytest
from pyspark.sql import functions as F

from casewright.llm import language

SYLLABLES = {"xx": ["the", "ing", "er", "and", "on", "st"], "yy": ["que", "eau", "ment", "ou", "ais", "re"], "zz": ["sch", "ung", "ein", "lich", "keit", "pf"]}


def text_in(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, text_in(lang, rng.randint(10, 120), rng), lang) for i in range(450) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy_and_rejections(spark, rows):
    odd = [(9001, None, "xx"), (9002, "", "xx"), (9003, "123 --- !!!", None), (9004, text_in("yy", 20_000, random.Random(3)), None), (None, rows[0][1], None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    dictionaries = language.fit_dictionaries(docs)
    assert sorted(dictionaries) == ["xx", "yy", "zz"]
    out = language.identify(docs, dictionaries)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_pred_", "lang_score", "lang_rejected"]
    got = {r.doc_id: r for r in out.collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred_"] == lang for i, lang in held) >= 0.98 * len(held)
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    for i in (9001, 9002, 9003):
        assert (got[i]["lang_pred_"], got[i].lang_score, got[i].lang_rejected) == ("und", 0.0, True)
    assert got[9004]["lang_pred_"] == "yy" and not got[9004].lang_rejected
    assert sum(got[i].lang_rejected for i, *_ in rows) <= 0.02 * len(rows)


def test_only_learnable_rows_teach(spark, rows):
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert language.fit_dictionaries(spark.createDataFrame(held, "doc_id long, text string, lang string")) == {}


def test_nothing_learned_or_one_language():
    assert language.Compressors({}).judge("hello") == ("und", 0.0, 0.0)
    assert language.Compressors({"xx": b"hello world hello"}).judge("hello") == ("xx", 1.0, 1.0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(docs, language.fit_dictionaries(docs)).count() == 0


def test_copies_take_no_places(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = docs.where("crc32(cast(doc_id as string)) % 3 <> 1 and lang = 'xx'").orderBy(F.xxhash64(F.substring("text", 1, 600))).first()
    copies = docs.where(f"doc_id = {first.doc_id}").crossJoin(spark.range(10_000, 11_000)).select("id", "text", "lang")
    assert language.fit_dictionaries(docs.union(copies)) == language.fit_dictionaries(docs)


def test_predictions_equal_a_plain_version(spark, rows):
    """Each document compressed anew with each dictionary, piece by piece; the fewest bytes win."""
    import zstandard

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = language.fit_dictionaries(docs)
    got = {r.doc_id: r for r in language.identify(docs, dictionaries).collect()}
    for i, text, _ in rows[:120]:
        words, sizes = language.plain(text), {}
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            squeeze = zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(squeeze.compress(words[at : at + language.PIECE_BYTES])) for at in range(0, len(words), language.PIECE_BYTES))
        first, second = sorted(sizes.values())[:2]
        assert got[i].lang_pred == min(sizes, key=lambda lang: (sizes[lang], lang))
        margin = (second - first) / second
        assert got[i].lang_score == pytest.approx(margin / (margin + 0.02)) and got[i].lang_rejected == (margin < language.MARGIN)


def test_passages_come_from_anywhere(spark):
    docs = spark.createDataFrame([(i, "start " * 200 + f"middle{i} " * 3000, "xx") for i in range(60)], "doc_id long, text string, lang string")
    assert language.fit_dictionaries(docs)["xx"].count(b"start ") < 20


def test_number_signs_are_no_letters():
    judge = language.Compressors({"de": b"der die das und ein ", "en": b"the and of to in a "}).judge
    for text in ("\u00bd \u00b2", "\u2167", "\u2460", "12 34", "___", ""):
        assert judge(text)[0] == "und"
    assert judge("\u00bd the and")[0] != "und"
