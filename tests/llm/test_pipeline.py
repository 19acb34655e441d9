import random

import pytest

import corpus_pipeline
from casewright.llm import copies, personal
from tests.llm.test_language import text_in

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, text_in(lang, rng.randint(40, 150), rng), lang, "s", 0) for i in range(300) for lang in [rng.choice(["xx", "yy"])]]
    labels = []
    for i in range(0, 300, 3):
        words = rows[i][1].split(" ")
        for _ in range(3):
            words.insert(rng.randrange(len(words)), "vilewretch")
        rows[i] = (i, " ".join(words), *rows[i][2:])
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)]
    copies = [(1000 + i, rows[1][1], "xx", "s", 0) for i in range(5)] + [(1010, rows[2][1] + " tail", "xx", "s", 0)]
    odd = [(2000, None, None, None, None), (2001, "", "xx", "s", 0), (2002, "?? 123 !!", "xx", "s", 0), (2003, rows[4][1] + " mail me at a.b@c.example.com", None, "s", 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows + copies + odd, COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), {r[0]: r for r in rows + copies + odd}


def test_stages_take_effect(spark, folder):
    sf_dir, rows = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.mode("overwrite").parquet(f"{sf_dir}/stage{i}")
        docs = spark.read.parquet(f"{sf_dir}/stage{i}")
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() - kept["language_id"].keys() == {2000, 2001, 2002}
    assert kept["language_id"][2003].lang in ("xx", "yy")
    toxic = {i for i, r in rows.items() if "vilewretch" in (r[1] or "")}
    assert kept["language_id"].keys() - kept["toxicity"].keys() == toxic
    # brute force over the stage's contract: five-word shingles, similarity 0.8 and more (2003 is such a copy of 4, though 7 bits apart)
    sets = {i: set(copies.shingle_set(r.text.encode(), corpus_pipeline.SHINGLE_WORDS).tolist()) for i, r in kept["toxicity"].items()}
    group = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            group[a] = min(group[b] for b in sets if a == b or len(sets[a] & sets[b]) >= corpus_pipeline.LEAST_SIMILARITY * len(sets[a] | sets[b]))
    assert kept["simhash_near_dedup"].keys() == {i for i, g in group.items() if i == g}
    assert not {1000, 1001, 1002, 1003, 1004, 1010} & kept["simhash_near_dedup"].keys()
    for i, r in kept["pii"].items():
        before = kept["simhash_near_dedup"][i].text
        base = personal.base_spans(before)
        assert r.text == personal.redact(before, base + personal.added_spans(before, base)) and r.n_chars == len(r.text)
    assert {r.doc_id for r in docs.collect()} == kept["pii"].keys()


def test_run_gives_the_last_stage(spark, folder):
    sf_dir, _ = folder
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    last = spark.read.parquet(f"{sf_dir}/stage4")
    assert sorted(map(tuple, out.drop("sequence_id", "offset").collect())) == sorted(map(tuple, last.drop("sequence_id", "offset").collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
