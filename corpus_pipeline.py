"""A corpus pipeline of five stages, each of which works on all that the one before kept.

Language ID drops what it rejects, toxicity drops what it rejects, SimHash
keeps one document of each group of near duplicates, PII redacts, and best-fit
packing returns the places of all documents in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import copies, language, packing, personal, toxicity
from casewright.llm.common import ensure_checkpoint_dir, remove_folder, table
from casewright.llm.queries import tokenizer_path

#: Near duplicates: words of a shingle, and bits of 64 that may differ. A distance of 6 is an angle whose cosine is 0.96,
#: a Jaccard similarity of about 0.92 between shingle sets; MinHash bands propose the pairs that this radius leaves out.
SHINGLE_WORDS, RADIUS = 5, 6
#: Documents are copies from this Jaccard similarity of their sets of shingles on.
LEAST_SIMILARITY = 0.8
#: Fingerprints of a shard; large, as a wide radius lets every further cut send many of them to both sides.
SHARD_ROWS = 1 << 15


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not clear; a null lang takes the predicted one."""
    found = language.identify(docs, language.fit_dictionaries(docs))
    kept = found.where(~F.col("lang_rejected"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.7 and more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where("tox_predicted = 0").select(docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near duplicates; links are verified on the shingles."""
    return copies.keep_one_per_group(docs, LEAST_SIMILARITY, words_per_shingle=SHINGLE_WORDS, radius=RADIUS, shard_rows=SHARD_ROWS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and counts their characters anew."""
    return personal.redact_documents(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_copies),
    ("pii", redact),
    ("best_fit_packing", pack),
]

#: The models and the tokenizer cannot be expressed in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared checkpoint folder and reread.

    A stage's table is removed once the next one is written; the last one stays, as the result reads it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{spark.sql('select uuid()').first()[0]}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
