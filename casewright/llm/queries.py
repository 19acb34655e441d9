"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import codes, convolution, language, neighbours, packing, personal, quality, resampling, sentencepiece, sharding, simhash, toxicity, urls
from casewright.llm.common import checkpointed, held_out, table

N_SHARDS = 24


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows.where("vec_id % 100 = 0"), rows, k=10)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_documents(docs, quality.fit_references(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_pieces", "piece_ids")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    digests = checkpointed(table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(utf8) + 8).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32")))
    sharded = sharding.shard_rows(digests, N_SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("pii_spans").alias("spans"))


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url with blocked = 1 if the document its path names is labelled toxic or of low quality; pages without labels are left out."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract(urls.url_path(F.col("url")), r"/([0-9]+)", 1).alias("named"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("named"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("blocked"))
    return pages.join(labels.groupBy("named").agg(F.max("blocked").alias("blocked")), "named").select("url", "blocked")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, urls.mine_rules(labelled_urls(spark, sf_dir)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.fit_dictionaries(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    gain = resampling.gains(resampling.bucket_counts(docs), resampling.bucket_counts(target))
    weighed = resampling.weigh_documents(docs, gain).drop("text")
    drawn = resampling.draw(weighed, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", F.col("dsir_features").alias("n_features"), F.col("dsir_weight").alias("weight"), F.col("dsir_score").alias("score"), F.col("dsir_rank").alias("rank"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    rows = codes.with_label_error(found.codes)
    return rows.select(F.col("id").alias("vec_id"), codes.code_text().alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = convolution.score_documents(docs, convolution.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", convolution.held_out().alias("held_out"), F.col("cnn_score").alias("score"), F.col("cnn_predicted").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_nearest_neighbours, op2_quality_rules, op3_sentencepiece, op4_sharding, op5_simhash, op6_packing, op7_toxicity, op8_personal_data, op9_url_filter, op10_language, op11_importance_resampling, op12_vector_codes, op13_quality_classifier)
}



def _rounds_sql(rounds: int) -> str:
    """One pair of tables for each round: every part's nearest entry, and the floored means of the assigned parts."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
            assigned{r} AS MATERIALIZED (
                SELECT n, part, min(d * 1000 + entry) % 1000 AS entry, min(d * 1000 + entry) // 1000 AS d
                FROM (SELECT p.n, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                      FROM parts p JOIN book{r} b ON p.part = b.part) GROUP BY n, part)""")
        if r < rounds:
            parts.append(f"""
            book{r + 1} AS MATERIALIZED (
                SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
                    SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY place) AS x FROM (
                        SELECT a.part, a.entry, place, sum(p.x[place])::DOUBLE AS total, count(*) AS n
                        FROM assigned{r} a JOIN parts p ON a.n = p.n AND a.part = p.part, range(1, 9) t(place) GROUP BY ALL)
                    GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    return ",".join(parts)


ORACLE = {
    "op1_nearest_neighbours": """
        WITH usable AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_importance_resampling": r"""
        WITH crc_steps AS MATERIALIZED (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(0, 256) r(i)),
        texts AS (SELECT doc_id, false AS goal, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
        found AS MATERIALIZED (
            SELECT doc_id, goal, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words,
                   row_number() OVER () AS n FROM texts),
        each_word AS MATERIALIZED (SELECT n, goal, word, count(*) AS k FROM (SELECT n, goal, unnest(words) AS word FROM found) GROUP BY ALL),
        hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each_word)),
        hashed AS MATERIALIZED (
            SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM hexed, crc_steps),
        counts AS (SELECT bucket, coalesce(sum(k) FILTER (NOT goal), 0)::BIGINT AS s, coalesce(sum(k) FILTER (goal), 0)::BIGINT AS t FROM each_word JOIN hashed USING (word) GROUP BY bucket),
        totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
        gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, totals),
        weighed AS (SELECT n, floor(sum(k * gain) / sum(k))::BIGINT AS weight FROM each_word JOIN hashed USING (word) JOIN gains USING (bucket) WHERE NOT goal GROUP BY n),
        scored AS (
            SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM found LEFT JOIN weighed USING (n) WHERE NOT goal),
        placed AS (SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * eligible // 100 THEN place END AS rank FROM placed
    """,
    "op12_vector_codes": f"""
        WITH usable AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT n, part, v[8 * part + 1 : 8 * part + 8] AS x FROM usable, range(0, 8) t(part)),
        book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM parts WHERE n <= 16), {_rounds_sql(6)},
        coded AS (SELECT n, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assigned6 GROUP BY n)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book6) AS codebooks_sha256
        FROM coded JOIN usable USING (n)
    """,
}
