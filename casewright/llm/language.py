"""Language identification by compression with per-language zstandard dictionaries.

Each language has a raw-content dictionary: plain text of that language. A
document is compressed once with each; the language whose dictionary gives the
fewest bytes wins, and a narrow margin over the runner-up is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import extended, free_name, held_out

#: Bounds of what a dictionary is fitted on: passages (one of a text) for each language, characters of each, bytes in all.
PASSAGES, PASSAGE_CHARS, DICTIONARY_BYTES = 160, 600, 16 * 1024
#: Groups of tasks whose passages are ranked together first.
BUCKETS = 256
#: Texts are compressed in pieces of so many bytes, so that the dictionary counts throughout a long one.
PIECE_BYTES = 4096
#: Least margin (share of the runner-up's bytes) that is not a rejection.
MARGIN = 0.002
_LETTER = re.compile(r"[^\W\d_]")  # and some number signs, which isalpha() tells apart
_ONLY_LETTERS = bytes(c if chr(c).islower() and c < 128 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-case UTF-8 with single spaces for all that is ASCII but no letter."""
    return b" ".join(text.lower().encode().translate(_ONLY_LETTERS).split())


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content for each language, from rows that are not held out.

    A bounded sample: the PASSAGES different passages (of at most PASSAGE_CHARS)
    of lowest hash for each language. A longer text's passage begins at a place
    that its hash chooses, anywhere in it. Rows with null text or language
    teach nothing; no rows give no languages.
    """
    places = F.greatest(F.char_length(text_col) - PASSAGE_CHARS + 1, F.lit(1))
    begin = F.pmod(F.xxhash64(text_col), places).cast("int") + 1
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    passages = rows.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), begin, F.lit(PASSAGE_CHARS)).alias("passage")).distinct()
    # Every task offers its first PASSAGES of a language. They are ranked among those of some tasks before the winners meet; the result is the same however the tasks are dealt.
    hashed = passages.withColumn("hash", F.xxhash64("passage")).withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS)))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("hash", "passage"))
    sample = hashed.withColumn("n", place("lang", "bucket")).where(F.col("n") <= PASSAGES).withColumn("n", place("lang")).where(F.col("n") <= PASSAGES).select("lang", "passage", "n").collect()
    content: dict[str, bytes] = {}
    for lang, passage, _ in sorted(sample, key=lambda r: (r.lang, -r.n)):
        content.setdefault(lang, b"")
        if (words := plain(passage)) and words not in content[lang]:
            content[lang] = (content[lang] + words + b" ")[-DICTIONARY_BYTES:]
    return {lang: text for lang, text in sorted(content.items()) if len(text) >= 8}


class Compressors:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        self.langs = list(dictionaries)
        self.each = []
        for text in dictionaries.values():
            d = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.each.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; und with zeros for null, no letter or no learned language."""
        if not text or not self.langs or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
            return "und", 0.0, 0.0
        words = plain(text)
        pieces = [words[i : i + PIECE_BYTES] for i in range(0, len(words), PIECE_BYTES)]
        sizes = [sum(len(squeeze(p)) for p in pieces) for squeeze in self.each]
        ranked = sorted(zip(sizes, self.langs, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, 1.0
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], margin / (margin + 0.02), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """All columns of docs and lang_pred, lang_score (0 to 1), lang_rejected.

    und, score 0 and a rejection for null or letterless texts, or if nothing
    was learned. Ties go to the language first in order, with score 0. Whole
    texts are read. New names get underscores where the input has them.
    """
    names = docs.columns
    pred, score, rejected = (free_name(n, names) for n in ("lang_pred", "lang_score", "lang_rejected"))
    at = names.index(docs.select(text_col).columns[0])
    schema = extended(docs.schema, {pred: "string", score: "double", rejected: "boolean"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries)
        for batch in batches:
            found = [compressors.judge(t.as_py()) for t in batch.column(at)]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == "und" or f[2] < margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, pred, score, rejected])

    return docs.mapInArrow(run, schema)
