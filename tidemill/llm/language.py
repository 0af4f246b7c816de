"""Language identification by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.stored import small_side, stored

SAMPLE, TEXT_CHARS, DICTIONARY_BYTES = 200, 20_000, 110_000  # of each language: documents drawn, their longest text, bytes kept
LEVEL = 3
MARGIN = 0.02  # a prediction whose lead is narrower is marked as rejected
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """For each language raw dictionary content: a bounded sample of labelled texts that are not held out.

    The SAMPLE different documents with the smallest hashes are drawn per language, so the sample does not depend on row order, and
    rows that repeat one count once, however often they do; each language's texts are taken whole up to DICTIONARY_BYTES. At
    most SAMPLE texts of TEXT_CHARS characters per language come to the driver, and nothing else.
    """
    labelled = docs.filter(~held_out(F.col("doc_id"))).filter("lang is not null and text is not null").filter(F.length("text").between(1, TEXT_CHARS))
    key = F.xxhash64("doc_id", "text")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    keys = labelled.select("lang", key.alias("key")).distinct().withColumn("n", first).filter(F.col("n") <= SAMPLE)
    drawn = small_side(stored(keys.select("lang", "key"), "drawn"), 64)
    rows = labelled.withColumn("key", key).join(drawn, ["lang", "key"]).select("lang", "key", "text").dropDuplicates(["lang", "key"]).collect()
    out: dict[str, bytes] = {}
    for lang, _, text in sorted(rows):
        data = text.encode() + b"\n"
        if len(out.get(lang, b"")) + len(data) <= DICTIONARY_BYTES:
            out[lang] = out.get(lang, b"") + data
    return out


def languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row of ``docs(doc_id, text, lang)``.

    Each whole text is compressed once with every language's dictionary; the smallest result wins, ties go to the first
    language by name. ``score`` is how much smaller it is than the second, as a share (1 if only one language was
    learned); ``rejected`` marks scores under MARGIN. Null texts and texts without a letter are ``und`` with score 0 and
    rejected, as is everything when no labelled row could be learned from. The columns lang, source and doc_id are no
    input of a prediction. Repeated rows get equal results; other columns are ignored.
    """
    learned = dictionaries(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presses = []
        for lang in sorted(learned):
            content = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            presses.append((lang, zstandard.ZstdCompressor(dict_data=content, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)))
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2).to_pylist():
                if not presses or not text or not _LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                data = text.encode()
                sizes = sorted((len(press.compress(data)), lang) for lang, press in presses)
                names.append(sizes[0][1])
                scores.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([s < MARGIN for s in scores], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op7_compression_language(spark, sf_dir):
    """The language of every document, learned from four fifths of the labelled ones."""
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
