"""Quality rules: cross-document line frequency, beside counts of words, symbols and repetition. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.stored import BROADCAST_BYTES, small_side, stored

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_DOCS = 10  # a line is common beyond so many distinct documents of its host, however large the host is
MIN_WORDS, KEPT_PERCENT = 10, 50  # a document is depleted below either
HOT = 2000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    first = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))),
    })
    # only the few texts with any repeated window go on to find where they are
    first = first.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_sorted", lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"]))
    first = first.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    first = first.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return first.withColumn("base_failed", failed).drop("_words", "_lines", "_windows", "_sorted", "_places")


def document_lines(docs: DataFrame) -> DataFrame:
    """``(_unit, _digest, place, h, words)``: each line that isn't blank, with the hash of its host and its normal form (lower
    case, single spaces) and its number of words."""
    line = F.trim(F.lower(F.regexp_replace(F.col("line"), SPACE, " ")))
    lines = docs.select("_host", "_unit", "_digest", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("place", "line")).withColumn("line", line).filter("line <> ''")
    return lines.select("_unit", "_digest", "place", F.xxhash64("_host", "line").alias("h"), F.size(F.split("line", " ")).alias("words"))


def common_lines(lines: DataFrame, limit: int, spare_first: bool) -> DataFrame:
    """``(_unit, _digest, place, words)`` of the lines that more than ``limit`` distinct documents of a host have, without
    those of the host's first such document if ``spare_first``.

    A line that has more than one HOT-th of all lines is one of fewer than HOT, so such lines are broadcast; all others
    are broadcast only if their table is small, else shuffled, and none of them fills a task.
    """
    often = lines.groupBy("h").agg(F.count_distinct("_unit").alias("n"), F.min("_unit").alias("first"), F.count("*").alias("rows")).filter(F.col("n") > limit)
    often = stored(often.drop("n"), "often")
    most = F.col("rows") * HOT > lines.count()
    hot = lines.join(F.broadcast(often.filter(most).select("h", "first")), "h")
    rest = lines.join(small_side(often.filter(~most).select("h", "first"), 32), "h")
    hits = hot.unionByName(rest)
    if spare_first:
        hits = hits.filter("_unit <> first")
    return hits.select("_unit", "_digest", "place", "words").distinct()


def _marked(docs: DataFrame) -> DataFrame:
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({"_host": F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name")), "_digest": digest, "_unit": F.coalesce(F.col("doc_id").cast("long"), digest)})


def _hits(marked: DataFrame, limit: int, spare_first: bool) -> DataFrame:
    lines = stored(document_lines(marked), "lines")
    return common_lines(lines, limit, spare_first)


def _sized(side: DataFrame, numbers) -> DataFrame:
    """A written table, with a broadcast hint if it holds few enough numbers."""
    held = side.agg(F.coalesce(F.sum(numbers), F.lit(0))).first()[0]
    return F.broadcast(side) if held * 8 <= BROADCAST_BYTES else side


def _verdict(counted: DataFrame, min_words: int, kept_percent: int) -> DataFrame:
    """``counted`` with n_kept_words and kept; ``_gone`` is the number of words removed, null for none."""
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    depleted = F.col("_gone").isNotNull() & ((left < min_words) | (100 * left < kept_percent * F.col("n_words")))
    return counted.withColumns({"n_kept_words": left.cast("long"), "kept": ~F.col("base_failed") & ~depleted})


def verdicts(docs: DataFrame, limit: int = MIN_DOCS, min_words: int = MIN_WORDS, kept_percent: int = KEPT_PERCENT, spare_first: bool = False) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_kept_words)`` for every
    row of ``docs``, by the rules of ``quality``. Only numbers are shuffled, never texts."""
    marked = _marked(docs.select("doc_id", "text", "source"))
    gone = stored(_hits(marked, limit, spare_first).groupBy("_unit", "_digest").agg(F.sum("words").alias("_gone")), "gone")
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = base_counts(marked).select(*counts, "_unit", "_digest")
    out = _verdict(counted.join(_sized(gone, F.lit(3)), ["_unit", "_digest"], "left"), min_words, kept_percent)
    return out.select(*counts, "kept", "n_kept_words")


def quality(docs: DataFrame, limit: int = MIN_DOCS, min_words: int = MIN_WORDS, kept_percent: int = KEPT_PERCENT, spare_first: bool = False) -> DataFrame:
    """``docs(doc_id, text, source)`` with the counts, ``kept_text`` (the text without common lines) and ``kept``.

    A line, lower-cased and with single spaces, is common if more than ``limit`` distinct documents of its host (``source``)
    have it. Common lines are removed from all of the host's documents; with ``spare_first`` from all but the one of smallest id,
    so that of many copies one stays whole. A document is depleted if under ``min_words`` words or
    ``kept_percent`` of its words remain. ``kept`` is false for those that fail the base rule or are depleted. Null texts count as
    empty and so fail; a null source is a host of its own, apart from an empty one; rows that repeat an id are one document; rows without an id are
    told apart by their text. Very long texts are cut into lines like all others, in time linear in their length. Other
    columns pass through (those of the added names are replaced); an empty table gives an empty result.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_text", "n_kept_words", "kept"]
    rest = [c for c in docs.columns if c not in {"doc_id", "text", "source", *added}]
    # other columns travel packed, so none can be taken for one of the steps'
    marked = _marked(docs.select("doc_id", "text", "source", *([F.struct(*rest).alias("_rest")] if rest else [])))
    places = stored(_hits(marked, limit, spare_first).groupBy("_unit", "_digest").agg(F.sum("words").alias("_gone"), F.collect_set("place").alias("_places")), "places")
    # a filter on the verdict must not be pushed below the counts: their nested expressions would be put into one another
    counted = base_counts(marked).withColumn("_row", F.monotonically_increasing_id())
    joined = _verdict(counted.join(_sized(places, 3 + F.size("_places")), ["_unit", "_digest"], "left"), min_words, kept_percent)
    lines = F.split("text", "\n", -1)
    held = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_places")
    # bound to a variable, so that the text is cut once and not for every line
    picked = F.transform(F.array(F.struct(lines.alias("lines"), held.alias("held"))), lambda z: F.transform(z["held"], lambda k: F.get(z["lines"], k)))[0]
    kept_text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(picked, "\n"))
    joined = joined.withColumn("kept_text", kept_text)
    return joined.withColumn("kept", F.col("kept") & (F.col("_row") >= 0)).select("doc_id", "text", "source", *(["_rest.*"] if rest else []), *added)


def op5_line_frequency_quality(spark, sf_dir):
    """Counts and verdict for every document."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_line_frequency_spared(spark, sf_dir):
    """The same, but the first document of a host keeps its common lines, so that of many copies one stays."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spare_first=True)


OP5_SPARED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {'n': source IS NULL, 's': coalesce(source, '')} AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT rid, unnest(generate_series(1, len(w) - 4)) AS i, unnest([array_to_string(w[k:k+4], ' ') FOR k IN generate_series(1, len(w) - 4)]) AS g FROM d WHERE len(w) >= 5),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(generate_series(i, i + 4)) AS p FROM grams WHERE n > 1) GROUP BY rid),
ln AS (SELECT rid, doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
norm AS (SELECT rid, doc_id, host, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM ln),
often AS (SELECT host, line, min(doc_id) AS first FROM norm WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT doc_id) > 10),
gone AS (SELECT rid, sum(len(string_split(line, ' '))) AS words FROM norm JOIN often USING (host, line) WHERE doc_id <> first GROUP BY rid),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(w) - coalesce(words, 0) AS BIGINT) AS n_kept_words, words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT (words IS NOT NULL AND (n_kept_words < 10 OR 100 * n_kept_words < 50 * n_words)) AS kept,
       n_kept_words
FROM base
"""

OP5_SQL = OP5_SPARED_SQL.replace(" WHERE doc_id <> first", "")
