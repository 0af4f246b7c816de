"""Mixing sources to target weights: temperature mixing under a token budget. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.quality import words_of
from tidemill.plans.stored import small_side, stored

SEED, EVENNESS, POINTS, PASSES = 17, 0.5, 32, 8


def exponents(counts: DataFrame, most_repeats: float | None = None, entropy: float | None = None, evenness: float = EVENNESS, budget: int | None = None) -> DataFrame:
    """``(host, tokens, docs, alpha, weight, quota)`` for ``counts(host, tokens, docs)``.

    A host's weight is its token share to the power alpha, normalised. Alpha lies between 0 (all equal) and 1 (as they
    are): with ``most_repeats`` the least for which no host's tokens are used more often within the budget (default: all
    tokens), else the largest for which the weights have the target entropy: ``entropy``, or by default so that ``evenness``
    of the way from the shares' own entropy to that of equal weights is gone. Each step cuts the interval to one of POINTS + 1
    parts by one aggregate over the hosts, whose sums alone come to the driver, so there may be any number of hosts.
    """
    shares = stored(counts.filter("tokens > 0"), "shares")
    total, k, least = shares.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    p = F.col("tokens") / F.lit(float(total or 1))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        """Of each exponent the sum of the powers, and of each power times the share's logarithm."""
        row = shares.agg(*(f for a in alphas for f in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))))).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(alphas))]

    def spread(a: float, z: float, logs: float) -> float:
        return math.log(z) - a * logs / z

    spent = budget or total
    alpha, z = 1.0, 1.0
    if k:
        ends = [spread(a, *s) for a, s in zip((0.0, 1.0), sums([0.0, 1.0]))]
        wanted = entropy if entropy is not None else ends[1] + evenness * (ends[0] - ends[1])

        def low(a: float, z: float, logs: float) -> bool:
            """Is the exponent below the one that is looked for?"""
            if most_repeats is not None:
                return spent / total * (least / total) ** (a - 1) / z > most_repeats
            return spread(a, z, logs) >= wanted

        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            alphas = [lo + (hi - lo) * i / (POINTS + 1) for i in range(POINTS + 2)]
            below = [a for a, s in zip(alphas, sums(alphas)) if low(a, *s)]
            lo, hi = (alphas[len(below) - 1], alphas[min(len(below), POINTS + 1)]) if below else (alphas[0], alphas[0])
        alpha = min(1.0, math.ceil(hi * 1e6 - 1e-3) / 1e6 if most_repeats is not None else math.floor(lo * 1e6 + 1e-3) / 1e6)
        z = sums([alpha])[0][0]
    weight = F.pow(p, F.lit(alpha)) / F.lit(z)
    return shares.select("host", "tokens", "docs", F.lit(alpha).alias("alpha"), weight.alias("weight"), F.floor(weight * F.lit(float(spent or 0)) + 1e-3).cast("long").alias("quota"))


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, host, n_tokens, place)``, without documents that have no word; ``place`` is the document's in all permutations."""
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"), place(F.col("doc_id"))).filter("n_tokens > 0")


def place(doc_id):
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit("")))).alias("place")


def block(place_, docs):
    """A host's documents fall into about as many blocks as each block has documents."""
    return F.pmod(F.conv(F.substring(place_, 1, 8), 16, 10).cast("long"), F.ceil(F.sqrt(docs)).cast("long"))


def turn(copy):
    """Where a block comes in a pass: each pass has its own permutation of a host's blocks."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), copy.cast("string"), F.col("block").cast("string"), F.col("host")))


def mixing_plan(narrow: DataFrame, **target) -> DataFrame:
    """One row for each host: its weight, how many times all its documents are used, and how far into the permutation of
    blocks the last, partial pass comes: up to ``cut_place`` in the block of ``cut_turn``."""
    counts = narrow.groupBy("host").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = stored(exponents(counts, **target).withColumns({"passes": F.expr("quota div tokens"), "rest": F.expr("quota % tokens")}), "weights")
    placed = narrow.join(small_side(plan.select("host", "docs", "passes", "rest"), 80), "host").withColumn("block", block(F.col("place"), F.col("docs")))
    blocks = placed.groupBy("host", "block", "passes", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("turn", turn(F.col("passes") + 1))
    blocks = blocks.withColumn("upto", F.sum("n").over(Window.partitionBy("host").orderBy("turn")))
    edge = blocks.filter("upto > rest and upto - n <= rest").select("host", "block", "turn", (F.col("upto") - F.col("n")).alias("before"))
    within = placed.join(edge, ["host", "block"]).withColumn("run", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("host", "block").orderBy("place")))
    cut = within.groupBy("host", F.col("turn").alias("cut_turn")).agg(F.max(F.when(F.col("run") <= F.col("rest"), F.col("place"))).alias("cut_place"))
    return plan.join(cut, "host", "left")


def _repeats(placed: DataFrame) -> DataFrame:
    at = turn(F.col("passes") + 1)
    last = (at < F.col("cut_turn")) | ((at == F.col("cut_turn")) & (F.col("place") <= F.coalesce("cut_place", F.lit(""))))
    times = F.col("passes") + F.when(F.coalesce(last, F.lit(False)), 1).otherwise(0)
    return placed.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)))).withColumn("turn", turn(F.col("copy")))


def mix(docs: DataFrame, **target) -> DataFrame:
    """The rows of ``docs``, each as often as the mix uses it, with ``copy``, ``block``, ``turn``, ``place``, ``weight`` and ``alpha``.

    Sorting by (copy, turn, place) gives the order of training: each pass is a fresh permutation of each host's blocks.
    A host gets its weight of the budget in whole passes and one partial pass that ends with the last document which
    fits. Documents without a word take no part; null and empty sources are one host; rows that repeat an id stand or
    fall together; very long texts count with all their words; other columns pass through (those of the added names are
    replaced); an empty table gives an empty result. See ``exponents`` for the targets.
    """
    plan = stored(mixing_plan(stored(sized(docs), "sized"), **target), "plan")
    added = ["copy", "block", "turn", "place", "weight", "alpha"]
    kept = [c for c in docs.columns if c not in added]
    # the documents' own columns travel packed, so none can be taken for one of the plan's
    hosted = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.struct(*kept).alias("_doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), place(F.col("doc_id")))
    placed = hosted.join(small_side(plan, 200), "host").withColumn("block", block(F.col("place"), F.col("docs")))
    return _repeats(placed).select("_doc.*", *added)


def op4_temperature_mixing(spark, sf_dir):
    """The mix of all documents within a budget of all tokens, its entropy half-way between that of the shares and that of equal weights."""
    narrow = stored(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sized")
    plan = stored(mixing_plan(narrow), "plan")
    placed = narrow.join(small_side(plan.drop("tokens"), 200), "host").withColumn("block", block(F.col("place"), F.col("docs")))
    return _repeats(placed).select("doc_id", F.col("host").alias("source"), "n_tokens", "copy", "block", "turn", "place", F.round("weight", 9).alias("weight"), "alpha")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS host, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (SELECT * FROM d WHERE n_tokens > 0),
hosts AS (SELECT host, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM s GROUP BY host),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS n FROM hosts),
share AS (SELECT list(CAST(tokens AS DOUBLE) / n ORDER BY host) AS ps FROM hosts, tot),
want AS (SELECT own + 0.5 * (ln(len(ps)) - own) AS target FROM (SELECT ps, -list_sum([p * ln(p) FOR p IN ps]) AS own FROM share)),
bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN e >= target THEN mid ELSE lo END, CASE WHEN e >= target THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, ln(zz) - mid * list_sum([pow(p, mid) * ln(p) FOR p IN ps]) / zz AS e
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, list_sum([pow(p, (lo + hi) / 2) FOR p IN ps]) AS zz, ps FROM bis, share WHERE i < 40)), want),
al AS (SELECT floor(lo * 1e6 + 1e-3) / 1e6 AS alpha FROM bis WHERE i = 40),
z AS (SELECT alpha, list_sum([pow(p, alpha) FOR p IN ps]) AS z FROM al, share),
plan AS (SELECT host, tokens, docs, alpha, pow(CAST(tokens AS DOUBLE) / n, alpha) / z AS weight FROM hosts, tot, z),
quota AS (SELECT *, CAST(floor(weight * n + 1e-3) AS BIGINT) AS quota FROM plan, tot),
placed AS (
  SELECT s.*, quota // tokens AS passes, quota % tokens AS rest, weight, alpha,
         CAST(('0x' || substr(place, 1, 8)) AS BIGINT) % CAST(ceil(sqrt(docs)) AS BIGINT) AS block
  FROM s JOIN quota USING (host)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY host ORDER BY md5('17:' || (passes + 1) || ':' || block || ':' || host), place) AS upto FROM placed),
times AS (SELECT *, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM run),
used AS (SELECT *, CAST(unnest(generate_series(1, n)) AS BIGINT) AS copy FROM times)
SELECT doc_id, host AS source, n_tokens, copy, block, md5('17:' || copy || ':' || block || ':' || host) AS turn, place, round(weight, 9) AS weight, alpha
FROM used
"""
