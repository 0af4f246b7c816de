"""Chat formatting by quotation linking: messages that quote earlier ones are tied to them and lose the quotes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.stored import stored

SPAN = 4096  # turns that are looked at together
MARK = r"^((?:[ \t]*>)+)"
WROTE = r"(?i)^.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"


def _normal(line):
    return F.trim(F.lower(F.regexp_replace(line, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``_key``, which tells texts of one turn apart, and ``_lines`` (level, body).

    A line's level is its number of leading ``>``; its body is what follows them.
    """
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", ""))
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n", -1), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARK + "[ \t]?", "").alias("body")))
    return messages.withColumns({"_key": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "_lines": lines})


def passages(read: DataFrame) -> DataFrame:
    """``(conv_id, turn, _key, level, kind, h, first, last)``: the passages of every message, with the hash of their lines in
    normal form (lower case, single spaces, without blank lines).

    Three kinds, from coarse to fine: 3, the lines of one level that follow one another (of level 0 also all of them
    together, the message's own text); 2, those among them between blank lines; 1, each line.
    """
    own = ["conv_id", "turn", "_key"]
    # "... wrote:" is nobody's text
    lines = read.filter("conv_id is not null and turn is not null").select(*own, F.posexplode("_lines").alias("place", "x"))
    lines = lines.filter(~F.col("x.body").rlike(WROTE)).select(*own, "place", "x.level", _normal(F.col("x.body")).alias("line"))
    w = Window.partitionBy(*own, "level").orderBy("place")
    runs = lines.withColumn("run", F.col("place") - F.row_number().over(w)).filter("line <> ''").withColumn("part", F.col("place") - F.row_number().over(w))
    joined = F.xxhash64(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n"))
    one = lambda kind, keys: runs.groupBy(*own, "level", *keys).agg(joined.alias("h"), F.min("place").alias("first"), F.max("place").alias("last")).select(*own, "level", F.lit(kind).alias("kind"), "h", "first", "last")
    single = runs.select(*own, "level", F.lit(1).alias("kind"), F.xxhash64("line").alias("h"), F.col("place").alias("first"), F.col("place").alias("last"))
    whole = one(3, ["run"]).union(one(2, ["run", "part"])).union(single)
    texts = runs.filter("level = 0").groupBy(*own).agg(joined.alias("h"), F.min("place").alias("first"), F.max("place").alias("last")).select(*own, F.lit(0).alias("level"), F.lit(3).alias("kind"), "h", "first", "last")
    return whole.union(texts)


def latest_before(said: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with ``source``, the latest earlier ``turn`` of ``said`` with equal keys.

    Turns fall into spans of SPAN: what a span's predecessors hold is one number, found by a window over spans, and each
    span is searched by itself, so a key that very many messages share is spread over tasks.
    """
    span = F.floor(F.col("turn") / SPAN).alias("span")
    held = said.select(*keys, span, "turn").groupBy(*keys, "span").agg(F.max("turn").alias("held"))
    marks = held.unionByName(asked.select(*keys, span).distinct(), allowMissingColumns=True).groupBy(*keys, "span").agg(F.max("held").alias("held"))
    earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("before", F.max("held").over(earlier)).drop("held")
    both = asked.withColumn("asks", F.lit(True)).unionByName(said.select(*keys, "turn").distinct().withColumn("asks", F.lit(False)), allowMissingColumns=True).withColumn("span", span)
    within = Window.partitionBy(*keys, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max(F.when(~F.col("asks"), F.col("turn"))).over(within)).filter("asks")
    return found.join(marks, [*keys, "span"], "left").withColumn("source", F.coalesce("near", "before")).drop("asks", "span", "near", "before")


def linked_lines(read: DataFrame) -> DataFrame:
    """``(conv_id, turn, _key, place, level, source)``: each quoted line with the message that it is taken from.

    A quoted passage belongs to the latest earlier message of its conversation that has a passage of equal hash; a line
    to that of the coarsest passage around it that is found anywhere.
    """
    found = stored(passages(read), "passages")
    quoted = found.filter("level > 0")
    said = found.filter("level = 0").select("conv_id", "turn", "h").join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").select("conv_id", "turn", "h")
    tied = latest_before(said, quoted, ["conv_id", "h"]).filter("source is not null")
    lines = tied.withColumn("place", F.explode(F.sequence("first", "last")))
    return lines.groupBy("conv_id", "turn", "_key", "place").agg(F.max_by("source", F.struct("kind", "source")).alias("source"), F.max("level").alias("level"))


def links(lines: DataFrame) -> DataFrame:
    """``(conv_id, turn, _key, parent_turn, n_linked, _places)`` of messages with linked lines: the parent is the message with
    most lines quoted at the first level that has any; ties go to the latest."""
    votes = lines.groupBy("conv_id", "turn", "_key", "level", "source").agg(F.count("*").alias("n"), F.collect_list("place").alias("at"))
    return votes.groupBy("conv_id", "turn", "_key").agg(F.max_by("source", F.struct(-F.col("level"), "n", "source")).alias("parent_turn"), F.sum("n").alias("n_linked"), F.flatten(F.collect_list("at")).alias("_places"))


def bound(function, **values) -> F.Column:
    """``function`` of a struct of values, each of which is computed once for a row, even where a lambda uses it."""
    return F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), function)[0]


def without_quotes(places) -> F.Column:
    """A message's text without the lines at ``places`` and the lines like "... wrote:" that lead to them. Blank lines around
    what goes go with it."""
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    leads = F.filter(every, lambda k: F.get("_lines", k)["body"].rlike(WROTE))
    others = F.array_except(every, leads)
    # the line after a lead and the leads behind it: so many of the others come before as the lead's place less its rank
    led = bound(lambda z: F.transform(z["leads"], lambda k, rank: F.struct(k.alias("k"), F.get(z["others"], k - rank).alias("to"))), leads=leads, others=others)
    heads = F.transform(F.filter(led, lambda x: F.array_contains(places, x["to"]) & (F.get("_lines", x["to"])["level"] > F.get("_lines", x["k"])["level"])), lambda x: x["k"])
    held = F.array_except(F.array_except(every, places), heads)
    source = F.split("text", "\r?\n", -1)
    return F.trim(F.regexp_replace(F.array_join(bound(lambda z: F.transform(z["held"], lambda k: F.get(z["lines"], k)), held=held, lines=source), "\n"), "\n{3,}", "\n\n"))


def threads(links_: DataFrame) -> DataFrame:
    """``(conv_id, turn, root_turn)`` of linked messages: where their chain of parents begins, by pointer doubling."""
    at = stored(links_.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("root_turn")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"))
        step = stored(at.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"), F.col("above").isNotNull().alias("moved")), "threads")
        if step.filter("moved").isEmpty():
            return step.drop("moved")
        at = step.drop("moved")


def placed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``place``, their number within the conversation by (root_turn, turn, role, text).

    Counts of spans of roots, then of each root's spans of turns, say how many come before; only messages of one such span
    are sorted together, so a conversation of any length is spread over tasks.
    """
    marked = messages.withColumns({"_roots": F.floor(F.col("root_turn") / SPAN), "_turns": F.floor(F.col("turn") / SPAN)})
    keys = ["conv_id", "_roots", "root_turn", "_turns"]
    small = marked.groupBy(*keys).agg(F.count("*").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("_inner", F.sum("n").over(earlier(Window.partitionBy("conv_id", "_roots").orderBy("root_turn", "_turns"))))
    large = small.groupBy("conv_id", "_roots").agg(F.sum("n").alias("n")).withColumn("_outer", F.sum("n").over(earlier(Window.partitionBy("conv_id").orderBy("_roots")))).drop("n")
    before = F.coalesce("_inner", F.lit(0)) + F.coalesce("_outer", F.lit(0))
    both = with_nulls(marked, with_nulls(small.drop("n"), large, keys[:2]).select(*keys, before.alias("_before")), keys)
    within = Window.partitionBy(*keys).orderBy("turn", "role", "text")
    return both.withColumn("place", (F.col("_before") + F.row_number().over(within)).cast("long"))


def with_nulls(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The left join on ``keys``, where null equals null."""
    renamed = right.select(*(F.col(k).alias(f"_{k}_") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(renamed, functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys)), "left").drop(*(f"_{k}_" for k in keys))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """``(conv_id, place, turn, role, parent_turn, root_turn, n_linked, text)`` for every row of ``messages``.

    ``text`` is the message without the quotes that were found in an earlier message of its conversation; quoted lines that
    nobody said stay. ``parent_turn`` is the message that it quotes, null if none is found; ``root_turn`` the start of its
    chain of replies (itself without a parent). ``place`` numbers a conversation's messages by (root_turn, turn), so
    replies follow what they answer. Null texts stay null; messages without conversation or turn link to nothing; rows
    that repeat a turn share its chain and are told apart by role and text. Very long texts are cut into lines like all
    others. Other columns are ignored; an empty table gives an empty result.
    """
    read = parsed(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    found = stored(links(linked_lines(read)), "replies")
    clean = F.when(F.col("_places").isNull(), F.col("text")).otherwise(without_quotes(F.col("_places")))
    out = read.join(found, ["conv_id", "turn", "_key"], "left").select("conv_id", "turn", "role", clean.alias("text"), "parent_turn", "n_linked").join(threads(found), ["conv_id", "turn"], "left")
    out = out.withColumns({"root_turn": F.coalesce("root_turn", "turn"), "n_linked": F.coalesce("n_linked", F.lit(0))})
    return placed(stored(out, "replies")).select("conv_id", "place", "turn", "role", "parent_turn", "root_turn", "n_linked", "text")


def quoting(messages: DataFrame) -> DataFrame:
    """The messages as mail programs would send them: each quotes its predecessor, and that one's in turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    prefixed = lambda text, mark: F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit(mark), x)), "\n")
    out = messages.withColumns({"_1": F.lag("text", 1).over(w), "_2": F.lag("text", 2).over(w)})
    second = F.when(F.col("_2").isNotNull(), F.concat(F.lit("> They wrote:\n"), prefixed(F.col("_2"), "> > "), F.lit("\n"))).otherwise(F.lit(""))
    text = F.when(F.col("_1").isNotNull(), F.concat(F.lit("You wrote:\n"), second, prefixed(F.col("_1"), "> "), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return out.withColumn("text", text).drop("_1", "_2")


def op1_quotation_linking(spark, sf_dir):
    """All conversations in reply order, without quotes."""
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op1_quotation_roundtrip(spark, sf_dir):
    """The conversations with quotes put in, linked and stripped again: texts come back, parents are the predecessors."""
    return reply_ordered(quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


# for tables without a line that begins with the mark, as the given ones: nothing is linked, every message is its own root
OP1_SQL = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, turn, role, CAST(NULL AS BIGINT) AS parent_turn, turn AS root_turn,
CAST(0 AS BIGINT) AS n_linked, text FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations)"""

# what comes back when each message quotes its predecessor, and that one's: all their lines are linked, the chain begins at the first turn
ROUNDTRIP_SQL = """WITH m AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
q AS (SELECT *, lag(text, 1) OVER w AS one, lag(text, 2) OVER w AS two, lag(turn, 1) OVER w AS parent_turn, min(turn) OVER (PARTITION BY conv_id) AS root_turn FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, turn, role, parent_turn, root_turn,
CAST(len(list_filter(string_split(coalesce(one, ''), chr(10)), lambda x: trim(x) <> '')) + len(list_filter(string_split(coalesce(two, ''), chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_linked, text FROM q"""
