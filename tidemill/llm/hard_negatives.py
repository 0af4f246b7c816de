"""Hard negatives by coordinate pruning: length buckets with sorted coordinate lists.

Candidates fall into buckets of similar length (and one label), each a packed row. For an anchor and a score that must be
reached, a bucket's longest vector bounds the cosine that is needed; that bounds, for each of the anchor's largest
coordinates (its focus), the range of values that a candidate can have there. The ranges are cut out of the bucket's
sorted coordinate lists, the candidates in all of them are verified by exact integer products. Anchors travel packed in
blocks, a block to each group of buckets; blocks and buckets whose lengths can't reach the score aren't paired at all.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.stored import BROADCAST_BYTES, stored

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score that a negative's must reach, and may not exceed
BUCKET_BYTES, BUCKET_ROWS, BLOCK_ROWS = 1 << 21, 4096, 512
FOCUS = 4  # coordinates of an anchor whose ranges are intersected
GROUPS = 64  # groups of buckets that get a copy of each block where blocks are too many to be broadcast
REMEMBERED = 64  # blocks whose best scores a task keeps
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)``: rows that take part, one for each id, with the label as changed where the id is divisible by 7."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x): as doubles while products of such vectors stay exact in them, else as Python's unbounded integers."""
    y = np.floor(256 * x)
    if not y.size or np.abs(y).max() < 1 << 40:
        return y
    exact = [int(v) * 256 if abs(v) >= 1 << 52 else int(np.floor(256 * v)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def lengths(m: np.ndarray) -> np.ndarray:
    """Lengths of the rows, a little too long rather than too short."""
    if m.dtype == object and any(abs(v) > 1 << 1000 for v in m.ravel()):
        return np.full(len(m), np.inf)  # no bound; see Bucket.candidates
    big = m.astype(float)
    top = np.abs(big).max(axis=1, initial=0)
    scaled = big / np.where(top > 0, top, 1)[:, None]
    return top * np.sqrt((scaled * scaled).sum(axis=1)) * (1 + 1e-12)


def products(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Inner products of the rows of ``a`` with vector ``b``; ``reach`` bounds any of them. Exact."""
    if reach < EXACT and a.dtype != object and b.dtype != object:
        return (a @ b).astype(np.int64)
    whole = lambda m: np.array([int(v) for v in m.ravel()], object).reshape(m.shape)
    found = [sum(x * y for x, y in zip(row, whole(b))) for row in whole(a)]
    return np.array(found, object)


class Bucket:
    """Vectors of one label, their lengths and, for each coordinate that is asked for, the sorted list of its values."""

    def __init__(self, label: int, ids: np.ndarray, v: np.ndarray):
        self.label, self.ids, self.v = label, ids, whole_numbers(v)
        self.length = lengths(self.v)
        self.top = float(self.length.max(initial=0))
        self.unit = self.v.astype(float) / np.where(self.length > 0, self.length, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def listed(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray:
        """Rows that may reach a score of ``least``: those whose values lie in the feasible range of each focus coordinate."""
        everything = np.arange(len(self.ids))
        reach = length * self.top
        if least <= 0 or not np.isfinite(reach):
            return everything
        need = least / reach * (1 - SLACK) if reach > 0 else 2.0
        if need > 1:
            return everything[:0]
        unit = anchor.astype(float) / length
        slope = np.arccos(min(1.0, need))
        found, seen = None, 0
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + slope)) - SLACK, np.cos(max(0.0, angle - slope)) + SLACK
            values, order = self.listed(f)
            inside = order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
            if len(inside) == len(everything):
                continue
            seen += 1
            if found is None:
                found = np.zeros(len(everything), np.int8)
            found[inside] += 1
        return everything if found is None else np.flatnonzero(found == seen)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(ids) > 8 * k and scores.dtype != object:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(ids))
    return near[sorted(range(len(near)), key=lambda i: (-scores[near[i]], ids[near[i]]))[:k]]


class Remembered(OrderedDict):
    """The scores to be beaten of the blocks met last: what a task has found already need not be matched again."""

    def of(self, block, make):
        if block in self:
            self.move_to_end(block)
        else:
            if len(self) >= REMEMBERED:
                self.popitem(last=False)
            self[block] = make()
        return self[block]


def packed(rows: DataFrame, keys: list[str], most_rows: int, extra: str = "") -> DataFrame:
    """Runs of equal ``keys`` in rows sorted by them and falling length, packed: ids and vectors as bytes, the lengths' bounds.

    ``rows(vec_id, label, dim, norm, v, need, aims)``; ``need`` is the length that a partner must have at least.
    """
    schema = pa.schema([("pack", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("top", pa.float64()), ("need", pa.float64()), ("ids", pa.binary()), ("v", pa.binary()), ("aims", pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))))])
    order = [*(F.col(k) for k in keys), F.desc("norm"), F.col("vec_id")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list = []
        n, key = 0, None

        def flushed() -> pa.RecordBatch:
            nonlocal number, held, n
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            number += 1
            vectors = block.column("v")
            values = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()]
            label, dim = block.column("label")[0].as_py(), block.column("dim")[0].as_py()
            out = [number, label, dim, block.num_rows, max(block.column("norm").to_pylist()), min(block.column("need").to_pylist()), block.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes(), values.astype("<f8").tobytes(), block.column("aims").to_pylist()]
            held, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, schema.types)], schema=schema)

        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(0), True]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                here, most = tuple(marks[:, lo].tolist()), max(1, min(most_rows, BUCKET_BYTES // max(1, 8 * int(dims[lo]))))
                if here != key and held:
                    yield flushed()
                key = here
                while lo < hi:
                    step = min(hi - lo, most - n)
                    held.append(batch.slice(lo, step))
                    n, lo = n + step, lo + step
                    if n == most:
                        yield flushed()
        if held:
            yield flushed()

    return ranged.mapInArrow(run, "pack long, label long, dim int, n int, top double, need double, ids binary, v binary, aims array<array<struct<id:bigint,score:bigint>>>")


def paired(buckets: DataFrame, blocks: DataFrame, on: list[str], same_label: bool) -> DataFrame:
    """Each bucket beside the blocks whose anchors it may serve. Few blocks are broadcast; many go once to each of GROUPS groups
    of buckets, so that no task has to hold all pairs of a label."""
    held = blocks.agg(F.coalesce(F.sum(F.octet_length("v") + 64 * F.col("n")), F.lit(0))).first()[0]
    b = blocks.select(*(F.col(c).alias(f"a_{c}") for c in ("pack", "label", "dim", "n", "need", "ids", "v", "aims")))
    alike = (F.col("dim") == F.col("a_dim")) & ((F.col("label") == F.col("a_label")) if same_label else F.lit(True)) & (F.col("top") >= F.col("a_need"))
    if held <= BROADCAST_BYTES:
        return buckets.drop("need", "aims").join(F.broadcast(b), alike)
    dealt = buckets.drop("need", "aims").withColumn("group", F.pmod(F.xxhash64("pack"), F.lit(GROUPS)))
    b = b.withColumn("a_group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    return dealt.join(b, alike & (F.col("group") == F.col("a_group")))


FOUND = "anchor_id long, positive_id long, vec_id long, score long"


def searched(pairs: DataFrame, negatives: bool) -> DataFrame:
    """``(anchor_id, positive_id, vec_id, score)``: the best of each bucket for the anchors of each block; positives have no positive_id."""
    columns = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, memory = None, None, Remembered()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                dim = row["dim"].as_py()
                matrix = lambda data, n: np.frombuffer(data.as_buffer(), "<f8").reshape(n, dim)  # noqa: B023, E731
                if number != (found := row["pack"].as_py()):
                    number = found
                    bucket = Bucket(row["label"].as_py(), np.frombuffer(row["ids"].as_buffer(), "<i8"), matrix(row["v"], row["n"].as_py()))
                n = row["a_n"].as_py()
                label, ids, v = row["a_label"].as_py(), np.frombuffer(row["a_ids"].as_buffer(), "<i8"), whole_numbers(matrix(row["a_v"], n))
                size = lengths(v)
                aims = row["a_aims"].as_py() if negatives else [[None]] * n
                # of each anchor and aim: its best scores so far
                so_far = memory.of(row["a_pack"].as_py(), lambda: [[[] for _ in a] for a in aims])  # noqa: B023
                out: list[tuple] = []
                for i in range(n):
                    if negatives:
                        if label == bucket.label:
                            break
                        ranges = [(-(-LOW * a["score"] // 100), HIGH * a["score"] // 100) for a in aims[i]]
                        least = [max(lo, kept[-1]) if len(kept) == NEGATIVES else lo for (lo, _), kept in zip(ranges, so_far[i])]
                        if not least:
                            continue
                        floor = min(least)
                    else:
                        kept = so_far[i][0]
                        floor = kept[-1] if len(kept) == POSITIVES else -LONGEST
                    rows = bucket.candidates(v[i], float(size[i]), float(floor))
                    if not len(rows):
                        continue
                    score, names = products(bucket.v[rows], v[i], float(size[i]) * bucket.top), bucket.ids[rows]
                    if negatives:
                        for a, (lo, hi), least_, kept in zip(aims[i], ranges, least, so_far[i]):
                            fit = np.flatnonzero((score >= least_) & (score <= hi) & (score >= lo))
                            top = fit[best(names[fit], score[fit], NEGATIVES)]
                            out += [(int(ids[i]), a["id"], int(names[t]), int(score[t])) for t in top]
                            kept[:] = sorted([*kept, *(int(score[t]) for t in top)], reverse=True)[:NEGATIVES]
                    else:
                        fit = np.flatnonzero((names != ids[i]) & (score >= floor))
                        top = fit[best(names[fit], score[fit], POSITIVES)]
                        out += [(int(ids[i]), None, int(names[t]), int(score[t])) for t in top]
                        kept[:] = sorted([*kept, *(int(score[t]) for t in top)], reverse=True)[:POSITIVES]
                if out:
                    *keys, scores = zip(*out)
                    scores = [max(-LONGEST, min(LONGEST, s)) for s in scores]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*keys, scores)], columns)

    return pairs.mapInArrow(run, FOUND)


def hard_negatives(vectors: DataFrame, every: int = 50) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors among ``vectors(vec_id, embedding, label)``.

    Anchors are the rows whose id is divisible by ``every``; their positives the POSITIVES best rows of the same label; the
    negatives of a pair the NEGATIVES best rows of another label with LOW to HIGH percent of the positive's score. Scores are
    inner products of floor(256 x), exact up to the limits of a long; a score beyond counts as that limit. Ties go to the smaller id. Rows without id, label or vector, or with a null or non-finite
    component, take no part; of rows with the same id the one of smallest label, then vector, counts; vectors of different
    lengths are never compared. Empty vectors score 0. Other columns are ignored; an empty table, or anchors without
    partners, give no rows.
    """
    rows = usable(vectors.select("vec_id", "embedding", "label")).withColumn("dim", F.size("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(F.least(F.abs(x), F.lit(1e12)) * 256 + 1).cast("double") * F.floor(F.least(F.abs(x), F.lit(1e12)) * 256 + 1).cast("double"))
    # bounds the length from above; infinite where components are too large to be squared
    norm = F.when(F.exists("v", lambda x: F.abs(x) > 1e12), F.lit(float("inf"))).otherwise(F.sqrt(squares))
    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    rows = stored(rows.select("vec_id", "label", "dim", "v", norm.alias("norm")), "vectors")
    index = stored(packed(rows.withColumns({"need": F.lit(0.0), "aims": none}), ["dim", "label"], BUCKET_ROWS), "buckets")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    blocks = stored(packed(anchors.withColumns({"need": F.lit(0.0), "aims": none}), ["dim", "label"], BLOCK_ROWS), "blocks")
    found = searched(paired(index, blocks, ["dim", "label"], True), False).drop("positive_id")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    positives = stored(found.withColumn("rank", rank).filter(F.col("rank") <= POSITIVES).drop("rank"), "positives")
    aims = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score"))).alias("aims"), F.min("score").alias("least"))
    # a partner must be long enough to reach the lowest score that is asked for; one unit less, for rounding
    need = F.when(F.col("least") > 0, (F.col("least") * (LOW / 100) - 1) / F.greatest(F.col("norm"), F.lit(1.0))).otherwise(F.lit(0.0))
    aimed = anchors.join(aims.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("need", F.greatest(need, F.lit(0.0)) * (1 - 1e-9)).drop("least")
    blocks = stored(packed(aimed, ["dim", "label"], BLOCK_ROWS), "blocks")
    found = searched(paired(index, blocks, ["dim"], False).filter("label <> a_label"), True)
    # ranked first, within tasks and then across them, so that no more than the result meets the positives' scores
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    out = out.join(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_coordinate_hard_negatives(spark, sf_dir):
    """Hard negatives for every fiftieth row of ``embeddings``."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum([a.e[k] * b.e[k] FOR k IN range(1, len(a.e) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
