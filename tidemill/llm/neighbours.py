"""Approximate nearest neighbours: vantage-point trees per shard.

The upper levels of one vantage-point tree, fitted on a bounded sample, cut all vectors into leaves; a leaf that holds more than
a shard should is dealt over several shards by id. Every query first asks its own leaf. The distance of the last of the ``k`` best
found there then rules out whole leaves by the triangle inequality, and the query goes, packed with others, to the shards of the
leaves that are left. Within a partition the packed rows of a shard come first, its queries after them: the shard's tree is built
once, and the queries stream down it, a block at a time. On unit vectors the chord is a metric that orders like the cosine, so the
triangle inequality rules subtrees out: with ``factor`` 1 exactly, above 1 earlier, at the price of recall. Tasks return the best
few of each query, ranked by the exact cosine of the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.stored import stored

SHARD_BYTES, MOST, QUERIES, LEAF = 1 << 25, 16_384, 1024, 256  # of a shard: bytes of components, vectors; queries of a block; vectors of a leaf
SAMPLE, SAMPLE_BYTES, APART = 65_536, 1 << 25, 8  # of the sample for the upper levels: vectors, bytes of components; sampled vectors of a leaf
BLOCK_BYTES = 1 << 22  # of the components in a packed row
SLACK = 1e-6  # of a chord, for rounding


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class VPTree:
    """A tree over the rows of ``unit`` (unit vectors), whose ``ids`` ascend."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, seed: int = 5):
        self.unit, self.ids, self.random = unit, ids, np.random.default_rng(seed)
        self.root = self.build(np.arange(len(ids)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = int(self.random.choice(rows))
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[rows] @ self.unit[vantage])))
        middle = float(np.median(far))
        inside = far <= middle
        if inside.all():
            return rows
        return vantage, middle, self.build(rows[inside]), self.build(rows[~inside])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the ``k`` nearest of each query (-1: none) and their cosines, without rows that bear its own id.
        Rows of a smaller cosine than ``known`` aren't looked for."""
        known = np.full(len(queries), -1.0) if known is None else np.maximum(known, -1)
        best = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1)
        most = np.iinfo(np.int64).max

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                near = np.round(queries[at] @ self.unit[node].T, 12)
                near[self.ids[node][None, :] == own[at][:, None]] = -np.inf
                some = (near >= np.maximum(best[at][:, -1], known[at] - SLACK)[:, None]).any(axis=1)  # the others keep what they have
                at, near = at[some], near[some]
                first = np.argsort(-near, axis=1, kind="stable")[:, :k]  # ids ascend in a leaf, so ties go to the smaller
                score = np.concatenate([best[at], np.take_along_axis(near, first, 1)], axis=1)
                found = np.concatenate([rows[at], node[first]], axis=1)
                found[score == -np.inf] = -1
                order = np.lexsort((np.where(found < 0, most, self.ids[found]), -score), axis=1)[:, :k]
                best[at], rows[at] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
                return
            vantage, middle, inner, outer = node
            far = np.sqrt(np.maximum(0, 2 - 2 * (queries[at] @ self.unit[vantage])))
            within = far <= middle
            visit(inner, at[within])
            visit(outer, at[~within])
            # the other side holds nothing nearer than its distance to the border
            reach = chord(np.maximum(best[at][:, -1], known[at])) + SLACK
            open_ = np.abs(far - middle) * factor <= reach
            visit(outer, at[within & open_])
            visit(inner, at[~within & open_])

        visit(self.root, np.arange(len(queries)))
        return rows, best


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero and holds no null or non-finite component."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(whole & F.exists(v, lambda x: x != 0))


def unscaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1, so that products neither overflow nor vanish;
    the digits stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def directions(x: np.ndarray) -> np.ndarray:
    y = unscaled(x)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def most(dim: int) -> int:
    """Vectors of a shard of this dimension."""
    return max(LEAF, min(MOST, SHARD_BYTES // (8 * dim)))


class Leaves:
    """The upper levels of a vantage-point tree, whose leaves are numbered from 0. A row's leaf hangs on that row only, not on
    those beside it: each distance is a sum of its own, never part of a matrix product."""

    def __init__(self, unit: np.ndarray, want: int, seed: int = 3):
        self.unit, self.random, self.n = unit, np.random.default_rng(seed), 0
        self.root = self.build(np.arange(len(unit)), want)
        del self.unit, self.random

    def build(self, rows: np.ndarray, want: int):
        if want > 1 and len(rows) >= 2 * APART:
            tried = self.random.choice(rows, min(8, len(rows)), replace=False)
            far = np.stack([self.distance(self.unit[rows], self.unit[v]) for v in tried])
            best = int(far.std(axis=1).argmax())  # the vantage point that spreads the others most
            middle = float(np.median(far[best]))
            inside = far[best] <= middle
            if not inside.all():
                return self.unit[tried[best]].copy(), middle, self.build(rows[inside], want // 2), self.build(rows[~inside], want - want // 2)
        self.n += 1
        return self.n - 1

    @staticmethod
    def distance(unit: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.sqrt(((unit - vantage) ** 2).sum(axis=1))

    def reached(self, unit: np.ndarray, reach: np.ndarray, factor: float = 1.0) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the rows of ``unit`` whose balls of radius ``reach`` they may hold something of; a negative one: its own leaf only."""
        todo = [(self.root, np.arange(len(unit)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            vantage, middle, inner, outer = node
            far = self.distance(unit[at], vantage)
            within = far <= middle
            open_ = np.abs(far - middle) * factor <= reach[at]
            todo += [(inner, at[within | open_]), (outer, at[~within | open_])]

    def leaf(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(unit), np.int64)
        for number, at in self.reached(unit, np.full(len(unit), -1.0)):
            out[at] = number
        return out


class Routes:
    """The leaves of each dimension that the sample holds, and the shards of each leaf."""

    def __init__(self, sample: list[np.ndarray], share: float):
        """``sample``: the distinct sampled vectors of each dimension; ``share``: the part of all rows that was sampled."""
        self.trees = {x.shape[1]: Leaves(directions(x), max(1, round(len(x) / share / most(x.shape[1])))) for x in sample}
        self.pieces: dict[tuple[int, int], int] = {}
        # fewer than 20 / share rows have a dimension that the sample lacks, but with a probability of 2e-9
        self.rest = max(1, int(20 / share / LEAF)) if share < 1 else 1

    def leaf(self, dim: int, unit: np.ndarray) -> np.ndarray:
        return self.trees[dim].leaf(unit) if dim in self.trees else np.zeros(len(unit), np.int64)

    def reached(self, dim: int, unit: np.ndarray, reach: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        return self.trees[dim].reached(unit, reach, factor) if dim in self.trees else iter([(0, np.arange(len(unit)))])

    def shards(self, dim: int, leaf: int) -> int:
        return self.pieces.get((dim, leaf), 1) if dim in self.trees else self.rest


def firsts(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of the rows of equal components, those of the ``k + 1`` smallest ids, each id once: no query needs another, as equal
    rows have equal cosines and go by their ids. Sorted by id."""
    heads, counts = np.unique(values[:, 0].copy().view(np.int64), return_inverse=True, return_counts=True)[1:]
    shared = np.flatnonzero(counts[heads.ravel()] > 1)  # the others equal no row
    same = np.arange(len(ids))
    rows = np.ascontiguousarray(values[shared]).view(np.dtype((np.void, 8 * values.shape[1]))).ravel()
    same[shared] = len(ids) + np.unique(rows, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    a, b = same[order], ids[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    order, a = order[new], a[new]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    order = order[nth <= k]
    return order[np.argsort(ids[order], kind="stable")]


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places in the batch and components of the vectors of each dimension."""
    if not batch.num_rows:
        return
    lists = batch.column("embedding")
    values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    dims = np.diff(starts)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, values[starts[at][:, None] + np.arange(dim)]


PACKED = pa.schema([("dim", pa.int32()), ("leaf", pa.int64()), ("piece", pa.int64()), ("asks", pa.bool_()), ("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.float64())), ("parts", pa.list_(pa.float64()))])
PACKED_DDL = "dim int, leaf long, piece long, asks boolean, ids array<long>, known array<double>, parts array<double>"


def packed(dim: int, leaf: int, piece: int, asks: bool, ids: np.ndarray, known: np.ndarray, parts: np.ndarray) -> dict:
    return {"dim": dim, "leaf": leaf, "piece": piece, "asks": asks, "ids": ids, "known": known, "parts": parts.ravel()}


def pack_rows(routes: Routes, k: int):
    """Candidates, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("vec_id").to_numpy()
            for dim, at, values in by_dimension(batch):
                ids = every[at]
                keep = firsts(values, ids, k)
                ids, values = ids[keep], values[keep]
                leaves = routes.leaf(dim, directions(values))
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                piece = (spread % np.array([routes.shards(dim, leaf) for leaf in leaves.tolist()], np.uint64)).astype(np.int64)
                order = np.lexsort((piece, leaves))
                cuts = np.flatnonzero(np.r_[True, (np.diff(leaves[order]) != 0) | (np.diff(piece[order]) != 0), True])
                groups = (order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:]))
                out = [packed(dim, int(leaves[g[0]]), int(piece[g[0]]), False, ids[g], np.zeros(0), values[g]) for g in groups]
                yield pa.RecordBatch.from_pylist(out, PACKED)

    return run


def pack_queries(routes: Routes, factor: float, again: bool):
    """Queries, packed by the shards that they ask: at first those of their own leaf, then those of all others that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, bounds = batch.column("vec_id").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False)
            for dim, at, values in by_dimension(batch):
                ids, known, unit = every[at], bounds[at], directions(values)
                own = routes.leaf(dim, unit)
                reach = chord(np.maximum(known, -1)) + SLACK if again else np.full(len(at), -1.0)
                step = max(1, min(QUERIES, BLOCK_BYTES // (8 * dim)))
                for leaf, rows in routes.reached(dim, unit, reach, factor):
                    rows = rows[own[rows] != leaf] if again else rows
                    for piece in range(routes.shards(dim, leaf)):
                        for lo in range(0, len(rows), step):
                            block = rows[lo : lo + step]
                            yield pa.RecordBatch.from_pylist([packed(dim, leaf, piece, True, ids[block], known[block], values[block])], PACKED)

    return run


class Shard:
    """The vectors of one shard as they arrive, then its tree."""

    def __init__(self, key: tuple[int, int, int]):
        self.key, self.rows, self.ids, self.tree = key, [], [], None

    def search(self, own: np.ndarray, vectors: np.ndarray, known: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids of the nearest and exact cosines."""
        if self.tree is None and self.rows:
            rows, ids = np.concatenate(self.rows), np.concatenate(self.ids)
            keep = firsts(rows, ids, k)
            self.rows, self.ids = unscaled(rows[keep]), ids[keep]
            self.tree = VPTree(directions(self.rows), self.ids)
        if self.tree is None:
            return own[:0], own[:0], np.zeros(0)
        asked = unscaled(vectors)
        found, _ = self.tree.search(directions(asked), own, k + 3, factor, known)
        at, slot = np.nonzero(found >= 0)
        a, b = asked[at], self.rows[found[at, slot]]
        return own[at], self.ids[found[at, slot]], (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def answers(k: int, factor: float):
    """The best of each query in each shard; the rows of a shard come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard((-1, -1, -1))
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("dim", "leaf", "piece", "asks")))
            for i, (*key, asks) in enumerate(keys):
                if shard.key != tuple(key):
                    shard = Shard(tuple(key))
                ids, known, parts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "known", "parts"))
                vectors = parts.reshape(len(ids), key[0])
                if asks:
                    found = shard.search(ids, vectors, known, k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, FOUND.types)], schema=FOUND)
                else:
                    shard.rows.append(vectors)
                    shard.ids.append(ids)

    return run


def routed(rows: DataFrame, k: int) -> Routes:
    """Leaves by a sample of at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``, taken by a hash of their ids; the shards of a leaf
    by the count of all its rows."""
    n, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest), 32 * APART * -(-n // most(widest))))
    share = min(1.0, 0.9 * bound / max(n, 1))
    drawn = rows if share == 1 else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample: dict[int, list[np.ndarray]] = {}
    if n > most(widest):
        for batch in drawn.select("embedding").limit(bound).toArrow().combine_chunks().to_batches():
            for dim, _, values in by_dimension(batch):
                sample.setdefault(dim, []).append(values)
    routes = Routes([np.unique(np.concatenate(v), axis=0) for v in sample.values()], share)
    if sample:
        sized = rows.mapInArrow(pack_rows(routes, k), PACKED_DDL).groupBy("dim", "leaf").agg(F.sum(F.size("ids")).alias("n"))
        sized = sized.filter(F.col("dim").isin(list(routes.trees)))  # no more rows than leaves
        routes.pieces = {(r["dim"], r["leaf"]): -(-r["n"] // most(r["dim"])) for r in sized.collect()}
    return routes


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of each query among ``vectors(vec_id, embedding)``.

    Queries are the rows whose id is divisible by ``every``; candidates all rows of the same dimension but the query's
    own id; nearness is the cosine in double precision, ties go to the smaller id. Unusable vectors (see ``usable``)
    take no part; vectors of any finite magnitude do. Rows that repeat an id and vector count once; of many rows of one vector only
    those of the smallest ids are sent, as the others can't be among the first. Very long vectors make
    smaller shards. Other columns are ignored; an empty table, or a query without candidates, gives no rows.
    """
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    routes = routed(rows, k)
    asked = rows.filter(F.col("vec_id") % every == 0)
    kept = rows.mapInArrow(pack_rows(routes, k), PACKED_DDL)
    tasks = 4 * max(1, sum(routes.pieces.values()))

    def ask(queries: DataFrame, again: bool) -> DataFrame:
        blocks = queries.mapInArrow(pack_queries(routes, factor, again), PACKED_DDL)
        dealt = kept.unionByName(blocks).repartition(tasks, "dim", "leaf", "piece").sortWithinPartitions("dim", "leaf", "piece", "asks")
        return dealt.mapInArrow(answers(k, factor), "query_id long, vec_id long, score double").distinct()

    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    found = ask(asked.withColumn("known", F.lit(-1.0)), again=False)
    if any(tree.n > 1 for tree in routes.trees.values()):
        first = stored(ranked(found), "own_leaf")
        last = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") - 1e-9).alias("known"))
        asked = asked.join(last, "vec_id", "left").select("vec_id", "embedding", F.coalesce("known", F.lit(-1.0)).alias("known"))
        found = first.drop("rank").unionByName(ask(asked, again=True)).distinct()
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def op10_vantage_point_neighbours(spark, sf_dir):
    """The five nearest rows of every fiftieth row of ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
