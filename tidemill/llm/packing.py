"""Packing documents into training windows by non-negative least squares over the histogram of lengths.

Whole windows of a document stand alone; what is left of it, its tail, is shorter than a window. The plan sees only how
many tails of each length there are: it enumerates combinations of up to three lengths that fill a window, solves for
repeat counts that use up the histogram (projected gradient steps on the least squares, counts never negative), rounds
them within what is there, packs the residual counts greedily, best fit first, and lays the pieces of windows that stay
open end to end, to be cut at the window's edges. A tail then finds its place by its rank among those of its length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidemill.plans.stored import small_side, stored

WINDOW, END = 2048, 1  # tokens of a sequence; the id behind each document
STEPS, KINDS = 300, 100_000  # gradient steps; combinations that a plan keeps, the rest being left to the greedy part
SLACK = 8  # tokens of padding that a greedily packed window may keep before its pieces are cut instead
LIGHT = 0.3  # weight of residuals of short lengths, which fit anywhere
BATCH_CHARS = 1 << 22


class Encoder:
    """The ids of a byte-level vocabulary: by its table of ranks, which is several times faster than the library that reads the
    JSON file and gives the same ids; by that library where the fast one gives up on a text."""

    def __init__(self, json_path: str, ranks_path: str):
        self.json_path, self.slow = json_path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        spec = Tokenizer.from_file(json_path).get_added_tokens_decoder()
        self.special = {t.content: i for i, t in spec.items()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        """The document's ids and END."""
        try:
            found = self.fast.encode(text, allowed_special="all") if any(s in text for s in self.special) else self.fast.encode_ordinary(text)
        except BaseException as e:  # the fast library panics, beyond Exception, where its pattern needs too many steps
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.slow is None:
                self.slow = Tokenizer.from_file(self.json_path)
            found = self.slow.encode(text, add_special_tokens=False).ids
        out = np.empty(len(found) + 1, "<u4")
        out[:-1], out[-1] = found, END
        return out


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """All combinations of one to three of the ``lengths`` (ascending) that add up to ``window``: three columns, the largest first,
    0 for none."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [np.array([[window, 0, 0]])] if there[window] else []
    two = lengths[(2 * lengths <= window) & there[window - lengths]]
    out.append(np.stack([window - two, two, np.zeros_like(two)], 1))
    for small in lengths[3 * lengths <= window].tolist():
        middle = lengths[(lengths >= small) & (2 * lengths <= window - small)]
        middle = middle[there[window - small - middle]]
        out.append(np.stack([window - small - middle, middle, np.full_like(middle, small)], 1))
    return np.concatenate(out).astype(np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often each combination is used: non-negative least squares of the used lengths against the histogram, by accelerated
    projected gradient steps. The columns of the system hold at most three entries, so a step is linear in the combinations."""
    size = len(histogram)
    weight = np.where(np.arange(size) * 16 < size, LIGHT, 1.0)
    weight[0] = 0
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale

    def used(x):
        return np.bincount(combos.ravel(), np.repeat(x, 3), size)

    # the largest eigenvalue bounds the step
    v = np.ones(len(combos))
    for _ in range(12):
        v = (weight * used(v))[combos].sum(1)
        norm = np.sqrt((v * v).sum())
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(STEPS):
        slope = (weight * (used(y) - goal))[combos].sum(1)
        nearer = np.maximum(0, y - step * slope)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = nearer + (momentum - 1) / after * (nearer - x)
        x, momentum = nearer, after
    return x * scale


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: groups of (lengths of a window, how many such windows)."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by free space
    spaces: list[int] = []

    def put(lengths: tuple[int, ...], n: int, space: int) -> None:
        if n:
            if space not in groups:
                groups[space] = []
                insort(spaces, space)
            groups[space].append((lengths, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                lengths, n, space = (), -(-count // (window // length)), window
            else:
                space = spaces[at]
                lengths, n = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
            each = space // length
            full, rest = min(n, count // each), 0
            if full < n:
                rest = count - full * each
                put(lengths + (length,) * rest, int(rest > 0), space - rest * length)
                if lengths:
                    put(lengths, n - full - (rest > 0), space)
            put(lengths + (length,) * each, full, space - each * length)
            count -= full * each + rest
    return [g for found in groups.values() for g in found]


class Plan:
    """Where the tail of a given length and rank lies: windows by combination first, then the strip of pieces laid end to end."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW, slack: int = SLACK):
        """``histogram[n]``: how many tails have ``n`` tokens, for n under ``window``."""
        self.window = window
        left = histogram.astype(np.int64).copy()
        chosen: list[tuple[tuple[int, ...], int]] = []
        combos = combinations(window, np.flatnonzero(np.r_[left, 0][: window + 1]))
        if len(combos):
            wanted = repeat_counts(combos, np.r_[left, 0].astype(float))
            order = np.argsort(-wanted, kind="stable")[:KINDS]
            order = order[wanted[order] > 1e-6]
            for whole in (True, False):  # first the whole parts, then one more for the fraction, larger counts first, as long as there are tails
                for k in order.tolist():
                    lengths = tuple(x for x in combos[k].tolist() if x)
                    n = min(int(wanted[k]) if whole else 1, *(int(left[x]) // lengths.count(x) for x in lengths))
                    if n > 0:
                        for x in lengths:
                            left[x] -= n
                        chosen.append((lengths, n))
        self.by_combination = sum(n for _, n in chosen)
        open_ = []
        for lengths, n in greedy(left, window):
            (chosen if window - sum(lengths) <= slack else open_).append((lengths, n))
        taken = np.zeros(window + 1, np.int64)
        entries: dict[int, list[tuple[int, int, int]]] = {}  # of a length: first rank, first sequence, offset; in the strip: -1 and a position
        self.packed = 0
        for lengths, n in chosen:
            offset = 0
            for x in lengths:
                entries.setdefault(x, []).append((int(taken[x]), self.packed, offset))
                taken[x] += n
                offset += x
            self.packed += n
        strip = 0
        for x in np.flatnonzero(histogram > taken[: len(histogram)]).tolist():
            entries.setdefault(x, []).append((int(taken[x]), -1, strip))
            strip += x * int(histogram[x] - taken[x])
        # the strip is cut into whole windows; its rest into powers of two, which need no padding
        self.strip_windows, rest = divmod(strip, window)
        self.edges = [self.strip_windows * window]
        while rest:
            rest -= 1 << (rest.bit_length() - 1)
            self.edges.append(strip - rest)
        self.places = {x: tuple(np.array(c, np.int64) for c in zip(*e)) for x, e in entries.items()}
        self.sequences = self.packed + self.strip_windows + len(self.edges) - 1

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, tokens, sequence, offset) of the pieces of a tail."""
        ranks, sequences, offsets = self.places[length]
        k = int(np.searchsorted(ranks, rank, "right")) - 1
        if sequences[k] >= 0:
            return [(0, length, int(sequences[k]) + rank - int(ranks[k]), int(offsets[k]))]
        out, at = [], int(offsets[k]) + (rank - int(ranks[k])) * length
        done = 0
        while done < length:
            if at < self.edges[0]:
                number, low, high = at // self.window, at // self.window * self.window, (at // self.window + 1) * self.window
            else:
                e = int(np.searchsorted(self.edges, at, "right"))
                number, low, high = self.strip_windows + e - 1, self.edges[e - 1], self.edges[e]
            n = min(length - done, high - at)
            out.append((done, n, self.packed + number, at - low))
            done, at = done + n, at + n
        return out


def tokenised(docs: DataFrame, json_path: str, ranks_path: str, window: int) -> DataFrame:
    """``(doc_id, ids, tokens, fulls, tail, block, tail_rank, full_rank)``: the ids of each document as little-endian unsigned
    32-bit integers and its ranks within the task (``block``), among tails of its length and among whole windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("tokens", pa.int64()), ("fulls", pa.int64()), ("tail", pa.int32()), ("block", pa.int32()), ("tail_rank", pa.int64()), ("full_rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = encoder(json_path, ranks_path), TaskContext.get().partitionId()
        ranks, windows = [0] * window, 0
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py() or "")
                fulls, tail = divmod(len(ids), window)
                rows.append((doc_id, ids.tobytes(), len(ids), fulls, tail, block, ranks[tail], windows))
                ranks[tail] += 1
                windows += fulls
                held += 4 * len(ids)
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, tokens long, fulls long, tail int, block int, tail_rank long, full_rank long")


def pack(docs: DataFrame, json_path: str, ranks_path: str, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: the pieces of all rows of ``docs(doc_id, text)``.

    Each row is a document of its own: its ids and END, cut into whole windows and a tail; the windows are sequences of their own, the
    tails are packed by the plan, which sees a histogram of ``window`` numbers, however many rows there are. Null and empty texts are
    END alone. Rows that repeat, and rows without an id, are packed like all others. Sequences hold at most ``window`` tokens; all
    but greedily packed ones (padding up to ``slack``) are full, save for the last ones, which are powers of two. Very long texts are
    encoded whole. Other columns are ignored; an empty table gives no rows.

    The ids are written once; then each row joins the number of tails of its length in earlier blocks, broadcast up to a size, else
    by a shuffle.
    """
    rows = stored(tokenised(docs, json_path, ranks_path, window), "ids")
    # how many tails of each length, and whole windows (as length 0), each block holds, and how many come before
    counts = rows.filter("tail > 0").groupBy("block", "tail").agg(F.count("*").alias("n")).unionByName(rows.filter("fulls > 0").groupBy("block").agg(F.sum("fulls").alias("n")).withColumn("tail", F.lit(0)))
    counts = stored(counts, "lengths")
    before = F.sum("n").over(Window.partitionBy("tail").orderBy("block")) - F.col("n")
    first = stored(counts.select("block", "tail", before.alias("before")), "before")
    histogram = np.zeros(window, np.int64)
    for length, n in counts.filter("tail > 0").groupBy("tail").agg(F.sum("n")).collect():  # at most one row for each length of a window
        histogram[length] = n
    plan = Plan(histogram, window, slack)
    side = small_side(first, 40)
    placed = rows.join(side.withColumnRenamed("before", "tails_before"), ["block", "tail"], "left")
    wholes = small_side(first.filter("tail = 0").select("block", F.col("before").alias("fulls_before")), 24)
    placed = placed.join(wholes, "block", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "tokens", "fulls", "tail", "tail_rank", "full_rank", "tails_before", "fulls_before")
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for ids, doc_id, tokens, fulls, tail, tail_rank, full_rank, tails, wholes in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in names)):
                data = ids.as_py()
                for k in range(fulls):
                    out.append((doc_id, k * window, window, data[4 * k * window : 4 * (k + 1) * window], tokens, plan.sequences + wholes + full_rank + k, 0))
                if tail:
                    at = fulls * window
                    for start, n, sequence, offset in plan.pieces(tail, tails + tail_rank):
                        out.append((doc_id, at + start, n, data[4 * (at + start) : 4 * (at + start + n)], tokens, sequence, offset))
                held += 4 * tokens
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    columns = placed.select("doc_id", "ids", "tokens", "fulls", "tail", "tail_rank", "full_rank", "tails_before", "fulls_before")
    return columns.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op12_least_squares_packing(spark, sf_dir):
    """All ``documents`` in windows of 2048 tokens of the byte-level vocabulary, with the checksum of each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
