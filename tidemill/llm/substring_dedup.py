"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

Every window's hash goes to the bucket of its leading bits, packed: a row holds all windows that a chunk of documents
sends to a bucket (hash remainder, document, position), so a shuffle moves about ten bytes a window and few rows. A
chunk settles what it can before the shuffle: of the windows of one hash only those of its smallest document leave, the
others are known to repeat. So the most common passage sends one entry per chunk, not one per document. The bucket finds the
smallest document of each hash; windows of other documents come back to their chunk and merge into maximal intervals.

A window is known by 88 bits of two rolling hashes, the leading ones of which name the bucket. Over 100 TB of text, some
1.6e13 windows, fewer than one pair of different windows is to be expected to agree in all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.words import byte_values, mixed, word_hashes
from tidemill.plans.stored import BROADCAST_BYTES, stored

BASE, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses modulo 2**64
CHUNK_WINDOWS = 1_000_000
BUCKET_WINDOWS = 1_000_000
HASH_BYTES = 10  # that a window sends: seven of the first hash, whose eighth is in the bucket, and three of the second
PACKED = "bucket long, label long, ids binary, counts binary, places binary, hashes binary"


class Roller:
    """Rabin-Karp hashes of all windows of a word sequence at once: differences of prefix sums, modulo 2**64."""

    def __init__(self, size: int, base: int = BASE):
        self.size, self.base, self.up, self.down = size, base, np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.inverse = pow(base, -1, 1 << 64)

    def windows(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if n < self.size:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            length = 1 << n.bit_length()
            powers = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(length - 1, x, np.uint64)], dtype=np.uint64)
            self.up, self.down = powers(self.base), powers(self.inverse)
        sums = np.r_[np.uint64(0), np.cumsum(hashes * self.down[:n], dtype=np.uint64)]
        return mixed((sums[self.size :] - sums[: -self.size]) * self.up[: n - self.size + 1])


def _packed(bucket: int, label: int, docs: np.ndarray, places: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> tuple:
    """A row of windows, which come ordered by document."""
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    counts = np.diff(np.r_[first, len(docs)])
    short = places.max(initial=0) < 1 << 16
    body = np.concatenate([hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7], more.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]], axis=1).tobytes()
    return bucket, label, docs[first].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), (b"\x02" if short else b"\x04") + places.astype("<u2" if short else "<u4").tobytes(), body


def _places(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.int64)


def _docs(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4"))


def _repeats(docs: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which windows a smaller document has too."""
    order = np.lexsort((docs, more, hashes))
    h, m, d = hashes[order], more[order], docs[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])]
    repeats = np.zeros(len(h), bool)
    repeats[order] = d > d[np.flatnonzero(first)][np.cumsum(first) - 1]
    return repeats


def _chunk_rows(chunk: list[tuple[int, np.ndarray, np.ndarray]], label: int, bits: int) -> Iterator[tuple]:
    docs = np.concatenate([np.full(len(h), i, np.int64) for i, h, _ in chunk])
    places = np.concatenate([np.arange(len(h)) for _, h, _ in chunk])
    hashes, more = (np.concatenate([x[k] for x in chunk]) for k in (1, 2))
    repeats = _repeats(docs, hashes, more)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    bucket[repeats] = (1 << bits) + label % (1 << bits)  # settled: passes through
    order = np.lexsort((places, docs, bucket))
    bucket, docs, places, hashes, more = bucket[order], docs[order], places[order], hashes[order], more[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        settled = bucket[lo] >= 1 << bits
        sent = slice(lo, lo if settled else hi)
        yield _packed(int(bucket[lo]), label, docs[lo:hi], places[lo:hi], hashes[sent], more[sent])


def packed_windows(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """All windows of ``docs``, packed by chunk and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rollers, chunk, total, part, number = word_hashes(), (Roller(size), Roller(size, SECOND)), [], 0, TaskContext.get().partitionId(), 0

        def batch_of() -> pa.RecordBatch:
            rows = list(_chunk_rows(chunk, (part << 24) + number, bits))
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["bucket", "label", "ids", "counts", "places", "hashes"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                words = known.of(text.split())
                found = rollers[0].windows(words)
                if len(found):
                    chunk.append((doc, found, (rollers[1].windows(words) >> np.uint64(40)).astype(np.uint32)))
                    total += len(found)
                if total >= CHUNK_WINDOWS:
                    yield batch_of()
                    chunk, total, number = [], 0, number + 1
        if chunk:
            yield batch_of()

    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED)


def _bucket(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The windows of one bucket that a smaller document has too, for each chunk."""
    if group["bucket"].iloc[0] >= 1 << bits:
        return group[["label", "ids", "counts", "places"]]
    docs = [_docs(i, c) for i, c in zip(group["ids"], group["counts"])]
    sizes = [len(d) for d in docs]
    sent = np.frombuffer(b"".join(group["hashes"]), np.uint8).reshape(-1, HASH_BYTES)
    first, second = np.zeros((len(sent), 8), np.uint8), np.zeros((len(sent), 4), np.uint8)
    first[:, :7], second[:, :3] = sent[:, :7], sent[:, 7:]
    repeats = _repeats(np.concatenate(docs), first.view("<u8").ravel(), second.view("<u4").ravel())
    out, at = [], 0
    for label, places, own in zip(group["label"], group["places"], docs):
        hit = repeats[at : at + len(own)]
        at += len(own)
        if hit.any():
            out.append(_packed(0, label, own[hit], _places(places)[hit], np.zeros(0, np.uint64), np.zeros(0, np.uint32))[1:5])
    return pd.DataFrame(out, columns=["label", "ids", "counts", "places"])


def _intervals(group: pd.DataFrame, size: int) -> pd.DataFrame:
    """Maximal runs of words under the repeated windows of a chunk's documents."""
    docs = np.concatenate([_docs(i, c) for i, c in zip(group["ids"], group["counts"])])
    places = np.concatenate([_places(p) for p in group["places"]])
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    apart = np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + size)]
    starts = np.flatnonzero(apart)
    ends = np.r_[starts[1:], len(docs)] - 1
    runs = np.stack([places[starts], places[ends] + size], axis=1).astype("<i4")
    owner = docs[starts]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
    return pd.DataFrame({"doc_id": owner[cuts[:-1]], "runs": [runs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]})


def repeated_runs(docs: DataFrame, size: int = 13) -> DataFrame:
    """``(doc_id, runs)``: the packed word intervals to remove, for documents that have any."""
    # the number of buckets follows the text, so a bucket's windows fit in a task at every size
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = max(8, math.ceil(math.log2(max(1, chars / 6 / BUCKET_WINDOWS))))
    found = packed_windows(docs, size, bits).groupBy("bucket").applyInPandas(lambda g: _bucket(g, bits), "label long, ids binary, counts binary, places binary")
    runs = found.groupBy("label").applyInPandas(lambda g: _intervals(g, size), "doc_id long, runs binary")
    # a chunk that ran twice may have met other documents in each run, so a document's runs can come in parts
    return runs.groupBy("doc_id").agg(F.collect_set("runs").alias("runs"))


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept)`` for every row of ``docs(doc_id, text)``.

    Removes each word that is covered by a window of ``size`` consecutive words whose sequence also starts in a document
    with a smaller id; windows are judged on the input. ``removed`` holds the maximal intervals (first word, end
    exclusive), ``kept`` the other words joined by one space. Null texts have no words; rows without an id lose nothing
    and take nothing from others; rows that repeat an id count as one document's; shorter documents have no window. Very
    long texts take time linear in their length. Other columns are ignored; an empty table gives an empty result.
    """
    runs = stored(repeated_runs(docs, size), "runs")
    held = runs.agg(F.coalesce(F.sum(F.aggregate("runs", F.lit(0), lambda n, r: n + F.length(r)) + 40), F.lit(0))).first()[0]
    side = F.broadcast(runs) if held <= BROADCAST_BYTES else runs
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("first", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n_words, n_removed, removed, kept = [], [], [], []
                for text, runs_ in zip(byte_values(part.column(1)), part.column(2).to_pylist()):
                    words = text.split() if text else []
                    cut: list[tuple[int, int]] = []
                    for lo, hi in sorted((lo, min(hi, len(words))) for r in runs_ or () for lo, hi in np.frombuffer(r, "<i4").reshape(-1, 2).tolist() if lo < len(words)):
                        if cut and lo <= cut[-1][1]:
                            cut[-1] = cut[-1][0], max(hi, cut[-1][1])
                        else:
                            cut.append((lo, hi))
                    left, at = [], 0
                    for lo, hi in cut:
                        left += words[at:lo]
                        at = hi
                    left += words[at:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    removed.append([{"first": lo, "end": hi} for lo, hi in cut])
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, removed array<struct<first:int,end:int>>, kept string")


def op9_rabin_karp_substring_dedup(spark, sf_dir):
    """Words of ``documents`` outside windows of 13 that a smaller document has too."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "removed")
