"""MinHash near-duplicates with odd sketches.

Each document gets 128 MinHash samples of its distinct word shingles. They serve twice: in 32 bands of 4 as bucket
keys, and folded into an odd sketch, a parity bitmap of 256 bits. The population count of two sketches' XOR estimates
a high similarity precisely, so most pairs that share a bucket by chance are dropped before any text is fetched. What
is left is confirmed on the full shingle sets.

The work stays linear in a group's size wherever the links allow it:

1. documents with equal shingle sets collapse to one representative (the smallest id);
2. in each bucket every member is compared with the bucket's centre only (the member that shares most buckets);
3. buckets whose members still lie in different components are compared in blocks of bounded size, all pairs across
   components, so no link is lost; each block passes on a tie per document, never all its pairs. Sketches and texts are
   packed into their block once, and only whole blocks are paired, so rows grow with a group's size over thousands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.words import byte_values, mixed, shingles, word_hashes
from tidemill.llm.components import connected_components
from tidemill.plans.stored import small_side, stored

SAMPLES, ROWS_PER_BAND, SKETCH_BITS = 128, 4, 256
FEW = 8  # members of a bucket whose pairs are tested in place
BLOCK = 256  # documents that one task compares with a centre
SKETCHES = 4096  # sketches of a block
TEXTS, SHINGLES = 1024, 1 << 21  # texts of a block, and shingles that they have together
COLUMNS = 1024  # shingles that a block compares at a time
STRIPE = 256  # rows of a matrix of pairs that are worked on at a time
HOT = 2000  # classes of copies with more than this part of all documents are joined by broadcast: there are fewer than so many

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def minhash(values: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set of 64-bit hashes."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        part = _MULTIPLY[:, None] * low[None, start : start + 2048]
        part += _ADD[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def bands(samples: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    rows = samples.reshape(-1, ROWS_PER_BAND).astype(np.uint64)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS_PER_BAND):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as four 64-bit words: each sample flips the bit that it hashes to."""
    at = mixed((np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) | samples.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """XOR bits that pairs of this similarity show at most: what they show on average when the MinHash estimate is five standard
    deviations low, and two deviations of the sketch (of a fair bit each, which is more than it has) on top."""
    part = 1 - similarity
    flips = 2 * SAMPLES * part
    wide = flips + 5 * 2 * np.sqrt(SAMPLES * part * (1 - part))
    bits = SKETCH_BITS / 2 * (1 - np.exp(-2 * wide / SKETCH_BITS))
    return min(SKETCH_BITS // 2, int(np.ceil(bits + 2 * np.sqrt(SKETCH_BITS) / 2)))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, key, bands, s0..s3)``; ``key`` is a digest of the whole set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = []
                for text in byte_values(part.column(1)):
                    found = shingles(known.of(text.lower().split()) if text else np.zeros(0, np.uint64), words)
                    if not len(found):
                        rows.append((0, None, None, None, None, None, None))
                        continue
                    samples = minhash(found)
                    first, second = mixed(found).sum(dtype=np.uint64), mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    sketch = odd_sketch(samples)
                    rows.append((len(found), f"{first:016x}{second:016x}{len(found):x}", bands(samples), *sketch.tolist()))
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], ["doc_id", "n_shingles", "key", "bands", "s0", "s1", "s2", "s3"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key string, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The compressed texts of the given documents, ``(rep, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(x or b"") for x in byte_values(batch.column(1))], pa.binary())], ["rep", "text"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(ids.select(F.col("rep").alias("doc_id")), 24), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "rep long, text binary").dropDuplicates(["rep"])


def connected(links: np.ndarray) -> np.ndarray:
    """For a symmetric link matrix: ``(k, 2)`` pairs that tie every linked row to its component's first."""
    rows = np.flatnonzero(links.any(axis=1))
    links = links[np.ix_(rows, rows)]
    label = np.arange(len(rows), dtype=np.int32)
    while len(rows):
        least = label.copy()
        for at in range(0, len(rows), STRIPE):
            part = slice(at, at + STRIPE)
            np.minimum(least[part], np.where(links[part], label[None, :], np.int32(len(rows))).min(axis=1), out=least[part])
        least = least[least]
        if (least == label).all():
            break
        label = least
    tied = label != np.arange(len(rows))
    return np.stack([rows[tied], rows[label[tied]]], axis=1)


def sketch_links(bits: np.ndarray, component: np.ndarray, limit: int) -> np.ndarray:
    """Pairs that tie together rows of different components whose sketches differ in at most ``limit`` bits."""
    links = np.zeros((len(bits), len(bits)), bool)
    for at in range(0, len(bits), STRIPE):
        part = slice(at, at + STRIPE)
        apart = np.zeros((len(bits[part]), len(bits)), np.int16)
        for word in bits.T:
            apart += np.bitwise_count(word[part, None] ^ word[None, :])
        links[part] = (apart <= limit) & (component[part, None] != component[None, :])
    return connected(links)


def block_links(sets: list[np.ndarray], components: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that tie together documents of different components that are linked, on full sets: all pairs of one side if there
    is one, else those between the two."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.r_[True, every[1:] != every[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one document adds nothing to an intersection
    column, owner = column[shared], owner[shared]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() and not side.all() else (np.arange(n),) * 2
    common = np.zeros((len(left), len(right)), np.float32)
    if len(column):
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
        cuts = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                present = np.zeros((n, COLUMNS), np.float32)
                present[owner[lo:hi], column[lo:hi] - column[lo] // COLUMNS * COLUMNS] = 1
                common += present[left] @ present[right].T
    links = np.zeros((n, n), bool)
    for at in range(0, len(left), STRIPE):
        rows = left[at : at + STRIPE]
        part = common[at : at + STRIPE]
        links[np.ix_(rows, right)] = (100 * part >= percent * (sizes[rows][:, None] + sizes[right][None, :] - part)) & (components[rows][:, None] != components[right][None, :])
    return connected(links | links.T)


def _sets(texts, words: int) -> list[np.ndarray]:
    known = word_hashes()
    press = zstandard.ZstdDecompressor()
    return [shingles(known.of(press.decompress(t).lower().split()), words) for t in texts]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Documents are linked when ``100 * |A and B| >= percent * |A or B|`` for their sets of distinct ``words``-word
    shingles of the whole lower-cased text; ``component_id`` is the smallest id that a document reaches over links, and
    ``kept`` marks the documents that are their own component's smallest. Null and blank texts have no shingles and are
    linked with nothing. Rows without an id are kept, with a null component. Rows that repeat an id count as one
    document. Other columns are ignored; an empty table gives an empty result.
    """
    limit = most_differing_bits(percent / 100)
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    signed = stored(signatures(docs, words), "signatures")
    filled = signed.filter("key is not null and doc_id is not null")
    classes = filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # the columns of the representative come along as an aggregate: no second pass over the class
    reps = stored(filled.groupBy("key").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "s0", "s1", "s2", "s3"), "doc_id").alias("r")).select("r.*").withColumnRenamed("doc_id", "rep"), "reps")

    # 1. buckets with more than one representative
    placed = reps.select("rep", F.explode("bands").alias("bucket"))
    full = stored(placed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "full")
    members = stored(placed.join(small_side(full, 32), "bucket"), "members")
    degree = members.groupBy("rep").agg(F.sum("members").alias("degree"))
    seen = stored(degree.join(reps.drop("bands"), "rep"), "seen")
    texts = stored(packed_texts(docs, seen), "texts")

    # 2. every member against the centre of its bucket
    ranked = members.join(seen, "rep")
    sketch = ["s0", "s1", "s2", "s3"]
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("least"), *sketch)).alias("c")).select("bucket", (-F.col("c.least")).alias("centre"), *(F.col(f"c.{s}").alias(f"c{s}") for s in sketch))
    differing = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"c{s}"))) for s in sketch[1:]), F.bit_count(F.col("s0").bitwiseXOR(F.col("cs0"))))
    pairs = stored(ranked.join(centres, "bucket").filter((F.col("rep") != F.col("centre")) & (differing <= limit)).select("rep", "centre").distinct(), "pairs")
    shares = pairs.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    dealt = pairs.join(shares, "centre").select("rep", "centre", F.pmod(F.xxhash64("rep"), "shares").alias("share"))
    dealt = dealt.union(shares.select(F.col("centre").alias("rep"), "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")))

    def to_centre(group: pd.DataFrame) -> pd.DataFrame:
        sets = _sets(group["text"], words)
        ids, centre = group["rep"].to_numpy(), group["centre"].iloc[0]
        middle = sets[int(np.flatnonzero(ids == centre)[0])]
        found = []
        for i, s in zip(ids, sets):
            common = len(np.intersect1d(s, middle, assume_unique=True))
            if i != centre and 100 * common >= percent * (len(s) + len(middle) - common):
                found.append(i)
        return pd.DataFrame({"a": np.array(found, np.int64), "b": np.full(len(found), centre, np.int64)})

    stars = stored(dealt.join(texts, "rep").groupBy("centre", "share").applyInPandas(to_centre, "a long, b long"), "stars")
    joined = connected_components(stars)

    # 3. what shares a bucket across components: sketches first, in blocks
    placed = stored(members.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "members", F.coalesce("component", "rep").alias("component")), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    parts = stored(placed.join(open_, "bucket").join(seen.select("rep", *sketch), "rep"), "open")
    # most buckets hold a few: their pairs are tested in place, and only those pass on that the sketches let through
    few = parts.filter(F.col("members") <= FEW).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("rep", "component", *sketch))).alias("m")).select("m").distinct()
    bits = lambda x, y: sum((F.bit_count(x[c].bitwiseXOR(y[c])) for c in sketch[1:]), F.bit_count(x["s0"].bitwiseXOR(y["s0"])))
    few = few.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: (y["rep"] > F.col("x.rep")) & (y["component"] != F.col("x.component")) & (bits(F.col("x"), y) <= limit))).alias("y"))
    few = few.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    # larger ones are packed into blocks; only blocks are paired, so their number is that of the bucket over SKETCHES
    parts = parts.filter(F.col("members") > FEW).withColumn("parts", F.ceil(F.col("members") / SKETCHES))
    packed = parts.groupBy("bucket", "parts", F.pmod(F.xxhash64("rep"), "parts").alias("part")).agg(F.collect_list(F.struct("rep", "component", *sketch)).alias("m"))
    cells = packed.withColumn("other", F.explode(up_to("parts"))).select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "m")

    def by_sketch(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((r["rep"], r["component"], *(r[c] for c in sketch)) for m in group["m"] for r in m)  # so that a bucket's ties are to its smallest, and those of other bands repeat them
        rows = np.array(rows, np.int64)
        found = sketch_links(rows[:, 2:].view(np.uint64), rows[:, 1], limit)
        return pd.DataFrame({"a": rows[found[:, 0], 0], "b": rows[found[:, 1], 0]})

    likely = stored(cells.groupBy("bucket", "i", "j").applyInPandas(by_sketch, "a long, b long").union(few).distinct(), "likely")
    groups = connected_components(likely)

    # 4. all pairs of each such group across components, on full sets: blocks of like size, as sets that differ more than
    #    percent in size can't be linked
    step = np.log(100 / percent)
    sized = groups.select(F.col("id").alias("rep"), F.col("component").alias("grp")).join(seen.select("rep", "n_shingles"), "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    sized = sized.select("rep", "grp", F.coalesce("component", "rep").alias("component"), F.floor(F.log(F.col("n_shingles").cast("double")) / step).cast("long").alias("sized"), "n_shingles")
    sized = stored(sized, "sized")
    counts = sized.groupBy("grp", "sized").agg(F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum("n_shingles") / SHINGLES)).alias("parts"))
    near = [counts.select("grp", (F.col("sized") + d).alias("sized"), F.col("parts").alias(n)) for d, n in ((0, "own"), (-1, "above"), (1, "below"))]
    packed = sized.join(near[0], ["grp", "sized"]).join(texts, "rep").groupBy("grp", "sized", "own", F.pmod(F.xxhash64("rep"), "own").alias("part")).agg(F.collect_list(F.struct("rep", "component", "text")).alias("m"))
    packed = packed.join(near[1], ["grp", "sized"], "left").join(near[2], ["grp", "sized"], "left")
    cell = lambda lo, hi, i, j, side: F.struct(lo.alias("lo"), hi.alias("hi"), i.alias("i"), j.alias("j"), side.alias("side"))
    same = F.transform(up_to("own"), lambda x: cell(F.col("sized"), F.col("sized"), F.least(F.col("part"), x), F.greatest(F.col("part"), x), (F.col("part") > x).cast("int")))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint,i:bigint,j:bigint,side:int>>")
    above = F.when(F.col("above").isNotNull(), F.transform(up_to("above"), lambda x: cell(F.col("sized"), F.col("sized") + 1, F.col("part"), x, F.lit(0))))
    below = F.when(F.col("below").isNotNull(), F.transform(up_to("below"), lambda x: cell(F.col("sized") - 1, F.col("sized"), x, F.col("part"), F.lit(1))))
    paired = packed.withColumn("cell", F.explode(F.concat(same, F.coalesce(above, none), F.coalesce(below, none)))).select("grp", "cell.*", "m")

    def by_set(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(r["rep"], r["component"], side, r["text"]) for side, m in zip(group["side"], group["m"]) for r in m]
        ids, component, side = (np.array(x) for x in list(zip(*rows))[:3])
        if (component == component[0]).all():
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        found = block_links(_sets([r[3] for r in rows], words), component, side, percent)
        return pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    rest = paired.groupBy("grp", "lo", "hi", "i", "j").applyInPandas(by_set, "a long, b long")
    ends = connected_components(stars.union(rest))

    # few classes have a large part of all documents: those are broadcast, so no task gets all copies of a text
    named = stored(classes.join(ends.withColumnRenamed("id", "rep"), "rep", "left").select("key", "copies", F.coalesce("component", "rep").alias("component_id")), "named")
    large = named.filter(F.col("copies") * HOT > signed.count())
    slim = signed.select("doc_id", "n_shingles", "key")
    met = slim.filter("key is not null").join(F.broadcast(large.select("key", F.col("component_id").alias("met"))), "key", "left")
    rest = met.filter("met is null").drop("met").join(named.select("key", "component_id"), "key", "left").select("doc_id", "n_shingles", "component_id")
    out = rest.union(met.filter("met is not null").select("doc_id", "n_shingles", "met")).union(slim.filter("key is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_odd_sketch_near_dedup(spark, sf_dir):
    """Near-duplicate components of ``documents`` on distinct four-word shingles, as this query's contract has them."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
