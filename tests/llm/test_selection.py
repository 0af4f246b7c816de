"""Hard negatives, packing and prefix tries against plain loops, with odd rows, small blocks and empty tables."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import hard_negatives, packing, prefix_trie

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def many_parts(spark):
    """Tasks are not merged, so ranges have borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- hard negatives


def plain_negatives(rows, every=50):
    ok = {}
    for i, v, label, *_ in sorted(((r[0], r[1], r[2]) for r in rows if None not in r[:3]), key=str):
        if all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            e = [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]
            ok[i] = min(ok.get(i, (label, v, e)), (label, v, e))
    out = set()
    for a, (label, _, e) in ok.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(e, f)), i, lab == label) for i, (lab, _, f) in ok.items() if i != a and len(f) == len(e)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(n, i) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s]
            out |= {(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit[:3])}
    return out


VECTORS = "vec_id long, embedding array<double>, label int, score long, dim int, pack string"


def test_hard_negatives_of_odd_rows(spark, monkeypatch, many_parts):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=8) * 0.4).tolist(), int(i % 5), 1, 2, "x") for i in range(700)]
    rows += [(i, rows[i - 1000][1], 3, 1, 2, "x") for i in range(1000, 1040)] + rows[:60]  # ties, and repeated rows
    rows += [(2000, [1.0] * 3, 1, None, None, None), (2001, [2.0] * 3, 2, 0, 0, ""), (2002, [2.5] * 3, 1, 0, 0, ""), (2100, [], 1, 0, 0, ""), (2101, [], 1, 0, 0, ""), (2102, [], 2, 0, 0, "")]
    rows += [(2150, [0.0] * 8, 1, 0, 0, ""), (None, [1.0] * 8, 1, 0, 0, ""), (2200, None, 1, 0, 0, ""), (2250, [1.0] * 7 + [None], 1, 0, 0, ""), (2300, [math.inf] * 8, 1, 0, 0, ""), (2350, [1.0] * 8, None, 0, 0, ""), (50, rows[51][1], 9, 0, 0, "")]
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 3)
    frame = spark.createDataFrame(rows, VECTORS)
    want = plain_negatives(rows)
    for bound in (1 << 24, 0):  # blocks broadcast, and dealt to groups of buckets
        monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", bound)
        got = [tuple(r) for r in hard_negatives.hard_negatives(frame).collect()]
        assert len(got) == len(want) and set(got) == want
    assert hard_negatives.hard_negatives(frame.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = [float(1 << 22) + k for k in range(4)]
    rows = [(0, [big[0], 1.0], 0), (1, [big[1], 1.0], 1), (2, [big[0] * 0.75 + 3, 5.0], 2), (3, [big[0] * 0.75 + 3, 4.0], 2), (4, [1e200, 0.0], 2), (8, [-1e305, 1.0], 3)]
    got = {tuple(r)[:4] for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {x[:4] for x in plain_negatives(rows)} and {x[3] for x in got} == {2, 3}


def test_pruning_keeps_all_that_can_reach_the_score():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 6))
    v *= rng.uniform(2, 2.2, 500)[:, None] / np.sqrt((v * v).sum(1, keepdims=True))  # similar lengths, as in a bucket
    bucket = hard_negatives.Bucket(1, np.arange(500), v)
    pruned = 0
    for anchor in hard_negatives.whole_numbers(rng.normal(size=(40, 6))):
        length = float(hard_negatives.lengths(anchor[None, :])[0])
        for least in (1, 100_000, 200_000, 300_000):
            rows = bucket.candidates(anchor, length, least)
            assert set(np.flatnonzero(bucket.v @ anchor >= least)) <= set(rows.tolist())
            pruned += 500 - len(rows)
    assert pruned > 40 * 4 * 500 // 4


# ---- packing


def check_pieces(rows, texts, window, slack=packing.SLACK):
    """The pieces hold every id once, and fill sequences without gaps; returns the padding."""
    t = Tokenizer.from_file(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and bytes(p["ids"]) == ids[at : at + p["length"]].tobytes() and p["doc_tokens"] == len(ids) and p["length"] > 0
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        assert at & (at - 1) == 0 or window - at <= slack
    return padding


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    padding = check_pieces(packing.pack(docs, JSON, RANKS).collect(), texts, 2048)
    assert padding < 0.002 * sum(map(len, filter(None, texts.values()))) / 4
    digest = packing.op12_least_squares_packing(spark, sf)
    assert digest.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    r = digest.filter("start = 0").first()
    ids = [*Tokenizer.from_file(JSON).encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1][: r["length"]]
    assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_of_odd_rows(spark, many_parts):
    texts = {1: None, 2: "", 3: "<|endoftext|> in a text<|endoftext|>", 4: " " * 200_000 + "x", 5: "word " * 9000, 6: "é ①Ⅷ 日本語🙂 İ ß\u0000\x1c don't I'LL", 7: "a" * 30_000, None: "no id", -8: "\n\n\t \r\n  x  "} | {100 + i: "same text, many times" for i in range(300)}
    frame = spark.createDataFrame([(i, t, 5, "x", 0) for i, t in texts.items()], "doc_id long, text string, tail int, block string, length long")
    for window in (2048, 64):
        check_pieces(packing.pack(frame, JSON, RANKS, window).collect(), texts, window)
    twice = frame.filter("doc_id = 5").union(frame.filter("doc_id = 5"))
    assert sum(r["length"] for r in packing.pack(twice, JSON, RANKS).collect()) == 2 * len(packing.encoder(JSON, RANKS).ids(texts[5]))
    assert packing.pack(frame.limit(0), JSON, RANKS).count() == 0


def test_least_squares_use_up_a_histogram_that_fits():
    """Counts that combinations can use up exactly are used up."""
    lengths = np.array([20, 30, 34, 40, 44, 64])
    combos = packing.combinations(64, lengths)
    assert all(sum(c) == 64 for c in combos.tolist()) and [64, 0, 0] in combos.tolist()
    histogram = np.zeros(65)
    for c, n in zip(combos.tolist(), (500, 300, 200, 100)):
        for x in c:
            histogram[x] += n
    histogram[0] = 0
    used = np.bincount(combos.ravel(), np.repeat(packing.repeat_counts(combos, histogram), 3), 65)
    assert np.abs(used - histogram)[1:].max() < 10


def test_every_rank_has_its_place():
    rng = np.random.default_rng(2)
    for _ in range(12):
        histogram = rng.integers(0, rng.integers(2, 60), 64)
        histogram[0] = 0
        plan = packing.Plan(histogram, 64, 2)
        filled = defaultdict(set)
        for length in range(1, 64):
            for rank in range(histogram[length]):
                for _, n, sequence, offset in plan.pieces(length, rank):
                    here = set(range(offset, offset + n))
                    assert not here & filled[sequence] and offset + n <= 64
                    filled[sequence] |= here
        assert set(filled) == set(range(plan.sequences)) and all(s == set(range(len(s))) for s in filled.values())
        assert all(len(s) >= 62 or len(s) & (len(s) - 1) == 0 for s in filled.values())


# ---- prefix tries


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, (role + "\0" + text)[:64], hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    order = {c: [x[4:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in order:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = order.get(c - int(math.fmod(c, 5)), [])[:h] + order[c][h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn int, role string, text string, pos long, key string, path string"


def odd_conversations():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(120):
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {rng.integers(0, 3)}"))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 290) for t in range(12)]  # many copies
    rows += [(300, t, "user", f"long {t}") for t in range(700)] + [(305, t, "user", f"long {t}") for t in range(650)] + [(310, t, "user", f"long {t if t < 600 else -t}") for t in range(700)]
    rows += [(400, None, None, None), (400, None, "user", None), (400, 1, None, "x"), (401, 5, "user", "ß🙂" * 40_000), (402, 1, "user", "tie b"), (402, 1, "user", "tie a"), (402, 1, "user", "tie a"), (None, 1, "user", "lost"), (-7, 1, "user", "below"), (-5, 1, "user", "zero")]
    return rows


@pytest.mark.parametrize("segment,block", [(1024, 1 << 14), (64, 5), (3, 7)])
def test_prefix_tries(spark, monkeypatch, many_parts, segment, block):
    rows = odd_conversations()
    if segment == 3:
        rows = [r for r in rows if r[0] is None or r[0] < 300 or r[0] >= 400]
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    frame = spark.createDataFrame([(*r, 1, "k", "p") for r in rows], TURNS).repartition(5)
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame).collect()]
    want = plain_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_tree_layouts_grow():
    """All layouts, forks in paths, and keys that are prefixes of others."""
    rng = np.random.default_rng(5)
    keys = sorted({bytes([a, *rng.integers(0, 3, int(rng.integers(0, 5)))]) for a in range(256) for _ in range(6)} | {b""})
    tree = prefix_trie.RadixTree()
    for k in rng.permutation(len(keys)).tolist():
        tree.insert(keys[k], k)
    assert isinstance(tree.top.kids, prefix_trie.Direct)
    found, stack = [], [(tree.top, b"")]
    while stack:
        node, before = stack.pop()
        assert len(node.kids.all()) >= (2 if node.row < 0 else 1) if node.kids else node.row >= 0
        if node.row >= 0:
            found.append((before + node.path, node.row))
        stack += [(kid, before + node.path) for kid in (node.kids.all() if node.kids else [])]
    assert sorted(found) == [(key, k) for k, key in enumerate(keys)]
    layout, kinds = prefix_trie.Sorted(), set()
    for label in range(200):
        layout = layout.put(label, label)
        kinds.add((type(layout).__name__, getattr(layout, "room", 0)))
        assert layout.all() == list(range(label + 1)) and layout.get(label) == label and layout.get(label + 1) is None
    assert kinds == {("Sorted", 4), ("Sorted", 16), ("Indexed", 0), ("Direct", 0)}
