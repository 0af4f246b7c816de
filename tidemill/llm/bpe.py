"""BPE encoding and decoding by speculation and verification.

For the new words of a batch, greedy longest match proposes tokens, all words advancing together through one trie. A
proposal is the exact BPE result if each pair of neighbouring tokens is compatible: merging the pair's own text gives
back just that pair. All pairs are looked up at once in a sorted table, and those not met before are tested together by
merging the rows of a matrix. Only words with an incompatible pair undergo exact merging, in the same way. Words repeat,
so a memory of two generations makes the cost of a batch that of its new words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


REMEMBERED_WORDS, REMEMBERED_PAIRS = 100_000, 500_000
BATCH_CHARS = 1 << 20  # texts are encoded together up to this many characters
ROWS, WIDE = 4096, 64  # words of a matrix; longer words than WIDE bytes go alone
END = 256  # stands for the end of a word in the trie
NONE = np.int64(1) << 40  # the rank of pairs that don't merge


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory:
    """Values of keys in two generations: what is used again stays, the rest goes. Holds up to twice ``size`` keys beside a batch's."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """The keys without a value; all others are young afterwards."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        new, young, old = [], self.young, self.old.get
        for key in keys - young.keys():
            value = old(key)
            if value is None:
                new.append(key)
            else:
                young[key] = value
        return new


def spans(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(sizes)])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    to = spans(sizes)
    return flat[np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])]


class WordBPE:
    """A byte-level BPE vocabulary with a word-end suffix, as its JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ", 1)
            merges.setdefault(self.vocab[left] << 20 | self.vocab[right], (rank, self.vocab[left + right]))
        self.merges = merges
        self.merge_keys = np.array([*sorted(merges), np.iinfo(np.int64).max], np.int64)
        # of a pair of ids: the rank of its merge and the id that it makes, packed
        self.merge_made = np.array([*(merges[k][0] << 20 | merges[k][1] for k in self.merge_keys[:-1].tolist()), NONE], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes_of = [token.get(i, "").encode() for i in range(max(token) + 1)]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = byte_letters()
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)])
        self.last = np.array([self.vocab[letters[b] + self.end] for b in range(256)])
        self.load({c: b for b, c in letters.items()}, max(token) + 1)
        self.chunks, self.words = Memory(REMEMBERED_WORDS), Memory(REMEMBERED_WORDS)
        self.pairs, self.fits, self.used = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    def load(self, byte_of: dict[str, int], n: int) -> None:
        """The trie of all tokens, with the symbols of each and whether merging those gives it."""
        edges: dict[int, int] = {}
        ends = [-1]  # of each node: the token that ends there
        symbols: list[list[int]] = [[]] * n
        for t, i in self.vocab.items():
            closes = t.endswith(self.end) and len(t) > len(self.end)
            data = [byte_of[c] for c in (t[: -len(self.end)] if closes else t) if c in byte_of]
            node = 0
            for b in data + [END] * closes:
                step = edges.get(node << 9 | b)
                if step is None:
                    step = edges[node << 9 | b] = len(ends)
                    ends.append(-1)
                node = step
            ends[node] = i
            symbols[i] = [*(int(self.inner[b]) for b in data[:-1]), *((int((self.last if closes else self.inner)[data[-1]]),) if data else ())]
        self.edges = np.array([*sorted(edges), np.iinfo(np.int64).max], np.int64)
        self.nodes = np.array([*(edges[k] for k in self.edges[:-1].tolist()), 0], np.int64)
        self.ends = np.array(ends)
        self.symbol_sizes = np.array([len(x) for x in symbols])
        self.symbol_starts = spans(self.symbol_sizes)[:-1]
        self.symbols = np.array([s for x in symbols for s in x], np.int64)
        flat, sizes = self.merged(self.symbols, self.symbol_sizes)
        self.whole = (sizes == 1) & (flat[np.minimum(spans(sizes)[:-1], len(flat) - 1)] == np.arange(n))

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter (no final sigma). White space separates pieces and is in none, so it stays."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and made id of each pair, packed; NONE or more where the pair doesn't merge or an id is negative."""
        key = left << 20 | right
        at = np.searchsorted(self.merge_keys, key)
        return np.where(self.merge_keys[at] == key, self.merge_made[at], NONE)

    def merged(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many rows of ids at once: each merges its pair of lowest rank, leftmost first, until none is left."""
        starts, done = spans(sizes)[:-1], [np.zeros(0, np.int64)] * len(sizes)
        for row in np.flatnonzero(sizes > WIDE).tolist():
            done[row] = self.merged_long(flat[starts[row] : starts[row] + sizes[row]].tolist())
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= WIDE]
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            width = int(sizes[rows[-1]])
            column = np.arange(width)
            held = column[None, :] < sizes[rows][:, None]
            ids = np.where(held, flat[np.minimum(starts[rows][:, None] + column, max(len(flat) - 1, 0))], -1) if width else np.zeros((len(rows), 0), np.int64)
            found = self.ranked(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 1), NONE)
            found[(ids[:, 1:] < 0) if width > 1 else slice(None)] = NONE
            while len(rows):
                best = found.argmin(axis=1)
                each = np.arange(len(rows))
                made = found[each, best]
                over = made >= NONE
                if over.any():
                    for k in np.flatnonzero(over).tolist():
                        done[rows[k]] = ids[k][ids[k] >= 0]
                    go = ~over
                    rows, ids, found, best, made = rows[go], ids[go], found[go], best[go], made[go]
                    each = np.arange(len(rows))
                    if not len(rows):
                        break
                ids[each, best] = made & 0xFFFFF
                # drop the merged pair's right id and its rank
                width = ids.shape[1] - 1
                column = np.arange(width)[None, :]
                ids = np.take_along_axis(ids, column + (column > best[:, None]), axis=1)
                if width == 1:
                    found = np.full((len(rows), 1), NONE)
                    continue
                column = column[:, :-1]
                found = np.take_along_axis(found, column + (column >= best[:, None]), axis=1)
                for place in (best - 1, best):
                    k = np.flatnonzero((place >= 0) & (place < width - 1))
                    a, b = ids[k, place[k]], ids[k, place[k] + 1]
                    found[k, place[k]] = np.where(b < 0, NONE, self.ranked(a, np.maximum(b, 0)))
        out = np.array([len(x) for x in done], np.int64)
        return np.concatenate(done) if len(done) else np.zeros(0, np.int64), out

    def merged_long(self, ids: list[int]) -> np.ndarray:
        """The same for one long row, by a heap of (rank, place) over a linked list."""
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get(a << 20 | b))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue
            ids[k], ids[right] = get(a << 20 | b)[1], -1
            after[k] = following = after[right]
            if following >= 0:
                before[following] = k
                if m := get(ids[k] << 20 | ids[following]):
                    heapq.heappush(heap, (m[0], k, ids[k], ids[following]))
            if (k := before[k]) >= 0 and (m := get(ids[k] << 20 | ids[after[k]])):
                heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def greedy(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest tokens that match, from the left, for all words of at most WIDE bytes together; a token with the
        word-end suffix matches at the end only, one without it leaves something over."""
        starts, n = spans(sizes)[:-1], len(sizes)
        out, counts = np.full((n, int(sizes.max(initial=0)) + 1), -1), np.zeros(n, np.int64)
        data = np.append(data, 0)
        word, begin, size = np.arange(n), starts.copy(), sizes.copy()
        at, node, token, upto = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        while len(word):
            symbol = np.where(at < size, data[np.minimum(begin + at, len(data) - 1)], np.where(at == size, END, END + 1))
            key = node << 9 | symbol
            k = np.searchsorted(self.edges, key)
            found = self.edges[k] == key
            node = np.where(found, self.nodes[k], 0)
            at = np.where(found, at + 1, upto)
            ends = np.where(found, self.ends[node], -1)
            fits = (ends >= 0) & (at != size)
            stuck = np.flatnonzero(~found)
            out[word[stuck], counts[word[stuck]]] = token[stuck]
            counts[word[stuck]] += 1
            token, upto = np.where(fits, ends, token), np.where(fits, at, upto)
            over = np.zeros(len(word), bool)
            over[stuck] = upto[stuck] > size[stuck]
            if over.any():
                go = ~over
                word, begin, size, at, node, token, upto = (x[go] for x in (word, begin, size, at, node, token, upto))
        return out[out >= 0], counts

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For (left << 20 | right) pairs of ids: does exact merging of both texts together give the two tokens?"""
        distinct, back = np.unique(pairs, return_inverse=True)
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs, self.fits = self.pairs[self.used], self.fits[self.used]
            self.used = np.zeros(len(self.pairs), bool)
        at = np.searchsorted(self.pairs, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == distinct[inside]
        new = distinct[~known]
        if len(new):
            both = np.stack([new >> 20, new & 0xFFFFF], axis=1).ravel()
            sizes = self.symbol_sizes[both]
            flat, counts = self.merged(gathered(self.symbols, self.symbol_starts[both], sizes), sizes.reshape(-1, 2).sum(axis=1))
            two = np.flatnonzero(counts == 2)
            first = spans(counts)[:-1][two]
            fits = np.zeros(len(new), bool)
            fits[two] = (flat[first] << 20 | flat[first + 1]) == new[two]
            self.pairs, self.fits, self.used = (np.insert(x, at[~known], y) for x, y in ((self.pairs, new), (self.fits, fits), (self.used, False)))
            at = np.searchsorted(self.pairs, distinct)
        self.used[at] = True
        return self.fits[at][back]

    def learn(self, words: list[str]) -> None:
        """Remembers the packed ids of new words."""
        encoded = [w.encode() for w in words]
        sizes = np.array([len(x) for x in encoded])
        data = np.frombuffer(b"".join(encoded), np.uint8).astype(np.int64)
        starts = spans(sizes)[:-1]
        short = np.flatnonzero(sizes <= WIDE)
        flat, counts = self.greedy(gathered(data, starts[short], sizes[short]), sizes[short])
        owner = np.repeat(np.arange(len(short)), counts)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.zeros(len(short), bool)
        bad[owner[inside[~self.compatible(flat[inside] << 20 | flat[inside + 1])]]] = True
        first = spans(counts)[:-1]
        bad[(counts == 1) & ~self.whole[flat[first]]] = True
        again = np.concatenate([short[bad], np.flatnonzero(sizes > WIDE)])
        symbols = self.inner[data]
        symbols[starts + sizes - 1] = self.last[data[starts + sizes - 1]]
        exact, exact_counts = self.merged(gathered(symbols, starts[again], sizes[again]), sizes[again])
        good = np.flatnonzero(~bad)
        for own, ids, count in ((short[good], gathered(flat, first[good], counts[good]), counts[good]), (again, exact, exact_counts)):
            packed, cuts = ids.astype("<u4").tobytes(), (spans(count) * 4).tolist()
            self.words.young.update(zip(map(words.__getitem__, own.tolist()), (packed[a:b] for a, b in zip(cuts, cuts[1:]))))

    def plain(self, texts: list[str]) -> list[bytes]:
        """The packed ids of normalised texts without special tokens."""
        odd = any(c in t for t in texts for c in "\x1c\x1d\x1e\x1f")  # the only characters that str.split takes for white space and patterns don't
        cut = [self.pieces.findall(t) if odd else t.split() for t in texts]
        new = self.chunks.missing(set().union(*cut))
        # runs of ASCII letters are pieces as they are
        pieces = [[c] if c.isascii() and c.isalpha() else self.pieces.findall(c) for c in new]
        words = self.words.missing({w for found in pieces for w in found})
        if words:
            self.learn(words)
        word, known = self.words.young.__getitem__, self.chunks.young
        known.update(zip(new, (word(found[0]) if len(found) == 1 else b"".join(map(word, found)) for found in pieces)))
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces, owner = [], []
        for text in texts:
            parts = self.specials.split(text) if "<|" in text else [text]
            owner.append(range(len(pieces), len(pieces) + len(parts)))
            pieces += parts
        ids = self.plain(["" if p in self.special else self.normal(p) for p in pieces])
        return [b"".join(self.special[pieces[k]].to_bytes(4, "little") if pieces[k] in self.special else ids[k] for k in own) for own in owner]

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids, in UTF-8. This vocabulary's file names no decoder, so tokens are joined by spaces as they stand."""
        return b" ".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and texts of a batch of (doc_id, text), in parts of about BATCH_CHARS."""
    texts, begin, total = [t or "" for t in batch.column(1).to_pylist()], 0, 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= BATCH_CHARS or k == len(texts) - 1:
            yield batch.column(0).slice(begin, k + 1 - begin), texts[begin : k + 1]
            begin, total = k + 1, 0


@lru_cache(maxsize=4)
def vocabulary(path: str) -> WordBPE:
    return WordBPE(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` for every row of ``docs(doc_id, text)``.

    ``ids`` are the packed token ids of the whole text, ``decoded`` the text that they decode to. Null and empty
    texts have no tokens. Repeated rows get equal results; other columns are ignored; an empty table gives an empty
    result. ``path`` is the vocabulary's file, which every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for docs_, texts in parts(batch):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([docs_, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of the ids and the text, so that neither leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for docs_, texts in parts(batch):
                ids = bpe.encode(texts)
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                yield pa.RecordBatch.from_arrays([docs_, pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(map(bpe.decode, ids))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_speculative_bpe(spark, sf_dir):
    """Token counts and digests of ids and decoded text for every document."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
