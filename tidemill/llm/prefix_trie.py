"""The trie of conversation prefixes, by adaptive radix trees over fixed-width turn ids.

A turn (role and text) becomes a 16-byte big-endian id, so a conversation is a byte string and a prefix of whole turns a
prefix of whole ids. Distinct strings are sorted by ranges and packed into blocks; each block builds one radix tree,
whose node layouts grow with their children and whose paths are compressed, and emits a node at every depth that lies
on a turn's edge. Only nodes on the border between two blocks are met twice; their sums are partial and are added up
afterwards. Very long conversations are cut into layers of SEGMENT turns, each a trie below the nodes of the layer above.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.stored import small_side, stored

WIDTH = 16  # bytes of a turn id
SEGMENT = 1024  # turns of a key; longer conversations go on in the next layer
BLOCK_BYTES, BLOCK_ROWS = 1 << 22, 1 << 14  # of the keys that share a radix tree
CHUNK = 1 << 13  # ids in a chunk of a list of members
TOP = 8  # turns that a conversation takes over at most, as it takes hash modulo 9
NO_ROOT = bytes(WIDTH)


class Sorted:
    """A layout of up to 4, then 16 children beside their sorted labels."""

    __slots__ = ("labels", "kids", "room")

    def __init__(self):
        self.labels, self.kids, self.room = bytearray(), [], 4

    def get(self, label: int):
        at = self.labels.find(label)
        return self.kids[at] if at >= 0 else None

    def put(self, label: int, kid):
        """The layout with the child, a roomier one where this is full."""
        at = bisect_left(self.labels, label)
        if at < len(self.labels) and self.labels[at] == label:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.room:
            if self.room == 16:
                return Indexed(zip(self.labels, self.kids)).put(label, kid)
            self.room = 16
        self.labels.insert(at, label)
        self.kids.insert(at, kid)
        return self

    def all(self) -> list:
        return self.kids


class Indexed:
    """A layout of up to 48 children behind an index of 256 bytes."""

    __slots__ = ("index", "kids")

    def __init__(self, found):
        self.index, self.kids = bytearray(256), []
        for label, kid in found:
            self.put(label, kid)

    def get(self, label: int):
        at = self.index[label]
        return self.kids[at - 1] if at else None

    def put(self, label: int, kid):
        if at := self.index[label]:
            self.kids[at - 1] = kid
            return self
        if len(self.kids) == 48:
            full = Direct()
            for k in range(256):
                if self.index[k]:
                    full.put(k, self.kids[self.index[k] - 1])
            return full.put(label, kid)
        self.kids.append(kid)
        self.index[label] = len(self.kids)
        return self

    def all(self) -> list:
        return [self.kids[at - 1] for at in self.index if at]


class Direct:
    """A layout with a place for each of 256 labels."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, label: int):
        return self.kids[label]

    def put(self, label: int, kid):
        self.kids[label] = kid
        return self

    def all(self) -> list:
        return [k for k in self.kids if k is not None]


class Node:
    """A compressed path and what comes after it; ``row`` is the key that ends here, or -1."""

    __slots__ = ("path", "kids", "row", "n", "first", "leaves", "saved", "children", "low", "high")

    def __init__(self, path: bytes, row: int = -1):
        self.path, self.row, self.kids = path, row, None

    def put(self, kid: "Node") -> None:
        self.kids = (self.kids or Sorted()).put(kid.path[0], kid)


def shared(a: bytes, b: bytes) -> int:
    """How many leading bytes two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - 1 - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() - 1) // 8


class RadixTree:
    def __init__(self):
        self.top = Node(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, at = self.top, 0
        while at < len(key):
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                node.put(Node(key[at:], row))
                return
            if key.startswith(kid.path, at):
                node, at = kid, at + len(kid.path)
                continue
            common = shared(kid.path, key[at : at + len(kid.path)])
            fork = Node(kid.path[:common])
            kid.path = kid.path[common:]
            fork.put(kid)
            node.put(fork)
            node, at = fork, at + common
        node.row = row


def emitted(rows: dict[str, list], before: int, after: int, continued: bool) -> Iterator[tuple]:
    """The nodes of a block of sorted distinct keys: (units, conv_id, parent, n, children, leaves, saved, ends, own id, parent's id).

    ``before`` and ``after`` are how many units its first and last key share with the block before and after; nodes on those
    paths get an own id and hold partial sums: what is distinct (children, text bytes saved once) counts where it comes
    first. ``continued``: the next block goes on below the last key.
    """
    keys, counts, firsts, sizes, ends = rows["key"], rows["n"], rows["first"], rows["sizes"], rows["ends"]
    last = len(keys) - 1
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    # children before parents
    order: list[tuple[Node, int]] = []
    stack = [(tree.top, 0)]
    while stack:
        node, at = stack.pop()
        order.append((node, at))
        if node.kids:
            stack += [(kid, at + len(node.path)) for kid in node.kids.all()]
    for node, start in reversed(order):
        kids = node.kids.all() if node.kids else []
        n, first, leaves, saved, children = 0, None, 0, 0, 0
        low, high = len(keys), -1
        if node.row >= 0:
            r = node.row
            n, first, low, high = counts[r], firsts[r], r, r
            if rows["more"][r]:
                leaves, saved, children = rows["more_leaves"][r], rows["more_saved"][r], rows["more"][r]
            elif not kids and not (r == last and continued):
                leaves = 1
        for kid in kids:
            n, leaves, saved, children = n + kid.n, leaves + kid.leaves, saved + kid.saved, children + kid.children
            first = kid.first if first is None else min(first, kid.first)
            low, high = min(low, kid.low), max(high, kid.high)
        end = start + len(node.path)
        edge = end // WIDTH
        here = children  # of the deepest node on this path; those above have one child
        for unit in range(edge, start // WIDTH, -1):
            size, again = (sizes[low][unit - 2] if unit > 1 else 0), low == 0 and unit <= before
            saved += n * size - (0 if again else size)
            here = 0 if again else 1
        node.n, node.first, node.leaves, node.saved, node.low, node.high = n, first, leaves, saved, low, high
        node.children = here if edge > start // WIDTH else children
        # for the second walk: the sums at the path's end
        node.path = (len(node.path), children)
    parents: list[tuple[Node, int, int | None, bytes | None]] = [(tree.top, 0, None, None)]
    while parents:
        node, start, parent, parent_id = parents.pop()
        length, children = node.path
        edge, low = (start + length) // WIDTH, node.low
        border = lambda unit: (low == 0 and unit <= before) or (node.high == last and unit <= after)  # noqa: B023, E731
        saved = node.saved
        for unit in range(start // WIDTH + 1, edge + 1):
            size, again = (sizes[low][unit - 2] if unit > 1 else 0), low == 0 and unit <= before
            at_end = unit == edge
            kids = children if at_end else int(not (low == 0 and unit + 1 <= before))
            own = hashlib.md5(keys[low][: unit * WIDTH]).digest() if border(unit) else None
            ended = ends[node.row] if at_end and node.row >= 0 and (start + length) % WIDTH == 0 else None
            yield unit, node.first, parent if unit > 2 else (rows["root_first"][low] if unit == 2 and rows["root_first"][low] is not None else parent), node.n, kids, node.leaves, saved, ended, own, parent_id, keys[low][:WIDTH]
            saved -= node.n * size - (0 if again else size)
            parent, parent_id = node.first, own
        if node.kids:
            parents += [(kid, start + length, parent, parent_id) for kid in node.kids.all()]


def positions(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, id, size)``: the place of each turn in its conversation, counted across tasks, so no conversation has to fit one.

    Rows are sorted by ranges of (conversation, turn, content); a task counts from its first row, and the few conversations
    that go on from one task to the next are set forward by what came before.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(F.concat(role, F.lit("\0"), text), 1, 64).alias("start"), digest.alias("id"), F.octet_length(text).cast("int").alias("size")
    )
    # equal rows may stand in any order, so a number of the row can part them
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("start"), F.col("id"), F.col("row")]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                at = at + 1 if conv == held else 0
                held = conv
                places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), batch.column(0), pa.array(places, pa.int64()), batch.column(1), batch.column(2)], ["part", "conv_id", "pos", "id", "size"])

    placed = stored(ranged.select("conv_id", "id", "size").mapInArrow(run, "part int, conv_id long, pos long, id string, size int"), "turns")
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("conv_id"), F.max("conv_id").alias("later"))
    whole = edges.select("part", "conv_id").union(edges.select("part", "later")).distinct()  # two conversations of each task
    held = placed.groupBy("part", "conv_id").agg(F.count("*").alias("n")).join(F.broadcast(stored(whole, "edges")) if edges.count() < 100_000 else whole, ["part", "conv_id"], "left_semi")
    shift = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    shifts = stored(held.select("part", "conv_id", shift.alias("shift")).filter("shift > 0"), "shifts")
    return placed.join(small_side(shifts, 32), ["part", "conv_id"], "left").select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "id", "size")


def taken(conv: Column) -> Column:
    """How many turns a conversation takes over from the first of its five."""
    return F.crc32(conv.cast("string").cast("binary")) % (TOP + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, id, size)`` of the rebuilt conversations, and ``(conv_id, n)``: all of them with their lengths."""
    placed = stored(positions(turns), "placed")
    lengths = stored(placed.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")), "lengths")
    base = F.col("conv_id") - F.col("conv_id") % 5
    known = lengths.select("conv_id", base.alias("base"), taken(F.col("conv_id")).alias("h"), "n")
    bases = lengths.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = known.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = stored(known.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "known")
    heads = placed.filter((F.col("pos") < TOP) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base").join(known.filter("head > 0").select("conv_id", "base", "head"), "base").filter("pos < head")
    # own turns move only where the first of the five is shorter than what would be taken over
    moved = stored(known.filter("head < h").select("conv_id", (F.col("head") - F.col("h")).alias("move")), "moved")
    own = placed.filter(F.col("pos") >= taken(F.col("conv_id"))).join(small_side(moved, 24), "conv_id", "left").withColumn("pos", F.col("pos") + F.coalesce("move", F.lit(0)))
    columns = ["conv_id", "pos", "id", "size"]
    return heads.select(columns).unionByName(own.select(columns)), known.select("conv_id", "n")


def as_bytes(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def segments(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(layer, root, path, key, sizes, conv_id, ended)``: at most SEGMENT turns of a conversation. ``root`` stands for all turns
    before them, ``path`` for those and them."""
    layer = F.floor(F.col("pos") / SEGMENT).cast("int")
    cut = turns.groupBy("conv_id", layer.alias("layer")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("t"))
    cut = cut.select("conv_id", "layer", F.array_join(F.transform("t", lambda x: x["id"]), "").alias("hex"), F.transform("t", lambda x: x["size"]).alias("sizes"))
    none = lengths.filter("n = 0").select("conv_id", F.lit(0).alias("layer"), F.lit("").alias("hex"), F.array().cast("array<int>").alias("sizes"))
    cut = cut.unionByName(none).join(lengths, "conv_id").withColumn("ended", F.col("layer") == F.greatest(F.floor((F.col("n") - 1) / SEGMENT), F.lit(0)))
    # sets of hashes with their layers inside stand for sequences, so that a running sum tells what came before
    cut = cut.withColumns({"a": F.xxhash64("layer", "hex"), "b": F.xxhash64("hex", "layer", F.lit("b"))})
    cut = stored(cut.select("conv_id", "layer", "n", F.unhex("hex").alias("key"), "sizes", "ended", "a", "b"), "segments")
    so_far = Window.partitionBy("conv_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = cut.filter(F.col("n") > SEGMENT).withColumns({"pa": F.bit_xor("a").over(so_far), "pb": F.bit_xor("b").over(so_far)})
    long = long.withColumns({"ra": F.col("pa").bitwiseXOR(F.col("a")), "rb": F.col("pb").bitwiseXOR(F.col("b"))})
    short = cut.filter(F.col("n") <= SEGMENT).withColumns({"pa": F.col("a"), "pb": F.col("b"), "ra": F.lit(0).cast("long"), "rb": F.lit(0).cast("long")})
    columns = ["layer", F.concat(as_bytes(F.col("ra")), as_bytes(F.col("rb"))).alias("root"), F.concat(as_bytes(F.col("pa")), as_bytes(F.col("pb"))).alias("path"), "key", "sizes", "conv_id", "ended"]
    return short.select(columns).unionByName(long.select(columns))


def member_hashes(members: DataFrame) -> DataFrame:
    """``(path, ends)``: the hex SHA-256 of the ascending ids of ``members(path, conv_id)``, comma-joined.

    Tasks of a range sort join their ids to chunks of text, whatever the size of a group; one stream a group then hashes chunks.
    """
    ranged = members.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        path, held = None, []
        out: list[tuple] = []
        for batch in batches:
            for p, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != path or len(held) == CHUNK:
                    if held:
                        out.append((path, part, number, ",".join(held)))
                        number += 1
                    path, held = p, []
                held.append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.int64(), pa.string()))], ["path", "part", "number", "ids"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, part, number, ",".join(held)), (pa.binary(), pa.int32(), pa.int64(), pa.string()))], ["path", "part", "number", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, running = None, None
        for batch in batches:
            done: list[tuple] = []
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p == path:
                    running.update(b"," + ids.encode())
                    continue
                if running:
                    done.append((path, running.hexdigest()))
                path, running = p, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["path", "ends"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([running.hexdigest()])], ["path", "ends"])

    text = ranged.select("path", "conv_id").mapInArrow(chunks, "path binary, part int, number long, ids string")
    return text.repartition("path").sortWithinPartitions("path", "part", "number").select("path", "ids").mapInArrow(hashes, "path binary, ends string")


ROW = "key binary, sizes array<int>, n bigint, first bigint, ends string, root_first bigint, more bigint, more_leaves bigint, more_saved bigint"
NODE = "units int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, own binary, parent binary, root binary"


def blocks(keys: DataFrame) -> DataFrame:
    """``(part, block, lead, tail, ahead, behind, rows)``: distinct keys in order, packed. ``lead`` is how many units the first key shares
    with the last of the block before, ``tail`` the last key with the next block's first; at the edges of a task those are
    null, and ``ahead`` and ``behind`` hold the keys."""
    ranged = keys.repartitionByRange("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        lead, held, size = None, [], 0

        def packed(next_key: bytes | None) -> pa.RecordBatch:
            nonlocal lead, held, size, number
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            first, last = rows.column(0)[0].as_py(), rows.column(0)[-1].as_py()
            tail = shared(last, next_key) // WIDTH if next_key is not None else None
            values = [part, number, lead, tail, tail is not None and tail * WIDTH == len(last), first if lead is None else None, last if tail is None else None]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            out = [pa.array([v], t) for v, t in zip(values, kinds)] + [pa.ListArray.from_arrays([0, rows.num_rows], rows.to_struct_array())]
            lead, held, size, number = tail, [], 0, number + 1
            return pa.RecordBatch.from_arrays(out, ["part", "block", "lead", "tail", "goes_on", "ahead", "behind", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                if size > BLOCK_BYTES or sum(b.num_rows for b in held) >= BLOCK_ROWS:
                    yield packed(piece.column(0)[0].as_py())
                held.append(piece)
                size += piece.get_total_buffer_size() if piece.num_rows == batch.num_rows else piece.nbytes
        if held:
            yield packed(None)

    return ranged.mapInArrow(run, f"part int, block long, lead int, tail int, goes_on boolean, ahead binary, behind binary, rows array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in ROW.split(', ')))}>>")


def layer_nodes(keys: DataFrame) -> DataFrame:
    """The nodes of the tries of a layer (columns NODE); those on borders between blocks are whole again."""
    packed = stored(blocks(keys), "blocks")
    # the edges of tasks: one row a task
    ends = packed.groupBy("part").agg(F.max("ahead").alias("first_key"), F.max("behind").alias("last_key"))
    by = Window.orderBy("part")
    ends = stored(ends.select("part", F.lag("last_key").over(by).alias("key_before"), F.lead("first_key").over(by).alias("key_after")), "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lead, tail, goes_on, before, after = (batch.column(c)[k].as_py() for c in ("lead", "tail", "goes_on", "key_before", "key_after"))
                start, end = batch.column("rows").offsets[k].as_py(), batch.column("rows").offsets[k + 1].as_py()
                structs = batch.column("rows").values.slice(start, end - start)
                rows = {f.name: structs.field(f.name).to_pylist() for f in structs.type}
                if lead is None:
                    lead = shared(before, rows["key"][0]) // WIDTH if before is not None else 0
                if tail is None:
                    tail = shared(rows["key"][-1], after) // WIDTH if after is not None else 0
                    goes_on = after is not None and tail * WIDTH == len(rows["key"][-1])
                found = list(emitted(rows, lead, tail, goes_on))
                for at in range(0, len(found), 8192):
                    columns = zip(*found[at : at + 8192])
                    kinds = (pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in NODE.split(", ")])

    nodes = stored(packed.join(F.broadcast(ends) if ends.count() < 10_000 else ends, "part").select("lead", "tail", "goes_on", "key_before", "key_after", "rows").mapInArrow(run, NODE), "nodes")
    border = nodes.filter("own is not null").groupBy("own").agg(
        F.min("units").alias("units"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"), F.max("parent").alias("parent"), F.max("root").alias("root")
    )
    border = stored(border, "border")
    above = small_side(border.select(F.col("own").alias("parent"), F.col("conv_id").alias("above"), (F.col("units") == 1).alias("top")), 64)
    columns = [c.split()[0] for c in NODE.split(", ") if c.split()[0] not in ("own", "parent")]
    waiting = nodes.filter("own is null and parent is not null").unionByName(border).join(above, "parent", "left")
    # the node above a layer's first turns belongs to the layer above, which is already known
    waiting = waiting.withColumn("parent_conv_id", F.when(F.col("above").isNull() | (F.col("top") & (F.col("root") != F.lit(NO_ROOT))), F.col("parent_conv_id")).otherwise(F.col("above")))
    return nodes.filter("own is null and parent is null").select(columns).unionByName(waiting.select(columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: every distinct prefix of
    rebuilt conversations.

    ``conversations(conv_id, turn, role, text)``: turns go by number (null first), then by the first 64 characters of role and
    text, then by a digest; null role and text count as empty; repeated rows are turns of their own; rows without conv_id take
    no part. A conversation begins with the first h turns of that whose id is the next lower multiple of five, h being its id's
    checksum modulo nine, and goes on with its own turns after the first h; without either it is turnless and ends at the root.
    Turns are told apart by 128-bit digests. Texts of any length count by their bytes only, as they become digests in the first
    scan. Conversations of any number of turns are cut into layers of SEGMENT turns; one round of jobs handles a layer. Other
    columns are ignored; an empty table gives no rows.
    """
    turns, lengths = rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    cut = stored(segments(turns, lengths), "keys")
    ended = member_hashes(cut.filter("ended").select("path", "conv_id"))
    keys = cut.groupBy("path").agg(*(F.first(c).alias(c) for c in ("layer", "root", "key", "sizes")), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    keys = stored(keys.join(ended, "path", "left"), "distinct")
    deepest = keys.agg(F.max("layer")).first()[0]
    if deepest is None:
        deepest = -1
    out, totals = None, None
    for layer in range(deepest, -1, -1):
        rows = keys.filter(F.col("layer") == layer)
        if layer:
            above = keys.filter(F.col("layer") == layer - 1).select(F.col("path").alias("root"), F.col("first").alias("root_first"))
            rows = rows.join(above, "root", "left")
        else:
            rows = rows.withColumn("root_first", F.lit(None).cast("long"))
        if totals is not None:
            rows = rows.join(totals, "path", "left")
        else:
            rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("more", "more_leaves", "more_saved")})
        nodes = layer_nodes(rows.select(F.concat("root", "key").alias("key"), "sizes", "n", "first", "ends", "root_first", "more", "more_leaves", "more_saved"))
        if layer:
            nodes = stored(nodes, "layer")
            totals = nodes.filter("units = 1").select(F.col("root").alias("path"), F.col("n_children").alias("more"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
            nodes = nodes.filter("units > 1")
        nodes = nodes.withColumn("depth", (F.col("units") - 1 + layer * SEGMENT).cast("long"))
        out = nodes if out is None else out.unionByName(nodes)
    if out is None:
        out = conversations.sparkSession.createDataFrame([], NODE + ", depth long")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))


def op13_radix_prefix_trie(spark, sf_dir):
    """Every node of the trie of the rebuilt ``conversations``."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, '') || chr(0) || coalesce(text, ''), 64)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR k IN range(8)]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > c.h),
conv AS (
  SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS s
  FROM crc c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
pre AS (SELECT conv_id, len(s) AS n, unnest(range(len(s) + 1)) AS depth, s FROM conv),
node AS (
  SELECT depth, s[:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN strlen(s[depth].t) ELSE 0 END) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM pre GROUP BY depth, s[:depth]),
kids AS (SELECT depth - 1 AS depth, p[:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.depth = n.depth AND k.p = n.p),
up AS (SELECT p, unnest(range(depth + 1)) AS depth, n_children, n_convs, bytes FROM whole),
below AS (SELECT depth, p[:depth] AS p, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below b ON b.depth = w.depth AND b.p = w.p LEFT JOIN node q ON q.depth = w.depth - 1 AND q.p = w.p[:w.depth - 1]
"""
