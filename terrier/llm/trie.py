"""A prefix trie of conversations from adaptive radix trees.

A turn's id is a big-endian number of 16 bytes, from a digest of its role and text; a conversation is the string of its turns'
ids. Equal conversations are counted before anything is dealt out, so copies cost one key. The distinct keys are dealt by ranges; a
task puts those of its range into an adaptive radix tree (nodes of 4, 16, 48 and 256 branches, unbranched bytes kept in the node)
and gives out a node of the trie at each depth that is a whole number of turns. A first turn that a third of all conversations
share is cut by its later turns. Only prefixes of a range's first and last key can lie in other ranges too: these are given out as
parts, which Spark adds up, and their totals are put together from the deepest up; they are as many as ranges times the turns of a
key. What lies below them is finished where it was built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.shared import fixed, n_words, release, stored

ID_BYTES = 16
#: Bytes of keys in a range that are aimed at.
RANGE_BYTES = 8 << 20
#: Branches that a node's layout has room for.
LAYOUTS = (4, 16, 48, 256)

_PART = [("open", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("words", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())]
_PART_DDL = "open boolean, node binary, parent binary, depth long, n_convs long, conv_id long, parent_conv_id long, words long, n_children long, n_leaves long, saved_tokens long"


class Node:
    """A radix tree's node: the bytes that follow without a branch, the key that ends here, and branches by the next byte.

    Layouts of 4 and 16 keep the branches' bytes beside them, that of 48 an index of all 256 bytes into its branches, that of 256 a place for each byte.
    """

    __slots__ = ("bytes", "prefix", "room", "slots", "value")

    def __init__(self, prefix: bytes, value: int | None = None):
        self.prefix, self.value = prefix, value
        self.room, self.bytes, self.slots = LAYOUTS[0], bytearray(), []

    def branch(self, byte: int) -> Node | None:
        if self.room == 256:
            return self.slots[byte]
        if self.room == 48:
            return self.slots[self.bytes[byte]] if self.bytes[byte] != 255 else None
        at = self.bytes.find(byte)
        return self.slots[at] if at >= 0 else None

    def add(self, byte: int, child: Node) -> None:
        if self.room < 256 and len(self.slots) == self.room:
            self._grow()
        if self.room == 256:
            self.slots[byte] = child
            return
        if self.room == 48:
            self.bytes[byte] = len(self.slots)
        else:
            self.bytes.append(byte)
        self.slots.append(child)

    def _grow(self) -> None:
        self.room = LAYOUTS[LAYOUTS.index(self.room) + 1]
        if self.room == 48:
            index = bytearray(b"\xff" * 256)
            for i, b in enumerate(self.bytes):
                index[b] = i
            self.bytes = index
        elif self.room == 256:
            slots: list[Node | None] = [None] * 256
            for b in range(256):
                if self.bytes[b] != 255:
                    slots[b] = self.slots[self.bytes[b]]
            self.bytes, self.slots = bytearray(), slots

    def children(self) -> Iterator[Node]:
        return (c for c in self.slots if c is not None)

    def split(self, at: int) -> None:
        """Cut the prefix before byte ``at``: what the node was becomes its only branch."""
        below = Node(self.prefix[at + 1 :], self.value)
        below.room, below.bytes, below.slots = self.room, self.bytes, self.slots
        byte = self.prefix[at]
        self.prefix, self.value, self.room, self.bytes, self.slots = self.prefix[:at], None, LAYOUTS[0], bytearray(), []
        self.add(byte, below)


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` agree with those of ``b`` from ``at`` on."""
    if b.startswith(a, at):
        return len(a)
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if b.startswith(a[:mid], at):
            lo = mid
        else:
            hi = mid - 1
    return lo


def tree(keys: list[bytes]) -> Node:
    """The radix tree of distinct keys; a node's value is its key's place."""
    root = Node(keys[0], 0)
    for value, key in enumerate(keys[1:], 1):
        node, at = root, 0
        while True:
            m = shared(node.prefix, key, at)
            if m < len(node.prefix):
                node.split(m)
            at += m
            if at == len(key):
                node.value = value
                break
            child = node.branch(key[at])
            if child is None:
                node.add(key[at], Node(key[at + 1 :], value))
                break
            node, at = child, at + 1
    return root


def path(root: Node, key: bytes) -> Iterator[Node]:
    """The nodes on the way to a key of the tree."""
    node, at = root, 0
    while node is not None:
        yield node
        at += len(node.prefix)
        node, at = (node.branch(key[at]) if at < len(key) else None), at + 1


def nodes(keys: list[bytes], counts: list[int], least: list[int], words: list[list[int]], width: int = ID_BYTES) -> list[tuple]:
    """The trie's nodes over distinct keys of whole turns, as rows of ``_PART``.

    Nodes on the way to the smallest or the largest key are open: their sums are those of this tree's closed nodes below them, and
    an open node counts for nothing above it.
    """
    root = tree(keys)
    open_ = {id(n) for key in (min(keys), max(keys)) for n in path(root, key)}
    # every node before those below it: (node, place of the one above, bytes before its branching byte)
    order, stack = [], [(root, -1, 0)]
    while stack:
        node, above, at = stack.pop()
        end = at + len(node.prefix)
        stack += [(c, len(order), end + 1) for c in node.children()]
        order.append((node, above, at, end))
    size = len(order)
    n, first, key_of, tops, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    chains: list[list[tuple[int, int, int, int]]] = [[] for _ in order]
    for i in range(size - 1, -1, -1):
        node, above, at, end = order[i]
        if node.value is not None:
            n[i] += counts[node.value]
            first[i] = least[node.value] if first[i] is None else min(first[i], least[node.value])
            key_of[i] = node.value
        own, closed = words[key_of[i]], id(node) not in open_
        # whole turns that end within the node's bytes (the branching byte among them), the deepest first
        for depth in range(end // width, -(-max(at, 1) // width) - 1 if above >= 0 else -1, -1):
            said = own[depth - 1] if depth else 0
            if closed:
                leaves[i] = leaves[i] or 1
                saved[i] += (n[i] - 1) * said
            chains[i].append((depth, tops[i], leaves[i], saved[i]))
            tops[i], leaves[i], saved[i] = (1, leaves[i], saved[i]) if closed else (0, 0, 0)
        if above >= 0:
            n[above] += n[i]
            first[above] = first[i] if first[above] is None else min(first[above], first[i])
            key_of[above] = key_of[i]
            tops[above] += tops[i]
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    out, last = [], [None] * size
    for i, (node, above, _, _) in enumerate(order):
        key, is_open = keys[key_of[i]], id(node) in open_
        # the trie's node above: its digest so far, its name, its smallest member, whether it is open
        digest, name, parent_least, parent_open = last[above] if above >= 0 else (hashlib.sha256(), None, None, True)
        for depth, below, n_leaves, total in reversed(chains[i]):
            if depth:
                digest = digest.copy()
                digest.update(key[(depth - 1) * width : depth * width])
            parent, name = name, digest.digest()[:ID_BYTES]
            out.append((is_open, name, parent if parent_open else None, depth, n[i], first[i], None if parent_open else parent_least, words[key_of[i]][depth - 1] if depth else 0, below, n_leaves, total))
            parent_least, parent_open = first[i], is_open
        last[i] = (digest, name, parent_least, parent_open)
    return out


def turns(conversations: DataFrame, head: int = 3) -> DataFrame:
    """conv_id, turns (id and words of each, in order) of every conversation, and of what it is rebuilt from the first ``head`` turns.

    Turns go by turn (null first), those that tie by their ids; null roles and texts are empty. Rows without a conv_id belong to no conversation.
    A conversation's ids and counts, 24 bytes a turn, come together in one row; its texts don't.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * ID_BYTES)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"), name.alias("id"), n_words(text).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id and turns of every conversation with its first turns taken from the first of its ``every``; how many, under ``most``, a checksum of its id says."""
    own = stored(turns(conversations), "turns")
    heads = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "_base", "left")
    lead = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(lead, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _key(turns_: str = "turns") -> Column:
    return F.unhex(F.array_join(F.transform(turns_, lambda t: t["id"]), ""))


def _node(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 2 * ID_BYTES))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PART)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _PART, strict=True)], names=[name for name, _ in _PART])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[], [], [], []]
    for batch in batches:
        for c, values in zip(columns, batch.columns, strict=True):
            c += values.to_pylist()
    if columns[0]:
        rows = nodes(*columns)
        for at in range(0, len(rows), 1 << 16):
            yield _columns(rows[at : at + (1 << 16)])
    release()


def _totals(table: pa.Table) -> pa.Table:
    """The open nodes, each once, with what lies below them put together from the deepest up."""
    rows = sorted(table.to_pylist(), key=lambda r: -r["depth"])
    by_name = {r["node"]: r for r in rows}
    for r in rows:
        if not r["n_children"]:
            r["n_leaves"] = 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        above = by_name.get(r["parent"]) if r["depth"] else None
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
            r["parent_conv_id"] = above["conv_id"]
    return pa.Table.from_batches([_columns([tuple(r[name] for name, _ in _PART) for r in rows])])


def joined_digests(members: DataFrame, parts: int | None = None) -> DataFrame:
    """node and ends_sha256, the digest of a node's conv_ids in ascending order, joined by commas.

    Ids are written out by ranges of (node, conv_id), so those of one node in several tasks; one task a node then digests the pieces in order and holds one at a time.
    """
    n = fixed(parts, members.sparkSession)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column(0), batch.column(1).to_pylist()
            ends = pc.run_end_encode(names).run_ends.to_pylist()
            starts = [0, *ends[:-1]][: len(ends)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(starts, pa.int64())), pa.array([ids[a] for a in starts], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in zip(starts, ends, strict=True)], pa.string())], names=["node", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            names, digests = [], []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        names.append(now)
                        digests.append(digest.hexdigest())
                    now, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    pieces = members.select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(written, "node binary, first long, ids string")
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digested, "node binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, parts: int | None = None) -> DataFrame:
    """The nodes of the trie over ``sequences`` (conv_id, distinct and not null, and turns, an array of id, 32 hexadecimal digits, and words).

    Of each distinct sequence of first turns: node (16 bytes that name it), depth, conv_id (the smallest that starts with it), parent_conv_id
    (its parent's; null for the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree, words of a node's last turn
    times the conversations beyond the first) and ends_sha256 (of the conv_ids that end there). A conversation without turns ends at the
    root. Without conversations there is no node. Other columns are ignored.
    """
    spark = sequences.sparkSession
    keyed = stored(sequences.select("conv_id", _key().alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "keys")
    distinct = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words")), "distinct")
    size = distinct.agg(F.sum(F.octet_length("key").cast("long"))).first()[0] or 0
    ranges = distinct.repartitionByRange(max(fixed(parts, spark), size // RANGE_BYTES), "key")
    built = stored(ranges.select("key", "n", "least", "words").mapInArrow(_built, _PART_DDL), "built")
    named = {name: F.first(name).alias(name) for name in ("open", "parent", "depth", "parent_conv_id", "words")} | {name: F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")} | {"conv_id": F.min("conv_id").alias("conv_id")}
    whole = built.filter("open").groupBy("node").agg(*[named[name] for name, _ in _PART if name != "node"])
    # as many rows as ranges times the turns of a key
    open_ = stored(whole.select(*[name for name, _ in _PART]).groupBy().applyInArrow(_totals, _PART_DDL), "open")
    above = open_.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    closed = built.filter("not open").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("_above", "parent_conv_id"))
    out = closed.select(*open_.columns).unionByName(open_)
    ends = joined_digests(keyed.select(_node(F.col("key")).alias("node"), "conv_id"), parts)
    numbers = ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.join(ends, "node", "left").select("node", "conv_id", *numbers, F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
