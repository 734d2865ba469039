"""Prefix trie of conversations, built as a distributed burst trie.

A conversation is a sequence of turn ids (128 bits of role and text) with the number of
words of each turn. A node is a distinct sequence of first turns.

*Containers.* Conversations stand as suffixes in containers under trie heads, at first all
under the root. A container with more than ``container_turns`` turns bursts: its head
becomes an inner node, and its suffixes go on to the containers of their next turn id; a
conversation that ends at the head is listed there. Sizes are counted with partial
aggregation, so a first turn that a third of all conversations share is no hot key; it only
bursts on. Rounds end when no container is too large.

*Sweep.* Shards of containers are sorted by head, suffix and conversation; one sweep over a
container opens and closes nodes on a stack and counts members, children, leaves and
savings on the way. A task holds one container's nodes.

*Heads.* Totals of the burst heads are summed from their children, deepest heads first;
the members that end at one are hashed as a sorted stream.

Defined results: null role or text counts as empty; turns that repeat a number are ordered
by their id; a null turn number comes first; rows without a conversation id belong to no
conversation; an empty table has no node; other columns are ignored. A conversation is one
row of 20 bytes a turn, without its texts.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, small_batches, written

CONTAINER_TURNS = 1 << 14
ID = 16  # bytes of a turn id
ROOT = bytes(ID)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def turn_id(role, text):
    """128 bits of role and text; null counts as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


_SEQUENCE = pa.schema([("conv_id", pa.int64()), ("ids", pa.binary()), ("words", pa.binary())])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
        ids, words = bytearray(), bytearray()
        for _, turn, n in turns:
            ids += turn
            words += n.to_bytes(4, "big")
        out.append((conv, bytes(ids), bytes(words)))
        held += len(ids) + 64
        if held > 1 << 20:
            yield _out(out, _SEQUENCE)
            out, held = [], 0
    if out:
        yield _out(out, _SEQUENCE)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, ids, words`` of ``conv_id, turn, role, text``: 16 bytes of turn id and 4 of
    word count (big-endian) per turn, by turn."""
    small_batches(turns.sparkSession)
    slim = (turns.filter(F.col("conv_id").isNotNull())
                 .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         turn_id(F.col("role"), F.col("text")).alias("id"), n_words(F.col("text")).cast("int").alias("n")))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "id")
    return ordered.select("conv_id", "id", "n").mapInArrow(_sequences, "conv_id long, ids binary, words binary")


def share_openings(seqs: DataFrame, family: int = 20, longest: int = 4) -> DataFrame:
    """``seqs`` with the first h turns of each conversation c taken from conversation
    c - c % family (all it has, if fewer; none, if it is absent), h = crc32(c) % longest."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest)).cast("int")
    own = seqs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    first = seqs.select(F.col("conv_id").alias("base"), F.expr(f"substring(ids, 1, {ID * longest})").alias("first_ids"),
                        F.expr(f"substring(words, 1, {4 * longest})").alias("first_words"))
    cut = lambda c, size: F.expr(f"concat(coalesce(substring(first_{c}, 1, {size} * h), X''), substring({c}, {size} * h + 1))")
    return own.join(first, "base", "left").select("conv_id", cut("ids", ID).alias("ids"), cut("words", 4).alias("words"))


_NODE = pa.schema([("head", pa.binary()), ("parent", pa.binary()), ("top", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()),
                   ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                   ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("turn_id", pa.binary())])
_NODE_DDL = ("head binary, parent binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
             "n_leaves long, saved_tokens long, ends_sha256 string, turn_id binary")


class Ends:
    """Hash of ascending ids joined by commas."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, conv: int) -> None:
        self.sha.update(f",{conv}".encode() if self.any else str(conv).encode())
        self.any = True


class Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "words", "turn")

    def __init__(self, words: int, turn: bytes):
        self.conv, self.n, self.leaves, self.saved = None, 0, 0, 0
        self.children: list[tuple] = []
        self.ends, self.words, self.turn = Ends(), words, turn

    def meet(self, conv: int, n: int) -> None:
        self.conv, self.n = conv if self.conv is None else min(self.conv, conv), self.n + n


def sweep(suffixes: Iterator[tuple], head: bytes, parent: bytes, depth: int, words: int, turn: bytes) -> Iterator[tuple]:
    """Nodes of a container, from ``conv_id, ids, words`` sorted by ids, then conversation."""
    stack, before = [Node(words, turn)], b""

    def close() -> Iterator[tuple]:
        node, level = stack.pop(), depth + len(stack)
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        for row in node.children:
            yield (head, parent, False, *row[:2], node.conv, *row[2:])
        row = (node.conv, level, node.n, len(node.children), node.leaves, node.saved, node.ends.sha.hexdigest(), node.turn)
        if stack:
            up = stack[-1]
            up.meet(node.conv, node.n)
            up.leaves += node.leaves
            up.saved += node.saved
            up.children.append(row)
        else:
            yield (head, parent, True, *row[:2], None, *row[2:])

    for conv, ids, counts in suffixes:
        same, most = 0, min(len(ids), len(before))
        while same < most and ids[same:same + ID] == before[same:same + ID]:
            same += ID
        while len(stack) > same // ID + 1:
            yield from close()
        for at in range(same, len(ids), ID):
            n = at // ID * 4
            stack.append(Node(int.from_bytes(counts[n:n + 4], "big"), ids[at:at + ID]))
        stack[-1].meet(conv, 1)
        stack[-1].ends.add(conv)
        before = ids
    while stack:
        yield from close()


def _sweep_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for head, rows in groupby(_rows(batches), key=lambda r: r[0]):
        first = next(rows)
        _, parent, depth, words, turn = first[:5]
        suffixes = (r[5:] for r in (x for part in ([first], rows) for x in part))
        for node in sweep(suffixes, head, parent, depth, words, turn):
            out.append(node)
            if len(out) >= 4096:
                yield _out(out, _NODE)
                out = []
    if out:
        yield _out(out, _NODE)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, schema = [], pa.schema([("head", pa.binary()), ("ends_sha256", pa.string())])
    for head, rows in groupby(_rows(batches), key=lambda r: r[0]):
        ends = Ends()
        for _, conv in rows:
            ends.add(conv)
        out.append((head, ends.sha.hexdigest()))
    if out:
        yield _out(out, schema)


def build_trie(seqs: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """Nodes of ``conv_id, ids, words``, one row for each: ``conv_id`` (its smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    turn_id`` (its last turn; null for the root)."""
    spark = small_batches(seqs.sparkSession)
    held = written(seqs.select(F.lit(ROOT).alias("head"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
                               F.lit(0).alias("last_words"), F.lit(None).cast("binary").alias("turn_id"), "conv_id", "ids", "words"))
    ready, bursts, ends = [], [], []
    while True:
        sizes = held.groupBy("head").agg(F.sum(F.octet_length("ids") / ID).alias("turns"), F.count("*").alias("n_convs"),
                                         F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
                                         F.first("last_words").alias("last_words"), F.first("turn_id").alias("turn_id"))
        big = written(sizes.filter((F.col("turns") > container_turns) & (F.col("n_convs") > 1)))
        if big.isEmpty():
            ready.append(held)
            break
        bursts.append(big)
        ready.append(held.join(big, "head", "left_anti"))
        on = held.join(big, "head", "left_semi")
        ends.append(on.filter(F.octet_length("ids") == 0).select("head", "conv_id"))
        step = F.expr(f"substring(ids, 1, {ID})")
        held = written(on.filter(F.octet_length("ids") > 0).select(
            F.unhex(F.md5(F.concat("head", step))).alias("head"), F.col("head").alias("parent"), (F.col("depth") + 1).alias("depth"),
            F.expr("cast(conv(hex(substring(words, 1, 4)), 16, 10) as int)").alias("last_words"), step.alias("turn_id"), "conv_id",
            F.expr(f"substring(ids, {ID + 1})").alias("ids"), F.expr("substring(words, 5)").alias("words")))
    order = ["head", "parent", "depth", "last_words", "turn_id", "conv_id", "ids", "words"]
    sorted_in_shards = (reduce(DataFrame.unionByName, ready).select(order).repartition("head").sortWithinPartitions("head", "ids", "conv_id"))
    nodes = written(sorted_in_shards.mapInArrow(_sweep_containers, _NODE_DDL))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]
    found = nodes.filter("not top").select(columns)
    tops = nodes.filter("top").drop("parent_conv_id")
    if not bursts:
        return found.unionByName(tops.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    hashed = (reduce(DataFrame.unionByName, ends).repartition("head").sortWithinPartitions("head", "conv_id")
              .mapInArrow(_hash_ends, "head binary, ends_sha256 string"))
    hashed = written(hashed)
    below = None  # heads of the level below, burst or swept
    heads = tops
    for level in range(len(bursts) - 1, -1, -1):
        children = tops.filter(F.col("depth") == level + 1)
        if below is not None:
            children = children.unionByName(below, allowMissingColumns=True)
        sums = children.groupBy(F.col("parent").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                                                                   F.sum("saved_tokens").alias("below_tokens"))
        own = bursts[level].join(sums, "head", "left").join(hashed, "head", "left")
        none = hashlib.sha256().hexdigest()
        below = written(own.select("head", "parent", F.lit(True).alias("top"), "conv_id", "depth", "n_convs", "n_children", "n_leaves",
                                   (F.col("below_tokens") + (F.col("n_convs") - 1) * F.col("last_words")).alias("saved_tokens"),
                                   F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "turn_id"))
        heads = heads.unionByName(below)
    known = reduce(DataFrame.unionByName, (b.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id")) for b in bursts))
    return found.unionByName(heads.join(known, "parent", "left").select(columns))
