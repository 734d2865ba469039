"""N-gram Jaccard join by PartEnum signatures, and its components.

A document's set is its distinct five-word shingles. Documents link when
``100 * |A and B| >= 75 * |A or B|``; then sizes a and b differ by a third at most and the
sets differ in at most ``(a + b) // 7`` elements.

*Signatures.* Sets are banded by size, [2^j, 2^(j+1)); a set near the lower edge also
joins the band below, so any two sets that can link meet in a band with equal
parameters. A band cuts the shingle domain (64-bit hashes) into 2^(j-1) groups of two
parts. Two sets that differ in k elements disagree in k parts at most, so among the
groups some keep one part unhurt, and each group enumerates its one-part subsets as
signatures: hash of (band, part, the set's shingles there). Parts where a set is empty
give none. Like a prefix filter, a set needs only its first ``k + spare`` parts: similar
sets then share ``spare`` signatures among them at least. A set with too few non-empty
parts also gives single shingles, of which it has enough, so no link is lost.

*Pruning, exact.* A set goes on only if enough of its signatures stand in another set
too, and then only if three quarters of its shingles stand in other sets that went on:
both follow from a link. Texts that merely share a passage end here.

*Links.* In each signature group all members are compared with the one that shares most,
which connects nearly all that links. What may still link different components is found by
a positional prefix: a set's shingles are put in one order, rarest first, and two similar
sets share a shingle early enough in both that the rest can still reach the overlap they
need. Holders of a shingle meet only across components (see ``crossing``), so no pair inside
a component is built and no pair of different components is left out.

Equal sets are one node from the start: copies are collapsed within a block and never
expanded. Nodes are 64 bits of a set's digest, or the other 64 where several sets share these.
Signatures travel packed by (block, bucket); nothing but plain rows per node is joined.

Defined results: null and empty text, and text without words, give an empty set linked
with nothing; fewer than five words are one shingle; a null id counts as larger than any
id; repeated rows are copies; an empty table gives an empty result; other columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import chunks, free_name, n_buckets, n_words, pack, small_batches, text_bytes, trimmed, unpack, written
from .components import components
from .shingles import LANES, Block, mix

SHINGLE = 5
BLOCK_BYTES = 2 << 20
_LAST = (1 << 63) - 1
MAX_SHARED = 100_000
_SINGLE = 64  # families from here on hold single shingles of a band


# ------------------------------------------------------------------ sets
def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end, sorted in each, and set sizes."""
    b = Block(texts, lower=True)
    at, doc = b.places(SHINGLE)
    h = mix(b.runs(SHINGLE, 0))[at] if len(at) else np.zeros(0, np.uint64)
    for size in range(1, SHINGLE):  # a shorter text is one shingle
        short = np.flatnonzero(b.n == size)
        if len(short):
            doc = np.concatenate((doc, short))
            h = np.concatenate((h, mix(b.runs(size, 0)[b.start[short]] ^ np.uint64(size))))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts)).astype(np.int64)


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _node(digest: bytes, taken: frozenset[int] = frozenset()) -> int:
    """The first 64 bits of a digest, or the other 64 if several sets have these (``taken``)."""
    first = int.from_bytes(digest[:8], "little", signed=True)
    return first if first not in taken else int.from_bytes(digest[8:], "little", signed=True)


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, text, row_key`` to their sets' size and digest."""
    for rows in chunks(batches, BLOCK_BYTES):
        h, n = shingle_sets([r[1] for r in rows])
        ends = np.cumsum(n)
        keys = [_digest(h[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "row_key": pa.array([r[2] for r in rows], pa.int64()),
                                          "n_shingles": pa.array(n, pa.int64()), "node": pa.array([_node(k) for k in keys], pa.int64()), "digest": pa.array(keys, pa.binary())})


# ------------------------------------------------------------------ signatures
def spare(size: int) -> int:
    return max(1, size // 8)


def signatures(h: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """``(family, need, signatures)`` of a sorted set: a family is a band, and a set that
    links with any other in it shares ``need`` of its signatures there with others."""
    size = len(h)
    out = []
    if size < 3:  # sets of one or two shingles link with equal sets only
        return out
    band = size.bit_length() - 1
    least_other, most_other = -(-3 * size // 4), 4 * size // 3
    for j in (band, band - 1):
        top = most_other if j == band else min(most_other, (1 << band) - 1)
        if top < least_other:
            continue
        k = (top + size) // 7
        part = (h >> np.uint64(64 - j)).astype(np.int64) if j else np.zeros(size, np.int64)
        head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        # one-part subsets of two-part groups, in the order of the parts
        take = head[:k + spare(size)]
        total = np.add.reduceat(mix(h), head)[:len(take)]
        out.append((j, max(1, min(len(head) - k, spare(least_other))),
                    mix(total + part[take].astype(np.uint64) * np.uint64(LANES[0]) + np.uint64(j * LANES[1] % (1 << 64)))))
        if len(head) <= k:
            out.append((_SINGLE + j, max(1, min(size - k, spare(least_other))), mix(h[:k + spare(size)] ^ np.uint64(_SINGLE + j))))
    return out


_PACKED = "bucket int, nodes binary, family binary, need binary, n binary, items binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("nodes", "family", "need", "n", "items"))])


def _send(segments: list[tuple[int, int, int, np.ndarray]], buckets: int, drop_bits: int = 0) -> pa.RecordBatch | None:
    """``(node, family, need, items)`` segments, dealt by item. Signatures go without their
    low bits, which the bucket holds in part: that they meet by chance costs a comparison."""
    if not segments:
        return None
    items = np.concatenate([s[3] for s in segments])
    seg = np.repeat(np.arange(len(segments)), [len(s[3]) for s in segments])
    node = np.array([s[0] for s in segments], np.int64)
    family, need = np.array([s[1] for s in segments], np.uint8), np.array([s[2] for s in segments], np.uint32)
    bucket = (items % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out: dict[str, list] = {c: [] for c in _PACKED_ARROW.names}
    for b in range(buckets):
        own = order[cuts[b]:cuts[b + 1]]
        if not len(own):
            continue
        which, n = np.unique(seg[own], return_counts=True)  # own is in the order of segments
        for c, v in zip(out, (b, pack(node[which]), pack(family[which]), pack(need[which]), pack(n.astype(np.uint32)), pack(items[own] >> np.uint64(drop_bits)))):
            out[c].append(v)
    return pa.RecordBatch.from_pydict(out, schema=_PACKED_ARROW)


def _send_signatures(buckets: int, taken: frozenset[int] = frozenset()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, BLOCK_BYTES):
            h, n = shingle_sets([r[1] for r in rows])
            ends, seen, segments = np.cumsum(n), set(), []
            for e, k in zip(ends.tolist(), n.tolist()):
                own = h[e - k:e]
                node = _node(_digest(own), taken)
                if node not in seen:  # copies in a block count once
                    seen.add(node)
                    segments.extend((node, f, need, s) for f, need, s in signatures(own))
            if (sent := _send(segments, buckets, 16)) is not None:
                yield sent
    return run


def _read(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Items of a bucket that stand in two nodes or more: item, node, family, need, and in
    how many nodes the item stands."""
    rows = table.to_pylist()
    node, family, need, n, item = (np.concatenate([unpack(r[c], t) for r in rows]) for c, t in
                                   (("nodes", np.int64), ("family", np.uint8), ("need", np.uint32), ("n", np.uint32), ("items", np.uint64)))
    node, family, need = (np.repeat(x, n) for x in (node, family, need))
    order = np.lexsort((node, item))
    item, node, family, need = item[order], node[order], family[order], need[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (node[1:] != node[:-1])  # copies in several blocks count once
    item, node, family, need = item[new], node[new], family[new], need[new]
    head = np.ones(len(item), bool)
    head[1:] = item[1:] != item[:-1]
    group = np.cumsum(head) - 1
    times = np.bincount(group)[group] if len(item) else group
    several = times > 1
    return item[several], node[several], family[several], need[several], times[several]


def _shared(table: pa.Table) -> pa.Table:
    item, node, family, need, _ = _read(table)
    b = table.column("bucket")[0].as_py()
    sig = (item << np.uint64(16)) | np.uint64(b % 65536)
    return pa.table({"sig": sig.view(np.int64), "node": node, "family": family.astype(np.int32), "need": need.astype(np.int32)})


_HOMES = "home int, nodes binary, size binary, n binary, items binary, times binary"
_HOMES_ARROW = pa.schema([("home", pa.int32()), *((c, pa.binary()) for c in ("nodes", "size", "n", "items", "times"))])


def _support(homes: int):
    """A bucket's items that stand in several nodes, packed by home (a hash bucket of
    nodes): per node its set size, how many such items it has, which, and in how many
    nodes each stands."""
    def run(table: pa.Table) -> pa.Table:
        item, node, _, size, times = _read(table)
        home = (node.view(np.uint64) % np.uint64(homes)).astype(np.int64)
        order = np.lexsort((node, home))
        item, node, size, times, home = (x[order] for x in (item, node, size, times, home))
        out: dict[str, list] = {c: [] for c in _HOMES_ARROW.names}
        cuts = np.searchsorted(home, np.arange(homes + 1))
        for h in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[h], cuts[h + 1])
            which, first, n = np.unique(node[own], return_index=True, return_counts=True)
            back = np.argsort(first)  # nodes stand in signed order already
            for c, v in zip(out, (h, pack(which[back]), pack(size[own][first[back]]), pack(n[back].astype(np.uint32)),
                                  pack(item[own]), pack(times[own].astype(np.uint32)))):
                out[c].append(v)
        return pa.Table.from_pydict(out, schema=_HOMES_ARROW)
    return run


def need_overlap(a: int, b: int) -> int:
    """The least overlap of similar sets of these sizes."""
    return -(-3 * (a + b) // 7)


_RARE = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("support", pa.int64()), ("first_place", pa.int64()),
                   ("elements", pa.list_(pa.int64()))])


def _rare(table: pa.Table) -> pa.Table:
    """Nodes of a home that have enough shared shingles to link: ``node, size, support``,
    and their shared ``elements`` by rarity, as far as the first that a node has in common
    with a similar set can stand. What no other set has comes before them, so the first
    has place ``first_place``."""
    rows = table.to_pylist()
    node, size, n, item, times = (np.concatenate([unpack(r[c], t) for r in rows]) for c, t in
                                  (("nodes", np.int64), ("size", np.uint32), ("n", np.uint32), ("items", np.uint64), ("times", np.uint32)))
    node, size = np.repeat(node, n), np.repeat(size, n)
    order = np.lexsort((item, times, node))
    node, size, item = node[order], size[order].astype(np.int64), item[order]
    head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    out: dict[str, list] = {c: [] for c in _RARE.names}
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(node)]):
        whole, support = int(size[a]), b - a
        if 4 * support < 3 * whole:
            continue
        alone = whole - support
        reach = max(0, whole - need_overlap(-(-3 * whole // 4), whole) + 1 - alone)
        for c, v in zip(out, (int(node[a]), whole, support, alone, item[a:a + reach].view(np.int64))):
            out[c].append(v)
    return pa.Table.from_pydict(out, schema=_RARE)


def _send_sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, held = [], 0
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # another mix than the sort key, as items are dealt by their low bits
                segments.append((node, 0, len(data) // 8, mix(np.frombuffer(data, np.uint64))))
                held += len(data)
                if held > BLOCK_BYTES:
                    yield _send(segments, buckets)
                    segments, held = [], 0
            if segments:
                yield _send(segments, buckets)
    return run


def _sets_of_nodes(taken: frozenset[int]):
    """Sets of documents whose set is the node that their row names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, BLOCK_BYTES):
            h, n = shingle_sets([r[1] for r in rows])
            ends = np.cumsum(n)
            out = [(r[0], h[e - k:e].tobytes()) for r, e, k in zip(rows, ends.tolist(), n.tolist()) if _node(_digest(h[e - k:e]), taken) == r[0]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                                                 names=["node", "elements"])
    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            hit = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                hit.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])
    return run


# ------------------------------------------------------------------ the join
def _texts_of_nodes(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, text`` of the documents that ``asked`` (``node, rep, rep_key``) names, copies once."""
    own = (F.col("rep") == F.col("key")) & (F.col("rep_key") == F.col("row_key"))
    return asked.join(texts, own).select("rep", "rep_key", "node", "text").distinct().select("node", "text")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the node pairs ``a, b`` whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
                        .mapInArrow(trimmed(_similar(75)), "a long, b long"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of labels, carried over to their nodes."""
    to = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    of = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    if links.isEmpty():
        return labels
    found = components(links.join(to, "a").join(of, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    new = found.select(F.col("node").alias("label"), F.col("label").alias("better"))
    return written(labels.join(new, "label", "left").select("node", F.coalesce("better", "label").alias("label")), instead_of=labels)


def crossing(labelled: DataFrame) -> DataFrame:
    """Pairs of rows of ``labelled`` (``node, size, element, place, label``) that share an
    element and have different labels, each once; the second row's columns end in ``_y``.

    The labels of an element are numbered. Two numbers differ in a highest bit: there, and
    only there, rows without the bit meet rows with it that are equal in the bits above. Rows
    of one label never meet."""
    split = labelled.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("element")
    x = labelled.join(split, "element", "left_semi")
    labels = x.select("element", "label").distinct()
    count = labels.groupBy("element").agg(F.count(F.lit(1)).alias("labels"))
    rank = F.row_number().over(Window.partitionBy("element").orderBy("label")) - 1
    ranks = (labels.withColumn("rank", rank).join(count, "element")
                   .withColumn("level", F.expr("explode(sequence(0, length(bin(labels - 1)) - 1))"))
                   .select("element", "label", "level", F.expr("shiftright(rank, level + 1)").alias("above"),
                           F.expr("shiftright(rank, level) & 1").alias("side")))
    sides = x.join(ranks, ["element", "label"])
    columns, meet = ("node", "size", "place", "label"), ["element", "level", "above"]
    y = sides.filter("side = 1").select(*meet, *[F.col(c).alias(f"{c}_y") for c in columns])
    return sides.filter("side = 0").select(*meet, *columns).join(y, meet).drop("level", "above")


def link_nodes(groups: DataFrame, prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, label`` of nodes that may link. ``groups``: signature groups (``sig, node,
    score, size, support``); ``prefixes``: ``node, size, element, place``."""
    best = groups.groupBy("sig").agg(F.max(F.struct("score", "node", "size", "support")).alias("best"))
    reach = F.expr("3 * (size + best.size) <= 7 * least(support, best.support)")
    star = (groups.join(best, "sig").filter((F.col("node") != F.col("best.node")) & reach)
                  .select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b")).distinct())
    labels = written(groups.select("node").distinct().withColumn("label", F.col("node")))
    labels = _merged(labels, _verified(star, sets))

    labelled = written(prefixes.join(labels, "node"))
    fits = F.expr("7 * least(size - place, size_y - place_y) >= 3 * (size + size_y)")
    pairs = (crossing(labelled).filter(fits)
             .select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct())
    return _merged(labels, _verified(pairs, sets))


def _numbered(slim: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """``slim`` with one number per set, its nodes, and the 64-bit numbers that several sets
    share: their sets are numbered by the other half of the digest. About n^2 / 2^65 of n sets
    share one (24 of 3e10), so the list is short, which is checked."""
    def grouped(rows: DataFrame) -> DataFrame:
        return (rows.filter("n_shingles > 0").groupBy("node").agg(
            F.min(F.struct("doc_id", "row_key")).alias("rep"), F.min("n_shingles").alias("size"), F.min("digest").alias("d0"), F.max("digest").alias("d1")))

    nodes = grouped(slim)
    taken = frozenset(r["node"] for r in nodes.filter("d0 <> d1").select("node").limit(MAX_SHARED + 1).collect())
    if not taken:
        return slim, nodes, taken
    if len(taken) > MAX_SHARED:
        raise ValueError(f"more than {MAX_SHARED} node numbers stand for several shingle sets")

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("node")
            new = pa.array([_node(d, taken) for d in batch.column("digest").to_pylist()], pa.int64())
            yield batch.set_column(at, "node", new)

    slim = written(slim.mapInArrow(renumber, slim.schema), instead_of=slim)
    nodes = grouped(slim)
    if not nodes.filter("d0 <> d1").isEmpty():
        raise ValueError("two different shingle sets agree in both halves of their numbers")
    return slim, nodes, taken


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row_key, n_shingles, label, component_id`` per row; a null id is the
    largest number, ``label`` is null for empty sets, and ``row_key`` hashes the text."""
    spark = small_batches(docs.sparkSession)
    ensure_checkpoint_dir(spark)
    buckets = n_buckets(spark, text_bytes(docs, text_col))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    texts = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.withColumn("row_key", F.xxhash64("text"))
    slim = written(keyed.mapInArrow(trimmed(_slim), "doc_id long, row_key long, n_shingles long, node long, digest binary"))
    slim, nodes, taken = _numbered(slim)
    nodes = nodes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.row_key").alias("rep_key"), "size")

    shared = written(texts.mapInArrow(trimmed(_send_signatures(buckets, taken)), _PACKED).groupBy("bucket")
                          .applyInArrow(trimmed(_shared), "sig long, node long, family int, need int"))
    scores = written(shared.groupBy("node", "family").agg(F.count(F.lit(1)).alias("score"), F.max("need").alias("need"))
                           .filter("score >= need").select("node", "family", "score"))
    asked = scores.select("node").distinct().join(nodes, "node")
    sets = written(_texts_of_nodes(asked.select("node", "rep", "rep_key"), keyed).mapInArrow(trimmed(_sets_of_nodes(taken)), "node long, elements binary"))
    rare = written(sets.mapInArrow(trimmed(_send_sets(buckets)), _PACKED).groupBy("bucket").applyInArrow(trimmed(_support(buckets)), _HOMES)
                       .groupBy("home").applyInArrow(trimmed(_rare), "node long, size long, support long, first_place long, elements array<long>"))
    groups = written(shared.join(scores.join(rare.select("node", "size", "support"), "node"), ["node", "family"])
                           .select("sig", "node", "score", "size", "support"), instead_of=shared)
    prefixes = (rare.select("node", "size", "first_place", F.posexplode("elements").alias("i", "element"))
                    .select("node", "size", "element", (F.col("first_place") + F.col("i")).alias("place")))
    labels = link_nodes(groups, prefixes, sets)

    labelled = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    member = labelled.join(least, "label").select("node", "label", "component_id")
    columns = ["doc_id", "row_key", "n_shingles", "label", "component_id"]
    alone = slim.filter("n_shingles = 0").withColumns({"label": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return slim.filter("n_shingles > 0").join(member, "node").select(columns).unionByName(alone.select(columns))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row."""
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return _components(docs, id_col, text_col).select(known("doc_id").alias("doc_id"), "n_shingles",
                                                      known("component_id").alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id (of rows that share it, one), with
    all columns; documents with an empty set stay."""
    found = written(_components(docs, id_col, text_col).select("doc_id", "row_key", "label"))
    best = (found.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "row_key")).alias("best"))
                 .select(F.col("label").alias("of"), "best"))
    i, k, gone_i, gone_k = (free_name(docs.columns, x) for x in ("row_id", "row_key", "gone_id", "gone_key"))
    gone = (found.join(best, found["label"] == best["of"]).filter(F.struct("doc_id", "row_key") != F.col("best"))
                 .select(F.col("doc_id").alias(gone_i), F.col("row_key").alias(gone_k)).distinct())
    keyed = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), k: F.xxhash64(F.col(text_col).cast("string"))})
    stay = keyed.join(gone, (keyed[i] == gone[gone_i]) & (keyed[k] == gone[gone_k]), "left_anti")
    if not found.filter("label is not null").groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        worded = n_words(F.col(text_col)) > 0
        stay = stay.filter(worded).dropDuplicates([i, k]).union(stay.filter(~worded))  # rows that repeat an id and a text
    return stay.select(*docs.columns)
