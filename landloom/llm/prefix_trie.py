"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

Each distinct conversation is a sequence of turn digests. The sequences are sorted over all partitions. A task takes a
block of them; neighbours are joined by an edge whose weight is the length of their longest common prefix (LCP), and a
union-find goes through the edges in descending depth: every merge of components creates a branching node, or adds to the
one that the same depth has just created. A node between two branching nodes has the members of the lower one, so a
component's chain is written out from its depths alone.

Nodes that hold neither the block's first nor its last sequence are finished. The rest of the block, its forest, is
contracted to these two sequences, with the counts of what hangs from them by depth. The contracted forests of all blocks
are sorted and go through the same steps, in blocks again, until one block is left: a node that several partitions share
is merged where their last and first sequences meet.

Defined cases: a null role or text is empty; a null turn comes first, turns of one number follow in order of digest; rows
without a conv_id belong to no conversation; a turn's digest is 128 bits of SHA-256 over role and text, and a
conversation's turns meet in one row as 24 bytes each; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, discard, materialise, spread_join

SIZE = 16  # bytes of a digest
#: Sequences and turns of a block.
BLOCK, BLOCK_TURNS = 20_000, 400_000
#: Ids that are joined to one text before they are hashed.
RUN = 5000

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, parent_key binary, key binary"
SPINE = "seq array<binary>, words array<bigint>, depths array<bigint>, convs array<bigint>, least array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"
_NODE, _SPINE = ([x.split(" ")[0] for x in s.split(", ")] for s in (NODE, SPINE))
_KINDS = {"seq": pa.list_(pa.binary()), "ends": pa.list_(pa.string()), "ends_sha256": pa.string(), "parent_key": pa.binary(), "key": pa.binary()}
ARROW = pa.schema([(c, _KINDS.get(c, pa.int64() if c in _NODE else pa.list_(pa.int64()))) for c in _NODE + _SPINE])
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Hung:
    """What hangs from one depth of a sequence: conversations, their least id, closed children, leaves and saved tokens
    below them, and the digest of those that end there."""

    __slots__ = ("children", "convs", "ends", "least", "leaves", "saved")

    def __init__(self, convs=0, least=None, children=0, leaves=0, saved=0, ends=None):
        self.convs, self.least, self.children, self.leaves, self.saved, self.ends = convs, least, children, leaves, saved, ends

    def add(self, o: Hung) -> None:
        self.convs += o.convs
        self.least = o.least if self.least is None else self.least if o.least is None else min(self.least, o.least)
        self.children += o.children
        self.leaves += o.leaves
        self.saved += o.saved
        self.ends = self.ends or o.ends


class Spine:
    """A sequence with what hangs from it."""

    __slots__ = ("digests", "hung", "words")

    def __init__(self, digests: bytes, words: list[int], hung: dict[int, Hung]):
        self.digests, self.words, self.hung = digests, words, hung

    @property
    def depth(self) -> int:
        return len(self.words)

    def saved_between(self, low: int, high: int) -> int:
        """Words of the turns low+1 to high."""
        return sum(self.words[low:high])

    def keys(self, depths: list[int]) -> dict[int, bytes]:
        """A digest of the prefix of each depth, depths ascending."""
        sha, at, out = hashlib.sha256(), 0, {}
        for d in depths:
            sha.update(self.digests[at * SIZE : d * SIZE])
            at = d
            out[d] = sha.digest()[:SIZE]
        return out

    def row(self) -> dict:
        at = sorted(self.hung)
        own = [self.hung[d] for d in at]
        return {
            "seq": [self.digests[i : i + SIZE] for i in range(0, len(self.digests), SIZE)], "words": self.words, "depths": at, "convs": [h.convs for h in own], "least": [h.least for h in own],
            "children": [h.children for h in own], "leaves": [h.leaves for h in own], "saved": [h.saved for h in own], "ends": [h.ends for h in own],
        }


def common(a: Spine, b: Spine) -> int:
    """Turns of the longest common prefix."""
    n = min(a.depth, b.depth) * SIZE
    x, y = np.frombuffer(a.digests[:n], np.uint8), np.frombuffer(b.digests[:n], np.uint8)
    differ = np.flatnonzero(x != y)
    return (int(differ[0]) if len(differ) else n) // SIZE


class Node:
    """A node of the contracted trie: a component of the union-find. first, last: the first and last sequence below it."""

    __slots__ = ("depth", "first", "hung", "last", "parts")

    def __init__(self, depth: int, first: int, last: int, hung: Hung):
        self.depth, self.first, self.last, self.hung, self.parts = depth, first, last, hung, []


def forest(spines: list[Spine]) -> Node:
    """The contracted trie of sorted sequences. What hangs from a depth that a sequence shares with its neighbour before is
    moved there first, so equal prefixes stand side by side."""
    lcp = [0, *(common(a, b) for a, b in zip(spines, spines[1:], strict=False))]
    for s in range(len(spines) - 1, 0, -1):
        for d in [d for d in spines[s].hung if d <= lcp[s]]:
            spines[s - 1].hung.setdefault(d, Hung()).add(spines[s].hung.pop(d))
    spines[0].hung.setdefault(0, Hung())
    tops, edges = [], []  # a component for each prefix that something hangs from; an edge to the one before
    for s, spine in enumerate(spines):
        before = lcp[s]
        for d in sorted(spine.hung):
            if tops:
                edges.append((-before, len(tops)))
            tops.append(Node(d, s, s, spine.hung[d]))
            before = d
    edges.sort()
    root = list(range(len(tops)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for minus, right in edges:
        depth, a, b = -minus, find(right - 1), find(right)
        x, y = tops[a], tops[b]
        root[b] = a
        if x.depth == depth:  # the branching node is there already, or x is a prefix of y
            node = x
        else:
            node = Node(depth, x.first, x.last, Hung())
            node.parts.append(x)
        if y.depth == depth:
            node.hung.add(y.hung)
            node.parts += y.parts
        else:
            node.parts.append(y)
        node.first, node.last = min(node.first, y.first), max(node.last, y.last)
        tops[a] = node
    return tops[find(0)]


def finished(spines: list[Spine], last_block: bool) -> Iterator[dict]:
    """Rows of the finished nodes, then, unless it is the last block, the contracted forest as one or two sequences."""
    if len(spines) == 1 and not last_block:
        yield spines[0].row()
        return
    top, end = forest(spines), len(spines) - 1
    is_open = lambda n: not last_block and (n.first == 0 or n.last == end)
    order, todo = [], [top]
    while todo:  # parents before children
        node = todo.pop()
        order.append(node)
        todo += node.parts
    total: dict[int, Hung] = {}  # of a node, at its own depth
    for node in reversed(order):
        own = Hung()
        own.add(node.hung)
        for part in node.parts:
            t = total[id(part)]
            own.add(Hung(t.convs, t.least, 1, t.leaves, t.saved + spines[part.first].saved_between(node.depth, part.depth) * (t.convs - 1)))
        own.leaves += own.children == 0
        total[id(node)] = own
    named: dict[int, list[Node]] = {}  # nodes that rows refer to, or have referred to, by the first sequence below them
    for node in order:
        if is_open(node) or node.hung.children:
            named.setdefault(node.first, []).append(node)
    keys = {id(n): k[n.depth] for s, nodes in named.items() for k in [spines[s].keys(sorted({n.depth for n in nodes}))] for n in nodes}
    hung = {s: {} for s in (0, end)}
    for node in order:
        if is_open(node):
            at = hung[0 if node.first == 0 else end].setdefault(node.depth, Hung())
            at.add(node.hung)
            for part in node.parts:
                if not is_open(part):
                    t = total[id(part)]
                    at.add(Hung(t.convs, t.least, 1, t.leaves, t.saved + spines[part.first].saved_between(node.depth, part.depth) * (t.convs - 1)))
    stack = [(top, None)]
    while stack:
        node, parent = stack.pop()
        stack += [(p, node) for p in node.parts]
        if is_open(node):
            continue
        t, words = total[id(node)], spines[node.first].words
        saved, low = t.saved, parent.depth if parent is not None else -1
        known = parent is not None and not is_open(parent)
        for depth in range(node.depth, low, -1):
            bottom, above = depth == node.depth, depth == low + 1
            yield {
                "conv_id": t.least, "depth": depth, "n_convs": t.convs, "n_children": t.children if bottom else 1, "n_leaves": t.leaves, "saved_tokens": saved + (words[depth - 1] * (t.convs - 1) if depth else 0),
                "parent_conv_id": t.least if not above else total[id(parent)].least if known else None, "ends_sha256": t.ends or NO_ENDS if bottom else NO_ENDS,
                "parent_key": keys[id(parent)] if above and parent is not None and not known else None, "key": keys.get(id(node)) if bottom else None,
            }
            saved += words[depth - 1] * (t.convs - 1) if depth else 0
    if not last_block:
        for s in (0, end):
            yield Spine(spines[s].digests, spines[s].words, hung[s]).row()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict.fromkeys(ARROW.names) | r for r in rows], schema=ARROW)


def _blocks(last_block: bool, block: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, out = [], 0, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, turns, out
            for r in finished(held, last_block):
                out.append(r)
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
            held, turns = [], 0

        for b in batches:
            for at in range(0, len(b), 500):
                for r in b.slice(at, 500).to_pylist():
                    hung = {d: Hung(*x) for d, *x in zip(*(r[c] for c in _SPINE[2:]), strict=True)}
                    held.append(Spine(b"".join(r["seq"]), r["words"], hung))
                    turns += len(r["words"]) + 1
                    if not last_block and (len(held) >= block or turns >= BLOCK_TURNS):
                        yield from done()
        if held:
            yield from done()
        yield _batch(out)

    return each


# the sequences


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, own (digest and words of each turn, in order)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SIZE))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")).alias("one"))
    sorted_turns = F.transform(F.sort_array(F.collect_list("one")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(sorted_turns.alias("own"))


def rebuilt(arrays: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, own: the first h turns of conversation c - c % group, then c's own turns after its first h; h = crc32(c) % heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = arrays.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("own", 1, heads - 1).alias("_head"))
    both = arrays.withColumn("_of", F.col("conv_id") - F.col("conv_id") % group).join(first, F.col("_of") == F.col("_base"), "left")
    none = F.filter("own", lambda x: F.lit(False))
    head = F.when(h > 0, F.slice(F.coalesce("_head", none), F.lit(1), h)).otherwise(none)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("own"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq_id, conv_id) in order -> one row of a sequence, with its digest; of sequences that may go on in another partition
    the ids as texts of RUN ids each."""
    names, first, now, ids, least, n, out = ["seq_id", "least", "convs", "part", "ids", "sha256"], True, None, [], None, 0, []
    part = TaskContext.get().partitionId() << 32

    def text() -> None:
        nonlocal part, ids
        out.append((now, ids[0], len(ids), part, ",".join(map(str, ids)), None))
        part, ids = part + 1, []

    def end(open_: bool) -> None:
        if open_ or n > len(ids):
            text()
        else:
            out.append((now, ids[0], n, None, None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    for b in batches:
        for seq_id, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if seq_id != now:
                if ids:
                    end(first)
                first, now, ids, n = first and now is None, seq_id, [], 0
            elif len(ids) >= RUN:
                text()
            ids.append(conv_id)
            n += 1
        yield batch()
    if ids:
        end(True)
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of ids in order of sequence and part -> one row of a sequence."""
    now, sha, least, n, out = None, None, None, 0, []
    for b in batches:
        for seq_id, low, convs, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if seq_id != now:
                if now is not None:
                    out.append((now, least, n, sha.hexdigest()))
                now, sha, least, n = seq_id, hashlib.sha256(), low, 0
            sha.update((("," if n else "") + ids).encode())
            n += convs
    if now is not None:
        out.append((now, least, n, sha.hexdigest()))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["seq_id", "least", "convs", "sha256"])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """seq_id, least conv_id, number of conversations and digest of their ids, of each distinct sequence. A sequence that a
    third of all conversations share is read by many tasks; only its ids' texts, RUN ids each, are then hashed in order."""
    ids = sequences.select("seq_id", "conv_id").repartitionByRange("seq_id", "conv_id").sortWithinPartitions("seq_id", "conv_id")
    runs = materialise(ids.mapInArrow(_runs, "seq_id binary, least bigint, convs bigint, part bigint, ids string, sha256 string"), "trie-runs")
    pieces = runs.where("part IS NOT NULL").repartition("seq_id").sortWithinPartitions("seq_id", "part").select("seq_id", "least", "convs", "ids")
    whole = pieces.mapInArrow(_digests, "seq_id binary, least bigint, convs bigint, sha256 string")
    return runs.where("part IS NULL").select("seq_id", "least", "convs", "sha256").unionByName(whole)


def trie_nodes(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of sequences(conv_id, own array<struct<digest, words>>): one row per node, columns as in the query."""
    block = max(block, 4)  # a block leaves two sequences at most, so each level has fewer of them
    named = sequences.withColumn("seq_id", F.unhex(F.substring(F.sha2(F.coalesce(F.aggregate("own", F.unhex(F.lit("")), lambda a, t: F.concat(a, t["digest"])), F.unhex(F.lit(""))), 256), 1, 2 * SIZE)))
    stored = materialise(named, "trie-sequences")
    distinct = distinct_sequences(stored)
    one: Column = F.lit(0).cast("bigint")
    spines = stored.join(distinct.select("least", "convs", "sha256"), F.col("conv_id") == F.col("least")).select(
        F.col("own.digest").alias("seq"), F.col("own.words").alias("words"), F.array(F.size("own").cast("bigint")).alias("depths"), F.array("convs").alias("convs"), F.array("least").alias("least"),
        F.array(one).alias("children"), F.array(one).alias("leaves"), F.array(one).alias("saved"), F.array("sha256").alias("ends"),
    )
    found, left = [], None
    while left is None or left > 1:
        last_block = left is not None and left <= block
        order = spines.coalesce(1) if last_block else spines.repartitionByRange("seq") if left is None else spines.repartitionByRange(-(-left // block), "seq")
        level = materialise(order.sortWithinPartitions("seq").mapInArrow(_blocks(last_block, block), f"{NODE}, {SPINE}"), "trie-level")
        found.append(level.where("depth IS NOT NULL").select(*_NODE))
        spines = level.where("seq IS NOT NULL").select(*_SPINE)
        if last_block:
            break
        left = spines.count()
        if left == 0:
            break
        left = max(left, 2)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), F.col("n_children").alias("weight"))
    columns = [c for c in _NODE if c not in ("parent_conv_id", "parent_key", "key")]
    waiting = spread_join(nodes.where("parent_key IS NOT NULL"), parents, "parent_key", "weight", "conv_id").select(*columns, F.col("above").alias("parent_conv_id"))
    return nodes.where("parent_key IS NULL").select(*columns, "parent_conv_id").unionByName(waiting)


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) as they are."""
    return trie_nodes(turn_arrays(conversations), block)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the trie of the rebuilt conversations."""
    return trie_nodes(rebuilt(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
