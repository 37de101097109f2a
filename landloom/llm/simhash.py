"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint takes the majority of each bit over its shingles' hashes. Distinct fingerprints are indexed in
two tables, one for each 32-bit segment. Each fingerprint enumerates the Hamming ball of radius 1 around its own
segments, fetches the tables' matches by an equi-join and verifies the complete distance; segments that many
fingerprints share are split by their other segment. Links are joined into components. Exact copies share a fingerprint
and are one node.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; fewer words than a shingle
make one shingle; equal halves leave a bit 0; null ids never become a component's id unless it has no other; repeated
rows each get their row; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, materialise, release, small_broadcasts, spread_join, text_key

SHINGLE = 3
SEED = 42
#: Segments of a fingerprint and their bits; within MAX_BITS of each other, two fingerprints differ in one bit at most in some segment.
SEGMENTS, WIDTH = 2, 32
MAX_BITS = 2
#: A segment that more fingerprints share is split by the other segment.
CROWD = 64
#: A list of more split segments than this is joined by shuffle, not broadcast.
BROADCAST_CROWDED = 100_000


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `size` lower-cased words, repeats included."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(size)), strict=False) if len(words) > size else [words]
    return np.array([digest(join(r), seed) for r in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp (signed view of the 64-bit fingerprint) of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [majority(shingle_hashes(x.as_py(), shingle, seed)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).mapInArrow(each, "id bigint, fp bigint")


def segment_of(fp, table):
    """The 32 bits that are a table's segment, and the other 32."""
    high, low = F.shiftrightunsigned(fp, WIDTH), fp.bitwiseAND(F.lit((1 << WIDTH) - 1))
    return F.when(table == 0, high).otherwise(low), F.when(table == 0, low).otherwise(high)


def ball(value) -> object:
    """The value and every value one bit away, of WIDTH bits."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """nodes(fp), distinct -> a, b: all pairs of fingerprints within MAX_BITS of each other.

    Two fingerprints within two bits agree in one of the two segments but for a bit. Table s lists fingerprints by
    segment s; each fingerprint looks up the members of the ball around its own segment. A segment that more than
    `crowd` fingerprints share is split by the other segment: its entries are listed under each member of the ball
    around that one, and a look-up, which has one or two bits left, names the other segment itself or its ball's members. No
    bucket then holds more than 33 for each look-up, whatever is indexed. Look-ups and entries meet by shuffle: Spark sizes
    them as if nothing had been exploded.
    """
    tabled = nodes.select("fp", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("tab"))
    segment, other = segment_of(F.col("fp"), F.col("tab"))
    index = tabled.select("fp", "tab", segment.alias("segment"), other.alias("other"))
    crowded = materialise(index.groupBy("tab", "segment").count().where(F.col("count") > crowd).select("tab", "segment", F.lit(True).alias("split")), "crowded-segments")
    small = crowded.limit(BROADCAST_CROWDED + 1).count() <= BROADCAST_CROWDED
    known = F.broadcast(crowded) if small else crowded.hint("merge")
    none = F.array(F.lit(-1).cast("bigint"))
    entries = index.join(known, ["tab", "segment"], "left").withColumn("rest", F.explode(F.when(F.col("split"), ball(F.col("other"))).otherwise(none)))
    probes = index.select("fp", "tab", "other", F.posexplode(ball(F.col("segment"))).alias("flipped", "segment"))
    left = F.when(F.col("flipped") == 0, ball(F.col("other"))).otherwise(F.array("other"))
    probes = probes.join(known, ["tab", "segment"], "left").withColumn("rest", F.explode(F.when(F.col("split"), left).otherwise(none)))
    met = probes.select("tab", "segment", "rest", "fp").join(entries.select("tab", "segment", "rest", F.col("fp").alias("found")).hint("merge"), ["tab", "segment", "rest"])
    return met.where((F.col("fp") < F.col("found")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("found"))) <= MAX_BITS)).select(F.col("fp").alias("a"), F.col("found").alias("b"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp, component_id (smallest id of the component) of each row."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    rooted = components(links(nodes.select("fp")))
    named = nodes.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialise(named.select("fp", "root", "n").join(smallest, "root").select("fp", "n", "component_id"), "fingerprint-classes")
    return spread_join(prints, classes, "fp", "n", "id").select("id", "fp", "component_id")


#: Near-duplicates by shingle similarity, found exactly. SimHash links texts first: fingerprints within MAX_BITS, found by the
#: multi-index tables, whose texts an exact comparison confirms. Similar texts whose fingerprints are further apart are found
#: by their shingles: put in one order, about rarest first, two texts of that similarity share one of their first
#: n - ceil(least * n) + 1 shingles, whatever their length or the number of texts.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8
#: Longs of a text's parity map: each shared shingle flips one bit, so two maps differ in no more bits than shingles.
MAP_LONGS = 8
#: Texts of a crowded key that meet in one block of pairs.
BLOCK = 2000
#: Parts of the keys, after each of which the links found are joined, before pairs are made by blocks.
TURNS = 4
#: Keys before a text's key that tell whether a pair has met already.
EARLIER = 8
#: Slots in which texts' shingles are counted; a shingle of many texts stands out from its slot's mean. MERGED tasks' counts meet.
SLOTS, MERGED = 1 << 20, 16
#: Bits of the map of texts worth a whole look, of fixed size: where texts outgrow it, it drops fewer of them, none wrongly.
WORTH_BITS, PAGE_BITS = 1 << 26, 1 << 15
_EPS = 1e-9


def _digest(words: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(words)[:8], "little", signed=True)


def _nodes(rows: DataFrame, shingle: int) -> DataFrame:
    """id, h1, h2, node (digest of the words), fp (SimHash fingerprint over the shingles; null without words) of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, fps = [], []
            for text in b.column(3):
                words = _words(text)
                found.append(_digest(b" ".join(words)))
                fps.append(majority(_shingles(words, shingle)) if words else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.int64()), pa.array(fps, pa.int64())], names=["id", "h1", "h2", "node", "fp"])
        release()

    return rows.mapInArrow(each, "id bigint, h1 bigint, h2 bigint, node bigint, fp bigint")


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_py().lower().split()


def _needed(n: int, least: float) -> int:
    """Shingles a text of n must share with a partner."""
    return math.ceil(least * n - _EPS)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """64-bit hash of each run of `shingle` words (fewer words: of all), repeats included: words are hashed one by one, runs all at once."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(words))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = len(words) - size + 1
    out = each[:runs] + np.uint64(size)
    for i in range(1, size + 1):
        out *= _MIX
        out ^= out >> np.uint64(29)
        if i < size:
            out += each[i : i + runs]
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """A text's distinct shingle hashes, in order."""
    out = _shingles(words, shingle)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def _commonness(rows: DataFrame, shingle: int) -> np.ndarray:
    """How many texts hold a shingle of each slot, summed over all rows. Vectors of fixed size meet MERGED at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out = np.zeros(SLOTS, np.uint32)
        for b in batches:
            for text in b.column(1):
                words = _words(text)
                node = _digest(b" ".join(words))
                if node not in seen:
                    seen.add(node)
                    np.add.at(out, (_hashes(words, shingle) % np.uint64(SLOTS)).astype(np.int64), 1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "flat"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SLOTS, np.uint32)
        for flat in pdf["flat"]:
            out += np.frombuffer(flat, np.uint32)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // MERGED], "flat": [out.tobytes()]})

    parts, count = rows.mapInArrow(each, "part int, flat binary"), rows.rdd.getNumPartitions()
    while count > 1:
        parts, count = parts.groupBy(F.expr(f"part div {MERGED}")).applyInPandas(merge, "part int, flat binary"), -(-count // MERGED)
    found = parts.collect()  # one vector
    return np.frombuffer(found[0].flat, np.uint32) if found else np.zeros(SLOTS, np.uint32)


def _prefix_rows(rows: DataFrame, shingle: int, least: float, common) -> DataFrame:
    """key, node, n (distinct shingles), i (its place) of each of the first n - needed + 1 shingles of each text, in the order
    of how common their slot is, then of their hashes; copies in one task give theirs once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes, sizes, keys, held = [], [], [], 0
        for b in batches:
            for text in b.column(1):
                words = _words(text)
                node = _digest(b" ".join(words))
                if node in seen:
                    continue
                seen.add(node)
                own = _hashes(words, shingle)
                if len(own):
                    rank = common.value[(own % np.uint64(SLOTS)).astype(np.int64)]
                    nodes.append(node)
                    sizes.append(len(own))
                    keys.append(own[np.argsort(rank, kind="stable")[: len(own) - _needed(len(own), least) + 1]].view(np.int64))
                    held += len(keys[-1])
                if held > 200_000:
                    yield _exploded(nodes, sizes, keys)
                    nodes, sizes, keys, held = [], [], [], 0
        yield _exploded(nodes, sizes, keys)
        release()

    return rows.mapInArrow(each, "key bigint, node bigint, n int, i int")


def _exploded(nodes: list[int], sizes: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
    each = np.array([len(k) for k in keys], np.int64)
    flat, place = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in each)])
    return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(nodes, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(place)], names=["key", "node", "n", "i"])


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows of keys that two texts or more have; a text's row once."""
    under = Window.partitionBy("key")
    bounds = prefixes.withColumn("least", F.min("node").over(under)).withColumn("most", F.max("node").over(under))
    return bounds.where("least <> most").select("key", "node", "n", "i").distinct()


def _worth(keys: DataFrame) -> np.ndarray:
    """A map of the texts that have a key: others need not be looked at. Its size follows the texts' number up to WORTH_BITS;
    where texts outgrow that, it drops fewer of them, none wrongly."""
    texts = keys.agg(F.approx_count_distinct("node")).first()[0]
    size = min(WORTH_BITS, max(PAGE_BITS, 1 << (16 * texts).bit_length()))
    slots = keys.select(F.pmod("node", F.lit(size)).alias("slot")).distinct()
    page, at = F.floor(F.col("slot") / PAGE_BITS).alias("page"), (F.col("slot") % PAGE_BITS).alias("at")
    pages = slots.select(page, at).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).collect()  # WORTH_BITS at most
    out = np.zeros(size // 8, np.uint8)
    for r in pages:
        out[r.page * PAGE_BITS // 8 : (r.page + 1) * PAGE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    del pages
    release()
    return out


def _marked(found: np.ndarray, node: int) -> bool:
    slot = node % (len(found) << 3)
    return bool(found[slot >> 3] >> (slot & 7) & 1)


def _maps(rows: DataFrame, shingle: int, worth) -> DataFrame:
    """node, n (distinct shingles), map of each text in the map `worth`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            found = []
            for text in b.column(1):
                words = _words(text)
                node = _digest(b" ".join(words))
                if node not in seen and _marked(worth.value, node):
                    seen.add(node)
                    keys = _hashes(words, shingle)
                    bits = np.bincount((keys % np.uint64(64 * MAP_LONGS)).astype(np.int64), minlength=64 * MAP_LONGS) % 2
                    found.append((node, len(keys), np.packbits(bits.astype(np.uint8)).view("<i8")))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), _lists([f[2] for f in found])], names=["node", "n", "map"])
        release()

    return rows.mapInArrow(each, "node bigint, n int, map array<bigint>").dropDuplicates(["node"])


def _sets(rows: DataFrame, shingle: int, wanted) -> DataFrame:
    """node, n, keys (all shingle hashes, in order) of each text in the map `wanted`: made anew for the texts of a step,
    so that no table holds the sets of all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            found = []
            for text in b.column(1):
                words = _words(text)
                node = _digest(b" ".join(words))
                if node not in seen and _marked(wanted.value, node):
                    seen.add(node)
                    found.append((node, _hashes(words, shingle).view(np.int64)))
                if len(found) >= 500:
                    yield _sets_batch(found)
                    found = []
            yield _sets_batch(found)
        release()

    return rows.mapInArrow(each, "node bigint, n int, keys array<bigint>").dropDuplicates(["node"])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int32()), _lists([f[1] for f in found])], names=["node", "n", "keys"])


def _possible(a, b, least: float):
    """Whether two texts under a key may be similar: by their sizes, what can follow the key, and their maps; no pair that is similar fails."""
    total = a["n"] + b["n"]
    sizes = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * least - _EPS
    follow = F.least(a["n"] - a["i"], b["n"] - b["i"]) >= total * (least / (1 + least)) - _EPS
    differ = F.aggregate(F.zip_with(a["map"], b["map"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return sizes & follow & (differ <= total * ((1 - least) / (1 + least)) + _EPS)


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """a, b: the roots (ra, rb) of the pairs (a, b) whose similarity is at least `least`; rows hold the texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            sides = [(b.column(f"k{s}"), b.column(f"n{s}").to_pylist()) for s in "ab"]
            for i in range(len(b)):
                x, y = (k[i].values.to_numpy() for k, _ in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both / (sides[0][1][i] + sides[1][1][i] - both) >= least)
            yield pa.RecordBatch.from_arrays([b.column("ra"), b.column("rb")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
        release()

    pairs = materialise(pairs.select("a", "b", "ra", "rb").distinct(), "near-pairs")
    wanted = rows.sparkSession.sparkContext.broadcast(_worth(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))))  # of fixed size
    texts = _sets(rows, shingle, wanted)
    side = lambda s: texts.select(F.col("node").alias(s), F.col("keys").alias(f"k{s}"), F.col("n").alias(f"n{s}"))
    good = materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(each, "a bigint, b bigint"), "near-links")
    wanted.destroy()
    discard(pairs)
    return good


def fingerprint_pairs(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """prints(node, fp) -> a, b: texts whose fingerprints are within MAX_BITS, by the multi-index tables.

    A fingerprint's first text stands for it: its other texts meet that one, and the first texts of linked fingerprints meet.
    Of a fingerprint's links to smaller ones two are taken, the least and the largest, so a group in which all
    fingerprints are linked makes two pairs for each.
    """
    texts = prints.where("fp IS NOT NULL").select("node", "fp")
    firsts = materialise(texts.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
    same = texts.distinct().join(firsts, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    linked = links(firsts.select("fp"), crowd).groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    linked = linked.select("b", F.explode(F.array_distinct(F.array("low", "high"))).alias("a"))
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    met = linked.join(side("a"), "a").join(side("b"), "b")
    return same.union(met.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))


def fingerprint_roots(prints: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """node, root of the texts that SimHash links to another and whose similarity is at least `least`."""
    pairs = fingerprint_pairs(prints)
    return components(_verified(pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")}), rows, shingle, least))


def similar_roots(keys: DataFrame, maps: DataFrame, rows: DataFrame, shingle: int, least: float, roots: DataFrame) -> DataFrame:
    """keys(key, node, n, i), stored, maps(node, n, map), stored, rows, which hold the texts, and roots, what SimHash linked
    -> node, root of each text that another is similar to; root is their smallest node.

    First, under keys whose texts are in several components, each text meets one other: the text that comes first under most of its keys. Then, under keys whose texts are
    in several components, each meets the first one and the one before it; then, under keys that still hold several
    components, each meets a neighbour in an order that differs from key to key, by TURNS parts of the keys; and under
    keys that even then hold several components, all pairs of texts of different components, by blocks; a pair that shares one of the EARLIER keys before
    this one in both texts has met there and isn't made again. So each possible pair is compared or already
    linked, and a family in which all pairs are similar makes about one comparison for each text. Between the steps the
    components found so far stand for their texts.
    """
    maps = maps.select("node", "map")
    whole = ["node", "n", "i"]
    follow_free = f"least(x.n, y.n) >= greatest(x.n, y.n) * {least} - {_EPS} AND least(x.n - x.i, y.n - y.i) >= (x.n + y.n) * {least / (1 + least)} - {_EPS}"  # sizes, and what can follow the key

    def checked(once: DataFrame) -> DataFrame:
        """once(a, b, x, y): texts met under a key, each pair once."""
        mapped = once.join(maps.withColumnsRenamed({"node": "a", "map": "ma"}), "a").join(maps.withColumnsRenamed({"node": "b", "map": "mb"}), "b")
        x, y = ({c: F.col(f"{s}.{c}") for c in ("n", "i")} | {"map": F.col(m)} for s, m in (("x", "ma"), ("y", "mb")))
        roots = [F.col(f"{s}.root").alias(f"r{t}") for s, t in (("x", "a"), ("y", "b"))]
        return _verified(mapped.where(_possible(x, y, least)).select("a", "b", *roots), rows, shingle, least)

    def unsettled(roots: DataFrame) -> DataFrame:
        """Keys whose texts are in several components."""
        of = roots.withColumnsRenamed({"node": "of"})
        rooted = keys.join(of, F.col("node") == F.col("of"), "left").select("key", *whole, F.coalesce("root", "node").alias("root"))
        under = Window.partitionBy("key")
        return rooted.withColumn("least", F.min("root").over(under)).withColumn("most", F.max("root").over(under)).where("least <> most").drop("least", "most")

    def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
        """roots, after components of roots were joined: more(node, root) names some of them."""
        both = roots.join(more.withColumnsRenamed({"node": "of", "root": "top"}), F.col("root") == F.col("of"), "full")
        return materialise(both.select(F.coalesce("node", "of").alias("node"), F.coalesce("top", "root").alias("root")), "near-roots")

    under = Window.partitionBy("key").orderBy("n", "node")
    entry = F.struct(*whole, "root")
    met = unsettled(roots).select(entry.alias("y"), F.first(entry).over(under).alias("x")).where("x.root <> y.root").where(follow_free)
    once = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.first("x").alias("x"), F.first("y").alias("y"))
    best = once.groupBy("b").agg(F.max_by(F.struct("a", "x", "y"), F.struct("times", "a")).alias("m")).select("m.a", "b", "m.x", "m.y")
    roots = merged(roots, components(checked(best)))
    rest = materialise(unsettled(roots), "near-unsettled")
    beside = rest.select(entry.alias("y"), F.array(F.first(entry).over(under), F.lag(entry).over(under)).alias("xs")).select("y", F.explode("xs").alias("x")).where("x.root <> y.root").where(follow_free)
    once = beside.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    roots = merged(roots, components(checked(once)))
    discard(rest)
    last = materialise(unsettled(roots), "near-unsettled")
    for turn in range(TURNS):
        if last.isEmpty():
            return roots
        shuffled = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"))
        dealt = last.where(F.pmod(F.xxhash64("key"), F.lit(TURNS)) == turn).select(entry.alias("y"), F.lag(entry).over(shuffled).alias("x"))
        beside = dealt.where("x.root <> y.root").where(follow_free)
        lower = F.col("x.node") < F.col("y.node")
        first, second = F.when(lower, F.col("x")).otherwise(F.col("y")), F.when(lower, F.col("y")).otherwise(F.col("x"))
        beside = beside.select(first.alias("x"), second.alias("y"))
        once = beside.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.first("x").alias("x"), F.first("y").alias("y"))
        roots = merged(roots, components(checked(once)))
        discard(last)
        last = materialise(unsettled(roots), "near-unsettled")
    if last.isEmpty():
        return roots
    before = Window.partitionBy("node").orderBy("i").rowsBetween(-EARLIER, -1)
    placed = last.withColumn("place", F.row_number().over(under)).withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    placed = placed.withColumn("earlier", F.collect_list("key").over(before)).join(maps, "node")
    placed = materialise(placed, "near-placed")
    discard(keys, last)
    left = placed.select("key", "block", F.struct(*whole, "root", "map", "place", "earlier").alias("x"))
    right = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"), F.struct(*whole, "root", "map", "place", "earlier").alias("y"))
    x, y = ({c: F.col(f"{s}.{c}") for c in ("n", "i", "map")} for s in "xy")
    other = (left["block"] == right["block"]) & (left["key"] == right["key"]) & (F.col("x.place") < F.col("y.place")) & (F.col("x.root") != F.col("y.root")) & ~F.arrays_overlap("x.earlier", "y.earlier")
    crossed = left.join(right, other & _possible(x, y, least)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))
    return merged(roots, components(_verified(crossed, rows, shingle, least)))


def _winners(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """prints(id, h1, h2, node) of each row, and node, n (rows), win (the first of its class: smallest id, nulls last)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), *text_key(F.col(text_col)), text.alias("text"))
    prints = materialise(_nodes(rows, shingle), "near-prints")
    rows = rows.select("id", "text")
    linked = fingerprint_roots(prints, rows, shingle, least)
    prints = prints.drop("fp")
    context = docs.sparkSession.sparkContext
    common = context.broadcast(_commonness(rows, shingle))  # of fixed size, as is worth
    keys = materialise(_shared(_prefix_rows(rows, shingle, least, common)), "near-keys")
    worth = context.broadcast(_worth(keys))
    maps = materialise(_maps(rows, shingle, worth), "near-maps")
    common.destroy()
    worth.destroy()
    rooted = similar_roots(keys, maps, rows, shingle, least, linked)
    same = prints.groupBy("node", "id", "h1", "h2").agg(F.count(F.lit(1)).alias("same"))
    nodes = same.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2", "same")).alias("first"), F.sum("same").alias("n"))
    named = nodes.join(rooted.withColumnsRenamed({"node": "of"}), F.col("node") == F.col("of"), "left").select("node", "n", "first", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "near-nodes")
    discard(maps)
    smallest = named.groupBy("root").agg(F.min("first").alias("win"))
    return prints, materialise(named.select("node", "n", "root").join(smallest, "root").select("node", "n", "win"), "near-winners")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, least: float = NEAR_SIMILARITY) -> DataFrame:
    """id, component_id (smallest id of the class) of each row: components of texts whose shingles have that similarity or more."""
    prints, winners = _winners(docs, id_col, text_col, shingle, least)
    return spread_join(prints, winners, "node", "n", "id").select("id", F.col("win.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, least: float = NEAR_SIMILARITY) -> DataFrame:
    """One row of each class, all columns kept: the smallest id (nulls last), of rows of that id one text, of rows of that
    id and text one."""
    prints, winners = _winners(docs, id_col, text_col, shingle, least)
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")
    judged = spread_join(prints, winners, "node", "n", "id").select("id", "h1", "h2", (~key.eqNullSafe(F.struct("win.no_id", "win.id", "win.h1", "win.h2"))).alias("goes"))
    names = {"id": "_id", "h1": "_g1", "h2": "_g2"}
    gone = judged.where("goes").select("id", "h1", "h2").distinct().withColumnsRenamed(names)
    h1, h2 = text_key(F.col(text_col))
    keyed = docs.withColumns({"_h1": h1, "_h2": h2})
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    kept = keyed.join(gone, same, "left_anti")
    again = winners.where("win.same > 1").select("win.id", "win.h1", "win.h2").distinct().withColumnsRenamed(names)
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, "_h1", "_h2"]))
    return kept.drop("_h1", "_h2")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: fingerprint and component of every document."""
    small_broadcasts(spark)
    found = near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
