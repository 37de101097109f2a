"""Mixing sources to target weights by a low-discrepancy schedule.

Targets are shares of all words by source weight, none above `cap` times its source. A source's documents are shuffled
by a keyed digest, laid end to end and cut into blocks of equal word counts. Slot i of the schedule has the point
frac(i * golden ratio); the cumulative block shares map it to a source, and its rank among that source's slots names
the block, starting over when the blocks are used up. Joining slots and documents on (source, block) gives what the mix
takes of each document. A source's last slot is cut to the words still wanted, so its total is its rounded target.

Defined cases: null or wordless texts have size 0 and nothing is taken; a null source is a source of its own, after all
others; sources of size 0 have target 0; equal ids are ordered by size, repeated rows share their blocks' uses one by
one; an empty table gives an empty table; columns other than id, text and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise, running_sum, text_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Words of a block; a source has at least LEAST_BLOCKS blocks' worth of slots, so small ones get smaller blocks.
BLOCK = 4096
LEAST_BLOCKS = 64
SEED = "mix"
#: Rows of one source that meet in a task, about; a power of two of chunks is made from it.
CHUNK_ROWS = 20_000
GOLDEN = 0.6180339887498949
CELLS = 1024
#: A source table of more rows than this is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) -> sid, source, source_size, weight, target. Capped sources come first in the order of
    cap/weight; the first that its fair level leaves below its cap sets the level of all others."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("sid", F.row_number().over(by_name))
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.expr(f"(sid - 1) % {len(weights)} + 1")))
    ahead = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.lit(float(cap)) * F.sum("source_size").over(ahead), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    levels = listed.withColumn("level", level).withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    fair = F.min(F.when(F.col("top") > F.col("level") * F.col("weight"), F.struct(F.col("source_size") / F.col("weight"), F.col("sid"), F.col("level").alias("level")))).over(whole)["level"]
    return levels.select("sid", "source", "source_size", "weight", F.coalesce(F.least(F.col("top"), fair * F.col("weight")), F.col("top")).alias("target"))


def block_plan(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds take (words wanted), block (its words), blocks (in the source) and slots (wanted of the schedule)."""
    plan = targets.withColumn("take", F.floor(F.col("target") + 0.5).cast("bigint"))
    plan = plan.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("take") / LEAST_BLOCKS))).cast("bigint"))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("bigint"))
    slots = F.expr("(take div source_size) * blocks + cast(ceil((take % source_size) / block) AS bigint)")
    return plan.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0).cast("bigint")))


def schedule(plan: DataFrame) -> DataFrame:
    """slot, sid, pass, nth (block), words: the mix in order. Twice the wanted slots are drawn: the golden-ratio points
    in an interval stray from its share by far less than the LEAST_BLOCKS slots that a source has at least."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).first()[0] or 0
    along = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    shares = plan.where("slots > 0").withColumn("low", F.coalesce(F.sum("slots").over(along), F.lit(0)) / max(total, 1)).withColumn("high", F.col("low") + F.col("slots") / max(total, 1))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    points = spark.range(0, 2 * total + 8 * LEAST_BLOCKS if total else 0).withColumn("x", (F.col("id") + 1) * GOLDEN)
    points = points.select(F.col("id").alias("slot"), (F.col("x") - F.floor("x")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(cells, "cell").where("u >= low AND u < high").withColumn("chunk", F.expr(f"slot div {CHUNK_ROWS}")).withColumn("one", F.lit(1))
    ranked = running_sum(drawn, ["sid"], "chunk", ["slot"], "one", "rank").where("rank < slots")
    ranked = ranked.withColumn("pass", F.expr("rank div blocks")).withColumn("nth", F.expr("rank % blocks"))
    words = F.expr("least(block, source_size - nth * block, take - pass * source_size - nth * block)")
    return ranked.select("slot", "sid", "pass", "nth", "block", words.alias("words"))


def _mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """id, source, h1, h2 (the text), size, source_size, target, taken, first_slot of each row."""
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("order"), *text_key(F.col(text_col))), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialise(block_plan(source_targets(sizes, weights, share, cap), block), "mix-plan")
    n, sources = rows.count(), plan.count()
    bits = max(4, math.ceil(math.log2(max(1, n / CHUNK_ROWS))))
    small = plan.select("sid", F.col("source").alias("of"), "source_size", "target", "block")
    rows = rows.join(F.broadcast(small) if sources <= BROADCAST_SOURCES else small, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = running_sum(rows.where("size > 0").withColumn("chunk", F.expr(f"shiftright(order, {60 - bits})")), ["sid"], "chunk", ["order", "id", "size", "h1", "h2"], "size", "start")
    pieces = placed.withColumn("nth", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)"))).drop("block")
    used = pieces.join(schedule(plan), ["sid", "nth"], "left")
    low, high = F.greatest(F.col("start"), F.expr("nth * block")), F.least(F.expr("start + size"), F.expr("nth * block + words"))
    part = F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), high - low)).otherwise(0)
    columns = ["id", "source", "h1", "h2", "size", "source_size", "target", "taken", "first_slot"]
    taken = used.groupBy("sid", "start", *columns[:-2]).agg(F.sum(part).cast("bigint").alias("taken"), F.min(F.when(part > 0, F.col("slot"))).alias("first_slot"))
    none = {"taken": F.lit(0).cast("bigint"), "first_slot": F.lit(None).cast("bigint")}
    return taken.select(columns).unionByName(rows.where("size = 0").withColumns(none).select(columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """id, size, source_size, target, taken (words), first_slot (of the schedule, in which the mix first reads it) of each row."""
    return _mix(docs, id_col, text_col, **settings).select("id", "size", "source_size", "target", "taken", "first_slot")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken (to the nearest whole number), all columns kept, and the
    first slot of each as slot_col if that is named. Rows of one id, source and text are taken as often as they are on average."""
    found = _mix(docs, id_col, text_col, source_col, **settings).where("size > 0").groupBy("id", "source", "h1", "h2")
    found = found.agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("_times"), F.min("first_slot").alias("_slot")).where("_times > 0")
    times = found.withColumnsRenamed({"id": "_id", "source": "_source", "h1": "_h1", "h2": "_h2"})
    h1, h2 = text_key(F.col(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & (h1 == F.col("_h1")) & (h2 == F.col("_h2"))
    out = docs.join(times, same).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    slot = [F.col("_slot").alias(slot_col)] if slot_col else []
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *slot)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: what the mix takes of every document."""
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2.0::DOUBLE * sum(source_size) OVER a, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER a, 0)) AS level
      FROM w WINDOW a AS (ORDER BY source_size::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (source_size::DOUBLE / weight, sid)) AS fair FROM l WHERE 2.0::DOUBLE * source_size > level * weight),
t AS (SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, fair * weight), 2.0::DOUBLE * source_size) AS target FROM l LEFT JOIN f ON true),
b0 AS (SELECT t.*, s.sid, CAST(floor(target + 0.5) AS BIGINT) AS take FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source),
b1 AS (SELECT *, CAST(greatest(1, least(4096, take // 64)) AS BIGINT) AS block FROM b0),
b AS (SELECT *, CAST(ceil(source_size::DOUBLE / block) AS BIGINT) AS blocks FROM b1),
g AS (SELECT *, CASE WHEN source_size > 0 THEN (take // source_size) * blocks + CAST(ceil((take % source_size)::DOUBLE / block) AS BIGINT) ELSE 0 END AS slots FROM b),
h AS (SELECT *, sum(slots) OVER ()::DOUBLE AS whole, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM g WHERE slots > 0),
q AS (SELECT *, below / whole AS low, below / whole + slots / whole AS high FROM h),
u AS (SELECT i, (i + 1) * 0.6180339887498949::DOUBLE - floor((i + 1) * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(0, CAST(2 * (SELECT sum(slots) FROM g) + 512 AS BIGINT))) AS i)),
r AS (SELECT q.*, u.i, row_number() OVER (PARTITION BY sid ORDER BY u.i) - 1 AS rank FROM u JOIN q ON u.u >= q.low AND u.u < q.high),
v AS (SELECT sid, i, rank % blocks AS nth, block, least(block, source_size - (rank % blocks) * block, take - (rank // blocks) * source_size - (rank % blocks) * block) AS words FROM r WHERE rank < slots),
p AS (SELECT b0.sid, d.doc_id, d.size, t.source_size, t.target, b0.take, row_number() OVER () AS rid,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN b0 ON b0.source IS NOT DISTINCT FROM t.source),
x AS (SELECT p.rid, CAST(min(v.i) AS BIGINT) AS first_slot FROM p JOIN v ON v.sid = p.sid AND least(p.start + p.size, v.nth * v.block + v.words) > greatest(p.start, v.nth * v.block) GROUP BY p.rid)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, take) - start) + greatest(0, least(start + size, take - source_size) - start) AS BIGINT) AS taken, x.first_slot
FROM p LEFT JOIN x ON p.rid = x.rid
"""
