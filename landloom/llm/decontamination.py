"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Items are partitioned by their number of shingles. An item's MinHash sketch holds its smallest shingle hashes, as many
as its partition's bound on missed shingles asks for, so every document that contains the item meets a known number of
them: the search loses nothing, and one shared phrase makes no candidate. Documents' shingle hashes are probed against
the sketches of the partitions that the document can hold, whatever its length; candidates are verified by the exact
share of the item's shingles that the document contains, shingle texts compared.

Defined cases: letter case A-Z is ignored; an item of fewer words than a shingle is one shingle of its words; null or
wordless items are never found, null or wordless texts contain nothing; items of equal words are searched as one, under
the smallest id; rows of one document id are verified each and the best is shown (the filter judges each row); an empty table gives no rows; columns
other than ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialise, text_key

SHINGLE = 5
CONTAINMENT = 0.8
#: Hashes of a sketch beyond those that a containing document may miss.
MORE = 2
#: A sketch table of more rows than this is joined by shuffle, not broadcast.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_texts(words: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")))


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, copies, size (words of a shingle), shingles, n, part, reach, sketch, need.

    part is the size partition, floor(log2 n). A containing document misses missed(n) = n - ceil(containment n) of an
    item's shingles at most. Sketches of a partition have one size, that of missed() at the partition's upper end and
    MORE: so a containing document meets `need` of the sketch at least, and has `reach` words' places at least.
    """
    words = items.select(F.col(id_col).cast("bigint").alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    one = words.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))
    sized = one.withColumn("size", F.least(F.lit(shingle), F.size("words"))).withColumn("shingles", shingle_texts(F.col("words"), F.col("size")))
    least = lambda n: F.ceil(F.lit(containment) * n - 1e-9).cast("int")
    sized = sized.withColumn("n", F.size("shingles")).withColumn("part", F.floor(F.log2("n") + 1e-9).cast("int"))
    low = F.pow(F.lit(2), F.col("part")).cast("int")
    most = 2 * low - 1
    sized = sized.withColumn("reach", least(low)).withColumn("k", F.least(F.col("n"), most - least(most) + MORE))
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    need = F.col("k") - (F.col("n") - least(F.col("n")))
    return sized.select("item_id", "copies", "size", "shingles", "n", "part", "reach", F.slice(hashes, F.lit(1), F.col("k")).alias("sketch"), need.alias("need"))


def _contained(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, shingle: int, containment: float) -> DataFrame:
    """doc_id, h1, h2 (the text), item_id, item_copies, item_shingles, shared for each item that a row's text contains."""
    sketches = materialise(item_sketches(items, shingle=shingle, containment=containment), "item-sketches")
    parts = sketches.groupBy("size", "part", "reach").count().orderBy("size", "part").collect()  # a row for each size partition: shingle * 31 at most
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *text_key(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = ["doc_id", "h1", "h2"]
    words = rows.select(*key, F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+").alias("w"))
    met = None
    for size in sorted({p["size"] for p in parts}):
        # one pass over the texts for all partitions of a shingle size; a document is searched only for partitions whose items it can hold
        least = min(p["reach"] for p in parts if p["size"] == size)
        keys = sketches.where(F.col("size") == size).select("item_id", "part", "reach", "need", F.explode("sketch").alias("h"))
        keys = F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
        each = words.where(F.size("w") >= size + least - 1).select(*key, "w", (F.size("w") - size + 1).alias("places"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i"))
        text = F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(size)])
        found = each.select(*key, "places", F.xxhash64(text).alias("h")).join(keys, "h").where("places >= reach").select(*key, "item_id", "need", "h")
        met = found if met is None else met.union(found)
    if met is None:
        return rows.select(*key, F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("item_copies"), F.lit(0).alias("item_shingles"), F.lit(0).alias("shared")).limit(0)
    hits = met.groupBy(*key, "item_id", "need").agg(F.count_distinct("h").alias("hits")).where("hits >= need")
    candidates = materialise(hits.select(*key, "item_id").distinct(), "contained-candidates")
    wanted = candidates.select(*key).distinct().withColumnsRenamed({k: f"_{k}" for k in key})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    texts = rows.join(wanted, same, "left_semi").select(*key, words_of(F.col("text")).alias("words")).dropDuplicates(key)
    # each text's shingles once, matched to the items' by the shingle itself
    sizes = sorted({p["size"] for p in parts})
    made = F.array(*[F.struct(F.lit(s).alias("size"), F.when(F.size("words") >= s, shingle_texts(F.col("words"), F.lit(s))).otherwise(F.array().cast("array<string>")).alias("own")) for s in sizes])
    own = texts.select(*key, F.explode(made).alias("m")).select(*key, "m.size", F.explode("m.own").alias("s"))
    known = sketches.select("item_id", F.col("copies").alias("item_copies"), F.col("n").alias("item_shingles"), "size", F.explode("shingles").alias("s"))
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    shared = own.join(known, ["size", "s"]).groupBy(*key, "item_id", "item_copies", "item_shingles").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    return shared.where(F.col("shared") >= containment * F.col("item_shingles") - 1e-9)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, item_copies, item_shingles, shared, containment for each item that a document contains."""
    found = _contained(docs, items, id_col, text_col, shingle, containment)
    best = found.groupBy("doc_id", "item_id", "item_copies", "item_shingles").agg(F.max("shared").alias("shared"))
    return best.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The rows whose text contains no item, all columns kept; a row is judged by its own text, whatever its id."""
    found = _contained(docs, items, id_col, text_col, shingle, containment).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    h1, h2 = text_key(F.col(text_col))
    return docs.join(found, (h1 == F.col("_h1")) & (h2 == F.col("_h2")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every benchmark item that a document contains."""
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT min(item_id) AS item_id, CAST(count(*) AS BIGINT) AS copies, w, CAST(least(5, len(w)) AS INTEGER) AS k FROM w WHERE len(w) > 0 GROUP BY w),
s AS (SELECT item_id, copies, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')))) AS g FROM i),
n AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM s),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
SELECT e.doc_id, n.item_id, n.copies AS item_copies, CAST(max(n.n) AS INTEGER) AS item_shingles, CAST(count(*) AS INTEGER) AS shared, count(*)::DOUBLE / max(n.n) AS containment
FROM e JOIN n ON e.k = n.k AND e.g = n.g GROUP BY e.doc_id, n.item_id, n.copies HAVING count(*)::DOUBLE / max(n.n) >= 0.8 - 1e-9
"""
