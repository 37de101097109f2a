"""What the operators of this subpackage share: shared-storage tables, text keys and two-level running sums."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise, new_path

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "discard", "materialise", "new_path", "release", "running_sum", "small_batches", "small_broadcasts", "spread_join", "text_key"]

#: A word: a run of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> list[Column]:
    """h1, h2: 128 bits that stand for a text, so that rows of one id with different texts are told apart."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit("second"), whole).alias("h2")]


#: Rows and bytes of an Arrow batch of whole texts: the JVM and the Python worker each hold some of them for each task.
BATCH_ROWS, BATCH_SIZE = 2000, "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands whole texts to Python workers in batches of bounded bytes, however long the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_SIZE)


#: Bytes by Spark's own estimate up to which it may broadcast a table unasked.
BROADCAST_BYTES = 256 << 10


def small_broadcasts(spark: SparkSession) -> None:
    """From now on the session broadcasts unasked only what it sizes at BROADCAST_BYTES or less: its estimates, by the sizes
    of files, leave out what an explode, a dictionary's codes or a hash table's entries add, all of which the driver holds."""
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_BYTES:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", BROADCAST_BYTES)


def release() -> None:
    """Gives a Python worker's free memory back to the system at a task's end: workers stay for the stages that follow."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


#: A key of more rows than this is dealt over SALTS tasks in spread_join.
HOT_ROWS, SALTS = 100_000, 64


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, spread_by: str) -> DataFrame:
    """rows joined to table, which has one row for each key and the number of its rows in `weight`; rows of hot keys are
    salted by a hash of spread_by, and their row of the table is repeated. At most rows / HOT_ROWS keys are hot: they are broadcast."""
    hot = F.broadcast(table.where(F.col(weight) > HOT_ROWS).select(F.col(key).alias("_hot")))
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).cast("int"))
    salts = F.when(F.col(weight) > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.drop("_hot").join(table.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all earlier rows of the same keys, in the order (chunk, *order).

    Chunk must rise with the wanted order. A key's rows are summed by chunk first, chunk totals are summed along the
    key, and only rows of one chunk meet in a task: a key that holds a third of all rows is spread over its chunks.
    """
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_chunk_sum"))
    along = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, chunk, F.coalesce(F.sum("_chunk_sum").over(along), F.lit(0)).alias("_chunk_start"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, [*keys, chunk]).withColumn(out, F.col("_inside") + F.col("_chunk_start")).drop("_inside", "_chunk_start")
