"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temp folder in local mode (tests) and an error on a cluster, whose
    machines would each see a folder of their own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="landloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df in parts of about so many rows: for rows that make much work, since a small file is one task however many rows it has."""
    return df.repartition(max(1, -(-df.count() // rows)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder once and reads it back: lineage is cut and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "uncompressed").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes what materialise wrote, once no result that is still to be computed reads it."""
    for df in stored:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class StateTable:
    """A keyed table in shared storage: rows by bucket of their key, a bucket's content by the epoch that wrote it last.

    An epoch rewrites only the buckets that it touches, in new folders, then names all current folders in one manifest,
    which is renamed into place. A replayed epoch starts from the manifest before it and writes the same again; readers
    see a whole epoch or none of it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """bucket -> epoch of the last manifest, or of the last one before an epoch."""
        fs, p = self._fs("manifests")
        if not fs.exists(p):
            return {}
        found = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()]
        found = [n for n in found if before is None or n < before]
        if not found:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{max(found)}").first()[0]
        return {int(b): e for b, e in json.loads(text).items()}

    def _commit(self, epoch: int, current: dict[int, int]) -> None:
        fs, temporary = self._fs(f"manifests/.{epoch}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(current).encode()))
        out.close()
        _, final = self._fs(f"manifests/{epoch}")
        if fs.exists(final):
            fs.delete(final, False)
        fs.rename(temporary, final)

    def _rows(self, current: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/epoch={e}/bucket={b}" for b, e in sorted(current.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._manifest())

    def next_epoch(self) -> int:
        """A number above those of all commits, for a writer that counts none itself."""
        fs, p = self._fs("manifests")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=-1) + 1 if fs.exists(p) else 0

    def merge(self, news: DataFrame, epoch: int, merged) -> None:
        """merged(old rows, news) gives the new rows of the keys of both; buckets without news stay as they are."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias("bucket")
        touched = {r.bucket for r in news.select(bucket).distinct().collect()}  # `buckets` at most
        if not touched:
            return
        before = self._manifest(epoch)
        old = self._rows({b: e for b, e in before.items() if b in touched})
        rows = merged(old, news)
        names = [x.split(" ")[0] for x in self.schema.split(", ")]
        rows.select(*names, bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "uncompressed").parquet(f"{self.path}/rows/epoch={epoch}")
        self._commit(epoch, before | dict.fromkeys(touched, epoch))
