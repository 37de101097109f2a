"""The observation cycle as a stream: one state machine for each resource, fed by observations and run-end markers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "source_id bigint, resource_key string, event_id bigint, state string"
STATE = "sha string, last_event bigint, seen boolean"



def classify_group(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Observations of one resource in event order: seen_new, unchanged or changed; the state holds the last content."""
    sha, last, seen = state.get if state.exists else (None, -1, False)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for event, content in zip(rows["event_id"], rows["sha"], strict=True):
        now = "seen_new" if not seen else "unchanged" if content == sha else "changed"
        out.append((key[0], key[1], int(event), now))
        sha, last, seen = content, int(event), True
    state.update((sha, last, seen))
    yield pd.DataFrame(out, columns=["source_id", "resource_key", "event_id", "state"])


def observation_stream(observations: DataFrame) -> DataFrame:
    """observations(source_id, resource_key, event_id, ts, sha) stream -> classified stream."""
    return observations.groupBy("source_id", "resource_key").applyInPandasWithState(classify_group, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def crawl_state_stream(observations: DataFrame, sink) -> DataFrame:
    """Runs the sink on each micro-batch's source aggregates (last check, successes, failures); the sink upserts them."""
    from pyspark.sql import functions as F

    def upsert(batch: DataFrame, epoch: int) -> None:
        g = batch.groupBy("source_id").agg(F.max("ts").alias("last_checked"), F.max(F.when(F.col("outcome") == "ok", F.col("ts"))).alias("last_success"), F.count_if(F.col("outcome") != "ok").alias("errors"))
        sink(g, epoch)

    return observations.writeStream.foreachBatch(upsert)


def append_new(batch: DataFrame, target: str, key: str) -> None:
    """Rows whose key the target doesn't hold yet are appended; a batch that comes again adds nothing."""
    spark, fresh = batch.sparkSession, batch.dropDuplicates([key])
    try:
        known = spark.read.parquet(target).select(key).distinct()
        fresh = fresh.join(known, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    fresh.write.mode("append").parquet(target)
