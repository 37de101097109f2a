"""The observation cycle in batch, run and source state, due selection and the scheduler's tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes of an observation and what they mean for the change log.
CHANGED = ("added", "reappeared", "url_changed", "metadata_changed", "checksum_changed", "disappeared")
HOST_CAP, TICK_LIMIT = 2, 20


def classify(observations: DataFrame, keys: list[str], at: str = "ts", sha: str = "sha", tie: str = "event_id") -> DataFrame:
    """Adds state: seen_new, unchanged or changed against the previous observation of the same resource."""
    before = Window.partitionBy(*keys).orderBy(at, tie)
    last = F.lag(sha).over(before)
    first = F.row_number().over(before) == 1
    return observations.withColumn("state", F.when(first, "seen_new").when(last.eqNullSafe(F.col(sha)), "unchanged").otherwise("changed"))


def observation_cycle(resources: DataFrame, discovered: DataFrame, complete: bool, keys: tuple[str, str] = ("source_id", "resource_key")) -> DataFrame:
    """resources(keys, url, meta, sha, status), discovered(keys, url, meta, sha, outcome) -> the next state and events.

    outcome ok carries a sha, not_modified keeps the old one, error keeps everything. A resource that is not discovered
    disappears in a complete run only; nothing is deleted."""
    old = resources.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("url", "meta", "sha", "status")])
    new = discovered.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("url", "meta", "sha", "outcome")])
    j = old.join(new, list(keys), "full_outer")
    seen, known = F.col("n_outcome").isNotNull(), F.col("o_status").isNotNull()
    fetched = F.col("n_outcome") == "ok"
    tests = {
        "added": seen & ~known,
        "reappeared": seen & known & (F.col("o_status") == "disappeared"),
        "url_changed": seen & known & ~F.col("o_url").eqNullSafe(F.col("n_url")),
        "metadata_changed": seen & known & ~F.col("o_meta").eqNullSafe(F.col("n_meta")),
        "checksum_changed": seen & known & fetched & F.col("o_sha").isNotNull() & ~F.col("o_sha").eqNullSafe(F.col("n_sha")),
        "disappeared": ~seen & (F.col("o_status") == "active") & F.lit(complete),
    }
    events = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()]))
    status = F.when(seen, "active").when(F.lit(complete), "disappeared").otherwise(F.col("o_status"))
    return j.select(*keys, F.when(seen, F.col("n_url")).otherwise(F.col("o_url")).alias("url"), F.when(seen, F.col("n_meta")).otherwise(F.col("o_meta")).alias("meta"), F.when(fetched, F.col("n_sha")).otherwise(F.col("o_sha")).alias("sha"), status.alias("status"), events.alias("events"))


def change_events(state: DataFrame, keys: tuple[str, str] = ("source_id", "resource_key")) -> DataFrame:
    return state.select(*keys, F.explode("events").alias("change_type"))


def disappeared(resources: DataFrame, discovered: DataFrame, runs: DataFrame) -> DataFrame:
    """Active resources not discovered, of sources whose run was complete."""
    active = resources.where("status = 'active'").join(runs.where("complete").select("source_id"), "source_id", "left_semi")
    return active.join(discovered, ["source_id", "resource_key"], "left_anti")


def consecutive_failures(runs: DataFrame, key: str = "source_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """key, failures since its last success, runs, last status. Aggregates only: no key's runs are sorted in one task."""
    place = F.struct(F.col(at), F.col(tie))
    last_ok = runs.groupBy(key).agg(F.max(F.when(F.col("ok"), place)).alias("_last"))
    j = runs.join(last_ok, key)
    after = F.col("_last").isNull() | (place > F.col("_last"))
    return j.groupBy(key).agg(F.count_if(~F.col("ok") & after).alias("failures"), F.count(F.lit(1)).alias("runs"), F.max_by("ok", place).alias("last_ok"))


def run_status(errors: Column, discovered: Column, downloaded: Column, fatal: Column) -> Column:
    """fatal: the message that ended the run, or null; one of a blocked source doesn't fail it. Errors alone fail a run
    that found nothing and fetched nothing."""
    failed = fatal.isNotNull() & ~F.coalesce(fatal.startswith("blocked:"), F.lit(False))
    return F.when(failed, "failed").when((errors > 0) & (discovered == 0) & (downloaded == 0), "failed").when(errors > 0, "partial").otherwise("succeeded")


def due_sources(sources: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Enabled sources whose next check has come and that nobody holds, by priority and id."""
    j = sources.join(states, "source_id", "left").where("enabled")
    due = F.col("next_check_at").isNull() | (F.col("next_check_at") <= now)
    free = F.col("locked_until").isNull() | (F.col("locked_until") <= now)
    return j.where(due & free)


def host_load(states: DataFrame, now: Column) -> DataFrame:
    return states.where(F.col("locked_until") > now).groupBy("host").agg(F.count(F.lit(1)).alias("load"))


def tick(due: DataFrame, load: DataFrame, cap: int = HOST_CAP, limit: int = TICK_LIMIT) -> DataFrame:
    """due(source_id, host, priority) -> source_id, outcome (enqueued, skipped_host_limit, later).

    Within a host the first cap - load sources by priority may go; of those, the first `limit` over all hosts do. A
    source is skipped for its host only if it comes before the last one that goes. Only the head of the queue is ranked
    over all hosts: `limit` rows."""
    place = F.struct("priority", "source_id")
    d = due.join(load, "host", "left").withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("priority", "source_id")))
    d = d.withColumn("fits", F.col("n") <= F.lit(cap) - F.coalesce("load", F.lit(0)))
    head = d.where("fits").orderBy("priority", "source_id").limit(limit)
    edge = head.agg(F.count(F.lit(1)).alias("chosen"), F.max(place).alias("last"))
    j = d.crossJoin(F.broadcast(edge))  # one row
    before = (F.col("chosen") < limit) | (place <= F.col("last"))
    return j.select("source_id", F.when(F.col("fits") & before, "enqueued").when(before, "skipped_host_limit").otherwise("later").alias("outcome"))


def recent(rows: DataFrame, key: str, at: str, n: int, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stage(artifacts: DataFrame, known: DataFrame, sha: str = "sha") -> DataFrame:
    """First row of each new content becomes downloaded, any other unchanged."""
    first = artifacts.withColumn("_n", F.row_number().over(Window.partitionBy(sha).orderBy("doc_id")))
    j = first.join(known.select(F.col(sha), F.lit(True).alias("_known")).distinct(), sha, "left")
    return j.select("doc_id", sha, F.when(F.col("_known").isNull() & (F.col("_n") == 1), "downloaded").otherwise("unchanged").alias("event"))
