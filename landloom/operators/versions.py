"""Version resolution, supersession, lineage, review tasks and admin units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import origin_rank


def resolve_records(incoming: DataFrame, records: DataFrame) -> DataFrame:
    """incoming(item_id, norm_title, code), records(record_id, norm_title, code) -> item_id, record_id, how: by title, by
    code, or new."""
    by_title = records.groupBy("norm_title").agg(F.min("record_id").alias("t_id"))
    by_code = records.where("code IS NOT NULL").groupBy("code").agg(F.min("record_id").alias("c_id"))
    j = incoming.join(by_title, "norm_title", "left").join(by_code, "code", "left")
    return j.select("item_id", F.coalesce("t_id", "c_id").alias("record_id"), F.when(F.col("t_id").isNotNull(), "title").when(F.col("c_id").isNotNull(), "code").otherwise("new").alias("how"))


def better_origin(old, new):
    """An origin is never replaced by a weaker one."""
    return F.when(old.isNull() | (origin_rank(new) < origin_rank(old)), new).otherwise(old)


def supersessions(versions: DataFrame) -> DataFrame:
    """versions(version_id, record_id, decision, supersedes_decision) -> version_id, supersedes_version_id, kind."""
    named = versions.select("record_id", F.col("decision").alias("supersedes_decision"), F.col("version_id").alias("old_id"))
    first = named.groupBy("record_id", "supersedes_decision").agg(F.min("old_id").alias("supersedes_version_id"))
    j = versions.join(first, ["record_id", "supersedes_decision"], "left")
    own = F.when(F.col("supersedes_version_id") != F.col("version_id"), F.col("supersedes_version_id"))
    return j.select("version_id", own.alias("supersedes_version_id"), F.when(own.isNotNull(), "replacement").otherwise("original").alias("kind"))


def lineage(versions: DataFrame) -> DataFrame:
    """Adds place and previous_id within a record: by effective date, missing dates last."""
    w = Window.partitionBy("record_id").orderBy(F.col("effective_from").asc_nulls_last(), "version_id")
    return versions.withColumn("place", F.row_number().over(w)).withColumn("previous_id", F.lag("version_id").over(w))


def resolve_tasks(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """tasks(task_id, status), decisions(task_id, decision) -> task_id, status, outcome: only pending tasks are resolved."""
    j = tasks.join(decisions, "task_id", "left")
    take = (F.col("status") == "pending") & F.col("decision").isin("done", "dismissed")
    outcome = F.when(F.col("decision").isNull(), "untouched").when(take, "resolved").when(F.col("status") != "pending", "conflict").otherwise("bad_decision")
    return j.select("task_id", F.when(take, F.col("decision")).otherwise(F.col("status")).alias("status"), outcome.alias("outcome"))


def upsert_units(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Units keyed by (code, valid_to), nulls equal: code, valid_to, name, action."""
    c = current.select(F.col("code").alias("o_code"), F.col("valid_to").alias("o_to"), F.col("name").alias("o_name"))
    j = incoming.join(c, (F.col("code") == F.col("o_code")) & F.col("valid_to").eqNullSafe(F.col("o_to")), "full_outer")
    action = F.when(F.col("o_code").isNull(), "created").when(F.col("code").isNull(), "kept").when(~F.col("name").eqNullSafe(F.col("o_name")), "updated").otherwise("unchanged")
    return j.select(F.coalesce("code", "o_code").alias("code"), F.coalesce("valid_to", "o_to").alias("valid_to"), F.coalesce("name", "o_name").alias("name"), action.alias("action"))


def unit_parents(units: DataFrame) -> DataFrame:
    """A district's parent is the province before it: provinces' places make intervals, and a district is matched by an
    equi-join on blocks of the input's order; the province in force at a block's start is found among block ends."""
    size = 1000
    u = units.withColumn("_b", F.floor(F.col("ord") / size))
    ends = u.where("level = 'province'").groupBy("_b").agg(F.max_by("code", "ord").alias("_last"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = u.select("_b").distinct().join(ends, "_b", "left").withColumn("_before", F.last("_last", ignorenulls=True).over(w)).select("_b", "_before")
    inside = Window.partitionBy("_b").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("level") == "province", F.col("code")), ignorenulls=True).over(inside)
    out = u.withColumn("_own", own).join(blocks, "_b")
    return out.withColumn("parent", F.when(F.col("level") == "district", F.coalesce("_own", "_before"))).drop("_b", "_own", "_before")
