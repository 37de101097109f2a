"""Registration of queries and the domain relations derived from the driver's tables.

A relation is one SQL text that Spark and DuckDB read alike (integer arithmetic, CASE, plain functions), so a query and
its oracle start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark", "embeddings")
LEVEL = "CASE {k} % 7 WHEN 0 THEN 'official_vector' WHEN 1 THEN 'derived_machine_unreviewed' WHEN 2 THEN 'official_document' WHEN 3 THEN 'derived_human_reviewed' WHEN 4 THEN 'official_raster' WHEN 5 THEN 'derived_machine_reviewed' ELSE 'reference_approximate' END"
REVIEW = "CASE {k} % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'in_review' END"
RELATIONS = {
    "features": """SELECT c_custkey AS id, concat('k', c_custkey) AS fkey, c_nationkey AS layer_id, c_mktsegment AS class, c_name AS name, c_acctbal AS val,
        102e0 + ((c_custkey * 7919) % 10000) / 1e3 - (c_custkey % 7 + 1) / 1e3 AS minx, 8e0 + ((c_custkey * 104729) % 15000) / 1e3 - (c_custkey % 7 + 1) / 1e3 AS miny,
        102e0 + ((c_custkey * 7919) % 10000) / 1e3 + (c_custkey % 7 + 1) / 1e3 AS maxx, 8e0 + ((c_custkey * 104729) % 15000) / 1e3 + (c_custkey % 7 + 1) / 1e3 AS maxy FROM customer""",
    "layers": "SELECT n_nationkey AS layer_id, n_name AS layer_name, n_regionkey AS dataset_id FROM nation",
    "datasets": f"""SELECT r_regionkey AS dataset_id, r_name AS dataset_name, {LEVEL.format(k="r_regionkey")} AS derivation_level, {REVIEW.format(k="r_regionkey")} AS review_status,
        r_regionkey % 4 <> 1 AS published, CASE WHEN r_regionkey % 2 = 0 THEN 'vector' ELSE 'raster' END AS dataset_type FROM region""",
    "points": "SELECT s_suppkey AS point_id, 102e0 + ((s_suppkey * 7919) % 10000) / 1e3 + 5e-4 AS lon, 8e0 + ((s_suppkey * 104729) % 15000) / 1e3 - 7e-4 AS lat FROM supplier",
    "versions": "SELECT o_orderkey AS version_id, o_custkey AS record_id, CAST(o_orderdate AS DATE) AS effective_from, concat('D', o_orderkey % 500) AS decision, o_orderpriority AS kind, o_totalprice AS price FROM orders",
    "old_parts": "SELECT p_partkey AS id, concat('p', p_partkey) AS fkey, p_type AS class, p_brand AS brand, p_size AS size, 105e0 + (p_partkey % 100) / 1e2 AS minx, 20e0 + (p_partkey % 70) / 1e2 AS miny, 5e-3 AS w FROM part WHERE p_partkey % 11 <> 0",
    "new_parts": """SELECT p_partkey AS id, concat('p', p_partkey) AS fkey, CASE WHEN p_partkey % 7 = 0 THEN 'NEW' ELSE p_type END AS class, p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS size,
        105e0 + (p_partkey % 100) / 1e2 AS minx, 20e0 + (p_partkey % 70) / 1e2 AS miny, CASE WHEN p_partkey % 3 = 0 THEN 7e-3 ELSE 5e-3 END AS w FROM part WHERE p_partkey % 13 <> 0""",
    "observations": """SELECT event_id, ts, user_id AS source_id, concat(user_id, '/', event_id % 5) AS resource_key, CAST(floor(value * 10) AS BIGINT) % 4 AS sha,
        CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'ok' WHEN 'purchase' THEN 'error' ELSE 'ok' END AS outcome, event_type FROM events""",
    "sources": """SELECT c_custkey AS source_id, concat(CASE WHEN c_custkey % 9 = 0 THEN 'demo/' ELSE 'gov/' END, c_custkey) AS source_key, c_custkey % 10 AS priority, c_custkey % 8 <> 0 AS enabled,
        concat('host', c_custkey % 17, '.example') AS host, c_nationkey AS unit_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE NULL END AS jurisdiction FROM customer""",
}


def portable(name: str) -> str:
    return " ".join(RELATIONS[name].split())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame."""
    text = portable(name)
    used = {t for t in TABLES if re.search(rf"\bFROM {t}\b", text)}
    text = re.sub(r"\bFROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in used else m[0], text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def query(name: str, sql: str | None = None):
    """Registers a query; relations named in its SQL are put before it as WITH parts."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            parts = [f"{r} AS ({portable(r)})" for r in RELATIONS if re.search(rf"\b{r}\b", sql)]
            head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
            body = sql[head.end() :] if head else sql
            recursive = "RECURSIVE " if head and head[1] else ""
            ORACLES[name] = (f"WITH {recursive}{', '.join(parts)}{', ' if head else ' '}{body}" if parts else sql).strip()
        return run

    return add
