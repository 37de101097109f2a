"""Provenance: event rows, summaries, labels and the walk over the input graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

MAX_DEPTH = 50


def events(rows: DataFrame, entity_type: Column, entity_id: Column, operation: str, input_refs: Column, output_sha256: Column, tool: str = "landloom", actor: str = "system", run_id: Column | None = None) -> DataFrame:
    """One provenance event row for each row."""
    return rows.select(entity_type.alias("entity_type"), entity_id.cast("string").alias("entity_id"), F.lit(operation).alias("operation"), input_refs.alias("input_refs"), F.lit(tool).alias("tool"), output_sha256.alias("output_sha256"), F.lit(actor).alias("actor"), (run_id if run_id is not None else F.lit(None).cast("string")).alias("run_id"))


def summary(features: DataFrame, layers: DataFrame, datasets: DataFrame) -> DataFrame:
    """features + p: the chain feature, layer, dataset, source as a struct; missing links give nulls."""
    chain = layers.join(datasets, "dataset_id", "left")
    return features.join(chain, "layer_id", "left").select(*features.columns, F.struct("layer_name", "dataset_name", "derivation_level", "source_key").alias("p"))


def labelled(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs(entity_type, entity_id) with the label of names, "(deleted)" where there is none."""
    return refs.join(names, ["entity_type", "entity_id"], "left").withColumn("label", F.coalesce("label", F.lit("(deleted)")))


def _levels(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Breadth first: the frontier meets the edges by an equi-join, nodes seen before are anti-joined, and each level is
    written to the shared folder, so cycles end and lineage stays short."""
    level = materialise(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "walk")
    seen = [level]
    for depth in range(1, max_depth + 1):
        met = level.join(edges, F.col("node") == F.col("child")).select("root", F.col("parent").alias("node")).distinct()
        past = reduce(DataFrame.union, [s.select("root", "node") for s in seen])
        level = materialise(met.join(past, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if level.isEmpty():
            break
        seen.append(level)
    return reduce(DataFrame.union, seen)


def walk(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """edges(child, parent), roots(root) -> root, node, depth: every input reached from each root, at its least depth.

    Where the roots' direct inputs are fewer than the roots, as when many records share their sources, the levels are walked
    from these inputs once, and each root takes what its inputs reach: one join and one least depth instead of a pass of
    all roots for each level. Else the levels are walked from the roots themselves."""
    own = materialise(roots.select("root").distinct(), "walk-roots")
    first = own.join(edges, F.col("root") == F.col("child")).select("root", "parent")
    inputs = materialise(first.select(F.col("parent").alias("root")).distinct(), "walk-inputs")
    if max_depth < 1 or inputs.count() >= own.count():
        return _levels(edges, own, max_depth)
    reached = _levels(edges, inputs, max_depth - 1)
    met = first.join(reached.withColumnRenamed("root", "parent"), "parent").select("root", "node", F.col("depth") + 1)
    whole = own.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).union(met)
    return whole.groupBy("root", "node").agg(F.min("depth").alias("depth"))
