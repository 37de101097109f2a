"""Connected components by minimum labels and pointer jumping, all state in shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise

#: Edges that one task joins at once.
FOREST_EDGES = 500_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges that connect what edges(a, b) connect: of each run of edges in a partition, one for each node but the smallest of its tree."""

    def joined(held: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1)
        nodes, at = np.unique(both, return_inverse=True)
        root = list(range(len(nodes)))
        for a, b in at.reshape(2, -1).T.tolist():
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
        for i, up in enumerate(root):  # a root comes before what hangs from it
            root[i] = root[up]
        top = np.array(root, np.int64)
        below = top != np.arange(len(top))
        return pa.RecordBatch.from_arrays([pa.array(nodes[top[below]]), pa.array(nodes[below])], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            if sum(h.shape[1] for h in held) >= FOREST_EDGES:
                yield joined(held)
                held = []
        yield joined(held)

    return edges.select("a", "b").mapInArrow(each, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, root for every node of an edge between two; root is the smallest node of its component.

    Edges are first reduced to a spanning forest inside each partition, so a group in which many pairs are similar
    brings a few edges for each node. Then, each round, a node takes the smallest label of its neighbours and its label's
    label, so the rounds grow with the logarithm of a component's width. Labels are reduced before each shuffle; no
    component meets in one task.
    """
    less = forest(edges.where("a <> b")).distinct()
    both = materialise(less.select("a", "b").union(less.select("b", "a")), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.join(near, F.col("node") == F.col("a")).select(F.col("node").alias("at"), F.least("label", "near").alias("next"))
        moved = materialise(hooked.join(roots, F.col("label") == F.col("at")).select("node", "old", F.col("next").alias("label")), "labels")
        discard(labels)
        done = moved.where("label <> old").isEmpty()
        labels = moved.select("node", "label")
        labels.stored_at = moved.stored_at
        if done:
            discard(both)
            return labels.withColumnRenamed("label", "root")
