"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a group-by with map-side minima and a join; each round's edges are written
to the shared folder, so a lost executor costs one round at most. Hubs stay splittable:
the minima are staged first, so that both sides of the join are plain shuffles that the
adaptive skew join can divide. Before the first step edges are dealt by ranges of their lesser
end, and each task puts what is linked among its own, a batch at a time, under one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.staging import discard, staged


def _linked(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m: the least of u and all its v."""
    least = staged(pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "star-min")
    return pairs.join(least.hint("merge"), "u"), least


def put_together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node linked to it) for all nodes of some edges but the least ones themselves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all() and (label[x] == label[y]).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of the same components as edges (u, v), longs, but fewer and shorter ways."""

    def run(batches):
        for batch in batches:
            u, v = put_together(*(np.asarray(batch.column(k)) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long").distinct()


#: Edges of a range, about.
RANGE = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of the component.

    Self links and repeated edges are allowed; null ends are ignored; no edges give no rows.
    """
    now = staged(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "star-edges",
    )
    count = now.count()
    if count:
        first = now
        now = staged(contracted(now.repartitionByRange(max(8, -(-count // RANGE)), "v")), "star-edges")
        discard(first)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        linked, least1 = _linked(both)
        large = staged(linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
        linked, least2 = _linked(large)
        small = linked.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        after = staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "star-edges")
        # Both are sets: they are equal if no edge is new and none is gone.
        stable = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        for done in (now, least1, large, least2):
            discard(done)
        now = after
        if stable:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
