"""Connected components of an edge table by randomised hooking and contraction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut, discard


def _jumped(parents: DataFrame) -> DataFrame:
    """Parents of the fourth generation (a root is its own parent)."""
    step = parents
    for _ in range(2):
        up = step.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        step = step.join(up, "parent").select("node", F.col("_up").alias("parent"))
    return step


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest row of each part) after the parts ``a`` and ``b`` became one, pair by pair."""
    up = np.arange(len(label))
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return up[label]
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


#: Edges between integers that one task settles at once (16 MB).
FEW = 1 << 20


def _settled(batches):
    """``node, parent`` of all edges ``a, b`` of a few batches; the parent is the smallest node of the part."""
    ends = [np.stack([batch.column(c).to_numpy() for c in "ab"]) for batch in batches if batch.num_rows]
    if ends:
        nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        a, b = place.reshape(2, -1)
        parent = nodes[merged(np.arange(len(nodes)), a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(parent)], names=["node", "parent"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the smallest node reachable.

    In every round each node hooks to its neighbour (or itself) with the smallest
    round-seeded hash, and edges are redrawn between the ancestors that four steps up the
    chains lead to.  A chain's own edges are redrawn too, so what a longer chain joins stays
    joined and no chain need be flat.  A node is a local minimum of random hashes with
    probability at most one half and chains of falling hashes are short, so the number of nodes with edges falls
    by a factor in expectation whatever the shape of the graph: rounds grow with the logarithm of
    the node count and need no cap; the last ``FEW`` edges between integers are settled in one task instead of in further rounds.  Minima are partial aggregates, so a hub's
    edges never meet in one task.  Self-loops are allowed and give a
    component of their own; edges with a null end are ignored; an empty table
    gives an empty result.
    """
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    first = cut(given.distinct())
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    live = cut(first.where("a <> b"))
    layers: list[DataFrame] = []
    whole_numbers = first.schema["a"].dataType == first.schema["b"].dataType == T.LongType()
    while left := live.count():
        if whole_numbers and left <= FEW:
            layers.append(cut(live.coalesce(1).mapInArrow(_settled, "node long, parent long")))
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(layers)), F.col(c)).alias("h"), F.col(c).alias("v"))
        ends = live.select(F.col("a").alias("node"), rank("b").alias("to")).union(live.select(F.col("b"), rank("a")))
        best = ends.groupBy("node").agg(F.min("to").alias("to"))
        hooked = cut(best.select("node", F.least(F.col("to"), rank("node"))["v"].alias("parent")))
        parents = cut(_jumped(hooked))
        discard(hooked)
        layers.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        redrawn = live.join(left, "a").join(right, "b").where("_a <> _b")
        smaller = cut(redrawn.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        discard(live)
        live = smaller
    # Fold the layers: a node's root is the parent of its parent of ... in layer order.
    start = nodes.withColumn("root", F.col("node"))
    rooted = reduce(
        lambda found, layer: found.join(layer.select(F.col("node").alias("root"), F.col("parent").alias("_up")), "root", "left")
        .select("node", F.coalesce("_up", "root").alias("root")),
        layers, start,
    )
    rooted = cut(rooted)
    smallest = rooted.groupBy("root").agg(F.min("node").alias("_min"))
    return rooted.join(smallest, "root").select("node", F.col("_min").alias("root"))
