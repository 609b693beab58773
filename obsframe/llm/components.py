"""Connected components of links between documents, without gathering links or components on the driver.

Rounds of large-star and small-star steps shrink the longest path; each round's tables are written to the shared
folder. Minima of neighbourhoods are partial aggregates, and joins are between written tables, so that Spark can split
a node of very many links. Once a round leaves no more than SMALL links, one task of that proven size finishes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import drop, materialize

#: So many links (16 bytes each) are finished by union-find in one task.
SMALL = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return nodes, nodes[parent]


def _finish(batches):
    u, v = [], []
    for batch in batches:
        u.append(batch.column(0).to_numpy(zero_copy_only=False))
        v.append(batch.column(1).to_numpy(zero_copy_only=False))
    if u:
        node, root = roots(np.concatenate(u), np.concatenate(v))
        for i in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], ["node", "root"])


def _forest(batches):
    """A spanning forest of the links a task sees; batches are contracted one by one to bound memory."""
    for batch in batches:
        u, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if len(u):
            node, root = roots(u, v)
            other = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], ["u", "v"])


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, root (the least node of its component) for every node of a link; edges: u, v as long."""
    edges = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "links")
    seen = None
    while edges.count() > small:
        old = edges
        both = old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        drop(old, least)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = down.join(least, "u")
        edges = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(edges.distinct(), "links")
        drop(large, least)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return star.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    return edges.coalesce(1).mapInArrow(_finish, "node long, root long")
