"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stash, unstash

_SCHEMA = "u long, v long"


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): every node of the edges (u, v) beside the least node it is joined to, but for the least."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = ends[: len(u)], ends[len(u) :]
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task by stars to each local component's smallest node."""
    for batch in batches:
        node, least = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["u", "v"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges hold u > v. Small: a node's smaller neighbours move to the least of them. Large: its larger ones move."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = stash(least.select(F.col("u").alias("__u"), "m"), "least")
    joined = both.join(least, F.col("u") == F.col("__u"))
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("__u").alias("u"), F.col("m").alias("v")))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stash(moved.filter("u > v").distinct(), "star")
    unstash(least)
    return out


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reachable.

    Every round is written to the shared folder, which cuts the lineage; the
    driver sees two sums a round. The rounds number about the logarithm of the
    longest shortest path.
    """
    pairs = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")).filter("u > v")
    now = stash(pairs.mapInArrow(_forest, _SCHEMA).distinct(), "edges")
    seen = None
    while True:
        large = _star(now, small=False)
        unstash(now)
        now = _star(large, small=True)
        unstash(large)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
