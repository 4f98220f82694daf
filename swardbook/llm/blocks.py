"""Deal keyed rows to tasks in bounded blocks, and stream whole blocks to a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, stash


def split_keys(df: DataFrame, keys: Sequence[str], by: str, most: int, *salt: Column) -> DataFrame:
    """Drop rows whose key nothing else has, and add __parts: in how many blocks a key's rows go.

    Keys are counted with map-side partial sums and the counts are joined back,
    so a key that holds a third of the rows is never gathered anywhere. The
    counts are written first: both sides of the join are then plain exchanges,
    of which Spark can split a skewed one. Rows of equal salt are cut alike: where
    parts do not meet through pair_blocks, salts of several cuts have to differ.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
    counts = stash(counts.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.ceil(F.col("__n") / most).cast("int").alias("__parts")), "counts")
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    joined = df.join(counts, on).drop(*(f"__k_{k}" for k in keys))
    return joined.withColumn("__part", F.pmod(F.xxhash64(by, *salt), F.col("__parts")).cast("int"))


def pair_blocks(df: DataFrame) -> DataFrame:
    """Replicate the rows of a key in p parts to the p blocks (low, high) that hold their part."""
    other = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__other")
    df = df.select("*", other)
    low, high = F.least("__part", "__other"), F.greatest("__part", "__other")
    return df.withColumn("__block", (low * F.col("__parts") + high).cast("int")).drop("__other")


def stream_blocks(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, within: Sequence[str] = ()) -> DataFrame:
    """Call fn(table, starts) on tables that hold whole blocks; starts are the blocks' first rows.

    Rows are dealt by keys and sorted by keys, then by within, so a task holds one batch and the block
    that it ends with, and no group is materialised by Spark itself.
    """
    n = partitions(df.sparkSession)
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def starts_of(table: pa.Table) -> np.ndarray:
            change = np.zeros(table.num_rows, dtype=bool)
            if table.num_rows:
                change[0] = True
            for k in names:
                v = table.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(change)

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            first, last = batch.slice(0, 1), batch.slice(batch.num_rows - 1, 1)
            if len(kept) > 1 and all(first.column(k)[0] == last.column(k)[0] == kept[0].slice(kept[0].num_rows - 1).column(k)[0] for k in names):
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            starts = starts_of(table)
            cut = int(starts[-1])
            if cut:
                yield from fn(table.slice(0, cut), starts[:-1])
            kept = table.slice(cut).combine_chunks().to_batches()
        if kept:
            table = pa.Table.from_batches(kept).combine_chunks()
            yield from fn(table, starts_of(table))

    return df.repartition(n, *names).sortWithinPartitions(*names, *within).mapInArrow(run, schema)
