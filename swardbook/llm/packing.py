"""Conflict-constrained best-fit packing of documents into context windows.

A document's length is its number of byte-level tokens: the bytes of its UTF-8
text and an end mark. Clusters are the near-duplicate classes of SimHash. Whole windows of a longer document fill bins of their own;
what remains, and every shorter document, is packed. Two pieces conflict if they
are of one duplicate cluster, or if their source already fills its share of the
bin. Every bin carries two bitmaps, of the clusters it holds and of the sources
that are full; bins are kept in order of what they have left, and the search
for a piece starts at the tightest bin that is large enough and goes on to the
next larger one until bin and piece are compatible.

Pieces are dealt into lots by a hash of the document, several thousand to a
lot, longest first within one; lots are packed independently, so copies of one
document and documents of one source spread over all lots.

Defined cases: a null or empty text is a piece of length 1 (its end mark); a
null doc_id packs like any other value; null sources share one source; equal
lengths are packed in the order of doc_id, then text hash; repeated rows are one
cluster and never share a bin; a very long text is whole windows and a rest; an
empty table gives no rows; the input's other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .blocks import stream_blocks
from .scratch import stash

CAPACITY = 8192
#: A source may fill this share of a bin; its first piece in a bin always may enter.
SOURCE_SHARE = 0.75
#: Pieces of a lot, on average.
LOT = 4096
SCHEMA = "lot long, bin long, slot int, at long, doc_id long, piece int, length long, source string, cluster long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, cluster, piece, length): full windows of a text, and what remains of it.

    clusters: doc_id and component_id of near-duplicates; without it, or for a
    document that it leaves out, equal texts are a cluster.
    """
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"), length.alias("__all"))
    if clusters is not None:
        known = clusters.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("component_id").alias("__component"))
        rows = rows.join(known, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "source", F.coalesce("__component", "cluster").alias("cluster"), "__all")
    count = F.ceil(F.col("__all") / capacity).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return rows.select("doc_id", "source", "cluster", "piece", F.least(F.col("__all") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("long").alias("length"))


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY, share: float = SOURCE_SHARE) -> tuple[list[int], list[int], list[int]]:
    """(bin, slot, place in the bin) of each piece, taken in the given order."""
    copies = Counter(clusters)
    bit = {c: 1 << k for k, c in enumerate(x for x, n in copies.items() if n > 1)}
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    quota = int(capacity * share)
    order: list[tuple[int, int]] = []  # (what is left, bin), ascending
    held: list[int] = []  # clusters of a bin
    full: list[int] = []  # sources that have filled their share of a bin
    used: list[dict[int, int]] = []  # bytes of each source in a bin
    filled: list[int] = []
    count: list[int] = []
    bins, slots, at = [], [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        mine, origin = bit.get(cluster, 0), source_bit[source]
        k = bisect_left(order, (length, -1))
        while k < len(order) and (held[order[k][1]] & mine or full[order[k][1]] & origin or used[order[k][1]].get(origin, -length) + length > quota):
            k += 1
        if k < len(order):
            b = order.pop(k)[1]
        else:
            b = len(held)
            held.append(0)
            full.append(0)
            used.append({})
            filled.append(0)
            count.append(0)
        bins.append(b)
        slots.append(count[b])
        at.append(filled[b])
        held[b] |= mine
        used[b][origin] = used[b].get(origin, 0) + length
        if used[b][origin] >= quota:
            full[b] |= origin
        filled[b] += length
        count[b] += 1
        if filled[b] < capacity:
            insort(order, (capacity - filled[b], b))
    return bins, slots, at


def _packer(capacity: int, share: float):
    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            lot = table.slice(int(a), int(b - a))
            lengths, sources, clusters = (lot.column(c).to_pylist() for c in ("length", "source", "cluster"))
            bins, slots, at = best_fit(lengths, sources, clusters, capacity, share)
            cols = [lot.column("lot"), pa.array(bins, type=pa.int64()), pa.array(slots, type=pa.int32()), pa.array(at, type=pa.int64())]
            cols += [lot.column(c) for c in ("doc_id", "piece", "length", "source", "cluster")]
            names = ["lot", "bin", "slot", "at", "doc_id", "piece", "length", "source", "cluster"]
            yield from pa.Table.from_arrays(cols, names=names).to_batches()

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, share: float = SOURCE_SHARE) -> DataFrame:
    """Place pieces: (lot, bin) names a bin, slot counts within it, at is the piece's first token."""
    parts = stash(parts, "pieces")
    lots = max(1, round(parts.count() / LOT))
    # Equal rows go by a running number of their copies, so that thousands of them still spread.
    spread = F.pmod(F.xxhash64("doc_id", "piece", "cluster", F.monotonically_increasing_id()), F.lit(lots))
    dealt = stash(parts.withColumn("lot", spread), "lots")
    rows = dealt.withColumn("__short", -F.col("length")).select("lot", "__short", "doc_id", "piece", "cluster", "source", "length")
    return stream_blocks(rows, ["lot"], _packer(capacity, share), SCHEMA, within=["__short", "doc_id", "piece", "cluster"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, clusters=simhash.classes(docs).select("doc_id", "component_id")))


def to_windows(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where every piece of every document goes. Near-duplicates are gone by then, so a cluster is the copies that mixing made."""
    return pack(pieces(docs))
