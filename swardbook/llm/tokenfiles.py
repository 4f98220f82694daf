"""Token ids as Parquet list columns.

Texts are dealt by range of doc_id and sorted, encoded in that order, and
written by Spark's own Parquet writer: ids as a dictionary-encoded list column
(the vocabulary fits a dictionary page, so an id takes 16 bits), doc_id and the
counts delta-encoded (format version 2, no dictionary), row groups and pages of
a set size, page indexes on. A reader of counts touches no ids, and a reader of
some doc_ids skips pages and row groups by their indexes.

The first id of a document is stored relative to its file's range; the ranges'
totals, one number each, give the global start.

Defined cases: a null text is the empty text, so only the end id; a very long
text is a batch of its own; a null doc_id sorts first; rows with one doc_id are
ordered by text, equal rows are interchangeable; an empty table gives no rows;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import default_vocabulary, encoder, small_parts
from .scratch import fresh_path, partitions

END = 0
#: Rows of one Arrow batch of ids at most; long texts make it shorter.
BATCH = 2048
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#at": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
SCHEMA = "part int, doc_id long, at long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write documents' ids to a folder in ascending doc_id order, file after file."""
    n = partitions(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(vocabulary), 0
        for batch in batches:
            for i, j in small_parts(batch.column(2), BATCH):
                some = batch.slice(i, j - i)
                flat, lengths = enc.encode(some.column(2), END)
                ends = np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), type=pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(at + ends - lengths), pa.array(lengths), lists],
                    names=["part", "doc_id", "at", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    sorted_docs = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    placed = sorted_docs.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    placed.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, first): ids before each range; reads the two narrow columns only."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, offsets = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, type=pa.int64())],
            names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
        )


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    rows = files.select("part", "doc_id", "at", "ids").mapInArrow(_digests, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts(files), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(read(spark, path))
