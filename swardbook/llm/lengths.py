"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram
answer, for every context limit, how many documents and tokens exceed it, the
total truncated at it, and the quantile it stands at. The histogram has at most
one row for each length that occurs. Its sums are made in two levels, so that
no task needs all of it.

Defined cases: a null text has length 0; a very long text is encoded whole, in
a batch of its own; a null doc_id counts like any other, as do repeated rows; an
empty table gives no rows, and no answer to a limit or a share; other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import default_vocabulary, encoder, small_parts
from .scratch import stash

#: Lengths in one block of the two-level sums.
SPAN = 1024
BATCH = 2048


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) without special ids."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i, j in small_parts(batch.column(1), BATCH):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(enc.lengths(batch.column(1).slice(i, j - i)))], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def answers(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: counts and sums on both sides of it.

    docs_over and tokens_over are of documents longer than the limit, total of
    all documents, truncated_total has every document cut at the limit, and
    share_within is the share of documents that fit, the quantile of the limit.
    at_limits() answers for limits between these, quantiles() for shares.
    """
    h = stash(hist.withColumn("block", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("docs")), "histogram")
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = sums.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("total"),
    )
    over = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    within = h.select("block", "n_tokens", "docs", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_in") for c in ("docs", "tokens")))
    out = within.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"),
        "docs",
        (F.col("docs_in") + F.col("d_above")).alias("docs_over"),
        (F.col("tokens_in") + F.col("t_above")).alias("tokens_over"),
        "all_docs",
        "total",
    )
    cut = F.col("total") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")
    return out.select("context_limit", "docs", "docs_over", "tokens_over", "total", cut.alias("truncated_total"), (1 - F.col("docs_over") / F.col("all_docs")).alias("share_within"))


def at_limits(found: DataFrame, limits: list[int]) -> DataFrame:
    """answers() at any limits: those of the largest length that occurs up to each, or of none below the least."""
    asked = found.sparkSession.createDataFrame([(int(x),) for x in limits], "asked long")
    below = F.broadcast(asked).join(found, F.col("context_limit") <= F.col("asked"), "left")  # a few limits
    at = below.groupBy("asked").agg(F.max_by(F.struct("docs_over", "tokens_over", "total"), "context_limit").alias("at"))
    every = found.agg(F.sum("docs").alias("n"), F.max("total").alias("t"))
    rows = at.crossJoin(F.broadcast(every)).filter("n IS NOT NULL")  # one row
    over, tokens = F.coalesce("at.docs_over", "n"), F.coalesce("at.tokens_over", "t")
    return rows.select(F.col("asked").alias("context_limit"), over.alias("docs_over"), tokens.alias("tokens_over"), F.col("t").alias("total"), (F.col("t") - tokens + over * F.col("asked")).alias("truncated_total"), (1 - over / F.col("n")).alias("share_within"))


def quantiles(found: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length within which the share of all documents fits."""
    asked = found.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return F.broadcast(asked).join(found, F.col("share_within") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("context_limit").alias("n_tokens"))  # a few shares


def query(spark, sf_dir: str) -> DataFrame:
    return answers(histogram(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
