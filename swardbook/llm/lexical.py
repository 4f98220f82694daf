"""Ranked lexical search with block-max pruning.

The forward index holds a row for each document with its distinct terms and their
counts, sorted inside each task by the columns of ``cluster`` and by length, and
cut into blocks of BLOCK documents. Beside it stand the blocks' per-term maxima:
the most that a term can give to a score in that block. A query's bound for a
block is the weighted sum of these maxima. First the SEEDS blocks with the highest
bounds of each query are scored; the k-th best score found is its threshold. Of
all other blocks those with a bound of at least the threshold are scored, in
falling order of bound inside each task, which raises the threshold as it goes
and stops a query at the first bound below it. The result is that of scoring all
documents: a bound is never less than a score.

Queries go in groups of bounded size, so what is broadcast does not grow with
their number. The forward index is shuffled by block once for each group; blocks
that few queries need are first picked out through a broadcast list of at most
PICK blocks.

Defined cases: documents without a term (null, empty or only other characters)
match nothing and are not counted; repeated rows of a doc_id are documents of
their own, and so are those without an id, which come after all ids among equal
scores; texts of one item_id make one query, null included; an item without
terms, or whose terms no document has, gives no rows; very long texts are counted
whole; an empty table on either side gives no rows. Other columns are not read,
so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import stream_blocks
from .scratch import running_totals, stash

#: Documents in a block; a power of two, so that blocks never span tasks.
BLOCK = 256
#: Blocks of a query that are scored before it has a threshold.
SEEDS = 2
#: Terms and places in rankings of a group of queries, and blocks in a broadcast list.
GROUP, PICK = 200_000, 1_000_000
#: Results of the query.
TOP = 50
#: Documents handed on at a time, and their terms.
ROWS, TERMS = 1000, 1 << 20

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LAST = np.iinfo(np.int64).max
_PART = 1 << 24


def count_terms(text: str | None) -> Counter:
    """Terms of a text as UTF-8 with their counts: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lowered."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP)
    if len(data) <= _PART:
        return Counter(data.split())
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PART)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the last, then n, terms and counts of the text in the last."""
    for batch in batches:
        names = batch.schema.names[:-1]
        counts: list[Counter] = []
        first = held = 0
        for i in range(batch.num_rows):
            counts.append(count_terms(batch.column(len(names))[i].as_py()))
            held += len(counts[-1])
            if len(counts) == ROWS or held > TERMS or i == batch.num_rows - 1:
                ends = np.cumsum([0, *map(len, counts)])
                offsets = pa.array(ends, type=pa.int32())
                terms = pa.array(list(chain.from_iterable(counts)), type=pa.string())
                tfs = pa.array(list(chain.from_iterable(c.values() for c in counts)), type=pa.int64())
                n = pa.array([sum(c.values()) for c in counts], type=pa.int64())
                kept = [batch.column(k).slice(first, len(counts)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, n, pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tfs)], names=[*names, "n", "terms", "tfs"])
                first, held, counts = i + 1, 0, []


def term_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n, terms, tfs) of a table with text."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", n long, terms array<string>, tfs array<long>"
    return df.select(*columns, "text").mapInArrow(_term_rows, schema)


def impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


def lengths_of(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Each document's m; in Python's integers where a product could pass 63 bits."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // terms for x in n], dtype=np.int64)
    return 50 + (50 * n * docs) // terms


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, number of the row of each value) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


@dataclass
class Index:
    """A forward index in blocks, its maxima, and the totals that scores need."""

    forward: DataFrame  # block, doc_id, n, terms, tfs
    maxima: DataFrame  # block, term, top, df
    docs: int
    terms: int


def build(docs: DataFrame, cluster: Sequence[str] = ()) -> Index:
    """Index documents with doc_id, text and the columns of cluster, by which similar documents share blocks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"by_{k}") for k, c in enumerate(cluster)), "text")
    keys = [c for c in rows.columns if c != "text"]
    counted = term_rows(rows, keys).filter("n > 0").sortWithinPartitions(*keys[1:], "n")
    blocks = F.floor(F.monotonically_increasing_id() / BLOCK).alias("block")
    forward = stash(counted.select(blocks, "doc_id", "n", "terms", "tfs"), "forward")
    total = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.docs, total.terms or 1

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, doc = _flat(batch.column(2))
            coded = values.dictionary_encode()
            worth = impacts(batch.column(3).flatten().to_numpy(), lengths_of(n, n_docs, n_terms)[doc])
            own = np.cumsum(np.concatenate(([0], blocks[1:] != blocks[:-1])))
            key = own[doc] * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            found = order[starts]
            for a in range(0, len(starts), TERMS):
                some = slice(a, a + TERMS)
                end = starts[a + TERMS] if a + TERMS < len(starts) else len(key)
                tops = np.maximum.reduceat(worth[order[:end]], starts[some])
                dfs = np.diff(np.append(starts[some], end))
                yield pa.RecordBatch.from_arrays([pa.array(blocks[doc[found[some]]]), values.take(pa.array(found[some])), pa.array(tops), pa.array(dfs)], names=["block", "term", "top", "df"])

    # A block that a batch's end cuts has two rows for some terms: their sum is a bound as well.
    parts = forward.select("block", "n", "terms", "tfs").mapInArrow(maxima, "block long, term string, top long, df long")
    return Index(forward, stash(parts, "maxima"), n_docs, n_terms)


def weigh(index: Index, items: DataFrame, k: int) -> DataFrame:
    """(item_id, no, batch, term, w): the terms of each item with weights, a number for the item and its group."""
    texts = term_rows(items.select("item_id", "text"), ["item_id"]).select("item_id", F.explode("terms").alias("term")).distinct()
    asked = stash(texts, "asked")
    wanted = asked.select(F.col("term").alias("__term")).distinct()
    dfs = index.maxima.join(wanted, F.col("term") == F.col("__term"), "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = stash(asked.join(dfs, "term").select("item_id", "term", weight.alias("w")), "weights")
    sizes = weighed.groupBy("item_id").agg((F.count("*") + k).alias("cost")).withColumn("one", F.lit(1))
    numbered = running_totals(sizes, [], ["item_id"], {"no": "one", "before": "cost"})
    numbered = numbered.select(F.col("item_id").alias("__item"), F.col("no").cast("int").alias("no"), F.floor(F.col("before") / GROUP).cast("int").alias("batch"))
    return stash(weighed.join(numbered, weighed["item_id"].eqNullSafe(numbered["__item"])).drop("__item"), "weighed")


class Scorer:
    """Scores blocks for the queries of a group; keeps each query's best scores and so its threshold."""

    def __init__(self, terms: list[str], queries: dict[int, tuple[np.ndarray, np.ndarray]], docs: int, total: int, k: int) -> None:
        self.terms, self.queries = terms, queries
        self.docs, self.total, self.k = docs, total, k
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.values: pa.Array | None = None

    def postings(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first posting of each query term, document, impact) of a block, by query term."""
        values, doc = _flat(rows.column("terms").chunk(0))
        if self.values is None:
            self.values = pa.array(self.terms, type=pa.string())
        term = pc.index_in(values, value_set=self.values)
        hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        term, doc = term.take(pa.array(hit)).to_numpy(), doc[hit]
        m = lengths_of(rows.column("n").to_numpy(), self.docs, self.total)
        worth = impacts(rows.column("tfs").chunk(0).flatten().to_numpy()[hit], m[doc])
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.terms) + 1)), doc[order], worth[order]

    def score(self, no: int, block: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> np.ndarray:
        first, doc, worth = block
        terms, weights = self.queries[no]
        starts, counts = first[terms], first[terms + 1] - first[terms]
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        scores = np.zeros(size, dtype=np.int64)
        np.add.at(scores, doc[at], np.repeat(weights, counts) * worth[at])
        return scores

    def admit(self, no: int, scores: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
        """Places of the documents that enter the query's best k so far."""
        had = self.best.get(no, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
        at = np.flatnonzero(scores >= max(least, self.threshold(no)))
        if not len(at):
            return at
        both, keys = np.concatenate((had[0], scores[at])), np.concatenate((had[1], ids[at]))
        order = np.lexsort((keys, -both))[: self.k]
        self.best[no] = (both[order], keys[order])
        return at[order[order >= len(had[0])] - len(had[0])]

    def threshold(self, no: int) -> int:
        had = self.best.get(no)
        return int(had[0][-1]) if had is not None and len(had[0]) == self.k else 1


def scan(index: Index, pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """(no, doc_id, score) of the documents that may be among the best of a query, from pairs (no, block, bound, least).

    Every task keeps its own best; a query stops at the first of its blocks at hand whose bound is below them.
    """
    needed = stash(pairs.select(F.col("block").alias("__block")).distinct(), "needed")
    rows = index.forward
    if needed.count() <= PICK:
        rows = rows.join(F.broadcast(needed), F.col("block") == F.col("__block"), "left_semi")
    asks = pairs.select("block", "no", "bound", "least")
    union = asks.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind = table.column("kind").to_numpy()
        ends = np.append(starts[1:], table.num_rows)
        turns = []
        blocks = []
        for b, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            split = s + int(np.searchsorted(kind[s:e], 1))
            blocks.append((split, e))
            if split < e:
                asked = table.slice(s, split - s)
                turns += zip(asked.column("no").to_pylist(), (-x for x in asked.column("bound").to_pylist()), [b] * (split - s), asked.column("least").to_pylist())
        # Falling bounds; each block is decoded when a query first comes to it.
        turns.sort(key=lambda t: (t[1], t[2]))
        decoded: dict[int, tuple] = {}
        nos, at, scores = [], [], []
        for no, bound, b, least in turns:
            if -bound < max(least, scorer.threshold(no)):
                continue
            split, end = blocks[b]
            if b not in decoded:
                own = table.slice(split, end - split).combine_chunks()
                decoded[b] = (scorer.postings(own), own.column("doc_id").fill_null(_LAST).to_numpy())
            postings, ids = decoded[b]
            found = scorer.score(no, postings, end - split)
            enter = scorer.admit(no, found, ids, least)
            if len(enter):
                nos.append(np.full(len(enter), no, dtype=np.int32))
                at.append(enter + split)
                scores.append(found[enter])
        if nos:
            ids = table.column("doc_id").take(pa.array(np.concatenate(at))).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nos)), ids, pa.array(np.concatenate(scores))], names=["no", "doc_id", "score"])

    return stream_blocks(union, ["block"], run, "no int, doc_id long, score long", within=["kind"])


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows (no, doc_id, score) of each query with their rank; in two steps, so that no task sorts all hits of a query."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = hits.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = some.withColumn("__at", F.row_number().over(Window.partitionBy("no", "__salt").orderBy(*order))).filter(F.col("__at") <= k)
    return some.drop("__salt", "__at").withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each item with item_id and text."""
    weighed = weigh(index, items, k)
    groups = weighed.agg(F.max("batch")).first()[0]
    out = []
    for g in range(-1 if groups is None else groups, -1, -1):
        mine = weighed.filter(F.col("batch") == g)
        rows = mine.select("no", "term", "w").toArrow()
        terms = pc.unique(rows.column("term")).to_pylist()
        place = pc.index_in(rows.column("term"), value_set=pa.array(terms, type=pa.string())).to_numpy()
        nos, weights = rows.column("no").to_numpy(), rows.column("w").to_numpy()
        order = np.argsort(nos, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], nos[order][1:] != nos[order][:-1], [True])))
        queries = {int(nos[order[a]]): (place[order[a:b]].astype(np.int64), weights[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])}
        scorer = lambda: Scorer(terms, queries, index.docs, index.terms, k)  # noqa: B023, E731

        weights_of = F.broadcast(mine.select(F.col("term").alias("__term"), "no", "w"))
        bounds = index.maxima.join(weights_of, F.col("term") == F.col("__term")).groupBy("no", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
        bounds = stash(bounds.filter("bound > 0"), "bounds")
        place_of = F.row_number().over(Window.partitionBy("no").orderBy(F.col("bound").desc(), "block"))
        seeds = stash(bounds.withColumn("__at", place_of).filter(F.col("__at") <= SEEDS).select("no", "block", "bound", F.lit(1).cast("long").alias("least")), "seeds")
        early = stash(scan(index, seeds, scorer()), "early")
        least = _best(early, k).filter(F.col("rank") == k).select(F.col("no").alias("__no"), F.col("score").alias("__least"))
        done = F.broadcast(seeds.select(F.col("no").alias("__no"), F.col("block").alias("__block")))
        rest = bounds.join(done, (F.col("no") == F.col("__no")) & (F.col("block") == F.col("__block")), "left_anti")
        rest = rest.join(F.broadcast(least), F.col("no") == F.col("__no"), "left").withColumn("least", F.coalesce("__least", F.lit(1).cast("long")))
        rest = stash(rest.filter("bound >= least").select("no", "block", "bound", "least"), "rest")
        late = scan(index, rest, scorer())
        names = mine.select(F.col("no").alias("__no"), "item_id").distinct()
        ranked = _best(early.unionByName(late), k)
        out.append(ranked.join(F.broadcast(names), F.col("no") == F.col("__no")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        none = F.lit(0).cast("long")
        return items.limit(0).select("item_id", F.lit(0).alias("rank"), none.alias("doc_id"), none.alias("score"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(build(docs, cluster=["lang"]), items)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
ORACLE = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
kept AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS total FROM kept),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM kept) a GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) b),
w AS (SELECT item_id, asked.term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df ON asked.term = df.term, totals),
m AS (SELECT r, doc_id, (50 + (50 * n * docs) // total)::BIGINT AS m FROM kept, totals),
scores AS (SELECT item_id, m.r, m.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score
  FROM w JOIN tf ON w.term = tf.term JOIN m ON tf.r = m.r GROUP BY item_id, m.r, m.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
