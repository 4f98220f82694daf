"""Embedding near-dedup by NN-descent over a thresholded neighbour graph.

1. Equal vectors become one node with a count.
2. Seeds: random hyperplanes deal the nodes into buckets, several times over; in
   each bucket every node keeps its best neighbours. Buckets beyond a block's
   size are split into blocks, in every table and round another way, so that
   what a cut keeps apart in one meets in others.
3. Rounds: at every node its neighbours, in both directions, meet and are
   compared with each other (neighbours of neighbours); each keeps its best. A
   list that is full of links doubles, until it is not full or is LISTS[-1]
   long; one full of links also keeps its best neighbours that are none, since
   those lead out of a tight group. Only neighbours that are new to a node meet
   the others there, and nothing meets where all are of one component already:
   such pairs are known, or are counted exactly in step 5. Rounds end when few
   lists change.
4. Every pair at the threshold or above that any block compares is in a tie,
   whatever the lists drop: blocks give a spanning forest of their links. Ties
   and kept links make the components.
5. Links are counted exactly: inside each component all members are compared in
   blocks, so a cluster of any size gets whole counts without a list of pairs.
6. Recall is audited: the nodes of which some vec_id is divisible by 50, made up
   to AUDIT[0] by others, are compared with every vector, AUDIT[1] at a time. If
   under RECALL, the search goes on with more hyperplanes until it is not or,
   after SEARCHES, one more finds nothing new; under LEAST that is an error.
   Without a true link in the sample the recall is null: not measured.

Only promising neighbours (FLOOR or more) enter a list: isolated vectors have
empty lists, cost nothing in the rounds, and cannot hide a link.

Defined cases: a vector that is null, empty, zero, or that holds a null or
non-finite component links with nothing; vectors of different lengths do not
link, those of any one length do; equal vectors link with each other; a null
vec_id links with nothing; two vectors with one vec_id are two vectors, each with
its own links; a very long vector is a row like any other; an empty table gives
no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pair_blocks, split_keys, stream_blocks
from .graph import components, stars
from .scratch import running_totals, stash, unstash

THRESHOLD = 0.9
#: Similarity from which a neighbour is worth following.
FLOOR = 0.7
#: Lengths of a neighbour list; one full of links moves to the next. Lists only lead the search: ties make components, links are counted apart.
LISTS = (8, 16, 32, 64)
#: Hyperplane tables of the first search, and of each further one after a failed audit.
TABLES = 8
#: Nodes of a bucket on average, and of a block at most.
BUCKET, BLOCK = 128, 512
ROUNDS = 4
RECALL, LEAST = 0.97, 0.9
#: Nodes audited at least, so that the share of found links is known to about a point, and in one pass over all vectors.
AUDIT = (400, 8192)
#: Searches after which one that does not raise the recall is an error.
SEARCHES = 3
_EDGE = "u long, v long, sim double, fresh boolean"


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length one."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy().astype(np.float64)
    x = flat.reshape(len(lists), -1)
    if x.size:  # an exact scaling by powers of two, so that no square overflows or vanishes
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes(vectors: DataFrame) -> DataFrame:
    """(least, v, copies, dim, asked): usable distinct vectors with their least vec_id; asked if any of their ids is divisible by 50."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).groupBy(e.alias("v")).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.max(F.col("vec_id") % 50 == 0).alias("asked"))
    return rows.select("least", "v", "copies", F.size("v").alias("dim"), "asked")


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, their vectors) of each length in a batch."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, lists.take(pa.array(rows))


def _signer(counts: dict[int, int], tables: int, first: int):
    """Rows (dim, table, signature) of every vector under seeded random hyperplanes, as many as its length's count asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, lists in _by_length(batch.column(1)) if batch.num_rows else ():
                dim = len(lists[0])
                bits = max(1, min(40, int(np.ceil(np.log2(max(2, counts[dim] / BUCKET))))))
                planes = np.random.default_rng([977 + first, dim]).standard_normal((dim, tables * bits))
                sign = (_unit(lists) @ planes > 0).reshape(len(rows), tables, bits)
                code = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).ravel()
                node = np.repeat(batch.column(0).to_numpy()[rows], tables)
                table = np.tile(np.arange(first, first + tables), len(rows))
                take = np.repeat(np.arange(len(rows)), tables)
                for s in range(0, len(node), 4096):
                    part = slice(s, s + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(node[part]), dim), type=pa.int32()), pa.array(table[part], type=pa.int64()), pa.array(code[part]), pa.array(node[part]), lists.take(pa.array(take[part]))],
                        names=["dim", "table", "code", "node", "v"],
                    )

    return run


def _best(node: np.ndarray, x: np.ndarray, most: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row's best neighbours of FLOOR or more among the rows, as (u, v, sim), and ends (a, b) that join all linked rows.

    Two rows that are not fresh have met before.
    """
    us, vs, sims, lows, highs = [], [], [], [], []
    wide = int(most.max())

    def take(s: np.ndarray, rows: np.ndarray, k: int, most: np.ndarray) -> None:
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        top, sim = np.take_along_axis(top, order, axis=1), np.take_along_axis(sim, order, axis=1)
        i, j = np.nonzero((sim >= FLOOR) & (np.arange(k)[None, :] < most[:, None]))
        us.append(node[rows[i]])
        vs.append(node[top[i, j]])
        sims.append(sim[i, j])

    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        rows = a + np.arange(len(s))
        s[np.arange(len(s)), rows] = -2
        s[np.ix_(~fresh[rows], ~fresh)] = -2
        k = min(wide, len(x) - 1)
        if k < 1:
            continue
        take(s, rows, k, most[rows])
        near = s >= THRESHOLD
        i, j = np.nonzero(near & (np.arange(len(x))[None, :] > rows[:, None]))
        if len(i) > len(s):
            i, j = stars(a + i, j)
            i = i - a
        lows.append(node[a + i])
        highs.append(node[j])
        full = np.flatnonzero(near.sum(axis=1) >= most[rows])
        if len(full):  # lists with links alone: what is no link leads on
            take(np.where(near[full], -2, s[full]), rows[full], min(LISTS[0], k), np.full(len(full), LISTS[0]))
    empty = np.zeros(0)
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else empty.astype(kind)
    return cat(us, np.int64), cat(vs, np.int64), cat(sims, np.float64), cat(lows, np.int64), cat(highs, np.int64)


def _meet(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Compare the nodes of every block with each other. Rows without sim are ties: a forest over all links of the blocks."""
    ends = np.append(starts[1:], table.num_rows)
    node, most = table.column("node").to_numpy(), table.column("most").to_numpy()
    fresh = table.column("fresh").to_numpy()
    out = []
    for a, b in zip(starts, ends):
        if b - a > 1:
            out.append(_best(node[a:b], _unit(table.column("v").slice(int(a), int(b - a))), most[a:b], fresh[a:b]))
    if out:
        u, v, sim, low, high = (np.concatenate(o) for o in zip(*out))
        low, high = stars(low, high)
        sim = pa.array(np.concatenate([sim, np.full(len(low), np.nan)]), from_pandas=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, low])), pa.array(np.concatenate([v, high])), sim, pa.array(np.ones(len(sim), dtype=bool))], names=["u", "v", "sim", "fresh"])


def _shortlist(edges: DataFrame) -> DataFrame:
    """All ties, and every node's best distinct neighbours: as many as its list is long, where full lists of links double.

    Offers for a node are bounded by what its blocks emit, and the first of its
    neighbours by (similarity, id) stay; beside links alone, LISTS[0] of the rest.
    """
    tie = F.col("sim").isNull()
    each = edges.groupBy("u", "v", tie.alias("tie")).agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u", "tie").orderBy(F.desc("sim"), "v"))
    links = F.sum((F.col("sim") >= THRESHOLD).cast("long")).over(Window.partitionBy("u", "tie"))
    length = F.lit(LISTS[-1])
    for n in reversed(LISTS[:-1]):
        length = F.when(F.col("__links") < n, n).otherwise(length)
    ranked = each.withColumns({"__rank": rank, "__links": links}).withColumn("most", length)
    beside = (F.col("__links") >= F.col("most")) & F.col("__rank").between(F.col("__links") + 1, F.col("__links") + LISTS[0])
    return ranked.filter(F.col("tie") | (F.col("__rank") <= F.col("most")) | beside).select("u", "v", "sim", "most", "fresh")


def _round(graph: DataFrame, found: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """Neighbours of neighbours: the nodes next to a node meet there, if some are new and they are of several components."""
    graph = graph.filter("sim IS NOT NULL")
    end = lambda at, node, fresh: graph.select(F.col(at).alias("at"), F.col(node).alias("node"), fresh)
    sides = end("v", "u", F.col("fresh")).union(end("u", "v", F.col("fresh"))).union(end("u", "u", F.lit(False)))
    sides = sides.groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
    sides = sides.join(labels, F.col("node") == F.col("__node"), "left").select("at", "node", "fresh", F.coalesce("__component", "node").alias("c"))
    sides = stash(sides, "sides")
    open_at = sides.groupBy("at").agg(F.max("fresh").alias("fresh"), F.min("c").alias("low"), F.max("c").alias("high")).filter("fresh AND low <> high")
    sides = sides.join(open_at.select(F.col("at").alias("__at")), F.col("at") == F.col("__at"), "left_semi")
    most = graph.groupBy("u").agg(F.max("most").alias("most"))
    dealt = split_keys(sides, ["at"], "node", BLOCK, F.col("at"), F.lit(salt))
    # Parts are cut anew in every round, so all that meets in a part may be new there.
    dealt = dealt.select("at", "__part", "node", (F.col("fresh") | (F.col("__parts") > 1)).alias("fresh"))
    members = stash(found.join(most, found["node"] == most["u"], "left").select(F.col("node").alias("__id"), "v", F.coalesce("most", F.lit(LISTS[0])).alias("most")), "members")
    rows = dealt.join(members, dealt["node"] == members["__id"]).select("at", "__part", "node", "most", "fresh", "v")
    return stream_blocks(rows, ["at", "__part"], _meet, _EDGE)


def _seeds(found: DataFrame, counts: dict[int, int], first: int) -> DataFrame:
    signed = found.select("node", "v").mapInArrow(_signer(counts, TABLES, first), "dim int, table long, code long, node long, v array<double>")
    signed = stash(signed, "signed")
    keys = ["dim", "table", "code"]
    dealt = split_keys(signed.select(*keys, "node"), keys, "node", BLOCK, F.col("table")).select(*keys, "__part", "node")
    members = signed.select(F.col("table").alias("__t"), F.col("node").alias("__id"), "v")
    rows = dealt.join(members, (F.col("table") == F.col("__t")) & (F.col("node") == F.col("__id")))
    rows = rows.select(*keys, "__part", "node", F.lit(LISTS[0]).alias("most"), F.lit(True).alias("fresh"), "v")
    return stream_blocks(rows, [*keys, "__part"], _meet, _EDGE)


def _labels(edges: DataFrame) -> DataFrame:
    """(__node, __component) of all linked nodes, as far as links are known."""
    links = edges.filter((F.col("sim") >= THRESHOLD) | F.col("sim").isNull())
    return stash(components(links, "u", "v").select(F.col("node").alias("__node"), F.col("component").alias("__component")), "placed")


def _refine(edges: DataFrame, found: DataFrame, search: int) -> DataFrame:
    graph = stash(_shortlist(edges), "graph")
    labels = _labels(graph)
    before = None
    for turn in range(ROUNDS):
        state = graph.agg(F.count("sim"), F.sum("sim")).first()
        if not state[0] or before and state[0] - before[0] <= 0.01 * before[0] and state[1] - before[1] <= 0.01 * before[1]:
            break
        before = state
        known = graph.select("u", "v", "sim", F.lit(False).alias("fresh"))
        more = stash(_shortlist(known.union(_round(graph, found, labels, search * ROUNDS + turn))), "graph")
        unstash(graph)
        graph = more
    return graph.select("u", "v", "sim", F.lit(False).alias("fresh"))


def _count_links(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of each node inside a block of its component; a node in the high part also meets the low one."""
    ends = np.append(starts[1:], table.num_rows)
    out_node, out_n = [], []
    node, part, copies = (table.column(c).to_numpy() for c in ("node", "__part", "copies"))
    for a, b in zip(starts, ends):
        x = _unit(table.column("v").slice(int(a), int(b - a)))
        p, w = part[a:b], copies[a:b].astype(np.float64)
        parts = np.unique(p)
        one = len(parts) == 1 and table.column("__alone")[int(a)].as_py()
        for s in range(0, len(x), 1024):
            near = x[s : s + 1024] @ x.T >= THRESHOLD
            near[np.arange(len(near)), s + np.arange(len(near))] = False
            if not one:
                near &= p[s : s + 1024, None] != p[None, :]
            out_node.append(node[a + s : a + s + len(near)])
            out_n.append((near @ w).astype(np.int64))
    if out_node:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node)), pa.array(np.concatenate(out_n))], names=["node", "n"])


def _exact_counts(member: DataFrame) -> DataFrame:
    """(node, n): copies of other nodes linked directly, from (component, node, v, copies)."""
    rows = split_keys(member, ["component"], "node", BLOCK)
    blocks = pair_blocks(rows).withColumn("__alone", F.pmod("__block", F.col("__parts") + 1) == 0)
    blocks = blocks.select("component", "__block", "__part", "__alone", "node", "copies", "v")
    return stream_blocks(blocks, ["component", "__block"], _count_links, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _audit(found: DataFrame, placed: DataFrame) -> float | None:
    """Share of the true links of a sample whose ends are in one component; None if it has no link.

    The sample goes through the driver AUDIT[1] vectors at a time, each lot in a pass over all vectors.
    """
    rows = found.join(placed, F.col("node") == F.col("__node"), "left").select("node", "asked", F.coalesce("__component", "node").alias("c"), "v")
    n = found.filter("asked").count()
    sample = rows.filter("asked") if n >= AUDIT[0] else rows.orderBy(F.desc("asked"), F.xxhash64("node")).limit(AUDIT[0])
    lots = running_totals(sample.select("node", "c", "v", F.lit(1).alias("one")), [], ["node"], {"no": "one"})
    lots = stash(lots.withColumn("lot", F.floor(F.col("no") / AUDIT[1])), "audit")
    true = got = 0
    for lot in range((lots.agg(F.max("lot")).first()[0] or 0) + 1):
        t, g = _audited(rows, lots.filter(F.col("lot") == lot).collect())
        true, got = true + t, got + g
    unstash(lots)
    return got / true if true else None


def _audited(rows: DataFrame, sample: list) -> tuple[int, int]:
    """True links of the sample's vectors with all, and how many of them have both ends in one component."""
    by_dim: dict[int, tuple] = {}
    for dim in {len(r["v"]) for r in sample}:
        some = [r for r in sample if len(r["v"]) == dim]
        lists = pa.array([r["v"] for r in some], type=pa.list_(pa.float64()))
        by_dim[dim] = (_unit(lists), np.array([r["node"] for r in some]), np.array([r["c"] for r in some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = got = 0
        for batch in batches:
            nodes_of, comps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, lists in _by_length(batch.column(2)) if batch.num_rows else ():
                if (found := by_dim.get(len(lists[0]))) is None:
                    continue
                x = _unit(lists)
                for s in range(0, len(found[0]), 1024):
                    asked, ids, own = (f[s : s + 1024] for f in found)
                    near = (x @ asked.T >= THRESHOLD) & (nodes_of[at][:, None] != ids[None, :])
                    true += int(near.sum())
                    got += int((near & (comps[at][:, None] == own[None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([got])], names=["t", "g"])

    t, g = rows.select("node", "c", "v").mapInArrow(run, "t long, g long").agg(F.sum("t"), F.sum("g")).first()
    return t or 0, g or 0


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall)."""
    found = stash(nodes(vectors).select(F.monotonically_increasing_id().alias("node"), "least", "v", "copies", "dim", "asked"), "nodes")
    counts = {r[0]: r[1] for r in found.groupBy("dim").count().collect()}  # one row for each length
    recall = None
    named = found.select("v", "copies", F.lit(0).cast("long").alias("n"), F.col("least").alias("c"))
    if counts:
        edges = None
        for search in itertools.count():
            seeds = _seeds(found, counts, search * TABLES)
            edges = stash(_refine(seeds if edges is None else edges.union(seeds), found, search), "edges")
            placed = _labels(edges)
            before, recall = recall, _audit(found, placed)
            if recall is None or recall >= RECALL:
                break
            if search + 1 >= SEARCHES and before is not None and recall <= before:
                if recall < LEAST:
                    raise RuntimeError(f"near-dedup found {recall:.4f} of the audited links after {search + 1} searches, and {LEAST} are wanted")
                break
        member = found.join(placed, F.col("node") == F.col("__node")).select(F.col("__component").alias("component"), "node", "least", "v", "copies")
        links = stash(_exact_counts(member.drop("least")), "counts").select(F.col("node").alias("__n"), "n")
        heads = member.groupBy(F.col("component").alias("__c")).agg(F.min("least").alias("__head"))
        heads = stash(placed.join(heads, F.col("__component") == F.col("__c")).select("__node", "__head"), "heads")
        named = found.join(heads, F.col("node") == F.col("__node"), "left").join(links, F.col("node") == F.col("__n"), "left")
        named = named.select("v", "copies", "n", F.coalesce("__head", "least").alias("c"))
    named = stash(named.select("v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("__links"), F.col("c").alias("__component_id")), "named")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("__v"))
    out = rows.join(named, (F.col("__v") == F.col("v")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("__component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
