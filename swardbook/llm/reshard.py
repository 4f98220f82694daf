"""Reshard by minimum-cost flow over shard sizes.

Old shards are sources of their bytes, new shards are sinks of their capacity;
a byte that stays in its shard costs nothing and a byte that moves costs one.
The flow is solved on the driver over shard totals, a table of one row a shard.

All of it is planned before a text moves, on three numbers a row: old shard,
size, and a key hashed from the row's file and place in it. In the order of that
key each old shard becomes a run of consecutive blocks, one for each transfer out
of it, the block that stays first; a block's border is a key, so (old shard, key)
tells any row its new shard without a join that grows. Rows larger than a small
share of a capacity (at most NEW_SHARDS / LARGE of them exist) are placed one by
one before the flow, in their own shard where they fit, so that borders fall
among small rows and new shards come out near equal.

Then affected shards are rewritten: rows that move are shuffled, rows that stay
are written by the task that reads them, and shards that nothing leaves or
enters are left alone. A row's slot is its place in its shard's files.

Defined cases: a null text has 0 bytes, so size 8; a null doc_id hashes as a
value of its own; a text larger than a capacity is one row and makes its shard
as large as itself; repeated rows are separate rows with their own keys and
slots; fewer rows than shards leave shards empty; an empty table gives no rows;
other columns are carried into the files whatever their names, except that the
working columns start with two underscores.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .scratch import fresh_path, partitions, running_totals

OLD_SHARDS = 16
NEW_SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Rows over this share of a capacity are placed one by one.
LARGE = 1 / 64


def min_cost_flow(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """Cheapest shipment from old shards to new ones: {(old, new): bytes}.

    Successive shortest paths with potentials on the bipartite network; shard i
    ships to shard i for nothing and elsewhere for 1. sum(supply) must not exceed
    sum(demand).
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # [to, capacity, cost]
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, capacity: int, cost: int) -> None:
        out[a].append(len(edges))
        edges.append([b, capacity, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, s in enumerate(supply):
        link(source, i, s, 0)
    for j, d in enumerate(demand):
        link(n + j, sink, d, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            link(i, n + j, supply[i], int(i != j))
    height = [0] * (n + m + 2)
    while True:
        far = {source: 0}
        via: dict[int, int] = {}
        queue = [(0, source)]
        while queue:
            d, x = heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                to, capacity, cost = edges[e]
                step = d + cost + height[x] - height[to]
                if capacity and step < far.get(to, 1 << 60):
                    far[to], via[to] = step, e
                    heappush(queue, (step, to))
        if sink not in far:
            break
        for x in range(len(height)):
            height[x] += far.get(x, far[sink])
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = edges[via[x] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return {(i, j): f for i in range(n) for j in range(m) if (f := edges[first + 2 * (i * m + j) + 1][1])}


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of the bytes, the remainder to the first shards."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def lay_out(docs: DataFrame, path: str, shards: int | Column = OLD_SHARDS) -> StructType:
    """Write docs as the old shards, by a column or dealt by the hash of doc_id: what a resharding starts from. Returns the files' schema."""
    home = F.pmod(F.xxhash64("doc_id"), F.lit(shards)) if isinstance(shards, int) else shards
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    rows = docs.select("*", size.alias("__size"), home.cast("int").alias("__shard"))
    rows.write.options(compression="zstd").partitionBy("__shard").parquet(path)
    return rows.schema


def _keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a layout with a key that depends on their file and place in it."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("__key"))


def plan(spark: SparkSession, path: str, schema: StructType, new_shards: int = NEW_SHARDS) -> tuple[list[tuple], list[tuple]]:
    """(blocks, singles) of the layout at path: (old shard, first key, end key, new shard), and (old shard, key, new shard) of large rows."""
    rows = _keyed(spark, path, schema).select("__shard", "__size", "__key")
    bytes_of = {r[0]: r[1] for r in rows.groupBy("__shard").agg(F.sum("__size")).collect()}  # one row a shard
    total, count = sum(bytes_of.values()), max([new_shards, *(k + 1 for k in bytes_of)])
    large = int(total / new_shards * LARGE)
    big = [tuple(r) for r in rows.filter(F.col("__size") > large).select("__size", "__shard", "__key").collect()]  # at most new_shards / LARGE rows
    small = [bytes_of.get(k, 0) for k in range(count)]
    for size, shard, _ in big:
        small[shard] -= size
    singles, free = place_large(big, capacities(total, new_shards))
    flow = min_cost_flow(small, fit(free, sum(small)))
    cuts = []
    for i in range(count):
        at, goes = 0, sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j))
        for j in goes:
            cuts.append((i, j, at, 1 << 62 if j == goes[-1] else at + flow[i, j]))
            at += flow[i, j]
    if not cuts:
        return [], singles
    borders = F.broadcast(spark.createDataFrame(cuts, "__o int, __to int, __lo long, __hi long"))  # at most one row for each old and new shard
    summed = running_totals(rows.filter(F.col("__size") <= large), ["__shard"], ["__key"], {"__before": "__size"})
    middle = F.col("__before") + F.floor(F.col("__size") / 2)
    inside = summed.join(borders, (F.col("__shard") == F.col("__o")) & (middle >= F.col("__lo")) & (middle < F.col("__hi")))
    firsts = sorted(tuple(r) for r in inside.groupBy("__shard", "__to").agg(F.min("__key").alias("k")).select("__shard", "k", "__to").collect())
    blocks = []
    for k, (i, first, j) in enumerate(firsts):
        alone = k == 0 or firsts[k - 1][0] != i
        after = firsts[k + 1][1] if k + 1 < len(firsts) and firsts[k + 1][0] == i else None
        blocks.append((i, None if alone else first, after, j))
    return blocks, singles


def place_large(rows: list[tuple[int, int, int]], caps: list[int]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Place (size, old shard, key) largest first: at home if it fits, else where most is free.

    Returns (old shard, key, shard) for each, and what is left of the capacities.
    """
    free, out = list(caps), []

    def put(row: tuple[int, int, int], shard: int) -> None:
        size, *where = row
        out.append((*where, shard))
        free[shard] -= size

    away = []
    for row in sorted(rows, key=lambda r: (-r[0], r[1:])):
        home = row[1] < len(free) and free[row[1]] >= row[0]
        put(row, row[1]) if home else away.append(row)
    for row in away:
        put(row, max(range(len(free)), key=lambda k: (free[k], -k)))
    return out, free


def fit(free: list[int], total: int) -> list[int]:
    """Demands that add up to total: what is free, less the overdraft of shards that large rows overfill."""
    level, demand = 0, [max(0, f) for f in free]
    while (over := sum(demand) - total) > 0:
        live = [k for k, d in enumerate(demand) if d]
        level = max(1, min(over // len(live), min(demand[k] for k in live)))
        for k in live[: max(1, over)] if over < len(live) else live:
            demand[k] -= level
    return demand


def rewrite(spark: SparkSession, old_path: str, schema: StructType, planned: tuple[list[tuple], list[tuple]], path: str) -> set[int]:
    """Write the shards whose rows change to path, a folder each; returns their numbers."""
    blocks, singles = planned
    moves = {(i, j) for i, _, _, j in blocks} | {(i, j) for i, _, j in singles}
    affected = {k for pair in moves if pair[0] != pair[1] for k in pair}
    rows = _keyed(spark, old_path, schema).filter(F.col("__shard").isin(sorted(affected)))
    cuts = F.broadcast(spark.createDataFrame(blocks, "__o int, __lo long, __hi long, __block int"))  # a row for each old and new shard
    lone = F.broadcast(spark.createDataFrame(singles, "__so int, __sk long, __single int"))  # new_shards / LARGE rows
    key = F.col("__key")
    in_block = (F.col("__shard") == F.col("__o")) & (F.col("__lo").isNull() | (key >= F.col("__lo"))) & (F.col("__hi").isNull() | (key < F.col("__hi")))
    placed = rows.join(cuts, in_block, "left").join(lone, (F.col("__shard") == F.col("__so")) & (key == F.col("__sk")), "left")
    placed = placed.withColumn("__to", F.coalesce("__single", "__block"))
    names = [c for c in schema.names if c != "__shard"]
    n = partitions(spark)
    spread = F.pmod(key, F.lit(max(1, -(-2 * n // max(1, len(affected))))))
    moved = placed.filter("__to <> __shard").repartition(n, "__to", spread)
    for some in (placed.filter("__to = __shard"), moved):
        out = some.select(*names, F.col("__shard").alias("__old_shard"), F.col("__to").alias("__shard"))
        out.write.mode("append").options(compression="zstd").partitionBy("__shard").parquet(path)
    return affected


def layout(spark: SparkSession, old_path: str, schema: StructType, path: str, affected: set[int], columns: list[Column | str]) -> DataFrame:
    """columns, __shard, __old_shard and __slot of the new layout: the shards at path, and those left alone where they are.

    Slots follow the order of a shard's files; one row for each file is all that this adds.
    """
    new = spark.read.schema(StructType([*schema.fields]).add("__old_shard", IntegerType())).parquet(path)
    old = spark.read.schema(schema).parquet(old_path).filter(~F.col("__shard").isin(sorted(affected)))
    file, row = F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")
    rows = new.select(*columns, "__shard", "__old_shard", file, row).union(old.select(*columns, "__shard", F.col("__shard").alias("__old_shard"), file, row))
    files = rows.groupBy(F.col("__shard").alias("__s"), F.col("__file").alias("__f")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("__s").orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__s", "__f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    found = rows.join(files, (F.col("__shard") == F.col("__s")) & (F.col("__file") == F.col("__f")))
    return found.withColumn("__slot", (F.col("__from") + F.col("__row")).cast("long")).drop("__s", "__f", "__from", "__file", "__row")


def query(spark, sf_dir: str) -> DataFrame:
    old, new = fresh_path(spark, "old-shards"), fresh_path(spark, "new-shards")
    schema = lay_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), old)
    affected = rewrite(spark, old, schema, plan(spark, old, schema), new)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32")
    rows = layout(spark, old, schema, new, affected, ["doc_id", F.col("__size").alias("size"), crc])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
