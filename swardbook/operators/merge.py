"""Office lists into one roster: first source with a value wins, notes add up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..functions import text as T
from . import state
from .once import once

FIELDS = ("address", "mow_price", "hedge_price", "email", "phone", "prefer_mail", "hedge_roster", "entity_kind")


def merge_sources(records: DataFrame) -> DataFrame:
    """One row for each name key of records (source, seq, name, fields…, billing_notes).

    The first value by (source, seq) wins; the name moves to a longer form or to
    one with a comma; a note is added after ' | ' unless it is already contained.
    """
    keyed = records.withColumns({"key": T.name_key(F.trim("name")), "__at": F.struct("source", "seq")}).filter("key <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("__at"))).alias(c)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(c).alias("v")))), lambda x: x["v"])
    better = lambda old, new: F.when(old == "", new).when((F.length(new) > F.length(old)) | (new.contains(",") & ~old.contains(",")), new).otherwise(old)
    name = F.aggregate(ordered("name"), F.lit(""), lambda acc, x: better(acc, F.trim(x)))
    note = lambda acc, x: F.when(F.coalesce(x, F.lit("")) == "", acc).when(acc == "", x).when(acc.contains(x), acc).otherwise(F.concat_ws(" | ", acc, x))
    notes = F.nullif(F.aggregate(ordered("billing_notes"), F.lit(""), note), F.lit(""))
    fields = [first(c) for c in FIELDS if c in records.columns]
    return keyed.groupBy("key").agg(name.alias("name"), *fields, notes.alias("billing_notes"))


def lookup(rows: DataFrame, mapping: DataFrame, value: str, out: str) -> DataFrame:
    """Add out: the mapping's value for a name's key, else for the key of what stands before its comma. mapping: key, value."""
    whole = mapping.select(F.col("key").alias("__k1"), F.col(value).alias("__v1"))
    short = mapping.select(F.col("key").alias("__k2"), F.col(value).alias("__v2"))
    surname = F.when(F.col("name").contains(","), T.name_key(F.split_part("name", F.lit(","), F.lit(1))))
    df = rows.withColumns({"__w": T.name_key(F.col("name")), "__s": surname})
    df = df.join(whole, F.col("__w") == F.col("__k1"), "left").join(short, F.col("__s") == F.col("__k2"), "left")
    return df.withColumn(out, F.coalesce("__v1", "__v2")).drop("__w", "__s", "__k1", "__v1", "__k2", "__v2")


@F.pandas_udf(ArrayType(StructType().add("key", StringType()).add("id", LongType())))
def _taken(edges: pd.Series) -> pd.Series:
    """What records take of (seq, gap, id, key) in that order: the nearest client that is still free."""

    def run(group) -> list[dict]:
        keys, ids = {}, set()
        for e in group:
            if e["key"] not in keys and e["id"] not in ids:
                keys[e["key"]] = e["id"]
                ids.add(e["id"])
        return [{"key": k, "id": i} for k, i in keys.items()]

    return edges.map(run)


def match_roster(records: DataFrame, clients: DataFrame) -> DataFrame:
    """(key, id): which client each office record is. Exact keys first, then a shorter key of eight letters or more that starts the longer.

    Every beginning of eight letters or more is a key to join by, so the search
    is an equi-join. Every client is used once; in their order, records take the
    free client whose key is nearest in length, so that the longer of two numbers
    at the end of a name is not taken for the shorter. Keys that compete begin
    with one shortest key, and only those take their clients together.

    Beginnings are many times the rows that they are of, which Spark does not
    expect when it plans, so the joins are asked for as merges: else it sends
    what it takes for small through the driver.
    """
    names = clients.select("id", T.name_key(F.col("name")).alias("__key"))
    exact = records.select("key", "seq").join(names.hint("merge"), F.col("key") == F.col("__key")).withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter("__r = 1").select("key", "id")
    left = records.select("key", "seq").join(exact.select("key").hint("merge"), "key", "left_anti")
    free = names.join(exact.select("id").hint("merge"), "id", "left_anti")
    begun = lambda c, least: F.explode(F.transform(F.sequence(F.lit(least), F.length(c)), lambda n: F.left(F.col(c), n)))
    within = left.filter(F.length("key") >= 8).withColumn("__begun", begun("key", 8)).join(free.hint("merge"), F.col("__begun") == F.col("__key"))
    # A client's key is longer by a letter or more; equal ones were found above.
    beyond = free.filter(F.length("__key") >= 9).withColumn("__begun", begun("__key", 8)).filter("__begun <> __key").join(left.hint("merge"), F.col("__begun") == F.col("key"))
    gap = F.abs(F.length("key") - F.length("__key")).alias("gap")
    short = F.col("__begun").alias("short")
    near = once(within.select("key", "seq", "id", gap, short).union(beyond.select("key", "seq", "id", gap, short)))
    # The shorter key of a pair begins with some shortest one, its root, which is the shorter key of a pair itself.
    roots = near.select(F.col("short").alias("__root")).distinct()
    rooted = near.select("short").distinct().withColumn("__begun", begun("short", 8)).join(roots.hint("merge"), F.col("__begun") == F.col("__root")).groupBy("short").agg(F.min_by("__root", F.length("__root")).alias("__root"))
    # Greedy in record order: a record takes its nearest free client.
    taken = near.join(rooted.hint("merge"), "short").groupBy("__root").agg(F.array_sort(F.collect_list(F.struct("seq", "gap", "id", "key"))).alias("__all"))
    return exact.union(taken.select(F.inline(_taken("__all"))).select("key", "id"))


#: What notes may not say; such notes are dropped with a row that the office lists no longer have.
BANNED = ("handwritten row", "crossed out", "printed $")
#: Fields that the office lists fill where they have a value, and keep where they have none.
FILLED = ("email", "phone", "address", "billing_address", "mow_price", "prefer_mail", "entity_kind", "sort_order", "mowing_group")


def import_office(records: DataFrame, clients: DataFrame) -> DataFrame:
    """The roster after an office import. records: key, seq, name and any of the roster's fields, one row a key.

    A record finds its client by match_roster. What it has fills the client;
    notes and hedge data are the office's, null included, and so is the name
    unless another client has it. Records without a client are added. Clients
    without a record lose their hedge data, and notes with a banned phrase.
    """
    pairs = match_roster(records.select("key", "seq"), clients).select(F.col("key").alias("__key"), F.col("id").alias("__id"))
    has = lambda c: F.col(f"r.{c}") if c in records.columns else F.lit(None)
    taken = clients.select(T.name_key(F.col("name")).alias("__taken")).distinct()
    found = records.join(pairs, F.col("key") == F.col("__key")).join(taken, F.col("key") == F.col("__taken"), "left")
    rows = clients.alias("c").join(found.alias("r"), F.col("c.id") == F.col("r.__id"), "left")
    hit, hedged = F.col("r.__id").isNotNull(), F.coalesce(has("hedge_roster"), F.lit(False))
    notes, scrubbed = F.coalesce("c.billing_notes", F.lit("")), F.lit(False)
    for phrase in BANNED:
        scrubbed = scrubbed | F.lower(notes).contains(phrase)
    new = {c: F.coalesce(has(c), F.col(f"c.{c}")) for c in FILLED}
    new["name"] = F.when(hit & F.col("r.__taken").isNull(), F.col("r.name")).otherwise(F.col("c.name"))
    new["billing_notes"] = F.when(hit, has("billing_notes").cast("string")).when(~scrubbed, F.nullif(notes, F.lit("")))
    new["hedge_price"] = F.when(hit & hedged, has("hedge_price")).cast("decimal(12,2)")
    new["hedge_roster"] = hit & hedged
    after = rows.select(*((new[c] if c in new else F.col(f"c.{c}")).alias(c) for c in clients.columns))
    fields = [c for c in ("name", *FILLED, "billing_notes", "hedge_price", "hedge_roster") if c in records.columns]
    added = records.join(pairs, F.col("key") == F.col("__key"), "left_anti").select(*fields)
    return state.coalesce_clients(after, added)


def import_counts(clients: DataFrame) -> DataFrame:
    """What an import reports of the roster, one row."""
    return clients.agg(
        F.count("*").alias("clients"), F.count("mow_price").alias("with_mow"), F.count("hedge_price").alias("with_hedge"), F.count_if(F.coalesce("hedge_roster", F.lit(False))).alias("on_hedge_roster"),
        F.count("phone").alias("with_phone"), F.count("billing_address").alias("with_billing_address"),
    )
