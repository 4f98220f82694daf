"""Scores of read sheets against checked ones, and size-bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import id_block, numbered

#: Fixed value: a price counts as read if it is this close.
PRICE_REACH = 1.01


def days_of(c: Column) -> Column:
    """Distinct numbers of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")))


def same_person(gold: Column, read: Column) -> Column:
    """Do two rows with name and words (its long words) name one person: equal names, or a first long word in common and another, if both have one?"""
    a, b = gold["words"], read["words"]
    single = (F.size(a) == 1) | (F.size(b) == 1)
    first = F.get(a, F.lit(0))
    shared = F.when(single, F.length(first) >= 5).otherwise(F.size(F.array_intersect(a, b)) >= 2)
    return (gold["name"] == read["name"]) | F.coalesce((first == F.get(b, F.lit(0))) & shared, F.lit(False))


def recall(gold: DataFrame, read: DataFrame) -> DataFrame:
    """Counts for each sheet. gold, read: sheet, seq, name, price, days (array<int>).

    Rows match greedily in order, each read row once: a fold over a sheet's
    checked rows keeps which read rows are used. A sheet of paper bounds both arrays.
    """
    row = "array<struct<seq:bigint,name:string,words:array<string>,price:double,days:array<int>>>"

    def listed(df: DataFrame, name: str) -> DataFrame:
        shaped = df.select("sheet", F.col("seq").cast("long").alias("seq"), T.norm_name(F.col("name")).alias("name"), F.col("price").cast("double").alias("price"), "days").filter("name <> ''")
        words = F.filter(F.split("name", " "), lambda w: F.length(w) >= 4)
        shaped = shaped.select("sheet", F.struct("seq", "name", words.alias("words"), "price", F.coalesce("days", F.array().cast("array<int>")).alias("days")).alias("row"))
        return shaped.groupBy(F.col("sheet").alias(f"{name}_sheet")).agg(F.array_sort(F.collect_list("row")).cast(row).alias(name))

    both = listed(gold, "gold").join(listed(read, "read"), F.col("gold_sheet").eqNullSafe(F.col("read_sheet")), "full")
    both = both.select(F.coalesce("gold_sheet", "read_sheet").alias("sheet"), *(F.coalesce(c, F.array().cast(row)).alias(c) for c in ("gold", "read")))

    def match(acc: Column, g: Column) -> Column:
        at = F.array_min(F.filter(F.transform("read", lambda r, i: F.when(same_person(g, r) & ~F.array_contains(acc["used"], i), i)), lambda i: i.isNotNull()))
        hit = F.get("read", at)
        price = F.coalesce(F.abs(g["price"] - hit["price"]) <= PRICE_REACH, F.lit(False))
        days = F.coalesce((F.size(g["days"]) > 0) & (F.size(F.array_except(g["days"], hit["days"])) == 0), F.lit(False))
        add = lambda n, by: (acc[n] + by.cast("long")).alias(n)
        return F.when(at.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(at)).alias("used"), add("clients", F.lit(1)), add("prices", price), add("day_hits", days)))

    nothing = F.struct(F.array().cast("array<int>").alias("used"), *(F.lit(0).cast("long").alias(n) for n in ("clients", "prices", "day_hits")))
    found = both.withColumn("found", F.aggregate("gold", nothing, match))
    count = lambda c: F.size(c).cast("long")
    return found.select(
        "sheet", count("gold").alias("n_gold"), count(F.filter("gold", lambda g: g["price"].isNotNull())).alias("n_price"), count(F.filter("gold", lambda g: F.size(g["days"]) > 0)).alias("n_days"),
        count("read").alias("n_read"), "found.clients", "found.prices", "found.day_hits",
    )


def rates(counts: DataFrame) -> DataFrame:
    """Recalls of each sheet, to four places; null where there is nothing to find."""
    rate = lambda n, d: F.round(F.col(n) / F.nullif(F.col(d), F.lit(0)), 4)
    return counts.select("*", F.coalesce(rate("clients", "n_gold"), F.lit(0.0)).alias("client_recall"), rate("prices", "n_price").alias("price_recall"), rate("day_hits", "n_days").alias("day_recall"))


def weighted(counts: DataFrame) -> DataFrame:
    """Recalls over all sheets, weighted by their rows, and the plain mean of client recalls."""
    rate = lambda n, d: F.round(F.sum(n) / F.nullif(F.sum(d), F.lit(0)), 4)
    mean = F.coalesce(F.round(F.avg("client_recall"), 4), F.lit(0.0))
    return rates(counts).agg(rate("clients", "n_gold").alias("client_recall"), rate("prices", "n_price").alias("price_recall"), rate("day_hits", "n_days").alias("day_recall"), mean.alias("mean_client_recall"))


def chunks(names: DataFrame, size: int, order: str, group: str) -> DataFrame:
    """Number fixed-size chunks of a group's rows in order of a number; a group of any size spreads by blocks of it."""
    at = numbered(names, "__at", [order], [id_block(F.col(order))], [group])
    return at.withColumn("chunk", F.floor((F.col("__at") - 1) / size).cast("int")).drop("__at")


def batches(files: DataFrame, limit: int, group: str, order: str, size: str) -> DataFrame:
    """Number batches of files in order: a batch closes before it would pass limit.

    Where a batch ends depends on all before it, so a group's files go through
    one task in order; they are streamed, and only what the open batch holds is kept.
    """

    def fill(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, held = None, 0, 0
        for batch in rows:
            out = []
            for g, n in zip(batch[group], batch[size]):
                if g != now:
                    now, number, held = g, 0, 0
                elif held and held + n > limit:
                    number, held = number + 1, 0
                held += n
                out.append(number)
            yield batch.assign(batch=pd.Series(out, index=batch.index, dtype="int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(group).sortWithinPartitions(group, order).mapInPandas(fill, f"{fields}, batch int")
