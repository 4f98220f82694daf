"""Office lists: roster rows, the hedge text, phones, labels and groups, from rows or lines.

Readers of xlsx and docx files hand over plain rows; everything from there on is
columns. A line source has (doc, line_no, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed patterns of the hedge list.
NAME_LINE = r"^[A-Z][A-Z' .\-]+,\s+\S"
PRICE_LINE = r"^\$?\d+(?:\.\d+)?(?:\s*/\s*\$?\d+(?:\.\d+)?)?$"
ADDRESS_LINE = r"(?i)\d|Rd\.?|Road|Ln\.?|Lane|St\.?|Street|Ave|Court|Ct\.?"
STOP_LINES = ("HEDGES CLIENT", "JULIE CAMERON")


def roster_rows(rows: DataFrame) -> DataFrame:
    """Cleaned roster of rows (seq, name, address, price, notes): no header lines, price 0 is none, notes give contact data."""
    kept = rows.filter((T.strip(F.col("name")) != "") & ~F.upper(F.trim("name")).startswith("REGULAR MAIL"))
    price = F.nullif(F.col("price").cast("string").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
    notes = T.strip(F.col("notes"))
    return kept.select(
        "seq", F.trim("name").alias("name"), T.blank_to_null(F.col("address")).alias("address"), price.alias("mow_price"), T.note_email(notes).alias("email"), T.note_phone(notes).alias("phone"),
        F.upper(notes).contains("REGULAR MAIL").alias("prefer_mail"), F.nullif(notes, F.lit("")).alias("billing_notes"), T.entity_kind(F.trim("name")).alias("entity_kind"),
    )


def _stops(line: Column) -> Column:
    return F.upper(line).startswith(STOP_LINES[0]) | F.upper(line).startswith(STOP_LINES[1])


def hedge_records(lines: DataFrame) -> DataFrame:
    """Records of a line list: a name line starts one, price, address and note lines follow.

    A running count of name lines numbers the records; a document is one list on paper.
    """
    order = Window.partitionBy("doc").orderBy("line_no")
    text = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    text = text.withColumn("__head", F.min(F.when(F.lower("line") == "notes", F.col("line_no"))).over(Window.partitionBy("doc")))
    body = text.filter("__head IS NULL OR line_no > __head")
    body = body.withColumn("__end", F.min(F.when(_stops(F.col("line")), F.col("line_no"))).over(Window.partitionBy("doc"))).filter("__end IS NULL OR line_no < __end")
    is_name = F.col("line").rlike(NAME_LINE) & ~F.col("line").rlike(PRICE_LINE)
    body = body.withColumns({"__name": is_name, "record": F.sum(is_name.cast("int")).over(order)}).filter("record > 0")
    priced = ~F.col("__name") & F.col("line").rlike(PRICE_LINE)
    place = ~F.col("__name") & ~priced & F.col("line").rlike(ADDRESS_LINE) & (F.length("line") < 80)
    body = body.withColumns({"__priced": priced, "__place": place})
    body = body.withColumn("__first", F.min(F.when(F.col("__place"), F.col("line_no"))).over(Window.partitionBy("doc", "record")))
    own = F.col("__place") & (F.col("line_no") == F.col("__first"))
    pick = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line_no", "line")))), lambda x: x["line"])
    g = body.groupBy("doc", "record").agg(F.min_by("line", "line_no").alias("name"), F.min(F.when(own, F.col("line"))).alias("address"), pick(F.col("__priced")).alias("prices"), pick(~F.col("__name") & ~F.col("__priced") & ~own).alias("rest"))
    single = (F.size("prices") == 1) & ~F.get("prices", F.lit(0)).contains("/")
    price = F.when(single, F.regexp_extract(F.get("prices", F.lit(0)), r"(\d+(?:\.\d+)?)", 1).try_cast("decimal(12,2)"))
    told = F.when(~single & (F.size("prices") > 0), F.concat(F.lit("hedge cell lists "), F.array_join("prices", " and ")))
    notes = F.nullif(F.concat_ws(" ", F.array_join("rest", " "), told), F.lit(""))
    return g.select("doc", "record", "name", "address", price.alias("hedge_price"), F.trim(notes).alias("billing_notes"), F.lit(True).alias("hedge_roster"), F.lit("client").alias("entity_kind"))


def row_order(rows: DataFrame) -> DataFrame:
    """(key, sort_order) of a table's names (seq, name): their place, also under the name before a bracket; the first place wins."""
    keys = F.array_distinct(F.array(T.name_key(F.col("name")), T.name_key(F.split_part("name", F.lit("("), F.lit(1)))))
    return rows.select((F.col("seq") + 1).alias("sort_order"), F.explode(keys).alias("key")).filter("key <> ''").groupBy("key").agg(F.min("sort_order").alias("sort_order"))


def labels(rows: DataFrame) -> DataFrame:
    """(key, billing_address) of mailing labels (seq, label): name line, then address lines; a surname that one label has is a key as well."""
    lines = F.filter(F.split("label", r"\r?\n"), lambda x: F.trim(x) != "")
    parts = rows.select("seq", lines.alias("l")).filter(F.size("l") > 1).select("seq", F.trim(F.get("l", F.lit(0))).alias("name"), F.array_join(F.transform(F.slice("l", 2, F.size("l")), lambda x: F.trim(x)), ", ").alias("billing_address"))
    whole = parts.select(T.name_key(F.col("name")).alias("key"), "billing_address", "seq", F.lit(0).alias("p"))
    last = F.when(F.col("name").contains(","), F.split_part("name", F.lit(","), F.lit(1))).otherwise(F.element_at(F.split("name", r"\s+"), -1))
    short = parts.select(T.name_key(last).alias("key"), "billing_address", "seq", F.lit(1).alias("p"))
    return whole.union(short).filter("key <> ''").groupBy("key").agg(F.min_by("billing_address", F.struct("p", "seq")).alias("billing_address"))


def phones(lines: DataFrame) -> DataFrame:
    """(key, phone) of a list in which a phone line follows its name line."""
    order = Window.partitionBy("doc").orderBy("line_no")
    text = lines.withColumn("line", F.trim("line")).filter("line <> ''").withColumn("next", F.lead("line").over(order))
    found = text.filter(~T.note_phone(F.col("line")).isNotNull() & T.note_phone(F.col("next")).isNotNull())
    return found.select(T.name_key(F.col("line")).alias("key"), T.note_phone(F.col("next")).alias("phone"), "doc", "line_no").filter("key <> ''").groupBy("key").agg(F.min_by("phone", F.struct("doc", "line_no")).alias("phone"))


def groups(names: DataFrame, size: int = 10) -> DataFrame:
    """(key, mowing_group): group-1 for the first names of a list (doc, seq, name), and so on."""
    at = F.row_number().over(Window.partitionBy("doc").orderBy("seq")) - 1
    return names.select(T.name_key(F.col("name")).alias("key"), F.concat(F.lit("group-"), (F.floor(at / size) + 1).cast("string")).alias("mowing_group"))
