"""Invoices and sales tax, for all clients and months in one set-wise plan.

Nothing here loops over clients: lines are decoded once, grouped by (month,
client, group) with partial aggregation, and totals come from the grouped rows.
Order within a bill is data: every row carries its section and first line id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BILL = ["month", "client_id"]
#: Order of the parts of a bill.
GROUPS, SINGLES, BUCKETS, TAX, TAXED, TAXED_SINGLES, TAXED_BUCKETS, TOTAL = range(1, 9)


def decode(lines: DataFrame) -> DataFrame:
    """Add role, label, day, prior_month and prior_day to lines with id, description and day_or_note."""
    note, desc = F.col("day_or_note"), F.col("description")
    kind = F.col("kind") if "kind" in lines.columns else None
    typed = lambda name: T.strip(F.col(name)) if name in lines.columns else F.lit("")
    out = lines.withColumns({
        "role": T.line_role(desc, note, kind),
        "label": T.service_label(desc),
        "day": T.service_day(desc, note),
        "__m": T.prior_month(note),
        "__d": T.prior_day(note),
    })
    from_note = F.col("__m") != ""
    owed = F.col("role").isin("prior", "prior_taxed")
    return out.withColumns({
        "prior_month": F.when(owed, F.when(from_note, F.col("__m")).otherwise(typed("prior_month"))).otherwise(""),
        "prior_day": F.when(owed, F.when(from_note, F.col("__d")).otherwise(typed("date"))).otherwise(""),
    }).drop("__m", "__d")


def printed_lines(decoded: DataFrame) -> DataFrame:
    """Lines that a bill shows: named, and no tax or total rows of an earlier bill."""
    return decoded.filter((F.col("label") != "") & ~F.lower("label").isin("sales tax", "total"))


def _loose(decoded: DataFrame) -> DataFrame:
    """A job whose note is one bare date: of another month it is owed from there, of this one it has a day."""
    found = T.editor_dates(F.col("day_or_note"), F.col("month"))
    out = decoded.withColumn("__dates", F.when((F.col("role") == "visit") & ~F.col("label").isin("Mowing", "Hedging") & T.is_month(F.col("month")), found))
    one = F.when(F.size("__dates") == 1, F.get("__dates", F.lit(0)))
    other = one["month"] != F.col("month")
    return out.withColumns({
        "role": F.when(other, "prior").otherwise(F.col("role")),
        "prior_month": F.when(other, one["month"]).otherwise(F.col("prior_month")),
        "prior_day": F.when(other, one["day"].cast("string")).otherwise(F.col("prior_day")),
        "day": F.when(one.isNotNull() & ~other, one["day"]).otherwise(F.col("day")),
    }).drop("__dates")


def _dates(days: Column, number: Column) -> Column:
    """'9/5, 9/12' in numeric order; bare days for a label that is no month."""
    one = lambda d: F.when(number > 0, F.concat(number.cast("string"), F.lit("/"), d.cast("string"))).otherwise(d.cast("string"))
    return F.array_join(F.transform(F.array_sort(days), one), ", ")


def _number(month: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(month, r"-(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def compile_rows(lines: DataFrame) -> DataFrame:
    """Printed rows of every bill, with tax and total.

    lines: id, month, client_id, description, amount, day_or_note, mow_price,
    hedge_price; optional kind, prior_month, date. Returns month, client_id,
    section, seq, date, description, amount, kind, prior_month. Lines count in
    order of id; a null amount is zero.
    """
    rows = printed_lines(_loose(decode(lines)))
    rows = rows.withColumn("amount", T.money(F.col("amount")))
    price = F.when(F.col("label") == "Mowing", F.col("mow_price")).when(F.col("label") == "Hedging", F.col("hedge_price"))
    rows = rows.withColumn("unit", F.when(price.isNotNull(), T.money(price)))
    owed = F.col("role").isin("prior", "prior_taxed")
    dated = owed & (F.col("prior_day") != "")
    bucket = dated & F.col("label").isin("Mowing", "Hedging")
    # One row for each printed row: its kind of row and what it is grouped by.
    single = dated & ~bucket
    rows = rows.withColumn("__kind", F.when(bucket, "b").when(single, "s").otherwise("g"))
    rows = rows.withColumn("__by", F.when(bucket, F.concat_ws("|", "prior_month", "label", "role")).when(single, F.col("id").cast("string")).otherwise(F.concat_ws(":", "role", F.lower("label"))))
    zero_fill = (F.col("__kind") == "g") & (F.col("amount") == 0) & F.col("unit").isNotNull()
    shown_day = F.when(F.col("__kind") != "g", F.col("prior_day").try_cast("int")).when((F.col("role") == "visit") & F.col("day").between(1, 31), F.col("day"))
    priced = F.col("unit").isNotNull()
    grouped = rows.groupBy(*BILL, "__kind", "__by", "role").agg(
        F.min("id").alias("seq"),
        F.min_by("label", "id").alias("description"),
        F.sum(F.when(zero_fill, F.col("unit")).otherwise(F.col("amount"))).alias("amount"),
        F.max_by(F.when(priced, F.col("unit")), F.when(priced, F.col("id"))).alias("unit"),
        F.collect_set(shown_day).alias("days"),
        F.min("prior_month").alias("prior_month"),
        F.min("prior_day").alias("prior_day"),
    )
    visits = (F.col("unit").isNotNull()) & (F.size("days") > 0) & (F.col("amount") == 0) & F.col("description").isin("Mowing", "Hedging") & (F.col("__kind") == "g")
    amount = F.when(visits, F.col("unit") * F.size("days")).otherwise(F.col("amount"))
    amount = F.when(F.col("role") == "discount", -F.abs(amount)).otherwise(amount)
    number, from_month = T.month_number(F.col("month")), _number(F.col("prior_month"))
    single_date = F.when(from_month > 0, F.concat(from_month.cast("string"), F.lit("/"), F.col("prior_day"))).otherwise(F.col("prior_day"))
    date = (
        F.when(F.col("__kind") == "s", single_date)
        .when(F.col("__kind") == "b", _dates(F.col("days"), from_month))
        .when(F.col("role") == "visit", _dates(F.col("days"), number))
        .otherwise("")
    )
    taxed = F.col("role") == "prior_taxed"
    at = lambda plain, late: F.when(taxed, late).otherwise(plain)
    section = F.when(F.col("__kind") == "g", at(GROUPS, TAXED)).when(F.col("__kind") == "s", at(SINGLES, TAXED_SINGLES)).otherwise(at(BUCKETS, TAXED_BUCKETS))
    body = grouped.select(
        *BILL,
        section.cast("int").alias("section"),
        "seq",
        date.alias("date"),
        "description",
        amount.cast("decimal(18,2)").alias("amount"),
        F.col("role").alias("kind"),
        F.when(F.col("__kind") == "g", "").otherwise(F.col("prior_month")).alias("prior_month"),
    )
    # Tax and total ride on the printed rows themselves: an exploded summary of each bill, no second scan.
    before = F.sum(F.when(F.col("section") < TAX, F.col("amount")).otherwise(0))
    after = F.sum(F.when(F.col("section") > TAX, F.col("amount")).otherwise(0))
    bills = body.groupBy(*BILL).agg(
        F.collect_list(F.struct("section", "seq", "date", "description", "amount", "kind", "prior_month")).alias("rows"), before.alias("before"), after.alias("after")
    )
    tax = F.round(F.col("before") * F.lit(T.RATE), 2).cast("decimal(18,2)")
    extra = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(None).cast("long").alias("seq"), F.lit("").alias("date"), F.lit(name).alias("description"), value.cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("prior_month"))
    bills = bills.withColumn("tax", tax)
    every = F.concat(F.col("rows"), F.array(extra(TAX, "Sales tax", F.col("tax")), extra(TOTAL, "Total", F.col("before") + F.col("tax") + F.col("after"))))
    return bills.select(*BILL, F.inline(every))


def editable_lines(compiled: DataFrame) -> DataFrame:
    """Rows for the bill editor: no tax and no total."""
    return compiled.filter(~F.col("description").isin("Sales tax", "Total")).withColumns({
        "kind": F.coalesce("kind", F.lit("visit")), "prior_month": F.coalesce("prior_month", F.lit(""))
    })


def tax_figures(lines: DataFrame) -> DataFrame:
    """Revenue, earlier balances, tax and total of each (month, client).

    Unlike compile_rows, stored amounts count as they are: no price is filled in
    and no loose date moves a line.
    """
    rows = printed_lines(decode(lines)).withColumn("amount", T.money(F.col("amount")))
    part = lambda role: F.sum(F.when(F.col("role") == role, F.col("amount")).otherwise(0)).cast("decimal(18,2)")
    plain = F.when(F.col("role") == "discount", -F.abs(F.col("amount"))).when(F.col("role") == "visit", F.col("amount")).otherwise(0)
    months = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & (F.col("prior_month") != ""), F.struct("id", T.month_label(F.col("prior_month")).alias("m"))))), lambda x: x["m"]), ", ")
    sums = rows.groupBy(*BILL).agg(
        F.sum(plain).cast("decimal(18,2)").alias("revenue"), part("prior").alias("prior"), part("prior_taxed").alias("prior_taxed"), months("prior").alias("__due"), months("prior_taxed").alias("__done")
    )
    tax = F.round((F.col("revenue") + F.col("prior")) * F.lit(T.RATE), 2).cast("decimal(18,2)")
    note = F.concat_ws("; ", F.when(F.col("__due") != "", F.concat("__due", F.lit(" — taxed with this month"))), F.when(F.col("__done") != "", F.concat("__done", F.lit(" — tax already included"))))
    sums = sums.withColumn("tax", tax)
    total = (F.col("revenue") + F.col("prior") + F.col("tax") + F.col("prior_taxed")).cast("decimal(18,2)")
    return sums.select(*BILL, "revenue", "prior", "prior_taxed", "tax", total.alias("total"), note.alias("note"))


def tax_totals(figures: DataFrame) -> DataFrame:
    """The workbook's summary row of each month: sums of the clients' rounded figures."""
    return figures.groupBy("month").agg(F.count("*").alias("clients"), *(F.sum(c).cast("decimal(18,2)").alias(c) for c in ("revenue", "prior", "prior_taxed", "tax", "total")))


def reprice_visits(lines: DataFrame) -> DataFrame:
    """Drop repeated (label, day) visits of a bill, the first line stays; fill zero visits from the roster price."""
    rows = decode(lines)
    counted = (F.col("role") == "visit") & F.col("label").isin("Mowing", "Hedging") & F.col("day").isNotNull()
    key = F.when(counted, F.concat_ws("|", "label", F.col("day").cast("string"))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    rows = rows.withColumn("__key", key)
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*BILL, "__key").orderBy("id"))).filter("__rank = 1")
    price = F.when(F.col("label") == "Mowing", F.col("mow_price")).when(F.col("label") == "Hedging", F.col("hedge_price"))
    fill = (F.col("role") == "visit") & (F.coalesce(F.col("amount"), F.lit(0)) == 0) & price.isNotNull()
    return rows.withColumn("amount", F.when(fill, price).otherwise(F.col("amount")).cast("decimal(12,2)")).select(*lines.columns)


def editor_items(lines: DataFrame) -> DataFrame:
    """Stored work lines of edited bill lines: one for each date, amounts split to the cent.

    lines: line_id, month, description, amount, date, kind, prior_month.
    Returns line_id, piece, month, description, amount, day_or_note.
    """
    desc, kind = T.strip(F.col("description")), F.coalesce(F.nullif(T.strip(F.col("kind")), F.lit("")), F.lit("visit"))
    amount = F.coalesce(F.col("amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    rows = lines.withColumns({"__desc": desc, "__kind": kind, "__amount": amount}).filter("NOT (__desc = '' AND __amount = 0) AND __desc NOT IN ('Sales tax', 'Total')")
    off = (F.col("__kind") == "discount") | F.lower("__desc").startswith("discount")
    owed = F.col("__kind").isin("prior", "prior_taxed")
    dates = F.when(off, F.array().cast("array<struct<month:string,day:int,hedge:boolean>>")).otherwise(T.editor_dates(F.col("date"), F.col("month")))
    rows = rows.withColumns({"__dates": dates, "__label": T.visit_label(F.col("__desc"))})
    pieces = T.split_amount(F.col("__amount"), F.size("__dates"))
    rows = rows.withColumn("__pieces", pieces)
    rows = rows.select("*", F.posexplode_outer(F.arrays_zip(F.col("__dates").alias("d"), F.col("__pieces").alias("p"))).alias("piece", "__x"))
    base = F.when(F.col("__kind") == "prior_taxed", "prior-taxed:").otherwise("prior:")
    written = F.regexp_extract("__desc", r"^Previous bill \((.*)\)$", 1)
    owner = F.coalesce(F.nullif(T.strip(F.col("prior_month")), F.lit("")), F.trim(written))
    day = F.col("__x.d")
    text = day["day"].cast("string")
    hedge = day["hedge"] | (F.coalesce("__label", F.lit("")) == "Hedging") | F.col("__desc").rlike("(?i)hedg")
    note = (
        F.when(off, "discount")
        .when(owed & day.isNotNull(), F.concat(base, day["month"], F.lit(":"), text))
        .when(owed, F.concat(base, owner))
        .when(day.isNull(), T.note_for_line(F.col("__desc"), F.lit("visit"), F.lit(""), F.col("date"), F.lit(None).cast("string")))
        .when(day["month"] != F.col("month"), F.concat(F.lit("prior:"), day["month"], F.lit(":"), text))
        .when(hedge, F.concat(text, F.lit("h")))
        .otherwise(text)
    )
    shown = F.when(~off & ~owed & day.isNotNull() & F.col("__label").isNotNull(), F.concat("__label", F.lit(" "), text)).otherwise(F.col("__desc"))
    return rows.select("line_id", F.coalesce("piece", F.lit(0)).alias("piece"), "month", shown.alias("description"), F.coalesce(F.col("__x.p"), F.col("__amount")).alias("amount"), note.alias("day_or_note"))
