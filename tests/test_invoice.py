"""Golden cases of invoices and tax, and a differential test over random lines."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from swardbook.functions import text as T
from swardbook.operators import invoice

SCHEMA = "id long, month string, client_id long, description string, amount decimal(12,2), day_or_note string, mow_price decimal(12,2), hedge_price decimal(12,2)"


def compiled(spark, lines, month="2026-09"):
    rows = [(i, month, 1, d, None if a is None else Decimal(str(a)), n, None if m is None else Decimal(m), None if h is None else Decimal(h)) for i, (d, a, n, m, h) in enumerate(lines)]
    out = invoice.compile_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("section", "seq").collect()
    return [(r.description, r.date, r.amount) for r in out]


def line(d, a, n=None, m=None, h=None):
    return d, a, n, m, h


def test_prior_month_job_has_its_own_date(spark):
    rows = compiled(spark, [line("Mowing", 40, "5"), line("Bush trimming", 50, "prior:2026-08:12")])
    assert ("Bush trimming", "8/12", Decimal("50.00")) in rows and rows[-1] == ("Total", "", Decimal("95.72"))


def test_zero_visits_take_the_roster_price(spark):
    rows = compiled(spark, [line("Bush", 50, "5"), line("Mowing 8", 0, "8", 42), line("Mowing 15", 0, "15", 42)])
    assert ("Bush", "9/5", Decimal("50.00")) in rows and ("Mowing", "9/8, 9/15", Decimal("84.00")) in rows
    rows = compiled(spark, [line("Hedging 15", 0, "15h", None, 40), line("Hedging 22", 0, "22h", None, 40)])
    assert ("Hedging", "9/15, 9/22", Decimal("80.00")) in rows
    rows = compiled(spark, [line("Mowing 8", 0, "8")])
    assert rows == [("Mowing", "9/8", Decimal("0.00")), ("Sales tax", "", Decimal("0.00")), ("Total", "", Decimal("0.00"))]


def test_tax_rounds_half_up(spark):
    assert ("Sales tax", "", Decimal("6.35")) in compiled(spark, [line("Mowing", 100, "1")])
    assert ("Sales tax", "", Decimal("7.05")) in compiled(spark, [line("Mowing", 111, "1")])


def test_earlier_balances(spark):
    rows = compiled(spark, [line("Mowing", 100, "1"), line("Previous", 50, "prior:2026-08")])
    assert ("Previous", "", Decimal("50.00")) in rows and ("Sales tax", "", Decimal("9.53")) in rows and rows[-1][2] == Decimal("159.53")
    rows = compiled(spark, [line("Mowing", 100, "1"), line("Previous", 50, "prior-taxed:2026-08")])
    assert [r[0] for r in rows] == ["Mowing", "Sales tax", "Previous", "Total"] and rows[-1][2] == Decimal("156.35")


def test_discount_and_reserved_names(spark):
    rows = compiled(spark, [line("Mowing", 100, "1"), line("Discount", 10)])
    assert ("Discount", "", Decimal("-10.00")) in rows and ("Sales tax", "", Decimal("5.72")) in rows
    rows = compiled(spark, [line("Mowing", 100, "1"), line("Sales tax", 9), line("TOTAL", 9)])
    assert [r[0] for r in rows] == ["Mowing", "Sales tax", "Total"]


def test_other_labels_do_not_fail(spark):
    rows = compiled(spark, [line("Mowing", 10, "5"), line("Bush", 5, "3/4")], month="test_month")
    assert ("Mowing", "5", Decimal("10.00")) in rows and rows[-1][0] == "Total"


def test_typed_date_of_a_later_month_takes_the_bills_year(spark):
    rows = compiled(spark, [line("Bush", 5, "12/5")], month="2026-01")
    assert ("Bush", "12/5", Decimal("5.00")) in rows


def test_tax_figures(spark):
    rows = [(1, "2026-09", 1, "Mowing", Decimal(100), "5"), (2, "2026-09", 1, "Old", Decimal(50), "prior:2026-08"), (3, "2026-09", 2, "Mowing", Decimal(40), "5"), (4, "2026-09", 2, "Old", Decimal(20), "prior-taxed:2026-08")]
    out = {r.client_id: r for r in invoice.tax_figures(spark.createDataFrame(rows, "id long, month string, client_id long, description string, amount decimal(12,2), day_or_note string")).collect()}
    assert (out[1].revenue, out[1].prior, out[1].tax) == (100, 50, Decimal("9.53")) and out[1].note == "August 2026 — taxed with this month"
    assert (out[2].revenue, out[2].tax, out[2].prior_taxed) == (40, Decimal("2.54"), 20)


def test_totals_are_sums_of_rounded_figures(spark):
    r = random.Random(1)
    rows = [(i, "2026-09", r.randrange(9), r.choice(["Mowing 3", "Hedging", "job", "Discount"]), Decimal(r.randrange(10000)) / 100, r.choice([None, "5", "5h", "prior:2026-08", "prior-taxed:2026-07:3", "discount"])) for i in range(300)]
    figures = invoice.tax_figures(spark.createDataFrame(rows, "id long, month string, client_id long, description string, amount decimal(12,2), day_or_note string"))
    total = invoice.tax_totals(figures).first()
    kept = figures.collect()
    assert total.tax == sum(x.tax for x in kept) and total.total == sum(x.total for x in kept)
    cents = lambda x: x.quantize(Decimal("0.01"), ROUND_HALF_UP)
    assert all(x.tax == cents((x.revenue + x.prior) * Decimal("0.0635")) for x in kept)


def test_split_amounts(spark):
    df = spark.createDataFrame([(Decimal(100), 3), (Decimal(50), 1), (Decimal(10), 0)], "a decimal(12,2), n int")
    assert [[str(x) for x in r[0]] for r in df.select(T.split_amount(F.col("a"), F.col("n"))).collect()] == [["33.33", "33.33", "33.34"], ["50.00"], []]


def test_editor_lines(spark):
    rows = [(1, "2026-09", "Mowing", Decimal(150), "5, 12, 9/19", "visit", ""), (2, "2026-09", "Bush", Decimal(40), "8/30", "visit", ""), (3, "2026-09", "Hedging", Decimal(30), "14h", "visit", ""), (4, "2026-09", "Previous bill (2026-07)", Decimal(9), "", "prior_taxed", ""), (5, "2026-09", "Total", Decimal(1), "", "visit", "")]
    df = spark.createDataFrame(rows, "line_id long, month string, description string, amount decimal(12,2), date string, kind string, prior_month string")
    got = [(r.line_id, r.description, str(r.amount), r.day_or_note) for r in invoice.editor_items(df).orderBy("line_id", "piece").collect()]
    assert got == [(1, "Mowing 5", "50.00", "5"), (1, "Mowing 12", "50.00", "12"), (1, "Mowing 19", "50.00", "19"), (2, "Bush", "40.00", "prior:2026-08:30"), (3, "Hedging 14", "30.00", "14h"), (4, "Previous bill (2026-07)", "9.00", "prior-taxed:2026-07")]


def test_reprice_drops_repeats_and_fills_zero(spark):
    rows = [(1, "2026-09", 1, "Mowing 5", Decimal(0), "5", Decimal(42), None), (2, "2026-09", 1, "Mowing 5", Decimal(9), "5", Decimal(42), None), (3, "2026-09", 1, "Mowing 6", Decimal(7), "6", Decimal(42), None)]
    got = invoice.reprice_visits(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect()
    assert [(r.id, r.amount) for r in got] == [(1, 42), (3, 7)]


def test_names_and_dates(spark):
    df = spark.createDataFrame([("SMITH, Mary",), ("BROWN LILLIAN",), ("MARY",), ("SMALL, & Mary",), ("O'NEIL-X",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(T.first_name(F.col("n"))).collect()] == ["Mary", "Lillian", "Mary", "Mary", "O'Neil-X", "Customer", "Customer"]
    months = spark.createDataFrame([("2026-09",), ("2026-12",)], "m string")
    assert [tuple(r) for r in months.select(T.letter_date(F.col("m")), T.month_name(F.col("m")), T.month_number(F.col("m"))).collect()] == [("October 1st, 2026", "September", 9), ("January 1st, 2027", "December", 12)]
    days = spark.sql("SELECT explode(array(date'2026-11-01', date'2026-01-15', date'2026-10-31')) AS d")
    assert [r[0] for r in days.select(T.work_month(F.col("d"))).collect()] == ["2026-10", "2025-12", "2026-09"]
