"""Streaming ingest, chat questions, office lists, and the catalogue against its oracles on small tables."""

import os
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from swardbook.operators import merge, numbering, score, sheets, views
from swardbook.plans import catalog, intent
from swardbook.sources import gold, office
from swardbook.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events supplier nation part region documents".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str(v) if hasattr(v, "quantize") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["tax_figures", "invoice_compile", "editor_items", "bills_ordered", "reassign_bills", "upsert_clients", "work_marks", "merge_office_lists", "email_worklist", "chat_months", "confirm_lines", "generate_month_bills", "save_bills_work", "office_import", "chat_turn_log", "job_states"])
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]}) q").fetchall()
    rows = lambda rs: sorted(str([plain(v) for v in r]) for r in rs)
    assert rows(df.select(*cols).collect()) == rows(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 90


def arrive(spark, path, rows):
    rows = [(i, 1, "2026-09", None, text, None, job, None, send, *(more or (None,))) for i, job, send, text, *more in rows]
    spark.createDataFrame(rows, ingest.LINE).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, where, name="c"):
    ingest.ingest(ingest.lines(spark, f"{where}/in"), f"{where}/log", f"{where}/{name}").awaitTermination()
    return sorted((r.id, r.description) for r in ingest.ledger(spark, f"{where}/log", "2026-09").collect())


def test_ingest_replaces_a_job_and_can_run_twice(spark, tmp_path):
    arrive(spark, f"{tmp_path}/in", [(1, "a", "s1", "x"), (2, "b", "s1", "y")])
    assert streamed(spark, tmp_path) == [(1, "x"), (2, "y")]
    assert streamed(spark, tmp_path, "again") == [(1, "x"), (2, "y")]  # a new checkpoint reads everything again
    arrive(spark, f"{tmp_path}/in", [(3, "a", "s2", "z")])
    assert streamed(spark, tmp_path) == streamed(spark, tmp_path, "again") == [(2, "y"), (3, "z")]


def test_lines_are_known_by_job_and_place_not_by_id(spark, tmp_path):
    arrive(spark, f"{tmp_path}/in", [(None, "a", "s1", "x"), (None, "a", "s1", "x"), (7, "a", "s1", "y"), (7, "b", "s1", "z"), (None, None, "t", "typed"), (None, None, "t", "typed too")])
    got = streamed(spark, tmp_path)
    assert sorted(t for _, t in got) == ["typed", "typed too", "x", "x", "y", "z"] and len({i for i, _ in got}) == 6 and (7, "y") in got
    assert streamed(spark, tmp_path, "again") == got
    # a send that comes once more in another file, with positions, is the same lines
    for _ in range(2):
        arrive(spark, f"{tmp_path}/in", [(None, "a", "s2", "one", 0), (None, "a", "s2", "two", 1)])
    assert sorted(t for _, t in streamed(spark, tmp_path)) == ["one", "two", "typed", "typed too", "z"]


def test_snapshots_keep_ids_and_bound_what_is_read(spark, tmp_path):
    log = f"{tmp_path}/log"
    now = lambda: sorted((r.id, r.description) for r in ingest.ledger(spark, log, "2026-09").collect())
    for k in range(2):
        arrive(spark, f"{tmp_path}/in", [(None, f"j{k}", "s1", f"a{k}"), (None, f"j{k}", "s1", f"b{k}"), (None, None, "t", f"typed{k}")])
    before = streamed(spark, tmp_path)
    assert ingest.compact(spark, log) == 1 and now() == before
    assert ingest.pending(spark, log).filter("NOT final").count() == 0
    arrive(spark, f"{tmp_path}/in", [(3, "j1", "s2", "new"), (None, None, "t", "last")])
    after = streamed(spark, tmp_path)
    kept = [x for x in before if x[1] not in ("a1", "b1")]
    assert [x for x in after if x in kept] == kept and sorted(t for i, t in after if (i, t) not in kept) == ["last", "new"]
    assert ingest.pending(spark, log).filter("NOT final").count() == 2
    assert ingest.compact(spark, log) == 2 and now() == after
    assert streamed(spark, tmp_path, "again") == after  # every file once more changes nothing
    (tmp_path / "log/snapshots/version=3/lines").mkdir(parents=True)  # a compaction that died
    assert now() == after and ingest.compact(spark, log) == 3 and now() == after


def test_nothing_has_arrived(spark, tmp_path):
    assert ingest.ledger(spark, str(tmp_path)).collect() == [] and ingest.compact(spark, str(tmp_path)) == 1 and ingest.ledger(spark, str(tmp_path)).collect() == []


def test_ingest_keeps_typed_lines_and_jobs_of_several_batches(spark, tmp_path):
    for k in (0, 10):
        arrive(spark, f"{tmp_path}/in", [(k + 1, None, None, "typed"), (k + 2, "J", "s1", "line")])
    assert streamed(spark, tmp_path) == [(1, "typed"), (2, "line"), (11, "typed"), (12, "line")]


def test_progress_is_the_last_state_for_a_while(spark):
    at = lambda s: datetime(2026, 11, 1, 12, 0, s)
    rows = [("a", "queued", "q", 0, at(0)), ("a", "running", "r", 50, at(10)), ("b", "done", "d", 100, at(5)), ("c", "done", "d", 100, at(20)), ("d", "queued", "q", 0, at(0))]
    df = spark.createDataFrame(rows, "id string, status string, message string, percent int, updated_at timestamp")
    got = {r.id: (r.status, r.percent) for r in ingest.progress(df, at(40)).collect()}
    assert got == {"a": ("running", 50), "c": ("done", 100), "d": ("queued", 0)}


def test_progress_follows_a_stream(spark, tmp_path):
    at = lambda s: datetime(2026, 11, 1, 12, s // 60, s % 60)
    schema = "id string, status string, message string, percent int, updated_at timestamp"
    for rows in ([("a", "running", "r", 50, at(0))], [("a", "done", "d", 100, at(10)), ("b", "queued", "q", 0, at(200))], [("c", "queued", "q", 0, at(201))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ingest.follow_progress(events).writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination()
    got = [(r.id, r.status, r.gone) for r in spark.table("seen").collect()]
    assert {("a", "running", False), ("a", "done", False), ("a", "done", True), ("b", "queued", False), ("c", "queued", False)} == set(got)


@pytest.mark.parametrize(
    "text, want",
    [("november", "2026-11"), ("october work", "2026-10"), ("this month", "2026-10"), ("december", "2025-12"), ("2026-13", None), ("may 2024", "2024-05"), ("nothing", None)],
)
def test_months_of_questions(spark, text, want):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(intent.month_of(F.col("q"), F.lit(date(2026, 11, 1)))).first()[0] == want


def test_intents(spark):
    df = spark.createDataFrame([("Do I have november data?",), ("delete november",), ("show november",)], "q string")
    today = F.lit(date(2026, 11, 1))
    got = [tuple(r) for r in df.select(intent.status_month(F.col("q"), today), intent.wipe_month(F.col("q"), today)).collect()]
    assert got == [("2026-11", None), (None, "2026-11"), (None, None)]


def test_mutations(spark):
    clients = spark.createDataFrame([(1, "A", "x@y", None), (2, "B", None, None)], "id long, name string, email string, mow_price decimal(12,2)")
    clients = clients.withColumns({c: F.lit(None).cast("string") for c in ("phone", "address", "billing_notes")}).withColumn("hedge_price", F.lit(None).cast("decimal(12,2)"))
    work = spark.createDataFrame([(1, 1, "2026-09", "m", None), (2, 1, "2026-08", "n", None), (4, 2, "2026-09", "k", None)], "id long, client_id long, month string, description string, amount decimal(12,2)")
    bills = spark.createDataFrame([(7, "2026-08", "k7"), (8, "2026-09", "k8")], "id long, month string, s3_key string")
    after = intent.Mutations(clients, work, bills).apply([
        {"op": "update_client", "client_name": " a ", "email": "", "mow_price": 5}, {"op": "add_work", "client_id": 1, "month": "2026-09", "amount": None},
        {"op": "delete_work", "work_id": 1}, {"op": "delete_work_month", "month": "2026-08"}, {"op": "delete_work_month", "month": "test"}, {"op": "add_work", "client_name": "nobody", "month": "2026-09"},
        {"op": "update_work"}, {"op": "update_work", "work_id": "x"}, {"op": "update_work", "work_id": 4, "amount": "bad"}, {"op": "update_work", "work_id": 4, "amount": "3.5", "description": " k "},
        {"op": "update_client", "client_id": 9, "email": "e"}, {"op": ""}, "text", None,
    ])
    assert [(r.id, r.email, r.mow_price and float(r.mow_price)) for r in after.clients.orderBy("id").collect()] == [(1, None, 5.0), (2, None, None)]
    assert [(r.id, r.description, r.amount and float(r.amount)) for r in after.work.orderBy("id").collect()] == [(4, " k ", 3.5), (5, "service", None)]
    assert [r.id for r in after.bills.collect()] == [8]
    assert [r.line for r in after.log.orderBy("seq").collect()] == [
        "updated client #1 A → email=None, address=None, mow=5.00, hedge=None", "added work_item #5 for client #1 (2026-09)", "deleted work_item #1", "deleted 1 work lines and 1 bills for 2026-08",
        "skipped delete_work_month (month must be YYYY-MM)", "skipped add_work (need client + month)", "skipped update_work (no work_id)", "failed update_work: invalid literal for int() with base 10: 'x'",
        "failed update_work: could not convert string to float: 'bad'", "updated work_item #4", "failed update_client: client not found", "skipped unknown op ''",
    ]


def test_gold_fixtures(spark, tmp_path):
    import json

    (tmp_path / "ground_truth").mkdir()
    entries = [("a", "Work completed", "a.json"), ("b", "roster", "b.json"), ("c", "work", "missing.json")]
    (tmp_path / "ground_truth" / "index.json").write_text(json.dumps({"fixtures": [{"id": i, "kind": k, "image": f"{i}.jpg", "gold_file": f"ground_truth/{g}"} for i, k, g in entries]}))
    for n in ("a", "b"):
        (tmp_path / "ground_truth" / f"{n}.json").write_text(json.dumps({"title": n}))
    got = gold.fixtures(spark, str(tmp_path)).collect()
    assert [(r.id, r.kind, r.image, json.loads(r.gold)) for r in got] == [("a", "Work completed", "a.jpg", {"title": "a"})]


def test_row_numbers_follow_the_order(spark):
    rows = [(k % 3, None if k % 7 == 0 else (k * 37) % 101 * 1000) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, v long").repartition(7)
    got = numbering.numbered(df, "n", [F.col("v").asc_nulls_first()], [numbering.id_block(F.col("v"))]).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == sorted((v for _, v in rows), key=lambda v: (v is not None, v or 0))
    assert sorted(r.n for r in got) == list(range(1, 201))
    each = numbering.numbered(df, "n", [F.col("v").asc_nulls_first()], [numbering.id_block(F.col("v"))], ["g"]).collect()
    assert all(sorted(r.n for r in each if r.g == g) == list(range(1, sum(x == g for x, _ in rows) + 1)) for g in range(3))


def test_hedge_list(spark):
    text = ["HEDGES", "Notes", "SMITH, Mary", "$40", "1 Neck Rd", "call", "BRADY, Jim", "40/50", "$60", "Julie Cameron", "LATER, No"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc long, line_no long, line string")
    got = [(r.name, r.address, r.hedge_price and float(r.hedge_price), r.billing_notes) for r in office.hedge_records(lines).orderBy("record").collect()]
    assert got == [("SMITH, Mary", "1 Neck Rd", 40.0, "call"), ("BRADY, Jim", None, None, "hedge cell lists 40/50 and $60")]


@pytest.mark.parametrize("given, want", [("nan", None), ("1e300", None), ("99999999999", None), ("-inf", None), ("x", None), ("41.5", 41.5), (" ", ""), (0, 0.0), ("9999999999.99", 9999999999.99)])
def test_amounts_that_do_not_fit_fail_and_change_nothing(spark, given, want):
    if want is None:
        with pytest.raises(ValueError):
            intent.number(given)
        return
    assert intent.number(given) == (want if want == "" else f"{want:.2f}")


def test_a_failed_amount_keeps_the_stored_one(spark):
    work = spark.createDataFrame([(2, 1, "2026-09", "x")], "id long, client_id long, month string, description string").selectExpr("*", "CAST(5 AS DECIMAL(12,2)) AS amount")
    turn = intent.Mutations(work.limit(0).selectExpr("id", "description AS name"), work, work.limit(0)).apply([{"op": "update_work", "work_id": 2, "amount": "1e300"}, {"op": "update_work", "work_id": 2, "amount": "7"}])
    assert [r.line for r in turn.log.orderBy("seq").collect()] == ["failed update_work: amount out of range: 1e300", "updated work_item #2"]
    assert [float(r.amount) for r in turn.work.collect()] == [7.0]


def test_office_rows_phones_and_labels(spark):
    rows = spark.createDataFrame([(0, "SMITH, Mary", "1 Rd", "0", "a@b.co call 860-961-5457"), (1, "Regular mail", None, None, None), (2, "FIELD 3", None, "45.5", None)], "seq long, name string, address string, price string, notes string")
    got = {r.name: r for r in office.roster_rows(rows).collect()}
    assert set(got) == {"SMITH, Mary", "FIELD 3"} and got["SMITH, Mary"].mow_price is None and got["SMITH, Mary"].phone == "860-961-5457" and got["FIELD 3"].entity_kind == "parcel"
    lines = spark.createDataFrame([(1, 0, "SMITH, Mary"), (1, 1, "(860) 961-5457")], "doc long, line_no long, line string")
    assert [tuple(r) for r in office.phones(lines).collect()] == [("smithmary", "860-961-5457")]
    labels = office.labels(spark.createDataFrame([(0, "SMITH, Mary\n1 Neck Rd\nTown")], "seq long, label string"))
    asked = merge.lookup(spark.createDataFrame([("SMITH, John",)], "name string"), labels, "billing_address", "to")
    assert asked.first().to == "1 Neck Rd, Town"
    order = {r.key: r.sort_order for r in office.row_order(spark.createDataFrame([(0, "POND (upper)")], "seq long, name string")).collect()}
    assert order == {"pond": 1, "pondupper": 1}


def test_batches_close_before_the_limit(spark):
    df = spark.createDataFrame([("m", i, s) for i, s in enumerate([6, 5, 4, 20, 1])], "m string, i long, s long")
    assert [r.batch for r in score.batches(df, 10, "m", "i", "s").orderBy("i").collect()] == [0, 1, 1, 2, 3]


def test_sheet_helpers(spark):
    df = spark.createDataFrame([(["Client", "Work date"], "9 16 23"), (["$53", "a@b"], "860-961-5457"), (["x"], "12 Main St")], "cols array<string>, c string")
    rows = df.select(sheets.headers_valid(F.col("cols")).alias("ok"), sheets.off_sheet(F.col("c")).alias("off"), sheets.columns_for("work", F.col("cols")).alias("use")).collect()
    assert [(r.ok, r.off) for r in rows] == [(True, False), (False, True), (False, True)]
    assert rows[0].use == ["Client", "Work date"] and rows[1].use == ["CLIENT", "DATE & WORK COMPLETED"]


@pytest.mark.parametrize(
    "delivery, mail, email, notes, phone, want",
    [("sms", True, "a@b.co", None, None, "sms"), (None, True, "a@b.co", None, None, "mail"), (None, False, "a@b.co", None, None, "email"), ("fax", None, None, "to x@y.org", None, "email"), (None, None, "", None, "860", "sms"), (None, None, None, None, " ", "mail")],
)
def test_delivery(spark, delivery, mail, email, notes, phone, want):
    df = spark.createDataFrame([(delivery, mail, email, notes, phone)], "delivery string, prefer_mail boolean, email string, billing_notes string, phone string")
    assert views.with_channel(df).first().channel == want


def test_snapshot_fits_and_keeps_its_floors(spark):
    import json

    from swardbook.operators import bills

    people = spark.range(200).selectExpr("id", "concat('CLIENT, Number ', id) AS name", "'a@b.co' AS email", "NULL AS phone", "false AS prefer_mail", "repeat('x', 60) AS billing_notes", "CAST(40 AS DECIMAL(12,2)) AS mow_price", "CAST(NULL AS DECIMAL(12,2)) AS hedge_price", "true AS on_roster", "CAST(id AS INT) AS sort_order")
    work = spark.range(500).selectExpr("id", "id % 200 AS client_id", "'2026-09' AS month", "'Mowing 5' AS description", "CAST(40 AS DECIMAL(12,2)) AS amount")
    sent = spark.range(90).selectExpr("id", "id AS client_id", "'2026-09' AS month", "CAST(NULL AS TIMESTAMP_NTZ) AS emailed_at")
    text = bills.snapshot(people, work, sent)
    found = json.loads(text)
    assert len(text) <= 10_000 and found["client_count"] == 200 and found["work_counts_by_month"] == {"2026-09": 500}
    assert len(found["work_items"]) == 10 and len(found["clients"]) >= 15 and found["clients_truncated"]


def test_name_scores(spark):
    pairs = [("SMITH, Mary", "Smith Rd"), ("SMITHSON", "SMITHERS"), ("THE MR", "THE MR"), ("Oak (upper) FIELD HOUSE", "house field"), ("", "x"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(sheets.name_score(sheets.name_words(F.col("a")), sheets.name_words(F.col("b")))).collect()] == [9, 3, 0, 18, 0, 0]


def test_rows_follow_the_names_of_their_sheet(spark):
    names = spark.createDataFrame([("s", 0, "POND, Al"), ("s", 1, "SMITH, Mary"), ("s", 2, "LEE"), ("s", 3, "SMITHERS, X"), ("none", 0, "A")], "sheet string, seq long, name string")
    pool = [("s", 0, "Lee", "5"), ("s", 1, "Mary Smith", "9"), ("s", 2, "POND, Al", " "), ("s", 3, "mary smith.", "9 16"), ("s", 4, "Smithson", "2"), ("s", 5, "", "7"), ("s", 6, "", "8"), ("t", 0, "ZED", "1"), ("t", 1, None, None)]
    got = sheets.assemble(names, spark.createDataFrame(pool, "sheet string, seq long, name string, work string"))
    rows = [(r.sheet, r.seq, r.name, r.work) for r in got.orderBy("sheet", "seq").collect()]
    assert rows == [("s", 0, "mary smith.", "9 16"), ("s", 1, "Lee", "5"), ("s", 2, "Smithson", "2"), ("s", 3, "", "7"), ("s", 4, "", "8"), ("t", 0, "ZED", "1")]


def test_read_rows_count_once_and_in_order(spark):
    fields = "sheet string, seq long, name string, price double, days array<int>"
    gold = [("s", 0, "SMITH, Mary", 40.0, [1, 2]), ("s", 1, "SMITH, Mary", 41.0, [3]), ("s", 2, "POND, Al", 5.0, []), ("s", 3, "KEELER", None, [4]), ("t", 0, "GONE", 1.0, None), ("s", 4, " ", 1.0, [1])]
    read = [("s", 0, "SMITH, Mary Ann", 41.01, [1, 2, 3]), ("s", 1, "Smith Mary", 45.0, [3]), ("s", 2, "POND, Bo", 5.0, []), ("s", 3, "KEELER, Chris", 9.0, [5]), ("u", 0, "EXTRA", 1.0, [1])]
    got = {r.sheet: tuple(r)[1:] for r in score.recall(spark.createDataFrame(gold, fields), spark.createDataFrame(read, fields)).collect()}
    assert got == {"s": (4, 3, 3, 4, 3, 1, 2), "t": (1, 1, 0, 0, 0, 0, 0), "u": (0, 0, 0, 1, 0, 0, 0)}


def test_preferred_table_computes_each_step_once(spark):
    from swardbook.operators import sheets as S

    assert str(S.preferred_table(F.col("sheet"))).count("aggregate(") == 1
    text = '{"tables":[{"columns":["Name"],"rows":[["SMITH, Mary"],["BRADY, Jim"]]},{"columns":["Address","x","y"],"rows":[["smith","1","2"],["","3","4"],["9","5","6"]]},{"columns":["a"],"rows":null}]}'
    t = spark.createDataFrame([(text,), (None,)], "j string").select(S.preferred_table(F.from_json("j", S.EXTRACT)).alias("t")).collect()
    assert t[0].t.columns == ["Contact", "x", "y"] and t[0].t.rows == [["SMITH, Mary", "1", "2"], ["", "3", "4"], ["9", "5", "6"]]
    assert t[1].t is None
