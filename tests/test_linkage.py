"""Golden cases of record linkage and the filing of sheets."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from swardbook.functions import jsonfix, names
from swardbook.operators import commit, linkage, sheets

FIELDS = "id long, name string, address string, mow_price double, on_roster boolean"


def roster(spark, rows):
    df = spark.createDataFrame(rows, FIELDS)
    from pyspark.sql import functions as F

    for c in ("email", "phone", "billing_notes"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumns({"hedge_price": F.lit(None).cast("decimal(12,2)"), "prefer_mail": F.lit(False), "sort_order": F.lit(None).cast("int")})


def filed(spark, name, rows):
    names = spark.createDataFrame([(name,)], "sheet_name string")
    return linkage.file_clients(names, roster(spark, rows)).first().client_id


@pytest.mark.parametrize(
    "name, rows, want",
    [
        ("SMIHT, Mary", [(4, "SMITH, Mary", "1 Rd", None, True), (8, "SMIHT, Mary", None, None, True)], 4),
        ("Test MMM", [(9, "MMM, Test", "1 Rd", None, True)], 9),
        ("SMITH, John", [(4, "SMITH, Mary", "1 Rd", None, True)], None),
        ("KELLEER, Chris", [(45, "KEELER, Chris", "1 Rd", None, True)], 45),
        ("Kelly Small", [(109, "SMALL, Kelly & Ryan", None, 40.0, True), (151, "Kelly Small", None, None, True)], 109),
        ("PRYIA", [(107, "RASKUMAR, Priya", "1 Rd", None, True)], 107),
        ("ST Sophia", [(104, "SAINT SOPHIA CHURCH", None, 40.0, True)], 104),
        ("BRADY, Jim", [(14, "BRADY, Jib & Susan", "1 Rd", None, True), (161, "BRADY, Jim", None, None, False)], 161),
        ("ANDERSN, Pat", [(1, "ANDERSON, Pat", "1 Rd", None, True), (2, "ANDERSEN, Pat", "1 Rd", None, True)], None),
        ("", [(1, "SMITH, Mary", "1 Rd", None, True)], None),
    ],
)
def test_filing(spark, name, rows, want):
    assert filed(spark, name, rows) == want


PARTS = ["SMITH", "Smiht", "Mary", "SAINT", "ST", "ste", "Sophia", "church", "Kelly", "Keeler", "KELLEER", "& Ryan", "12", "a", "O'Neil", "Priya", "PRYIA", "ab", "axb", "B", ","]


def answers(asked, people, suggest):
    """The rules in a plain loop: the one close spelling of each name, or None."""
    out = {}
    for a in asked:
        scores = []
        for place, (i, n, priced) in enumerate(people):
            equal = names.spelling(n).key == names.spelling(a).key
            score = 0.0 if not n.strip() or equal and (suggest or not priced) else 1.0 if equal else names.similarity(a, n)
            if score >= linkage.SCORE:
                scores.append((-score, place, i))
        scores.sort()
        clear = scores and (len(scores) == 1 or -scores[1][0] <= -scores[0][0] - linkage.MARGIN)
        out[a] = scores[0][2] if clear else None
    return out


def test_index_leaves_no_match_out(spark, monkeypatch):
    """Filing and suggestions against a plain loop over all pairs, with blocks in many parts and in one."""
    r = random.Random(5)
    some = lambda n: list({" ".join(r.choice(PARTS) for _ in range(r.randrange(1, 5))) for _ in range(n)})
    people = [(k, n, "1 Rd", 4.0 if k % 3 else None, True) for k, n in enumerate(sorted(some(160)))]
    asked = some(60) + ["KELLEER, Chris", "a b", "A.B.", "ab", "abc", "a b c", "", "maryannsmiht", "ST Sophia"]
    ordered = sorted(people, key=lambda p: (p[1], p[0]))
    light = [(i, n, bool(price)) for i, n, _, price, _ in ordered]
    want = answers(asked, light, True)
    exact = {names.spelling(n).key for _, n, priced in light if priced}
    filed = answers([a for a in asked if names.spelling(a).key not in exact], light, False)
    sheet = spark.createDataFrame([(a,) for a in asked], "sheet_name string")
    for part in (3, 5000):
        monkeypatch.setattr(linkage, "PART", part)
        got = {x.sheet_name: x.suggestion for x in linkage.suggest_clients(sheet, roster(spark, people)).collect()}
        assert got == {a: i for a, i in want.items() if i is not None} and len(got) > 5
    got = {x.sheet_name: x.client_id for x in linkage.file_clients(sheet, roster(spark, people)).collect()}
    known = {names.spelling(n).key for _, n, _ in light}
    assert all(got[a] == i for a, i in filed.items() if names.spelling(a).key not in known)


def numbered_names(n):
    """Names that numbers tell apart, in several spellings."""
    r = random.Random(7)
    told = ["SMITH, Mary", "SMIHT, Mary", "Mary SMITH", "VAN DYKE, Ana & Joe", "ST Ann", "SAINT, Ann", "KEELEER, Lee", "LEE, Lee", "B 7 SMITH, Al"]
    number = lambda: r.choice(["", "10", "11"]) + str(r.randrange(10 ** r.randrange(1, 5)))
    return sorted({r.choice([f"{t} {number()}", f"{number()} {t}", f"{t} {number()} {number()}"]) for t in (r.choice(told) for _ in range(n))})


def test_no_score_passes_the_bound_of_its_body():
    """Also of rows without a like number, where none of the numbers that are looked up is the row's."""
    import re

    rows = [n for n in numbered_names(400) if "7" not in n.split()]
    body = lambda n: " ".join("#" * len(w) if w.isdigit() and len(w) > 1 else w for w in re.findall("[a-z0-9]+", n.lower()))
    rows = [n for n in rows if not re.search("[0-9]", body(n))]
    bodies = sorted({body(n) for n in rows})
    at, table, whole = {b: k for k, b in enumerate(bodies)}, names.Bodies(bodies), names.Table(rows)
    close = 0
    for a in numbered_names(90) + ["KELLER, Lee 1011", "SMITHMary 1012", "7", "Ann 1", "M SMITH 4-4"]:
        most, apart, near = table.bounds(a), table.bounds(a, apart=True), set(whole.near_numbers(a).tolist())
        for k, b in enumerate(rows):
            score = names.similarity(a, b)
            if score >= linkage.SCORE:
                close += 1
                assert score <= most[at[body(b)]] and (k in near or score <= apart[at[body(b)]]), (a, b)
    assert close > 1000


def test_rows_of_a_body_are_all_met(spark, monkeypatch):
    """Filing and suggestions against a plain loop, where rows are met by their bodies, in many parts and in one."""
    monkeypatch.setattr(linkage, "COMMON", 3)
    monkeypatch.setattr(linkage, "SOME", 5)
    people = [(k, n, "1 Rd", 4.0 if k % 3 else None, True) for k, n in enumerate(numbered_names(260))]
    asked = numbered_names(330)[::5] + ["KELLER, Lee 1011", "SMITHMary 1012", "Mary", "10"]
    light = [(i, n, bool(price)) for i, n, _, price, _ in sorted(people, key=lambda p: (p[1], p[0]))]
    assert linkage._people(roster(spark, people)).filter("body IS NOT NULL").count() > 60
    want = answers(asked, light, True)
    exact = {names.spelling(n).key for _, n, priced in light if priced}
    filed = answers([a for a in asked if names.spelling(a).key not in exact], light, False)
    sheet = spark.createDataFrame([(a,) for a in asked], "sheet_name string")
    known = {names.spelling(n).key for _, n, _ in light}
    for part in (2, 5000):
        monkeypatch.setattr(linkage, "PART", part)
        got = {x.sheet_name: x.suggestion for x in linkage.suggest_clients(sheet, roster(spark, people)).collect()}
        assert got == {a: i for a, i in want.items() if i is not None}
    got = {x.sheet_name: x.client_id for x in linkage.file_clients(sheet, roster(spark, people)).collect()}
    assert all(got[a] == i for a, i in filed.items() if names.spelling(a).key not in known)


def test_dense_numbers_meet_few_rows(spark):
    """Clients that numbers tell apart, of 30 names: each meets the rows of its own name and of few others."""
    told = [f"{s}, {g}" for s in ("SMITH", "BRADY", "FENN", "GRAY", "HOLT", "POND") for g in ("Mary", "Jim", "Chris", "Ruth", "Lee")]
    people = [(k, f"{told[k % 30]} {k + 1000}", None, 1.0, True) for k in range(3000)]
    sheet = spark.createDataFrame([(n.lower(),) for _, n, *_ in people], "sheet_name string")
    got = linkage.candidate_pairs(sheet, roster(spark, people)).first()
    assert got.names == got.rows == 3000 and 3000 <= got.pairs < 3000 * 3000 / 10


def test_candidates_are_few(spark):
    people = [(k, f"{chr(65 + k % 26)}{chr(65 + k // 26 % 26)}{chr(65 + k * 7 % 26)}{chr(65 + k * 11 % 26)}MAN, Lee", None, 1.0, True) for k in range(400)]
    sheet = spark.createDataFrame([(n.lower(),) for _, n, *_ in people], "sheet_name string")
    got = linkage.candidate_pairs(sheet, roster(spark, people)).first()
    assert got.names == got.rows == 400 and 400 <= got.pairs < 400 * 400 / 4


def test_texts_that_are_close_share_a_key():
    r = random.Random(3)
    for least in (0.8, 0.82, 0.95):
        for _ in range(6000):
            a = "".join(r.choices("abcde1", k=r.randrange(1, 14)))
            b = list(a)
            for _ in range(r.randrange(4)):
                b[r.randrange(len(b) + 1) : r.randrange(len(b) + 1)] = r.choices("abcde1", k=r.randrange(2))
            b = "".join(b)
            if b and names.ratio(a, b) >= least:
                assert set(names.index_keys(a, least, True)) & set(names.index_keys(b, least, False)), (a, b)
                assert names.reaches(a, b, least)
            else:
                assert not names.reaches(a, b, least)


def test_no_score_passes_its_bound():
    r = random.Random(3)
    some = sorted({" ".join(r.choice(PARTS) for _ in range(r.randrange(5))) for _ in range(250)})
    table = names.Table(some)
    for a in some[:80]:
        bounds = table.bounds(a)
        assert all(names.similarity(a, b) <= bounds[k] for k, b in enumerate(some) if names.similarity(a, b) >= names.TOKEN)
        assert all(names.similarity(a, b, 0.82) == names.similarity(a, b) for b in some if names.similarity(a, b) >= 0.82)


def test_similarity_is_not_symmetric():
    assert names.similarity("", "a") == 0.0 and names.similarity("A-b", "ab") == 1.0
    assert SequenceMatcher(None, "tide", "diet").ratio() != SequenceMatcher(None, "diet", "tide").ratio()


def test_conflicts_join_work(spark):
    rows = spark.createDataFrame([(1, "unknown ZZZ, Test", "15h"), (2, "unknown ZZZ, Test", "bush 40"), (3, "unknown ZZZ, Test", "bush"), (4, "SMITH Mary", "3")], "seq long, name string, work string")
    got = linkage.open_conflicts(rows, roster(spark, [(4, "SMITH, Mary", "1 Rd", None, True)])).collect()
    assert [(r.name, r.work) for r in got] == [("unknown ZZZ, Test", "15h bush 40")]


def sheet(*rows):
    return json.dumps({"tables": [{"columns": ["CLIENT", "DATE & WORK COMPLETED"], "rows": [list(r) for r in rows]}]})


def test_confirm_prices_and_replaces(spark):
    people = roster(spark, [(4, "SMITH, Mary", "1 Rd", 42.0, True)])
    work = spark.createDataFrame([(1, 4, "2026-09", "5", "old", "j1"), (2, 4, "2026-09", None, "typed", None), (3, 4, "2026-08", "5", "other", "j1")], "id long, client_id long, month string, day_or_note string, description string, source_job_id string").selectExpr("*", "CAST(5 AS DECIMAL(12,2)) AS amount")
    jobs = spark.createDataFrame([("j1", "2026-09", sheet(["SMITH, Mary", "9 15h | bush trimming $50"]))], "id string, month string, extract_json string")
    once = commit.confirm(jobs, people, work)
    assert once["conflicts"].count() == 0
    rows = once["work"].orderBy("id").collect()
    assert [(r.id, r.description, float(r.amount)) for r in rows] == [(2, "typed", 5.0), (3, "other", 5.0), (4, "Mowing 9", 42.0), (5, "Hedging 15", 0.0), (6, "bush trimming", 50.0)]
    again = commit.confirm(jobs, people, once["work"])["work"]
    assert sorted(r.description for r in again.collect()) == sorted(r.description for r in rows)


def test_conflicts_write_nothing(spark):
    people = roster(spark, [(4, "SMITH, Mary", "1 Rd", 42.0, True)])
    work = spark.createDataFrame([(1, 4, "2026-09", "5", "old", "j1")], "id long, client_id long, month string, day_or_note string, description string, source_job_id string").selectExpr("*", "CAST(5 AS DECIMAL(12,2)) AS amount")
    jobs = spark.createDataFrame([("j1", "2026-09", sheet(["SMITH, Mary", "9"], ["NOBODY, Known", "9"]))], "id string, month string, extract_json string")
    out = commit.confirm(jobs, people, work)
    assert out["conflicts"].count() == 1 and [r.description for r in out["work"].collect()] == ["old"]
    answers = spark.createDataFrame([("NOBODY, Known", None, None, None, None, None, None, 30.0, None, False, True)], "name string, save_as string, match_client_id long, address string, phone string, email string, billing_notes string, mow_price double, hedge_price double, prefer_mail boolean, add_permanently boolean")
    out = commit.confirm(jobs, people, work, answers)
    assert sorted((r.description, float(r.amount)) for r in out["work"].collect()) == [("Mowing 9", 30.0), ("Mowing 9", 42.0)]
    assert sorted(r.name for r in out["clients"].collect()) == ["NOBODY, Known", "SMITH, Mary"]


def test_cut_off_sheets_are_repaired(spark):
    whole = sheet(["SMITH, Mary", "9"], ["BRADY, Jim", "10"])
    jobs = spark.createDataFrame([("a", "```json\n" + whole + "\n```"), ("b", '{"title": "kept", "tables": [], "notes": ["a", "b'), ("c", "nothing"), ("d", None)], "id string, extract_json string")
    parsed = sheets.parse(jobs)
    assert sorted((r.id, r.name) for r in sheets.extract_rows(parsed).collect()) == [("a", "BRADY, Jim"), ("a", "SMITH, Mary")]
    assert {r.id: r.sheet and r.sheet.title for r in parsed.collect()} == {"a": None, "b": "kept", "c": None, "d": None}


def test_richest_and_longest_rows(spark):
    df = spark.createDataFrame([(0, ["A", "", "x"]), (1, ["a!", "1", "y"]), (2, ["", "q"]), (3, ["A", "2", "zzz"])], "row_no int, cells array<string>").selectExpr("*", "1 AS g")
    got = sorted((r.seen, r.cells) for r in sheets.richest_rows(df, ["g"]).collect())
    assert got == [(0, ["A", "2", "zzz"]), (2, ["", "q"])]


def test_cut_off_json_closes_in_order_of_nesting():
    whole = {"title": 'x "q" \\ é', "tables": [{"columns": ["CLIENT", "B"], "rows": [["A", "1"], ["B", "2"]]}], "notes": [], "n": -1.5e3, "complete": True}
    for indent in (None, 1):
        text = json.dumps(whole, indent=indent)
        assert jsonfix.loads(text) == whole
        last = 0
        for end in range(jsonfix.LEAST + 3, len(text)):
            if len(text[:end].strip()) <= jsonfix.LEAST:
                continue
            found = jsonfix.loads(text[:end])
            assert isinstance(found, dict) and set(found) <= set(whole)
            assert len(json.dumps(found)) >= last - 2  # what is kept grows with what is there
            last = len(json.dumps(found))
    cut = '{"title": "x", "tables": [{"columns": ["CLIENT"], "rows": [["A"'
    assert jsonfix.loads(cut) == {"title": "x", "tables": [{"columns": ["CLIENT"], "rows": [["A"]]}]}
    assert jsonfix.loads('{"a": [1, 2}, "b": 3, "cccccccccc": 1') == {"a": [1, 2]}
    assert [jsonfix.loads(t) for t in (None, "", "nothing", '{"a": 1', '```json\n{"t": 1}\n```', 'see {"a": 1} ok')] == [None, None, None, None, {"t": 1}, {"a": 1}]


def test_office_names_take_the_client_of_the_nearest_key(spark):
    from swardbook.operators import merge

    clients = spark.createDataFrame([(1, "GRAY, Lee 1191"), (2, "GRAY, Lee 11916"), (3, "BRADY, Jim Jones"), (4, "OAKES, J")], "id long, name string")
    records = spark.createDataFrame([("graylee11916etal", 1), ("graylee1191etal", 2), ("bradyjim", 3), ("oakesjohn", 4)], "key string, seq long")
    assert {(r.key, r.id) for r in merge.match_roster(records, clients).collect()} == {("graylee11916etal", 2), ("graylee1191etal", 1), ("bradyjim", 3)}
    alone = spark.createDataFrame([("graylee1", 1), ("graylee11", 2)], "key string, seq long")
    assert {(r.key, r.id) for r in merge.match_roster(alone, clients).collect()} == {("graylee1", 1), ("graylee11", 2)}


def test_matching_the_roster_sends_no_table_through_the_driver(spark, tmp_path):
    """What is planned from a small file is no broadcast, and keys that share a stem alone are no group."""
    from swardbook.operators import merge

    spark.range(3000).selectExpr("id", "concat('SMITH, Mary ', id + 1000) AS name").write.parquet(str(tmp_path / "clients"))
    clients = spark.read.parquet(str(tmp_path / "clients"))
    records = clients.selectExpr("concat('smithmary', id + 1000, IF(id % 2 = 0, '', 'etal')) AS key", "id AS seq")
    got = merge.match_roster(records, clients)
    assert "BroadcastExchange" not in got._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {(r.key, r.id) for r in got.collect()} == {(r.key, r.seq) for r in records.collect()}


def test_repair_deals_rows_whatever_the_file(spark, tmp_path):
    from swardbook.plans import linking
    from swardbook.sources.fixtures import Ledger

    rows = spark.sql("SELECT id AS event_id, timestamp'2026-01-02 03:04:05' AS ts, id % 3 AS user_id FROM range(2000)")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sizes = linking.cut_off(Ledger(spark, str(tmp_path))).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r[1] for r in sizes) < 600


def test_strings_cut_behind_a_backslash_stay_open():
    assert jsonfix.loads('{"k": {"a": 1}, "t": [["word\\') == {"k": {"a": 1}, "t": [["word"]]}
    assert jsonfix.loads('{"k": {"a": 1}, "t": [["word\\"\\') == {"k": {"a": 1}, "t": [['word"']]}


def test_numbers_meet_only_their_neighbours():
    numbers = [str(n) for n in range(10_000, 14_000)]
    there = {}
    for n in numbers:
        for k in names.index_keys(n, names.TOKEN, False):
            there[k] = there.get(k, 0) + 1
    met = sum(there.get(k, 0) for n in numbers for k in names.index_keys(n, names.TOKEN, True))
    assert met < 250 * len(numbers)


def test_ratio_is_that_of_difflib_and_near_texts_share_a_key():
    r = random.Random(11)
    for _ in range(4000):
        letters = r.choice(["ab", "0123456789", "abcdefghijkl"])
        a = "".join(r.choice(letters) for _ in range(r.randint(1, 22)))
        b = "".join(c for c in a if r.random() > 0.1) + r.choice(["", a[:1], "z"])
        assert names.ratio(a, b) == (1.0 if a == b else SequenceMatcher(None, a, b).ratio())
        for least in (0.8, 0.95):
            if b and names.ratio(a, b) >= least:
                assert set(names.index_keys(a, least, True)) & set(names.index_keys(b, least, False))
