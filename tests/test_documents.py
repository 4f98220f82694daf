"""Office files: what is written comes back, and files of other make are read as they are."""

import struct

from pyspark.sql import functions as F

from swardbook.sources import documents as D


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def compound(streams):
    """A compound file of 512-byte sectors: allocation table, folder, then each stream in sectors of its own."""
    sectors, table, entries = [b"", b""], [0xFFFFFFFD, 0xFFFFFFFE], []
    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        pieces = [data[k : k + 512].ljust(512, b"\0") for k in range(0, len(data), 512)]
        first = len(sectors)
        table += [*range(first + 1, first + len(pieces)), 0xFFFFFFFE]
        sectors += pieces
        entries.append((name, 2, first, len(data)))
    folder = b""
    for name, kind, first, size in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        text = name.encode("utf-16-le")
        folder += text.ljust(64, b"\0") + struct.pack("<HB", len(text) + 2, kind) + b"\0" * 49 + struct.pack("<IQ", first, size)
    sectors[1] = folder.ljust(512, b"\0")
    sectors[0] = struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0) + struct.pack("<II", 0xFFFFFFFE, 0)
    return head + struct.pack("<I", 0).ljust(436, b"\xff") + b"".join(sectors)


def test_workbooks_come_back(spark, tmp_path):
    rows = [["name", "a & <b>"], [None, "é\x00 \n x"], [], ["", "5"]]
    put(tmp_path / "a/one.xlsx", D.workbook(rows, "Data & more"))
    put(tmp_path / "two.xlsx", b"no workbook")
    put(tmp_path / "three.txt", b"other")
    got = D.workbook_rows(D.files(spark, str(tmp_path), "*.xlsx")).orderBy("row_no").collect()
    assert [(r.sheet, r.row_no, r.cells) for r in got] == [("Data & more", k + 1, c) for k, c in enumerate([["name", "a & <b>"], [None, "é \n x"], [], ["", "5"]])]


def test_shared_strings_and_gaps(spark, tmp_path):
    main = f'<workbook xmlns="{D._X[1:-1]}" xmlns:r="{D._OFFICE}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>'
    sheet = f'<worksheet xmlns="{D._X[1:-1]}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3"><v>45.5</v></c></row><row><c t="str"><v>f</v></c></row></sheetData></worksheet>'
    shared = f'<sst xmlns="{D._X[1:-1]}"><si><t>no</t></si><si><r><t>SMITH, </t></r><r><t>Mary</t></r><rPh><t>x</t></rPh></si></sst>'
    put(tmp_path / "x.xlsx", D._package("m", "xl/workbook.xml", main, {"worksheets/sheet1.xml": ("w", sheet), "sharedStrings.xml": ("s", shared)}))
    got = {r.row_no: r.cells for r in D.workbook_rows(D.files(spark, str(tmp_path))).collect()}
    assert got[3] == [None, "SMITH, Mary", *[None] * 24, "45.5"] and got[4] == ["f"]


def test_word_tables_lines_and_merged_cells(spark, tmp_path):
    put(tmp_path / "a.docx", D.word_table([["NAME", "x"], ["POND (upper)", "1"], ["LEE\nsecond", None]]))
    w = D._W[1:-1]
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:tbl><w:tr>{cell("wide", "<w:gridSpan w:val=%s/>" % chr(34).join(["", "2", ""]))}{cell("tall", "<w:vMerge w:val=%s/>" % chr(34).join(["", "restart", ""]))}</w:tr><w:tr>{cell("p")}{cell("q")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    put(tmp_path / "b.docx", D._package("d", "word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>', {}))
    got = {(r.path[-6:], r.row_no): r.cells for r in D.word_table_rows(D.files(spark, str(tmp_path))).collect()}
    assert got["a.docx", 2] == ["LEE\nsecond", ""] and got["b.docx", 0] == ["wide", "wide", "tall"] and got["b.docx", 1] == ["p", "q", "tall"]
    order = D.row_order(D.files(spark, str(tmp_path), "a.docx"))
    assert {r.key: r.sort_order for r in order.collect()} == {"pondupper": 1, "pond": 1, "leesecond": 2}


def test_phone_lists_of_the_old_format(spark, tmp_path):
    text = "\r".join(["ab", "SMITH, Mary", "860-961-5457", "POND", "(860) 555-1212"]).encode("utf-16-le")
    put(tmp_path / "p.doc", compound({"Other": b"z", "WordDocument": b"\1\2" * 300 + text, "1Table": b""}))
    put(tmp_path / "q.doc", b"\xd0\xcf\x11\xe0")
    found = D.files(spark, str(tmp_path), "*.doc")
    assert [r.line for r in D.old_word_lines(found).orderBy("line_no").collect()] == ["SMITH, Mary", "860-961-5457", "POND", "(860) 555-1212"]
    assert {r.key: r.phone for r in D.phones(found).collect()} == {"smithmary": "860-961-5457", "pond": "860-555-1212"}


def test_files_are_written_by_rows(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("book"), "id", F.array(F.col("id").cast("string"), F.lit(None).cast("string")).alias("cells"))
    made = D.packed(rows, D.workbook, F.concat(F.lit("b"), F.col("book").cast("string")), F.col("id"), ["head"])
    got = sorted((r.path, r.row_no, r.cells[0]) for r in D.workbook_rows(made).collect())
    assert got[:3] == [("b0", 1, "head"), ("b0", 2, "0"), ("b0", 3, "2")] and len(got) == 12
    assert D.workbook_rows(made.limit(0)).collect() == []
