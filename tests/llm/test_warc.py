import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from swardbook.llm import warc
from swardbook.llm.scratch import list_files

PAGES = [
    (1, "http://a/ x", "<p>one</p>\r\n\r\nWARC/1.1\r\n\r\n"), (2, "http://b", "<p>one</p>\r\n\r\nWARC/1.1\r\n\r\n"), (3, None, None), (4, "http://c", ""),
    (5, "http://d", "é" * 200_000), (6, "http://e", "last"), (6, "http://e2", "last"), (6, "http://e3", "other"), (None, "http://n", "null id"), (None, "http://n", "last"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def made(spark, path, pages=PAGES):
    return warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(path))


def test_round_trip(spark, tmp_path):
    got = [tuple(r) for r in warc.resolve(made(spark, tmp_path / "w")).collect()]
    want = [
        (1, sha(PAGES[0][2]), "revisit", 2), (2, sha(PAGES[0][2]), "response", None), (3, sha(""), "revisit", 4), (4, sha(""), "response", None),
        (5, sha(PAGES[4][2]), "response", None), (6, sha("last"), "response", None), (6, sha("last"), "response", None), (6, sha("other"), "response", None),
        (None, sha("null id"), "response", None), (None, sha("last"), "revisit", 6),
    ]
    assert sorted(((i, d, t, r) for i, _, d, t, r in got), key=str) == sorted(want, key=str)
    size = {sha(h): len((h or "").encode()) for _, _, h in PAGES}
    assert all(n == size[d] for _, n, d, _, _ in got)


def test_files_are_warc(spark, tmp_path):
    rows = made(spark, tmp_path / "w").collect()
    types = []
    for name in list_files(spark, str(tmp_path / "w")):
        data = gzip.decompress(warc.open_input(name).read())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(head.rpartition(b"Content-Length: ")[2])
            assert rest[size : size + 4] == b"\r\n\r\n"
            types.append(b"WARC-Type: response" in head)
            data = rest[size + 4 :]
    assert len(types) == len(PAGES) == len(rows)


def test_index_selects_single_records(spark, tmp_path):
    rows = made(spark, tmp_path / "w")
    got = warc.read(rows.filter("page_id = 5")).collect()
    assert [bytes(r.payload).decode() for r in got] == ["é" * 200_000]
    urls = {r.page_id: r.url for r in rows.collect()}
    assert urls[1] == "http://a/%20x" and urls[3] == "about:blank"


def test_ranges_merge():
    spans = [(0, 10), (14, 6), (10 + warc.GAP * 2, 5)]
    assert list(warc.ranges(spans)) == [(0, 20, [0, 1]), (10 + warc.GAP * 2, 15 + warc.GAP * 2, [2])]
    assert list(warc.ranges([])) == []


def test_no_pages(spark, tmp_path):
    assert warc.resolve(made(spark, tmp_path / "w", [])).collect() == []


def test_chosen_revisits_fetch_what_they_refer_to(spark, tmp_path):
    rows = made(spark, tmp_path / "w", [(k, f"http://x/{k}", "same page" if k < 4 else f"page {k}") for k in range(8)])
    whole = {tuple(r) for r in warc.resolve(rows).collect()}
    for chosen in ([1], [1, 3], [0, 5], [3], []):
        got = {tuple(r) for r in warc.resolve(rows, rows.filter(F.col("page_id").isin(chosen))).collect()}
        assert got == {r for r in whole if r[0] in chosen} and len(got) == len(chosen)
