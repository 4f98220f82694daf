"""Fill-in-the-middle: brute force over code points and words, edges and the round trip."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from swardbook.llm import infill

DOCS = "doc_id long, text string, row string, cuts long, parts string"
WORD = "[^ ]+ ?| "


def slow(doc_id, text, unit="."):
    text = text or ""
    ends = [0] + [m.end() for m in re.finditer(unit, text, re.S)]
    n = len(ends) - 1
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, text, n, "plain", None, text)
    lo, hi = (ends[x] for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return (doc_id, text, n, form, [pre, mid, suf], out)


def texts():
    r = random.Random(3)
    out = [None, "", "x", "<P>", "a <S> b", "<", "<<P", "S>", "<M", "🙂é\n\r\n  ü" * 90, "a" * 255, "b" * 256, "c" * 257, "d" * 512, " lead", "trail ", "𝄞" * 700]
    out += ["".join(r.choices("ab \n\té🙂<PSM>", k=r.choice([1, 2, 5, 300, 1500]))) for _ in range(150)]
    return out + ["".join(r.choices("abcd ", k=400_000))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


@pytest.mark.parametrize("unit,pattern", [(infill.CODE_POINT, "."), (WORD, WORD)])
def test_parts_match_brute_force(spark, unit, pattern):
    rows = list(enumerate(texts())) + [(None, "no id here"), (7, "twice"), (7, "twice"), (-5, "below zero")]
    got = [tuple(x[c] for c in ("doc_id", "text", "n", "form", "parts", "output")) for x in infill.transform(frame(spark, rows), unit).collect()]
    assert sorted(map(repr, got)) == sorted(repr(slow(i, t, pattern)) for i, t in rows)


def test_outputs_give_the_texts_back(spark):
    rows = list(enumerate(texts() * 2))
    out = infill.transform(frame(spark, rows)).withColumn("again", infill.restore(F.col("output"), F.col("form")))
    assert {"plain", "psm", "spm"} == {x.form for x in out.select("form").distinct().collect()}
    assert out.filter("text <> again OR again IS NULL").count() == 0


def test_any_number_of_cuts(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    cuts = [0, 0, 1, 255, 256, 257, 999, 1000, 5000]
    rows = spark.createDataFrame([(1, text, cuts), (2, "one", [1]), (3, "", [0, 0]), (4, "two words", [])], "row long, text string, cuts array<long>")
    got = {x.row: x.parts for x in infill.split(rows, WORD).collect()}
    assert "".join(got[1]) == text and len(got[1]) == 10 and [len(p.split()) for p in got[1]] == [0, 0, 1, 254, 1, 1, 742, 1, 0, 0]
    assert got[2] == ["one", ""] and got[3] == ["", "", ""] and got[4] == ["two words"]


def test_units_have_to_cover_the_text(spark):
    rows = spark.createDataFrame([(1, "a b", [1])], "row long, text string, cuts array<long>")
    with pytest.raises(Exception, match="leaves characters out"):
        infill.split(rows, "[a-z]").collect()


def test_no_documents(spark):
    assert infill.transform(spark.createDataFrame([], DOCS)).collect() == []
