"""Personal data: the base kinds against their patterns, the added kinds, masking."""

import hashlib
import random
import re
import time

from swardbook.llm import private

DOCS = "doc_id long, text string, spans string, kind long"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def slow(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


HARD = [
    None, "", "a@b", "a@b.c", "a@b.c@d.e", "@b.c", "x..y@-.-", "a@b..c", "é.a@b.c.d.é", "a@b.c.", "a@@b.c", "a+1@b.c+2@d.e",
    "1.2.3.4", "1.2.3.4.5.6.7.8.9", "1.2.3", "256.1.1.1.2.2.2.2", "0001.002.03.0255", "1..2.3.4.5", ".1.2.3.4.", "99999999999.1.1.1",
    "4432507379035540", "4432-5073 7903-5540", "4432  5073 7903 5540", "4432507379035540 1", "1 2 3 4", "0" * 16, "0" * 19, "0" * 20, "44325073790355401234567",
    "+1 (499) 555-6503", "+12", "+123", "+1 2", "+1()2", "+12345678", "+1 2345678 ", "+123456789012345", "+1234567890123456", "++1 2345678", "+1 2345678+3 4567890", "+1.2.3.4.5678",
    "１２３４", "٣.٣.٣.٣", "a@b.c,1.2.3.4+1 2345678-", "19@mail5.example.com ining", "1-2-3-4-" * 5,
]


def texts():
    r = random.Random(9)
    out = HARD + ["".join(r.choices("ab1234567890.@+- ()é,%", k=r.choice([5, 20, 80, 400]))) for _ in range(1500)]
    out += ["".join(r.choices(["@", ".", "a", "+", "0", "00", " ", "-", "255", "4432507379035540", "a@b.c", "+4912345678"], k=30)) for _ in range(1500)]
    return out + long_texts(100)


def long_texts(n):
    return ["1 " * n, "a" * n + "@", "a." * n + "@" + "b." * n + "c", "1." * n, "+1" * n, "token " * n]


def test_long_texts_cost_their_length():
    began = time.perf_counter()
    sizes = [len(private.Finder().spans(t)) for t in long_texts(200_000)]
    assert sizes == [0, 0, 1, 50_000, 0, 0] and time.perf_counter() - began < 30


def test_base_kinds_match_their_patterns():
    find = private.Finder().spans
    for t in texts():
        got = [x for x in find(t or "") if x[0] in private.BASE]
        assert got == slow(t), (t or "")[:200]


def test_query_columns(spark, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts()[:200])] + [(None, "a@b.c", None, None), (3, "a@b.c", "", 0), (3, "a@b.c", "", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in private.query(spark, str(tmp_path)).collect()]
    want = []
    for i, t, _, _ in rows:
        base = slow(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        want.append((i, *(sum(x[0] == k for x in base) for k in private.BASE), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_added_kinds_need_a_cue_and_a_check():
    find = lambda t: [(k, t[s:e]) for k, s, e in private.Finder().spans(t) if k not in private.BASE]
    assert find('x Token = "1eb9c654e721b4f812088970e66a6345cee33dd6" y') == [("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6")]
    assert find("api_key: abcdef0123456789abcdef") == [("secret", "abcdef0123456789abcdef")]
    assert find("the token of his appreciation, a password manager, secret: none, tokens 12") == []
    assert find("IBAN: DE89 3704 0044 0532 0130 00 paid") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert find("iban GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")] and find("IBAN DE00370400440532013000") == []
    assert find("see ftp://anna:hunter2@files.example.com/x or http://example.com:80/@x") == [("login", "anna:hunter2")]
    assert find("İIBAN GB82WEST12345698765432")[0][1] == "GB82WEST12345698765432"


def test_masking(spark):
    rows = [(1, "mail ä a@b.c, or +1 2345678 now", None, 1), (2, "nothing", None, 1), (3, None, None, 1), (4, "http://a:b@c.de/", None, 1), (5, "9.9.9.9", None, 1)]
    got = {x.doc_id: x.text for x in private.mask(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "mail ä <EMAIL>, or <PHONE> now", 2: "nothing", 3: None, 4: "http://<LOGIN>/", 5: "<IP>"}


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert private.find(none).collect() == [] and private.mask(none).collect() == []
