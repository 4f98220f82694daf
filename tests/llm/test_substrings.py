import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from swardbook.llm import scratch, substrings
from swardbook.llm.words import WORD


def slow(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    grams = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if grams[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(n=150, seed=0):
    r = random.Random(seed)
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    shared = [fresh(k) for k in (34, 35, 36, 50, 120, 400)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += fresh(r.randrange(0, 60))
            if r.random() < 0.6:
                s = r.choice(shared)
                a = r.randrange(max(1, len(s) - 36))
                parts += s[a : a + r.randrange(30, 90)]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a b " * 40), (n + 3, " ".join(fresh(3000) * 2)), (None, rows[0][1]), (3, rows[3][1])]
    rows += [(n + 10 + k, "copy " + " ".join(shared[3])) for k in range(30)]
    return rows


@pytest.mark.parametrize("chunk, segment", [(substrings.CHUNK, substrings.SEGMENT), (5000, 400), (300, 2000)])
def test_matches_brute_force(spark, monkeypatch, chunk, segment):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "SEGMENT", segment)
    monkeypatch.setattr(substrings, "STEP", 500)
    rows = corpus()
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)


def test_texts_keep_their_form_and_columns(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(1, f"Head,\n two\t{long}  tail", "s1"), (2, f"other {long}", "s2"), (3, "kept  as\tit is", None), (4, long, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice string")
    got = {r.doc_id: (r.text, r.slice) for r in substrings.cut_repeats(spark, docs, "").collect()}
    assert got == {1: ("Head,\n two\ttail", "s1"), 2: ("other ", "s2"), 3: ("kept  as\tit is", None)}


def test_long_texts_keep_their_form(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 300)
    shared = " ".join(f"x{i}" for i in range(40))
    long = "\n ".join(f"y{i}" for i in range(300))
    rows = [(1, f"  {long}\t{shared}  {long[:50]}z \n", [1, 2], {"a": 1}), (2, shared, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<int>, notes map<string,int>")
    got = {r.doc_id: (r.text, r.tags, r.notes) for r in substrings.cut_repeats(spark, docs, "").collect()}
    assert got == {1: (f"  {long}\t{long[:50]}z \n", [1, 2], {"a": 1})}


def test_segments_cover_a_text(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 200)
    text = " \n".join(f"é{i}" for i in range(400))
    words, parts = text.split(), list(substrings.segments(text))
    assert "".join(p[0] for p in parts) == text and len(parts) > 5
    for own, before, after, base in parts:
        around = [*before.split(), *own.split(), *after.split()]
        assert words[base : base + len(around)] == around and base % substrings.BLOCK == 0
    assert all(len(p[2].split()) == 34 for p in parts[:-2]) and all(len(p[1].split()) >= 18 for p in parts[1:])


def test_columns_with_clashing_names(spark):
    long = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long, 7, "s", 2), (2, "a " + long, 8, "t", 3)], "doc_id long, text string, n_words long, kept_sha256 string, N_Removed int")
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 40, 40), (2, 41, 40)]
    stay = substrings.cut_repeats(spark, docs, "").collect()
    assert [tuple(r) for r in stay] == [(2, "a ", 8, "t", 3)] and stay[0].__fields__ == docs.columns


def test_scope_drops_what_was_written(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    with scratch.scope(spark):
        assert substrings.remove_repeats(docs).count() == 1
        assert len({t.name for t in spark.catalog.listTables()} - before) == 1
    assert {t.name for t in spark.catalog.listTables()} == before


def test_one_first_hash_of_two_windows(monkeypatch):
    """Where first hashes are equal, second hashes decide."""
    monkeypatch.setattr(substrings, "WINDOW", 2)
    b = substrings.Batch([("a b c a b d", "", "", 0)])
    at, h = b.windows(2)
    first = np.array([h[0]] * 2, dtype=np.uint64)
    second = np.array([1, b.second(at)[0]], dtype=np.uint64)
    back = pa.table({"__chunk": [0], "data": [first.tobytes() + second.tobytes()]})
    docs = pa.table({"text": ["a b c a b d"], "__before": [""], "__after": [""], "__base": [0], "__many": [False], "__row": [0], "__seg": [0]})
    got = substrings._cover([], False)(docs, back)
    assert got.column("text").to_pylist() == ["c d"]


def test_no_documents(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_of_hashes():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        v = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        assert (substrings._unpack(substrings._pack(v)) == v).all()
        v = np.unique(v >> np.uint64(30))
        assert (substrings._unpack(substrings._pack(v)) == v).all()
