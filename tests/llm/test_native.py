"""Quality rules and mixing: brute force, edges and laws."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from swardbook.llm import mixing, quality
from swardbook.llm.words import WORD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n", "a b c a b c", "one", "x y", "é à é à é à # $", "line\nline\n\n line\nline", "a a a a a a", "w1 w2 w3 w4 w2 w3 w4 w5", "# & |<>\x0b\x0cq", " ".join(f"t{i % 700}" for i in range(5000))]


def test_base_columns_match_brute_force(spark):
    r = random.Random(0)
    texts = TEXTS + [" ".join(r.choices("abcdefgh", k=r.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in quality.measure(df).collect()}
    assert got == {i: slow_base(t) for i, t in enumerate(texts)}


def test_windows_with_equal_hash_bits(spark, monkeypatch):
    """A hash of few values puts other windows between equal ones; the words decide."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * (1 << 40))
    r = random.Random(4)
    texts = TEXTS + [" ".join(r.choices(["a", "b", "cc", "dd"], k=r.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.n_repeat_words for x in quality.measure(df).collect()}
    assert got == {i: slow_base(t)[4] for i, t in enumerate(texts)}


def test_columns_with_clashing_names(spark):
    r = random.Random(2)
    rows = [(i, clean(r), "en", "a", 1, i, "h", 2.5) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS + ", n_words long, kept string, size double")
    assert sorted(map(tuple, quality.keep_good(spark, df, "").collect())) == sorted(rows)
    assert sorted({tuple(x) for x in mixing.resample(spark, df, "").collect()}) == sorted(rows)
    assert {x.size for x in mixing.mix(df).collect()} == {120}


def test_letters_of_any_script_count(spark):
    df = spark.createDataFrame([("слово 1",), ("词语",), ("ab#$",), (None,), ("12",)], "t string")
    assert [x.q for x in df.select(mixing.quality(F.col("t")).alias("q")).collect()] == [71, 100, 50, 1, 1]


def clean(r, n=120):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


def test_outliers_go_and_clean_documents_stay(spark):
    r = random.Random(1)
    rows = [(i, clean(r), r.choice(["en", None]), r.choice(["a", "b", None]), 1) for i in range(600)]
    bad = {1000: "$$$$ ## " * 3 + " ".join(f"{w} ####" for w in clean(r).split()), 1001: " ".join("abcdefghijklmnopqrst" * 2 + w for w in clean(r).split()), 1002: "few words"}
    rows += [(i, t, "en", "a", 1) for i, t in bad.items()] + [(5, rows[5][1], "en", "a", 1), (None, clean(r), "en", "a", 1)]
    got = [(x.doc_id, x.kept, x.base_failed) for x in quality.judge(spark.createDataFrame(rows, DOCS)).collect()]
    assert {i for i, kept, _ in got if not kept} == set(bad) and {i for i, _, failed in got if failed} == {1002}
    stay = quality.keep_good(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert len(stay) == len(rows) - 3 and stay[0].__fields__ == [c.split()[0] for c in DOCS.split(", ")]


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.judge(none).collect() == [] and mixing.mix(none).collect() == []


def level_targets(sizes):
    """Give shares by weight and hand on what is over, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(out.values())
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            open_.discard(s)


@pytest.mark.parametrize("seed", range(3))
def test_mix_laws(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["word"] * r.randrange(30)) or None, None, r.choice(["s1"] * 9 + ["s2", "s3", None, "ſ"]), 1) for i in range(900)] + [(2000, "x " * 5, None, "tiny", 1), (2000, "x " * 5, None, "tiny", 1), (None, "y", None, "s2", 1), (9, None, None, "empty", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = level_targets(sizes)
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 3 * x.size and x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 15 for s in want)


def test_stage_repeats_documents(spark):
    rows = [(i, "a b c d", "en", "s1", 7) for i in range(30)] + [(100 + i, "a b", "en", "s2", 3) for i in range(5)]
    df = spark.createDataFrame(rows, DOCS)
    taken = {x.doc_id: x.taken // x.size for x in mixing.mix(df).collect() if x.size}
    out = mixing.resample(spark, df, "")
    assert out.columns == df.columns and Counter(x.doc_id for x in out.collect()) == Counter({i: n for i, n in taken.items() if n})
