import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from swardbook.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            base = rows[r.randrange(min(len(rows), 20))][1].split(" ")
            for _ in range(r.randrange(3)):
                base[r.randrange(len(base))] = r.choice(words)
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(r.choices(words, k=r.randrange(1, 200)))))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.classes(df).collect()]


@pytest.mark.parametrize("text", ["", None, "One", "a B", "x y z", "É É b c\td  e\n" * 40, "long word " * 3000])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_large_fingerprint_histogram():
    rows = np.random.default_rng(0).integers(0, 256, (5000, 8), dtype=np.uint8)
    assert (simhash._bit_counts(rows) == np.unpackbits(rows, axis=1).sum(axis=0)).all()


def test_index_finds_every_pair_within_three_bits():
    """The pigeonring bound: any three flipped bits leave a key equal and its chain within budget."""
    flips = [c for n in range(4) for c in combinations(range(64), n)]
    diff = np.array([sum(1 << b for b in c) for c in flips], dtype=np.uint64)
    first = simhash._first_key(diff)
    assert (first < 24).all()
    same = diff.view(np.uint8).reshape(-1, 8) == 0
    shown = np.zeros(len(diff), dtype=bool)
    for start in range(8):
        chain = simhash._chain(diff, np.full(len(diff), start))
        keyed = np.zeros(len(diff), dtype=bool)
        for choice in simhash.CHOICES:
            keyed |= same[:, [(start + k) % 8 for k in choice]].all(axis=1)
        shown |= chain & keyed
    assert shown.all()


def test_classes_match_brute_force(spark, monkeypatch):
    rows = corpus(260)
    rows += [(1000, None), (1001, ""), (1002, " \t")]
    want = {(i, *v) for i, v in slow_classes(rows).items()}
    assert set(run(spark, rows)) == want
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "SMALL", 2)
    assert set(run(spark, rows)) == want


def test_edges(spark):
    assert run(spark, []) == []
    twice = [(1, "same text here now"), (1, "same text here now"), (None, "same text here now")]
    fp = f"{simhash.fingerprint('same text here now'):016x}"
    assert sorted(run(spark, twice), key=str) == sorted([(1, fp, 1), (1, fp, 1), (None, fp, None)], key=str)


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(k, "one text of some words", 1, 2, 3, "x") for k in range(3)], "doc_id long, text string, fp long, rep long, component_id long, slot string")
    assert [(r.doc_id, r.component_id) for r in simhash.classes(df).orderBy("doc_id").collect()] == [(0, 0), (1, 0), (2, 0)]
    assert [tuple(r) for r in simhash.keep_first(spark, df, "").collect()] == [(0, "one text of some words", 1, 2, 3, "x")]
