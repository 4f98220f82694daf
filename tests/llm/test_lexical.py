"""Ranked search against a plain scan of all documents, with small blocks and groups, ties, edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from swardbook.llm import lexical

DOCS = "doc_id long, text string, lang string, n long, block long, terms string"
ITEMS = "item_id long, text string, score long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c, m in rows:
            m = 100 - 50 + 50 * m * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, out))


def corpus(n=600):
    r = random.Random(11)
    words = [f"w{k}" for k in range(200)] + ["Été", "ÉTÉ", "naïve", "日本", "X9", "x9", "don't"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(r.choices(words, weights, k=r.choice([1, 3, 20, 120]))) + r.choice(["", ".", "\n-"])) for k in range(n)]
    docs += [(None, "w150 w151"), (None, "w150 w151"), (5, docs[5][1]), (5, "w150 w151"), (n, None), (n + 1, ""), (n + 2, " .,- "), (-7, "w150 W151!")]
    docs += [(n + 10 + k, "w199 copies of one text w198") for k in range(90)] + [(n + 500, "long " + " ".join(f"u{k % 3000}" for k in range(50_000)))]
    r.shuffle(docs)
    items = [(k, " ".join(r.choices(words, k=r.randrange(1, 12)))) for k in range(25)]
    items += [(100, None), (101, "... "), (102, "nobody says this"), (None, "w3"), (None, "w4 W4"), (7, "w150"), (103, "w199 w198 u7"), (104, " ".join(words))]
    return docs, items


def frames(spark, docs, items):
    docs = spark.createDataFrame([(i, t, None if (i or 0) % 5 == 0 else f"l{(i or 0) % 3}", 1, 2, "x") for i, t in docs], DOCS).repartition(3)
    return docs, spark.createDataFrame([(i, t, 9) for i, t in items], ITEMS)


@pytest.mark.parametrize("block, group, cluster", [(8, 60, ["lang"]), (256, 200_000, [])])
def test_ranks_match_a_plain_scan(spark, monkeypatch, block, group, cluster):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "GROUP", group)
    docs, items = corpus()
    d, q = frames(spark, docs, items)
    got = lexical.search(lexical.build(d, cluster), q, 7)
    assert sorted(repr(tuple(r)) for r in got.collect()) == slow(docs, items, 7)


def test_blocks_under_the_threshold_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    seen = []
    scan = lexical.scan
    monkeypatch.setattr(lexical, "scan", lambda index, pairs, scorer: seen.append(pairs.count()) or scan(index, pairs, scorer))
    docs = [(k, f"common filler{k % 7} " + ("rare " * 5 if k < 16 else "")) for k in range(400)]
    d, q = frames(spark, docs, [(1, "common rare")])
    index = lexical.build(d.coalesce(1).sortWithinPartitions("doc_id"))
    assert sorted(repr(tuple(r)) for r in lexical.search(index, q, 5).collect()) == slow(docs, [(1, "common rare")], 5)
    assert seen[0] == lexical.SEEDS and seen[0] + seen[1] < index.forward.select("block").distinct().count()


def test_empty_tables(spark):
    docs, items = corpus(20)
    d, q = frames(spark, docs, items)
    assert lexical.search(lexical.build(d.limit(0)), q).collect() == []
    assert lexical.search(lexical.build(d), q.limit(0)).collect() == []


def test_products_beyond_63_bits():
    assert lexical.lengths_of(np.array([1 << 40, 3]), 1 << 40, 1 << 50).tolist() == [50 + 50 * (1 << 40) * (1 << 40) // (1 << 50), 50]
