import random
from collections import defaultdict

from swardbook.llm import packing, simhash


def slow(lengths, sources, clusters, capacity, share):
    """Scan every bin for the tightest one that takes the piece."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        best = None
        for k, b in enumerate(bins):
            left = capacity - sum(x[0] for x in b)
            own = [x[0] for x in b if x[1] == s]
            ok = left >= n and all(x[2] != c for x in b) and not (own and (sum(own) >= int(capacity * share) or sum(own) + n > int(capacity * share)))
            if ok and (best is None or left < best[0]):
                best = (left, k)
        if best is None:
            bins.append([])
            best = (0, len(bins) - 1)
        bins[best[1]].append((n, s, c))
        out.append(best[1])
    return out


def test_best_fit_matches_a_full_scan():
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(1, 120)
        lengths = sorted((r.randrange(1, 101) for _ in range(n)), reverse=True)
        sources = [r.choice(["a", "b", None]) for _ in range(n)]
        clusters = [r.randrange(30) for _ in range(n)]
        got = packing.best_fit(lengths, sources, clusters, 100, 0.75)[0]
        assert got == slow(lengths, sources, clusters, 100, 0.75)


def check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.lot, r.bin].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.slot)
        assert [r.slot for r in b] == list(range(len(b)))
        assert [r["at"] for r in b] == [sum(x.length for x in b[:k]) for k in range(len(b))]
        assert sum(r.length for r in b) <= capacity
        assert len({r.cluster for r in b}) == len(b)
        use = defaultdict(list)
        for r in b:
            use[r.source].append(r.length)
        assert all(len(x) == 1 or sum(x) <= capacity * packing.SOURCE_SHARE for x in use.values())
    return bins


def test_every_byte_is_packed_once(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, "x" * r.randrange(400), r.choice(["s", "t", None])) for i in range(600)]
    rows += [(1000 + i, "same text", "s") for i in range(300)] + [(None, None, None), (5, "é" * 1000, "s"), (5, "é" * 1000, "s"), (6, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(packing, "LOT", 100)
    got = packing.pack(packing.pieces(df, 256), 256).collect()
    bins = check(got, 256)
    assert len({b[0] for b in bins}) > 5
    assert sum(x.length for x in got) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    sizes = defaultdict(int)
    for x in got:
        sizes[x.doc_id] += x.length
    assert sizes[5] >= 2 * 2001


def test_no_documents(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string, source string"))).collect() == []


def test_near_duplicates_are_clusters(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = [(k, " ".join([*words[:-1], f"end{k % 2}"]), "s", 5) for k in range(6)] + [(9, "another text", "t", 6), (None, "no id", "t", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster long")
    got = packing.pieces(df, clusters=simhash.classes(df).select("doc_id", "component_id")).collect()
    assert {x.cluster for x in got if x.doc_id is not None and x.doc_id < 6} == {0} and {x.cluster for x in got if x.doc_id == 9} == {9}
    check(packing.pack(packing.pieces(df, clusters=simhash.classes(df))).collect(), packing.CAPACITY)
