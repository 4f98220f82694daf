import numpy as np
from pyspark.sql import functions as F

from swardbook.llm import neighbours


def slow(rows):
    good = [(k, i, np.array(v, dtype=np.float64)) for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    x = [v / np.sqrt((v * v).sum()) for _, _, v in good]
    near = np.array([[len(a) == len(b) and a @ b >= 0.9 for b in x] for a in x]).reshape(len(x), len(x))
    np.fill_diagonal(near, False)
    root = list(range(len(good)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near)):
        root[find(a)] = find(b)
    least = {}
    for k, (_, i, _) in enumerate(good):
        least[find(k)] = min(i, least.get(find(k), i))
    want = {at: (int(near[k].sum()), least[find(k)]) for k, (at, _, _) in enumerate(good)}
    return sorted([(i, *want.get(k, (0, i))) for k, (i, _) in enumerate(rows)], key=str)


def rows(seed=0):
    r = np.random.default_rng(seed)
    out = [r.standard_normal(8) for _ in range(150)]
    for c in range(6):
        centre = r.standard_normal(8)
        out += [centre + 0.1 * r.standard_normal(8) for _ in range(4 + 15 * c)]
    out += [out[0]] * 20 + [out[160] * 2] * 3
    out = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(out)]
    n = len(out)
    out += [(n + 10 + k, r.standard_normal(3).tolist()) for k in range(4)] + [(n + 20 + k, [1.0, 2.0, 3.0 + 0.01 * k]) for k in range(5)]
    out += [(3, (-np.array(out[3][1])).tolist()), (3, out[170][1])]  # one id, other vectors
    out += [(n, None), (n + 1, []), (n + 2, [0.0] * 8), (n + 3, [float("nan")] * 8), (n + 4, [1.0] * 7 + [None]), (n + 5, [float("inf")] + [1.0] * 7), (n + 6, [1.0, 2.0]), (None, out[0][1])]
    return out


def run(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = neighbours.classes(df).collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert all(r.audited_recall is None or r.audited_recall >= 0.9 for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "BUCKET", 16)
    data = rows()
    assert run(spark, data) == slow(data)


def test_no_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0, 0.0])]) == [(1, 0, 1), (2, 0, 2)]


def test_full_lists_grow(spark):
    edges = [(0, k, 0.95) for k in range(1, 21)] + [(30, k, 0.8) for k in range(1, 21)] + [(60, k, 0.95) for k in range(100, 200)]
    got = neighbours._shortlist(spark.createDataFrame([(*e, True) for e in edges], neighbours._EDGE)).collect()
    assert sum(x.u == 0 for x in got) == 20 and {x.most for x in got if x.u == 0} == {32}
    assert sum(x.u == 30 for x in got) == 8
    assert sum(x.u == 60 for x in got) == 64 and {x.most for x in got if x.u == 60} == {64}


def group(r, centre, n, tight=0.01):
    return [(centre + tight * r.standard_normal(8)).tolist() for _ in range(n)]


def test_tight_groups_with_linked_members(spark, monkeypatch):
    """Every list fills with closer members of the own group, and all of one group links with all of the other."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "BUCKET", 32)
    r = np.random.default_rng(5)
    a = np.eye(8)[0]
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * np.eye(8)[1]
    data = [(k, v) for k, v in enumerate(group(r, a, 30) + group(r, b, 30) + r.standard_normal((200, 8)).tolist())]
    assert run(spark, data) == slow(data)


def test_ties_outlive_lists(spark):
    edges = [(0, k, 0.95) for k in range(1, 81)] + [(140, 0, None), (0, 150, 0.8)]
    got = neighbours._shortlist(spark.createDataFrame([(*e, True) for e in edges], neighbours._EDGE)).collect()
    assert [(x.u, x.v) for x in got if x.sim is None] == [(140, 0)]
    assert sorted(x.v for x in got if x.u == 0) == [*range(1, 65), 150]


def test_known_neighbours_are_not_fresh(spark):
    edges = [(0, 1, 0.95, False), (0, 1, 0.95, True), (0, 2, 0.95, True)]
    got = neighbours._shortlist(spark.createDataFrame(edges, neighbours._EDGE)).collect()
    assert {x.v: x.fresh for x in got} == {1: False, 2: True}


def test_cluster_beyond_a_block(spark, monkeypatch):
    """Parts of one bucket meet in other tables, as each cuts it another way."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "BUCKET", 16)
    data = list(enumerate(group(np.random.default_rng(7), np.eye(8)[0], 150, 1e-4) + np.eye(8)[1:].tolist() + (-np.eye(8)).tolist()))
    assert run(spark, data) == slow(data)


def test_failed_audit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_audit", lambda *_: 0.5)
    try:
        run(spark, [(k, v) for k, v in enumerate(np.eye(8).tolist())])
    except RuntimeError as e:
        assert "0.5" in str(e)
    else:
        raise AssertionError("no error")


def test_recall_is_not_measured_without_links(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(np.eye(8).tolist())], "vec_id long, embedding array<float>")
    assert {r.audited_recall for r in neighbours.classes(df).collect()} == {None}


def test_audit_takes_every_fiftieth(spark, monkeypatch):
    """All of them, in one lot or in several."""
    data = [(k, 0, [1.0, 0.001 * k], 1, 2, k % 50 == 0) for k in range(200)]
    found = spark.createDataFrame(data, "least long, x long, v array<double>, copies long, dim int, asked boolean").withColumn("node", F.col("least"))
    half = spark.createDataFrame([(k, k // 100) for k in range(200)], "__node long, __component long")
    for lot in (1000, 3):
        monkeypatch.setattr(neighbours, "AUDIT", (0, lot))
        assert neighbours._audit(found, half) == (4 * 100 - 4) / (4 * 200 - 4)


def test_an_id_is_asked_whichever_of_its_copies_it_is(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (50, [1.0, 2.0]), (4, [2.0, 1.0]), (51, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.least, r.copies, r.asked) for r in neighbours.nodes(df).collect()} == {(3, 2, True), (4, 2, False)}


def test_columns_with_clashing_names(spark):
    data = [(k, v, 1, 2, 3.0, "c") for k, v in enumerate(np.eye(4).tolist() + np.eye(4).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, node long, n_links long, v double, component string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.classes(df).collect()) == [(k, 1, k % 4) for k in range(8)]
