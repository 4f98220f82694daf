"""The pipeline's stages in a row against plain restatements of each."""

import random
from collections import Counter

from swardbook.llm import mixing, packing, quality, simhash
from swardbook.llm.words import WORD

import corpus_pipeline
from tests.llm.test_packing import check
from tests.llm.test_simhash import slow_classes
from tests.llm.test_substrings import slow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    fresh = lambda n: ["".join(r.choices("abcdefghijkl", k=r.randrange(2, 9))) for _ in range(n)]
    shared = fresh(60)
    rows = []
    for i in range(160):
        words = fresh(r.randrange(60, 160))
        if i % 10 == 0:
            words[20:20] = shared
        rows.append((i, " ".join(words), r.choice(["en", "de"]), r.choice(["a", "a", "a", "b", "c"]), 1))
    rows += [(200 + k, rows[k % 7][1], "en", "a", 1) for k in range(30)]  # copies
    for k in range(10):  # near copies
        words = rows[11][1].split()
        words[k] = "changed"
        rows.append((300 + k, " ".join(words), "en", "b", 1))
    return rows + [(400, "short", "en", "a", 1), (401, None, None, None, None), (402, "same words again " * 40, "en", "a", 1)]


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: Counter(x.doc_id for x in df.collect())

    kept = quality.keep_good(spark, docs, "").cache()
    assert ids(kept) == Counter(x.doc_id for x in quality.judge(docs).collect() if x.kept)
    assert not {400, 401, 402} & set(ids(kept))

    single = simhash.keep_first(spark, kept, "").cache()
    classes = slow_classes([(x.doc_id, x.text) for x in kept.collect()])
    assert ids(single) == Counter(i for i, (_, c) in classes.items() if i == c)
    assert not any(200 <= i < 230 for i in ids(single))

    cut = corpus_pipeline.STAGES[2][1](spark, single, "").cache()
    want = {i: (n, gone) for i, n, gone, _ in slow([(x.doc_id, x.text) for x in single.collect()])}
    assert {x.doc_id: len(WORD.findall(x.text)) for x in cut.collect()} == {i: n - gone for i, (n, gone) in want.items() if n > gone or not gone}
    assert any(gone for _, gone in want.values())

    mixed = mixing.resample(spark, cut, "").cache()
    times = {x.doc_id: x.taken // x.size for x in mixing.mix(cut).collect() if x.taken}
    assert ids(mixed) == Counter(times)
    assert docs.columns == kept.columns == single.columns == cut.columns == mixed.columns

    packed = packing.to_windows(spark, mixed, "").collect()
    check(packed, packing.CAPACITY)
    assert sum(x.length for x in packed) == sum(len(x.text.encode()) + 1 for x in mixed.collect())

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.piece, x.length) for x in whole) == Counter((x.doc_id, x.piece, x.length) for x in packed)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
