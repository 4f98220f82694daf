import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from swardbook.llm import encode, lengths, tokenfiles

TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "one two, three. four's it's 's", "x <|endoftext|> y", "<|endoftext|>",
    "<|endo ftext|>", "É ê ça 12 345 6a7", "a b  c 　d", "\x1c a \x1c", "tab\tb \tc", "word " * 5000, "A" * 9000, "…-- ?! ,.", "a" + " " * 50 + "b",
]


def plain(texts):
    t = Tokenizer.from_file(encode.default_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    enc = encode.Encoder(encode.default_vocabulary())
    want, texts = plain(TEXTS), pa.array(TEXTS, pa.string())
    assert enc.cuts
    for memo, young in ((encode.MEMO, encode.YOUNG), (3, 2), (0, 1)):
        monkeypatch.setattr(encode, "MEMO", memo)
        monkeypatch.setattr(encode, "YOUNG", young)
        enc = encode.Encoder(encode.default_vocabulary())
        for _ in range(2):
            flat, n = enc.encode(texts, 0)
            cuts = np.split(flat, np.cumsum(n)[:-1])
            assert [c.tolist() for c in cuts] == [[*w, 0] for w in want]
            assert enc.lengths(texts).tolist() == [len(w) for w in want]
            some = texts.slice(3, 9)
            assert enc.lengths(some).tolist() == [len(w) for w in want[3:12]]
    assert len(enc.encode(texts.slice(0, 0), 0)[0]) == 0


def test_long_texts_are_runs_of_their_own(monkeypatch):
    monkeypatch.setattr(encode, "BYTES", 10)
    texts = pa.array(["aaaa", None, "b" * 50, "cc", "dd", "ee"], pa.string())
    assert list(encode.small_parts(texts, 2)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert list(encode.small_parts(texts.slice(0, 0), 2)) == []


def test_cuts_in_odd_white_space():
    """Random texts of every kind of white space, against whole-text encoding."""
    r = np.random.default_rng(3)
    alphabet = list("ab. 1'\n\t\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000\u2028 é世")
    texts = ["".join(r.choice(alphabet, r.integers(0, 40))) for _ in range(600)] + ["  ", " ", "\x00 \x00"]
    flat, n = encode.Encoder(encode.default_vocabulary()).encode(pa.array(texts), 0)
    assert [c.tolist() for c in np.split(flat, np.cumsum(n)[:-1])] == [[*w, 0] for w in plain(texts)]


def rows():
    return [(i * 7 % 23, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    tokenfiles.write(docs, str(tmp_path / "t"))
    got = tokenfiles.digests(tokenfiles.read(spark, str(tmp_path / "t"))).collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for (i, _), ids in zip(order, plain([t for _, t in order])):
        ids = np.array([*ids, 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    tokenfiles.write(docs, str(tmp_path / "t"))
    for f in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        col = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert col["doc_id"].has_offset_index and col["doc_id"].has_column_index
        assert "DELTA_BINARY_PACKED" in col["doc_id"].encodings
        assert any("DICTIONARY" in e for e in next(c for p, c in col.items() if p.startswith("ids")).encodings)


def test_empty_files(spark, tmp_path):
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert tokenfiles.digests(tokenfiles.read(spark, str(tmp_path / "t"))).collect() == []


def test_histogram_answers_every_limit(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    sizes = [len(x) for x in plain([t for _, t in rows()])]
    monkeypatch.setattr(lengths, "SPAN", 4)
    got = {r.context_limit: r for r in lengths.answers(lengths.histogram(lengths.encoded_lengths(docs))).collect()}
    assert set(got) == set(sizes)
    for limit, r in got.items():
        over = [s for s in sizes if s > limit]
        assert (r.docs, r.docs_over, r.tokens_over) == (sizes.count(limit), len(over), sum(over))
        assert r.total == sum(sizes) and r.truncated_total == sum(min(s, limit) for s in sizes)
        assert abs(r.share_within - (1 - len(over) / len(sizes))) < 1e-12
    assert lengths.answers(lengths.histogram(lengths.encoded_lengths(docs.limit(0)))).collect() == []


def test_any_limit_and_share(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    sizes = sorted(len(x) for x in plain([t for _, t in rows()]))
    found = lengths.answers(lengths.histogram(lengths.encoded_lengths(docs)))
    limits = [-1, 0, 1, 7, 100, 10**9]
    for r in lengths.at_limits(found, limits).collect():
        over = [s for s in sizes if s > r.context_limit]
        assert (r.docs_over, r.tokens_over, r.total, r.truncated_total) == (len(over), sum(over), sum(sizes), sum(min(s, r.context_limit) for s in sizes))
    got = {r.share: r.n_tokens for r in lengths.quantiles(found, [0.1, 0.5, 1.0]).collect()}
    assert got == {q: next(s for s in sizes if sum(x <= s for x in sizes) >= q * len(sizes)) for q in (0.1, 0.5, 1.0)}
    none = lengths.answers(lengths.histogram(lengths.encoded_lengths(docs.limit(0))))
    assert lengths.at_limits(none, limits).collect() == [] and lengths.quantiles(none, [0.5]).collect() == []


def test_columns_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows()], "doc_id long, text string, n_tokens long, at long, part string")
    tokenfiles.write(docs, str(tmp_path / "t"))
    assert tokenfiles.digests(tokenfiles.read(spark, str(tmp_path / "t"))).count() == len(rows())
    assert lengths.encoded_lengths(docs).count() == len(rows())


def test_texts_without_spaces_are_not_remembered():
    """What a worker keeps is bounded in bytes, whatever the texts hold."""
    own = encode.Encoder(encode.default_vocabulary())
    texts = ["".join(chr(0x4E00 + (k * 31 + j * 7) % 20000) for j in range(500)) for k in range(300)] + ["short words here"]
    ids, sizes = own.encode(pa.array(texts), 0)
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == own._ids(t) + [0]
        at += n
    kept = [*own.memo, *own.young]
    assert max(map(len, kept)) <= encode.LONGEST and len(kept) < 10
