"""Exact substring dedup with fixed-block anchors.

Every text gives non-overlapping reference blocks of BLOCK words; any window of
2 * BLOCK - 1 words holds one whole block. Blocks are the index, and every
rolling window of BLOCK words of every text probes it. A block that occurs
anywhere else is a hit. Hits are extended to maximal exact repeats: around each
hit block, all windows of WINDOW words that hold the block are looked up among
the windows around all other hits, and runs of repeated windows are the maximal
repeats. Both texts of a repeat hold a hit block of their own inside it, so both
sides of every repeat are looked up.

Texts stay where they are. They are written once, as chunks of about CHUNK
bytes, to a table bucketed by chunk; a text over SEGMENT bytes is cut into
segments that know the words before and after them, so neither a chunk nor a
task grows with the longest text. Only hashes travel: a chunk sends each slice
of the hash space its distinct hashes, each once whatever its frequency, and
gets back those that matter to it. A passage that a third of all documents share
is one entry for each chunk, and no pair of documents is ever formed. There are
never more messages than hashes, so traffic stays in proportion to the text.

The block index has 32 bits inside a slice of bounded size; a false hit there
costs a lookup of the windows around it and no more. Windows are compared by two
independent hashes of 64 bits, so among n windows around hits two different ones
are taken for equal with probability n * n / 2**129: less than one in a billion
for a trillion windows. Words themselves are not shipped.

Defined cases: a null text has no words and stays null; a null doc_id is
carried; texts shorter than WINDOW words keep all; a very long text is cut and
put together again, and gives what it would give whole; repeated rows are
repeats of each other and lose all words in windows; an empty table gives no
rows; other columns are carried, whatever their names, except that a column
named like one that remove_repeats adds gives way to it, and that working
columns start with two underscores.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, remember, stash
from .words import py_words

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Words that a segment knows before it: whole blocks, and a window less one at least.
LEAD = 2 * BLOCK
#: Bytes of a chunk, of one segment of a long text, and of text for each slice of the hash space.
CHUNK, SEGMENT, SLICE = 4 << 20, 1 << 20, 8 << 20
#: Most buckets that a table may have.
BUCKETS = 50_000
#: Words hashed at a time, and words whose hashes a worker remembers.
STEP, MEMO = 400_000, 400_000
ADDED = ("n_words", "n_removed", "kept_sha256")
_LOW = 32
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])

_memo: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    try:
        return np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(_memo) > MEMO:
            _memo.clear()
        for w in words:
            if w not in _memo:
                _memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
        return np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))


def _rolling(x: np.ndarray, k: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """Mixed polynomial hash of every k values in a row."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc *= base
        acc += x[j : j + n]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(29)
    return acc


class Batch:
    """Word hashes of some segments in a row: where each starts, which words are its own, and where they stand in their text."""

    def __init__(self, rows: list[tuple]) -> None:
        """rows: (text, words before it, words after it, place of the first of all these words in the whole text)."""
        self.words = [py_words(t) if not b and not a else [*py_words(b), *py_words(t), *py_words(a)] for t, b, a, _ in rows]
        self.sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(rows))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.lead = np.array([len(py_words(b)) if b else 0 for _, b, _, _ in rows], dtype=np.int64)
        self.tail = np.array([len(py_words(a)) if a else 0 for _, _, a, _ in rows], dtype=np.int64)
        parts = [_word_hashes(w) for w in self.words]
        self.x = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.inside = np.arange(len(self.x)) - np.repeat(self.starts, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.inside
        self.place = self.inside + np.repeat(np.array([r[3] for r in rows], dtype=np.int64), self.sizes)
        self.own = (self.inside >= np.repeat(self.lead, self.sizes)) & (self.left > np.repeat(self.tail, self.sizes))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows of k words inside one segment."""
        at = np.flatnonzero(self.left >= k)
        return at, _rolling(self.x, k)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def second(self, at: np.ndarray) -> np.ndarray:
        """The other hash of the windows of WINDOW words at some places."""
        return _rolling(self.x, WINDOW, _BASES[1])[at] if len(at) else np.zeros(0, dtype=np.uint64)


def _batches(rows: list[tuple]) -> Iterator[tuple[int, Batch]]:
    """Batches of about STEP words, each with the number of its first row."""
    first, size = 0, 0
    for i, row in enumerate(rows):
        size += len(row[0] or "") // 6
        if size >= STEP:
            yield first, Batch(rows[first : i + 1])
            first, size = i + 1, 0
    if first < len(rows):
        yield first, Batch(rows[first:])


_PARTS = ("text", "__before", "__after", "__base")


def _rows(docs: pa.Table | pa.RecordBatch) -> list[tuple]:
    return list(zip(*(docs.column(c).to_pylist() for c in _PARTS)))


def segments(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(own text, words before, words after, place of the first word) of the segments of a text, cut at blocks."""
    data = text.encode("utf-8", "surrogatepass")
    space = np.concatenate(([True], _SPACE[np.frombuffer(data, dtype=np.uint8)], [True]))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    n = len(starts)
    cuts = np.searchsorted(starts, np.arange(SEGMENT, len(data), SEGMENT))
    cuts = np.unique(-(-cuts // BLOCK) * BLOCK)
    cuts = [0, *cuts[(cuts > 0) & (cuts < n)].tolist(), n]
    cut = lambda a, b: data[a:b].decode("utf-8", "surrogatepass")
    for c, d in zip(cuts[:-1], cuts[1:]):
        base, after = max(0, c - LEAD), min(n, d + WINDOW - 1)
        own = cut(int(starts[c]) if c else 0, int(starts[d]) if d < n else len(data))
        yield own, cut(int(starts[base]), int(starts[c])) if c else "", cut(int(starts[d]), int(ends[after - 1])) if d < n else "", base


def _cut(text_at: int, row_at: int):
    """Documents as segments in chunks of about CHUNK bytes; other columns stay with a document's first segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = held = 0

        def numbered(sizes: list[int]) -> list[int]:
            nonlocal chunk, held
            out = []
            for s in sizes:
                if held and held + s > CHUNK:
                    chunk, held = chunk + 1, 0
                held += s + 64
                out.append(chunk)
            return out

        def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            """rows: (row of the batch, segment, own, before, after, base, many)."""
            first = pa.array([r[0] if r[1] == 0 else None for r in rows], type=pa.int64())
            cols = [c.take(first) for c in batch.columns]
            cols[text_at] = pa.array([r[2] for r in rows], type=pa.string())
            row = batch.column(row_at).take(pa.array([r[0] for r in rows], type=pa.int64()))
            cols[row_at] = row
            where = (row[0].as_py() >> 33) << 20 if len(row) else 0
            numbers = numbered([len(r[2] or "") for r in rows])
            more = [pa.array([r[k] for r in rows], type=t) for k, t in ((1, pa.int64()), (3, pa.string()), (4, pa.string()), (5, pa.int64()), (6, pa.bool_()))]
            return pa.RecordBatch.from_arrays([*cols, *more, pa.array([where + c for c in numbers], type=pa.int64())], names=[*batch.schema.names, *_EXTRA])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
            if sizes.max() <= SEGMENT:
                n = batch.num_rows
                where = (batch.column(row_at)[0].as_py() >> 33) << 20
                same = [pa.array(np.zeros(n, dtype=np.int64)), *[pa.array([""] * n)] * 2, pa.array(np.zeros(n, dtype=np.int64)), pa.array(np.zeros(n, dtype=bool))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *same, pa.array([where + c for c in numbered(sizes.tolist())], type=pa.int64())], names=[*batch.schema.names, *_EXTRA])
                continue
            rows, size = [], 0
            for i, text in enumerate(batch.column(text_at)):
                if sizes[i] <= SEGMENT:
                    rows.append((i, 0, text.as_py(), "", "", 0, False))
                    size += int(sizes[i])
                else:
                    for k, (own, before, after, base) in enumerate(segments(text.as_py())):
                        rows.append((i, k, own, before, after, base, True))
                        size += len(own)
                        if size > CHUNK:
                            yield made(batch, rows)
                            rows, size = [], 0
                if size > CHUNK:
                    yield made(batch, rows)
                    rows, size = [], 0
            if rows:
                yield made(batch, rows)

    return run


_EXTRA = ("__seg", "__before", "__after", "__base", "__many", "__chunk")


def _key(h: np.ndarray, slices: int) -> np.ndarray:
    """Slice number over the hash's low bits."""
    return ((h >> np.uint64(_LOW)) % np.uint64(slices)) << np.uint64(_LOW) | (h & np.uint64((1 << _LOW) - 1))


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as 32-bit differences where these fit."""
    if len(values) > 1:
        steps = np.diff(values)
        if int(steps.max()) < 1 << 32:
            return b"\x01" + values[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"\x00" + values.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\x00":
        return np.frombuffer(data, dtype=np.uint64, offset=1)
    steps = np.frombuffer(data, dtype=np.uint32, offset=9).astype(np.uint64)
    return np.concatenate((np.frombuffer(data, dtype=np.uint64, count=1, offset=1), steps)).cumsum(dtype=np.uint64)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among sorted known ones."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


_SENT = "slice long, __chunk long, data binary"
_BACK = "__chunk long, data binary"
_none = np.zeros(0, dtype=np.uint64)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else _none


def _send(chunk: int, slice_of: np.ndarray, pack) -> pa.RecordBatch:
    """One row for each slice; values are sorted by slice, and pack(a, b) gives the bytes of some of them."""
    cuts = np.flatnonzero(np.concatenate(([True], slice_of[1:] != slice_of[:-1]))) if len(slice_of) else np.zeros(0, dtype=np.int64)
    data = [pack(a, b) for a, b in zip(cuts, [*cuts[1:], len(slice_of)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(slice_of[cuts].astype(np.int64)), pa.array(np.full(len(cuts), chunk, dtype=np.int64)), pa.array(data, type=pa.binary())],
        names=["slice", "__chunk", "data"],
    )


def _probes(slices: int):
    """Each chunk's distinct probe hashes: bits inside their slice, then 'starts here', 'twice here' and 'a block here'."""

    def emit(chunk: int, rows: list[tuple]) -> pa.RecordBatch:
        every, blocks = [], []
        for _, b in _batches(rows):
            at, h = b.windows(BLOCK)
            k = _key(h, slices)
            blocks.append(k[b.place[at] % BLOCK == 0])
            own = b.own[at]
            every.append(k if own.all() else k[own])
        keys, counts = np.unique(_join(every), return_counts=True)
        asked = np.unique(_join(blocks))
        flags = (counts > 1).astype(np.uint64) << np.uint64(1) | np.uint64(4)
        beside = asked[~_in(asked, keys)]  # blocks of the segments next door
        if len(beside):
            keys, flags = np.concatenate((keys, beside)), np.concatenate((flags, np.zeros(len(beside), dtype=np.uint64)))
            order = np.argsort(keys, kind="stable")
            keys, flags = keys[order], flags[order]
        flags[np.searchsorted(keys, asked)] |= np.uint64(1)
        values = (keys & np.uint64((1 << _LOW) - 1)) << np.uint64(3) | flags
        return _send(chunk, keys >> np.uint64(_LOW), lambda a, b: _pack(values[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for chunk, row in zip(batch.column(0).to_pylist(), _rows(batch)):
                if chunk != now:
                    if rows:
                        yield emit(now, rows)
                    now, rows = chunk, []
                rows.append(row)
        if rows:
            yield emit(now, rows)

    return run


def _back(chunks: list[int], sizes: list[int], mine: np.ndarray, *values: np.ndarray) -> pa.Table:
    """The marked values, each chunk's own."""
    ends = np.cumsum(sizes)
    rows = [(c, b"".join(v[a:b][mine[a:b]].tobytes() for v in values)) for c, a, b in zip(chunks, [0, *ends[:-1]], ends)]
    rows = [r for r in rows if r[1]]
    return pa.table({"__chunk": pa.array([r[0] for r in rows], type=pa.int64()), "data": pa.array([r[1] for r in rows], type=pa.binary())})


def _hits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A slice's blocks that occur at two places at least, back to the chunks that hold them."""
    sent = [_unpack(d.as_py()) for d in table.column("data")]
    v = np.concatenate(sent)
    keys, place = np.unique(v >> np.uint64(3), return_inverse=True)
    starts = (v >> np.uint64(2) & np.uint64(1)) + (v >> np.uint64(1) & np.uint64(1))
    counts = np.bincount(place, weights=starts.astype(np.float64), minlength=len(keys))
    mine = (v & np.uint64(1)).astype(bool) & (counts[place] >= 2)
    return _back(table.column("__chunk").to_pylist(), list(map(len, sent)), mine, keys[place] | np.uint64(key[0].as_py()) << np.uint64(_LOW))


def _groups(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts pairs of hashes, number of each sorted pair's group)."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.concatenate(([False], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    return order, np.cumsum(new)


def _around(slices: int):
    """Distinct windows around a chunk's hit blocks: two hashes, and in how many places they start here, up to two."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        data = [np.frombuffer(d.as_py(), dtype=np.uint64) for d in back.column("data")]
        known, found, seconds, starts = np.unique(_join(data)), [], [], []
        chunk = docs.column("__chunk")[0].as_py() if docs.num_rows else 0
        for _, b in _batches(_rows(docs)) if len(known) else ():
            at, h = b.windows(BLOCK)
            block = b.place[at] % BLOCK == 0
            hit = at[block][_in(_key(h[block], slices), known)]
            edge = np.zeros(len(b.x) + 1, dtype=np.int64)
            np.add.at(edge, hit - np.minimum(b.inside[hit], WINDOW - BLOCK), 1)
            np.add.at(edge, hit + 1, -1)
            near = np.cumsum(edge[:-1]) > 0
            at, h = b.windows(WINDOW)
            some = near[at]
            found.append(h[some])
            seconds.append(b.second(at[some]))
            starts.append(b.own[at[some]])
        h, g, own = _join(found), _join(seconds), np.concatenate(starts) if starts else np.zeros(0, dtype=bool)
        order, group = _groups(h, g)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, dtype=np.int64)
        counts = np.minimum(np.bincount(group, weights=own[order], minlength=len(first)), 2).astype(np.uint8)
        h, g = h[order][first], g[order][first]
        slice_of = h % np.uint64(slices)
        order = np.argsort(slice_of, kind="stable")
        h, g, counts = h[order], g[order], counts[order]
        return pa.Table.from_batches([_send(chunk, slice_of[order], lambda a, b: h[a:b].tobytes() + g[a:b].tobytes() + counts[a:b].tobytes())])

    return run


def _repeats(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A slice's windows that start at two places at least, back to the chunks that hold them."""
    data = [d.as_py() for d in table.column("data")]
    sizes = [len(d) // 17 for d in data]
    h, g = (np.concatenate([np.frombuffer(d, dtype=np.uint64, count=n, offset=8 * n * k) for d, n in zip(data, sizes)]) for k in (0, 1))
    counts = np.concatenate([np.frombuffer(d, dtype=np.uint8, offset=16 * n) for d, n in zip(data, sizes)])
    order, group = _groups(h, g)
    mine = np.zeros(len(h), dtype=bool)
    mine[order] = np.bincount(group, weights=counts[order])[group] >= 2
    return _back(table.column("__chunk").to_pylist(), sizes, mine, h, g)


def _known(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of hashes that came back, sorted by the first."""
    data = [np.frombuffer(d.as_py(), dtype=np.uint64).reshape(2, -1) for d in back.column("data")]
    h, g = (_join([d[k] for d in data]) for k in (0, 1))
    order = np.argsort(h, kind="stable")
    return h[order], g[order]


def without(text: str, gone: np.ndarray) -> str:
    """A text without some of its words, each of which takes the white space after it along."""
    tokens = re.split("([ \x09-\x0d]+)", text)
    out, word = [], -1
    for i in range(0, len(tokens), 2):
        if tokens[i]:
            word += 1
            if gone[word]:
                continue
        out.append(tokens[i])
        out += tokens[i + 1 : i + 2]
    return "".join(out)


def _cover(names: list[str], long: bool):
    """A chunk's whole texts, or its segments of long ones, with the repeated words taken out: their digests, or of segments the kept words."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        docs = docs.filter(pc.equal(docs.column("__many"), long))
        first, second = _known(back)
        twins = set(first[1:][first[1:] == first[:-1]].tolist())  # one first hash of two windows
        rows = _rows(docs)
        texts = [r[0] for r in rows]
        n_words, n_removed, sums, kept = [], [], [], []
        for at0, b in _batches(rows):
            gone = np.zeros(len(b.x), dtype=bool)
            if len(first):
                at, h = b.windows(WINDOW)
                hit = _in(h, first)
                at, h = at[hit], h[hit]
                g = b.second(at)
                equal = second[np.searchsorted(first, h)] == g
                if twins:
                    pairs = set(zip(first.tolist(), second.tolist()))
                    equal = np.array([e or (x in twins and (x, y) in pairs) for e, x, y in zip(equal, h.tolist(), g.tolist())], dtype=bool)
                at = at[equal]
                edge = np.zeros(len(b.x) + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
            for i, (words, s, e, lead, tail) in enumerate(zip(b.words, b.starts, b.ends, b.lead, b.tail), at0):
                drop = gone[s + lead : e - tail]
                if lead or tail:
                    words = words[lead : len(words) - tail]
                removed = int(drop.sum())
                if removed:
                    texts[i] = without(texts[i], drop)
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                n_words.append(len(drop))
                n_removed.append(removed)
                left = " ".join(words)
                sums.append(None if long else hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
                kept.append(left if long else None)
        out = {c: docs.column(c) for c in (*names, "__row", "__seg")}
        out["text"] = pa.array(texts, type=pa.string())
        out |= {"__n_words": pa.array(n_words, type=pa.int64()), "__n_removed": pa.array(n_removed, type=pa.int64()), "__kept_sha256": pa.array(sums, type=pa.string()), "__kept": pa.array(kept, type=pa.string())}
        return pa.table(out)

    return run


def _removed(docs: DataFrame) -> DataFrame:
    """docs with the repeated words out of text, and __n_words, __n_removed and __kept_sha256."""
    spark = docs.sparkSession
    n, names = partitions(spark), docs.columns
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices, buckets = max(n, -(-int(size) // SLICE)), min(BUCKETS, max(n, -(-int(size) // CHUNK)))
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    cut = rows.mapInArrow(_cut(names.index("text"), len(names)), f"{fields}, __seg long, __before string, __after string, __base long, __many boolean, __chunk long")
    name = remember(spark, "table", f"chunks_{uuid.uuid4().hex}")
    cut.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "__chunk").sortBy("__chunk").saveAsTable(name)
    table = spark.table(name)

    texts = table.select("__chunk", *_PARTS)
    hits = texts.mapInArrow(_probes(slices), _SENT).groupBy("slice").applyInArrow(_hits, _BACK)
    near = texts.groupBy("__chunk").cogroup(hits.groupBy("__chunk")).applyInArrow(_around(slices), _SENT)
    repeats = stash(near.groupBy("slice").applyInArrow(_repeats, _BACK), "repeats")

    def covered(some: DataFrame, known: DataFrame, long: bool) -> DataFrame:
        done = some.groupBy("__chunk").cogroup(known.groupBy("__chunk"))
        return done.applyInArrow(_cover(names, long), f"{fields}, __seg long, __n_words long, __n_removed long, __kept_sha256 string, __kept string")

    whole = covered(table, repeats, False).select(*names, "__n_words", "__n_removed", "__kept_sha256")
    many = table.filter("__many")
    if many.isEmpty():
        return whole
    known = repeats.join(many.select(F.col("__chunk").alias("__c")).distinct(), F.col("__chunk") == F.col("__c"), "left_semi")
    # Segments of one long text meet again; a text is a row, so a task holds one at a time.
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("__seg", F.col(c).alias("x")))), lambda s: s["x"])
    own = [F.array_join(of("text"), "").alias("text") if c == "text" else F.max_by(c, -F.col("__seg")).alias(c) for c in names]
    kept = F.sha2(F.array_join(F.filter(of("__kept"), lambda s: s != ""), " "), 256)
    long = covered(many, known, True).groupBy("__row").agg(*own, F.sum("__n_words").alias("__n_words"), F.sum("__n_removed").alias("__n_removed"), kept.alias("__kept_sha256"))
    return whole.union(long.drop("__row"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words out of text, and n_words, n_removed and kept_sha256.

    The chunks are a table of the session's warehouse, named chunks_*, which
    scratch.scope() drops at its end; without a scope it stays.
    """
    carried = [c for c in docs.columns if c.lower() not in ADDED]
    return _removed(docs.select(*carried)).select(*carried, *(F.col(f"__{c}").alias(c) for c in ADDED))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", *ADDED)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated passages; documents that had words and keep none go."""
    out = _removed(docs).filter("__n_removed = 0 OR __n_removed < __n_words")
    length = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)
