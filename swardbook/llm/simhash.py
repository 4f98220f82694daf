"""SimHash near-duplicates by the pigeonring principle.

A fingerprint is a ring of SEGMENTS segments. If two fingerprints differ in at
most MAX_BITS bits, some segment starts a chain in which, for every length l,
the first l segments differ in at most floor(l * MAX_BITS / SEGMENTS) bits. With
8 segments and 3 bits the budgets are 0 0 1 1 1 2 2 3: a chain starts with two
equal segments and has at most one bit among the next three, so at least two of
these are equal too. Every start and choice of two gives one index key of four
equal segments (32 bits, 24 keys), which is the exact part of the chain test;
candidates that share a key pass the whole chain before the full distance.

Work is on distinct fingerprints, so a group of exact copies is one row. A key
with more than BLOCK fingerprints is split into blocks, and pairs of blocks are
compared in separate tasks. A large block gives a spanning forest of its links
(at most one edge for each fingerprint), a small one its links, each from the
first key that shows it; no task emits all pairs of a group.

A key that n fingerprints share costs n * n / 2 comparisons, dealt in blocks: the
32 bits of a key are shared by near copies and by chance, not by a share of the
corpus, as equal fingerprints are one row.

Defined cases: a null or blank text has fingerprint zero and links like any
other; a very long text is hashed whole, a part at a time; a null doc_id is carried with a null component and links nothing; rows
with one doc_id are one node if their fingerprints link, and otherwise each
keeps its own component; an empty table gives no rows; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pair_blocks, split_keys, stream_blocks
from .graph import components
from .scratch import stash
from .words import SPACES

MAX_BITS = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: floor(l * MAX_BITS / SEGMENTS) for chain lengths l = 1..SEGMENTS.
BUDGETS = tuple(n * MAX_BITS // SEGMENTS for n in range(1, SEGMENTS + 1))
#: Segments, counted from the chain's start, that one index key holds.
CHOICES = tuple((0, 1, *c) for c in combinations((2, 3, 4), 2))
#: Rows of a key in one part; a block holds two parts.
BLOCK = 1024
SHINGLE = 3
#: Blocks up to this size give each link once; larger ones give a spanning forest.
SMALL = 48
_STEP = 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = bytes(32 if chr(b) in SPACES else b for b in range(256))
_TABLE = _LOWER.translate(_BLANK)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 hashes of a text's word shingles."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest, counts = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    a, b = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, _STEP):
        raw = b"".join([digest(joined[i:j], 42) for i, j in zip(a[at : at + _STEP], b[at : at + _STEP])])
        counts += _bit_counts(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8))
    bits = counts * 2 > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """Ones in each of the 64 bit places of big-endian hashes: byte histograms times the bytes' bits."""
    n = len(rows)
    if n < 2000:
        return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    place = rows.astype(np.int64) + np.arange(8) * 256
    found = np.bincount(place.ravel(), minlength=2048).reshape(8, 256)
    return (found @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(x.as_py()) for x in batch.column(1)]
        signed = np.array(values, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])


def _chain(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Does the chain that starts at the given segment keep every budget short of the full distance?"""
    parts = np.bitwise_count(diff.view(np.uint8).reshape(-1, SEGMENTS))
    ring = (np.arange(SEGMENTS - 1)[None, :] + start[:, None]) % SEGMENTS
    sums = np.take_along_axis(parts, ring, axis=1).cumsum(axis=1)
    return (sums <= np.array(BUDGETS[:-1])).all(axis=1)


def _links(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    diff = a ^ b
    ok = _chain(diff, start)
    ok[ok] = np.bitwise_count(diff[ok]) <= MAX_BITS
    return ok


def _first_key(diff: np.ndarray) -> np.ndarray:
    """The least index key (start, choice) whose four segments are equal and whose chain keeps its budgets."""
    same = diff.view(np.uint8).reshape(-1, SEGMENTS) == 0
    first = np.full(len(diff), 255)
    for start in reversed(range(SEGMENTS)):
        chained = _chain(diff, np.full(len(diff), start))
        for c in reversed(range(len(CHOICES))):
            first[same[:, [(start + k) % SEGMENTS for k in CHOICES[c]]].all(axis=1) & chained] = start * len(CHOICES) + c
    return first


def _compare(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of whole blocks, as (u, v) of representatives."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    rep, slot, part = (table.column(c).to_numpy() for c in ("rep", "slot", "__part"))
    parts = table.column("__parts").to_numpy()
    ends = np.append(starts[1:], len(fp))
    size = ends - starts
    out: list[tuple[np.ndarray, np.ndarray]] = []
    group = np.repeat(np.arange(len(starts)), size)
    small = (size <= SMALL)[group] & (parts == 1)
    index = np.flatnonzero(small)
    for shift in range(1, SMALL):
        left = index[index + shift < len(fp)]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            break
        ok = _links(fp[left], fp[left + shift], slot[left] // len(CHOICES))
        left = left[ok]
        left = left[_first_key(fp[left] ^ fp[left + shift]) == slot[left]]
        out.append((rep[left], rep[left + shift]))
    for s, e in zip(starts[(size > SMALL) | (parts[starts] > 1)], ends[(size > SMALL) | (parts[starts] > 1)]):
        out.append(_forest(fp[s:e], rep[s:e], part[s:e], int(slot[s]) // len(CHOICES)))
    if out:
        u, v = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _forest(fp: np.ndarray, rep: np.ndarray, part: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least linked representative, breadth first, so that a block gives fewer edges than rows."""
    todo = np.ones(len(fp), dtype=bool)
    us, vs = [], []
    for seed in np.argsort(rep, kind="stable"):
        if not todo[seed]:
            continue
        todo[seed] = False
        front = [seed]
        while front and todo.any():
            x = front.pop()
            rest = np.flatnonzero(todo)
            near = rest[_links(np.broadcast_to(fp[x], rest.shape).copy(), fp[rest], np.full(len(rest), start))]
            todo[near] = False
            front.extend(near.tolist())
            us.append(np.full(len(near), rep[seed]))
            vs.append(rep[near])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def index_keys(fps: DataFrame) -> DataFrame:
    """Add (slot, key) rows: each start and choice, and its four segments as one 32-bit number."""
    segment = lambda k: F.shiftrightunsigned("fp", WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit(255))
    rows = []
    for start in range(SEGMENTS):
        for c, choice in enumerate(CHOICES):
            key = F.lit(0).cast("long")
            for k in choice:
                key = key * 256 + segment(start + k)
            rows.append(F.struct(F.lit(start * len(CHOICES) + c).alias("slot"), key.alias("key")))
    return fps.select("*", F.explode(F.array(*rows)).alias("k")).select("rep", "fp", "k.slot", "k.key")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for documents with doc_id and text."""
    fps = stash(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fps")
    reps = stash(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    keyed = split_keys(index_keys(reps), ["slot", "key"], "rep", BLOCK)
    blocks = pair_blocks(keyed).select("slot", "key", "__block", "rep", "fp", "__part", "__parts")
    links = stash(stream_blocks(blocks, ["slot", "key", "__block"], _compare, "u long, v long").filter("u <> v").distinct(), "links")
    found = components(links, "u", "v")
    named = reps.join(found, reps["rep"] == found["node"], "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    named = stash(named, "named")
    out = fps.join(named, (fps["fp"] == named["__fp"]) & fps["doc_id"].isNotNull(), "left")
    return out.select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component, that with the least doc_id; those without an id stay."""
    found = stash(classes(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct(), "first")
    # Ids kept grow with the corpus, so small corpora join as large ones do.
    return docs.join(found.hint("merge"), docs["doc_id"] == found["__id"], "left_semi").union(docs.filter("doc_id IS NULL"))
