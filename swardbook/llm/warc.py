"""WARC archives with an index that is made first and read by byte ranges.

A record is a gzip member of its own, as usual for .warc.gz, so that any record
can be read alone. Each task writes one file and returns a row of file, offset,
length, type, URL and digest for each of its records; these rows are the index.
A file counts only through the rows of the attempt that wrote it, so a task that
is lost and run again leaves at most a file that no index names. Payloads that
occur more than once are a response once, at the largest page_id, and revisits
elsewhere.

A read selects index rows, sorts them by file and offset, merges ranges that are
close, and opens each file once for a few long reads.

Defined cases: null html is the empty payload; a null url is written as
about:blank and any white space or control character in a URL is
percent-encoded; null page_ids are written without a number, are never the
response of others and count as larger than none; all rows with a payload's
largest page_id are responses, so repeated rows are; a very long page is one
record and one read; an empty table gives no rows; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_path, partitions, stash

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are all responses.
LEAST = 0
#: Ranges no further apart than this are read in one go, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20
INDEX = "file string, offset long, length long, type string, page_id long, refers_to long, url string, digest string"
#: Index rows returned at a time.
ROWS = 2000
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _store(path: str):
    """(file system, inner path) of a folder that is not local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path if path.startswith("/") else None


def open_input(path: str):
    """A seekable file of any store that pyarrow or the local system can open."""
    if local := _local(path):
        return open(local, "rb")
    store, inner = _store(path)
    return store.open_input_file(inner)


def open_output(path: str):
    if local := _local(path):
        return open(local, "wb")
    store, inner = _store(path)
    return store.open_output_stream(inner)


def record(kind: str, page_id: int | None, refers_to: int | None, url: str | None, payload: bytes, sha: str) -> bytes:
    """One WARC record with its end."""
    page = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe_url(url)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def safe_url(url: str | None) -> str:
    return "about:blank" if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def payload_of(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = data.partition(END)
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(END)[2]


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, rows = f"{path}/part-{uuid.uuid4().hex}.warc.gz", 0, []
        out = None
        for batch in batches:
            for page_id, url, html, head in zip(*(batch.column(i) for i in range(4))):
                page_id, url, head = page_id.as_py(), url.as_py(), head.as_py()
                data = (html.as_py() or "").encode("utf-8")
                sha = digest(data)
                kind = "revisit" if head is not None and page_id != head and len(data) >= LEAST else "response"
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(record(kind, page_id, head, url, data, sha)) + squeeze.flush()
                out = out or open_output(name)
                out.write(member)
                rows.append((name, at, len(member), kind, page_id, head if kind == "revisit" else None, safe_url(url), sha))
                at += len(member)
                if len(rows) == ROWS:
                    yield _rows(rows)
                    rows = []
        if out:
            out.close()
        if rows:
            yield _rows(rows)

    return run


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write one record for each page into a folder; returns the index, itself a table in the shared folder.

    Only digests are grouped. Pages move once, to meet the heads of their
    payload, and not at all while these are few enough for Spark to broadcast.
    """
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    heads = pages.select("page_id", sha.alias("__sha")).groupBy("__sha").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    heads = stash(heads.select("__sha", "head"), "heads")
    rows = pages.select("page_id", "url", "html", sha.alias("sha"))
    rows = rows.join(heads, F.col("sha") == F.col("__sha"), "left").select("page_id", "url", "html", "head")
    return stash(rows.mapInArrow(_writer(path), INDEX), "index")


def ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Merge sorted (offset, length) spans into reads (start, end, numbers of the spans inside)."""
    start = end = 0
    inside: list[int] = []
    for k, (at, length) in enumerate(spans):
        if inside and (at - end > GAP or at + length - start > READ):
            yield start, end, inside
            inside = []
        if not inside:
            start = at
        inside.append(k)
        end = at + length
    if inside:
        yield start, end, inside


def read(chosen: DataFrame, measure: bool = False) -> DataFrame:
    """The records of chosen index rows: (page_id, type, refers_to, noted, payload); noted is the header's digest.

    With measure, the payload's bytes and digest take its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            files, offsets, lengths, pages, refers = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < batch.num_rows:
                stop = at
                while stop < batch.num_rows and files[stop] == files[at]:
                    stop += 1
                if files[at] != name:
                    if file:
                        file.close()
                    name, file = files[at], open_input(files[at])
                for start, end, inside in ranges(list(zip(offsets[at:stop], lengths[at:stop]))):
                    file.seek(start)
                    data = file.read(end - start)
                    got = [at + k for k in inside]
                    found = [payload_of(zlib.decompress(data[offsets[k] - start : offsets[k] - start + lengths[k]], 31)) for k in got]
                    last = [pa.array([len(p) for _, p in found], type=pa.int64()), pa.array([digest(p) for _, p in found])] if measure else [pa.array([p for _, p in found], type=pa.binary())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([pages[k] for k in got], type=pa.int64()),
                            pa.array([h["WARC-Type"] for h, _ in found]),
                            pa.array([refers[k] for k in got], type=pa.int64()),
                            pa.array([h["WARC-Payload-Digest"].removeprefix("sha1:") for h, _ in found]),
                            *last,
                        ],
                        names=["page_id", "type", "refers_to", "noted", *(["bytes", "digest"] if measure else ["payload"])],
                    )
                at = stop
        if file:
            file.close()

    n = partitions(chosen.sparkSession)
    dealt = chosen.select("file", "offset", "length", "page_id", "refers_to").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, type string, refers_to long, noted string, " + ("bytes long, digest string" if measure else "payload binary"))


def resolve(index: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Read all records of an index, or chosen rows of it: their payload sizes and digests; a revisit has those of the response it refers to.

    Responses that chosen revisits refer to are read as well, wherever they are.
    A response is found by its page_id and payload digest, as one page_id may have several.
    """
    mine = index if chosen is None else chosen
    got = stash(read(mine, measure=True), "records")
    asked = mine.filter("type = 'revisit'").select(F.col("refers_to").alias("__r"), F.col("digest").alias("__n")).distinct()
    wanted = lambda df: df.filter("type = 'response' AND page_id IS NOT NULL").join(asked, (F.col("page_id") == F.col("__r")) & (F.col("digest") == F.col("__n")), "left_semi")
    heads = wanted(got)
    if chosen is not None:
        here = chosen.select(F.col("file").alias("__file"), F.col("offset").alias("__offset"))
        away = wanted(index).join(here, (F.col("file") == F.col("__file")) & (F.col("offset") == F.col("__offset")), "left_anti")
        heads = heads.union(read(away, measure=True))
    heads = stash(heads.select(F.col("page_id").alias("__head"), F.col("bytes").alias("__bytes"), F.col("digest").alias("__digest")).distinct(), "heads")
    own = got.filter("type = 'response'").select("page_id", "bytes", "digest", "type", "refers_to")
    seen = got.filter("type = 'revisit'").join(heads, (F.col("refers_to") == F.col("__head")) & (F.col("noted") == F.col("__digest")))
    seen = seen.select("page_id", F.col("__bytes").alias("bytes"), F.col("__digest").alias("digest"), "type", "refers_to")
    return own.union(seen).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def query(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    return resolve(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path))
