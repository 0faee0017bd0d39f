"""WARC archives with a two-level capture index.

Tasks write archives of gzip members, one per record, to the shared folder and return where each
record lies; what they return, not what lies in the folder, says which archives count, so a
repeated task leaves at most files that nobody refers to. Captures are sorted by their reversed-
host URL key into compressed blocks; a sparse directory holds the first and last key of each
block. A look-up searches the directory, reads the range of one block, searches it, and reads the
ranges of the records. The directory is bounded by construction: blocks grow before it does.

Archives and blocks are read and written with pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm.common import shared_folder
from alertlake.session import written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 50_000
BLOCK_LINES = 3000
MAX_BLOCKS = 100_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id bigint, archive string, offset bigint, length bigint"
RECORD = "key string, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _line(text: str) -> str:
    """A header value without control characters or blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def surt_key(url: str | None) -> str:
    """Host parts in reverse, then path and query; the scheme, www-less or not, does not count.

    Blanks and control characters are escaped, so a key is sorted, stored and looked up as one text.
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return _line((url or "").lower())
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return _line(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP header of the payload only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    return packed.compress(text) + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found.group(1)) if found else None


def parse_record(member: bytes) -> dict:
    """The fields of a record; the payload of a response must match its digest and length."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, kind = int(_headers(http)["content-length"]), warc["warc-type"]
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of {warc.get('warc-record-id')}")
    return {
        "page_id": _page(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"),
        "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _page(warc.get("warc-refers-to")),
    }


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, which may be given as path or as URI."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root))


class _Output:
    """A file of parts; add() gives the offset of each."""

    def __init__(self, root: str, suffix: str):
        self.store, path = _store(root)
        self.store.create_dir(path, recursive=True)
        self.name, self.size = f"{uuid.uuid4().hex}{suffix}", 0
        self.stream = self.store.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data)


class _Input:
    """Ranges of files below a folder; the last file stays open."""

    def __init__(self, root: str):
        self.store, self.path = _store(root)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.store.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, offset)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_BLOCK = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])
_RECORD = pa.schema([
    ("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def with_revisits(pages: DataFrame, url: str = "url", payload: str = "html", id: str = "page_id") -> DataFrame:
    """(page_id, url, payload, refers_to, is_revisit): equal payloads of 1000 bytes or more are
    stored once, for the largest id.

    Verdicts are found on ids and digests alone; whole payloads move once, dealt out by id.
    """
    c = F.col
    body = F.encode(F.coalesce(c(f"`{payload}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(c(f"`{id}`").cast("bigint").alias("page_id"), c(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    marked = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    narrow = marked.filter(c("size") >= REVISIT_BYTES).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter((c("n") > 1) & c("refers_to").isNotNull())
    again = narrow.join(groups, "digest").filter(c("page_id").isNull() | (c("page_id") < c("refers_to")))
    again = written(again.select(c("page_id").alias("page"), c("digest").alias("same"), "refers_to").distinct(), "revisits")
    met = marked.join(again, c("page_id").eqNullSafe(c("page")) & (c("digest") == c("same")), "left")
    return met.select("page_id", "url", "payload", "refers_to", c("refers_to").isNotNull().alias("is_revisit"))


def write_archives(records: DataFrame, root: str) -> DataFrame:
    """Writes every record below `root` and returns where it lies, written as a table."""
    def run(batches):
        out, rows = None, []
        for batch in batches:
            names = ("page_id", "url", "payload", "refers_to", "is_revisit")
            for page, url, payload, refers_to, is_revisit in zip(*[batch.column(n) for n in names]):
                page, url = page.as_py(), url.as_py()
                member = record(page, url, payload.as_py(), refers_to.as_py(), is_revisit.as_py())
                out = out or _Output(root, ".warc.gz")
                rows.append((surt_key(url), page, out.name, out.add(member), len(member)))
                if out.size >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    out.stream.close()
                    yield _batch(rows, _ENTRY)
                    out, rows = None, []
        if out is not None:
            out.stream.close()
            yield _batch(rows, _ENTRY)

    return written(records.mapInArrow(run, ENTRY), "captures")


@dataclass
class Index:
    """`directory` has at most MAX_BLOCKS rows, one per block; `root` holds archives and blocks."""

    root: str
    directory: DataFrame


def build_index(entries: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sorts captures by key into blocks of tab-separated lines.

    Ties of a key are told apart by archive and offset, so a page captured millions of times
    fills many blocks in many tasks.
    """
    lines = max(block_lines, -(-entries.count() // MAX_BLOCKS))

    def run(batches):
        out, rows, held = None, [], []

        def flush():
            nonlocal out, held
            out = out or _Output(root, ".blocks")
            text = "\n".join("\t".join(("" if x is None else str(x)) for x in row) for row in held)
            packed = zlib.compress(text.encode("utf-8", "surrogatepass"))
            rows.append((held[0][0], held[-1][0], out.name, out.add(packed), len(packed), len(held)))
            held = []

        for batch in batches:
            for key, *rest in zip(*[batch.column(n).to_pylist() for n in _ENTRY.names]):
                held.append((key, *rest))
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.stream.close()
            yield _batch(rows, _BLOCK)

    order = ["key", "archive", "offset"]
    dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(run, "first_key string, last_key string, file string, offset bigint, length bigint, n bigint")
    return Index(root, written(blocks, "capture-directory"))


def _block_lines(data: bytes) -> list[tuple]:
    """Entries of a block in order of their key."""
    out = []
    for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n"):
        key, page, archive, offset, length = line.split("\t")
        out.append((key, int(page) if page else None, archive, int(offset), int(length)))
    return out


def lookup(index: Index, keys: DataFrame, key: str = "key") -> DataFrame:
    """The captures (see ENTRY) of every distinct key; null keys have none.

    Sorted by code point, as Spark sorts, first and last keys are searched by bisection. A key that
    spans several blocks is looked up in each of them by another task.
    """
    spark, root = keys.sparkSession, index.root
    sparse = sorted((tuple(r) for r in index.directory.select(*_BLOCK.names).collect()), key=lambda r: (r[0].encode("utf-8", "surrogatepass"), r[1].encode("utf-8", "surrogatepass")))
    shared = spark.sparkContext.broadcast(sparse)
    order = lambda text: text.encode("utf-8", "surrogatepass")

    def blocks_of(batches):
        firsts, lasts = [order(r[0]) for r in shared.value], [order(r[1]) for r in shared.value]
        for batch in batches:
            found = [], []
            for at in batch.column("key").to_pylist():
                for block in range(bisect_left(lasts, order(at)), bisect_right(firsts, order(at))):
                    found[0].append(block)
                    found[1].append(at)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string())], ["block", "key"])

    def entries_of(batches):
        source, now, lines, at = _Input(root), None, [], []
        for batch in batches:
            rows = []
            for block, wanted in zip(batch.column("block").to_pylist(), batch.column("key").to_pylist()):
                if block != now:
                    lines = _block_lines(source.read(*shared.value[block][2:5]))
                    now, at = block, [order(line[0]) for line in lines]
                rows += lines[bisect_left(at, order(wanted)):bisect_right(at, order(wanted))]
            yield _batch(rows, _ENTRY)

    def escaped(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_line(k) for k in batch.column("key").to_pylist()], pa.string())], ["key"])

    given = keys.select(F.col(f"`{key}`").cast("string").alias("key")).filter("key is not null")
    wanted = given.mapInArrow(escaped, "key string").distinct()
    hits = wanted.mapInArrow(blocks_of, "block bigint, key string").repartition("block").sortWithinPartitions("block", "key")
    return hits.mapInArrow(entries_of, ENTRY)


def read_records(entries: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """The records (see RECORD) at the given places, read by ranges, file by file."""
    def run(batches):
        source = _Input(root)
        for batch in batches:
            rows, size = [], 0
            for key, archive, offset, length in zip(*[batch.column(n).to_pylist() for n in ("key", "archive", "offset", "length")]):
                found = parse_record(source.read(archive, offset, length))
                if not with_payload:
                    found["payload"] = None
                rows.append(tuple({"key": key, **found}[n] for n in _RECORD.names))
                size += len(found["payload"] or b"")
                if size > ARCHIVE_BYTES // 4:
                    yield _batch(rows, _RECORD)
                    rows, size = [], 0
            yield _batch(rows, _RECORD)

    dealt = entries.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, RECORD)


def url_keys(pages: DataFrame, url: str = "url") -> DataFrame:
    """(key) of every page."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt_key(u) for u in batch.column("url").to_pylist()], pa.string())], ["key"])

    return pages.select(F.col(f"`{url}`").cast("string").alias("url")).mapInArrow(run, "key string")


def archive_pages(pages: DataFrame, root: str | None = None, **columns: str) -> Index:
    """Writes the archives of all pages and their index below one folder.

    Null payloads are empty, null URLs have an empty key. Rows that repeat an id and a payload are
    one capture each, all of them responses if the payload is stored for that id. An empty table
    gives an empty index. Other columns are not stored.
    """
    root = root or shared_folder(pages.sparkSession, "warc")
    entries = write_archives(with_revisits(pages, **columns), root)
    return build_index(entries, root)


def archived(spark: SparkSession, pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Pages written to archives and read back through the index, by the keys of their URLs."""
    index = archive_pages(pages)
    found = lookup(index, url_keys(pages))
    return read_records(found, index.root, with_payload)


def digest_columns() -> list[Column]:
    return [F.col(n) for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
