"""WARC archives with a two-level capture index.

write_archives() writes one gzip member for each record, at most RECORDS to a file, and returns their
manifest; read_archives() reads files back record by record. Of records with equal payloads of LEAST
bytes or more, the one with the smallest id is a response, the others revisit it (rows that repeat the
smallest id are all responses).

build_index() sorts lines of (reversed-host URL key, id, file, offset, length) into compressed blocks
of LINES, and keeps a sparse directory: each block's first key, place and size. lookup() sends sorted
keys to the index's parts, binary-searches the directory, reads the blocks by range and then the
records by range.

Files lie in the shared folder and are opened through pyarrow's file systems, so any store with a URI
will do. A file's name is new in every attempt of a task and only the manifest of finished attempts
counts, so lost executors leave files that nothing refers to.

Defined results: null payload is empty; null URL has the key and target `-`; null ids are written as
such and never the response of others; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import new_path, partitions, persisted

LEAST = 100
RECORDS = 20_000
LINES = 300
DATE = "1970-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, port unless it is the scheme's own, then path and query: com,example)/a?b."""
    if not url:
        return "-"
    try:
        p = urlsplit(url.strip())
        host, port = p.hostname or "", p.port
    except ValueError:
        return re.sub(r"\s", "%20", url.strip()) or "-"
    host = ",".join(reversed(host.split(".")))
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(p.scheme) else ""
    key = f"{host}{port}){p.path or '/'}" + (f"?{p.query}" if p.query else "")
    return re.sub(r"[\s]", "%20", key)


def record(row: dict) -> bytes:
    """Header lines, a blank line, the block (empty for revisits) and two line ends."""
    payload = row["payload"] or b""
    revisit = row["refers_to"] is not None
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', row['url'] or '-')}", f"WARC-Payload-Digest: sha256:{row['digest']}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record, its payload checked against its digest where it is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(h["Content-Length"])]
    number = lambda x: None if x in ("None", None) else int(x)
    urn = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(h["WARC-Payload-Length"])):
        raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": number(urn(h["WARC-Record-ID"])), "payload_bytes": int(h["WARC-Payload-Length"]), "payload_digest": digest, "record_type": kind,
        "refers_to": number(urn(h.get("WARC-Refers-To"))), "url_key": url_key(h["WARC-Target-URI"] if h["WARC-Target-URI"] != "-" else None),
    }


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def squeeze(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_references(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, payload, digest, refers_to. Only digests that occur
    twice take part in the join; ids, not payloads, are summed."""
    x = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    twice = x.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return x.join(twice.select("digest", "first"), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("first") != F.coalesce("page_id", F.lit(-1)), F.col("first")).alias("refers_to")
    )


MANIFEST = "file string, records long, bytes long"


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes archives below path and returns their manifest, itself written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, out, name, n, size = *_open(path), "", 0, 0
        base, sink, done = out, None, []
        for b in batches:
            for row in b.to_pylist():
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, n, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = squeeze(record(row))
                sink.write(data)
                n, size = n + 1, size + len(data)
                if n >= RECORDS:
                    sink.close()
                    done.append((name, n, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, n, size))
        for x in done:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    system, base = _open(path)
    system.create_dir(base, recursive=True)
    return persisted(with_references(pages).mapInArrow(run, MANIFEST), "manifest")


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, file string, offset long, length long"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())


def records(stream, step: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream, a step of bytes at a time."""
    held, at = b"", 0
    while True:
        if not held and not (held := stream.read(step)):
            return
        z, start, out = zlib.decompressobj(31), at, []
        while True:
            out.append(z.decompress(held))
            if z.eof:
                at += len(held) - len(z.unused_data)
                held = z.unused_data
                break
            at += len(held)
            if not (held := stream.read(step)):
                raise ValueError("an archive ends within a record")
        yield start, at - start, b"".join(out)


def read_archives(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Every record of the archives: fields, key, and where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(path)
        for b in batches:
            for name, want in zip(b.column("file").to_pylist(), b.column("records").to_pylist()):
                rows, n = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, length, data in records(stream):
                        rows.append((*parse(data).values(), name, offset, length))
                        n += 1
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                if n != want:
                    raise ValueError(f"{name} has {n} records, its manifest {want}")
                if rows:
                    yield _batch(rows)

    files = manifest.repartition(partitions(spark), "file")
    return files.mapInArrow(run, CAPTURE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=[x.split()[0] for x in CAPTURE.split(", ")])


#: A block's first and last line (key and id), and where it lies.
DIRECTORY = "part string, first string, first_page long, last string, last_page long, offset long, length long, lines long"
DIRECTORY_NAMES = [x.split()[0] for x in DIRECTORY.split(", ")]
#: Stands for a null id, which sorts before all others.
NO_PAGE = -(2**63)


def _page():
    return F.coalesce(F.col("page_id"), F.lit(NO_PAGE))


def build_index(captures: DataFrame, path: str, lines: int = LINES) -> DataFrame:
    """Writes sorted, compressed blocks of capture lines and returns their directory, which is written
    to the shared folder: one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(path)
        name, sink, at, held, rows = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush() -> None:
            nonlocal sink, at
            if sink is None:
                sink = system.open_output_stream(f"{base}/{name}", compression=None)
            data = squeeze("\n".join(" ".join(map(str, x)) for x in held).encode())
            sink.write(data)
            rows.append((name, *held[0][:2], *held[-1][:2], at, len(data), len(held)))
            at += len(data)
            held.clear()

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length"))):
                held.append(x)
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if sink is not None:
            sink.close()
            kinds = [pa.string() if " string" in x else pa.int64() for x in DIRECTORY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=DIRECTORY_NAMES)

    system, base = _open(path)
    system.create_dir(base, recursive=True)
    ordered = captures.select("url_key", _page().alias("page_id"), "file", "offset", "length").repartitionByRange(partitions(captures.sparkSession), "url_key", "page_id")
    return persisted(ordered.sortWithinPartitions("url_key", "page_id").mapInArrow(run, DIRECTORY), "directory")


class Index:
    """The directory of some index parts, read once, and the last block that was opened."""

    def __init__(self, path: str, rows: list[tuple]):
        self.system, self.base = _open(path)
        self.rows = sorted(rows, key=lambda r: r[1:5])
        self.first, self.last = [r[1:3] for r in self.rows], [r[3:5] for r in self.rows]
        self.block: tuple[int, list[tuple]] = (-1, [])
        self.reads = 0

    def captures(self, key: str, page: int) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the lines of a key and id, from the blocks that may hold them."""
        out, want = [], (key, page)
        for i in range(bisect_left(self.last, want), bisect_right(self.first, want)):
            if self.block[0] != i:
                part, offset, length = self.rows[i][0], *self.rows[i][5:7]
                with self.system.open_input_file(f"{self.base}/{part}") as f:
                    data = f.read_at(length, offset)
                lines = [x.split(" ") for x in zlib.decompress(data, 31).decode().split("\n")]
                self.block, self.reads = (i, [(k, int(p), f, int(o), int(n)) for k, p, f, o, n in lines]), self.reads + 1
            lines = self.block[1]
            at = bisect_left(lines, want)
            while at < len(lines) and lines[at][:2] == want:
                out.append(lines[at][2:])
                at += 1
        return out


def lookup(keys: DataFrame, directory: DataFrame, index_path: str, archive_path: str | None = None) -> DataFrame:
    """keys (url_key, page_id) -> a row for each capture that the index has of a key and id, where it lies and,
    with archive_path, the digest of the record found there; nulls where it has none. Keys and directory
    rows meet by ranges of lines that the directory itself gives: a sample of its first lines cuts them, a
    block that spans a cut goes to both sides, and one key with many ids is cut as well."""
    spark = keys.sparkSession
    n = partitions(spark)
    cuts = _cuts(directory, n)
    line = lambda k, p: F.struct(k.alias("k"), p.alias("p"))
    none = F.expr("cast(array() as array<struct<k:string,p:bigint>>)")
    edges = F.array(*[line(F.lit(k), F.lit(p).cast("long")) for k, p in cuts]) if cuts else none
    place = lambda x: F.size(F.filter(edges, lambda e: e <= x))
    first, last = (line(F.col(c), F.col(f"{c}_page")) for c in ("first", "last"))
    blocks = directory.withColumn("bin", F.explode(F.sequence(place(first), place(last))))
    asked = keys.select("url_key", _page().alias("page_id")).withColumn("bin", place(line(F.col("url_key"), F.col("page_id"))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        index = Index(index_path, list(zip(*(right[c].to_pylist() for c in DIRECTORY_NAMES))))
        system, base = _open(archive_path) if archive_path else (None, None)
        found, files = [], {}
        for k, p in sorted(set(zip(left["url_key"].to_pylist(), left["page_id"].to_pylist()))):
            hits = index.captures(k, p)
            for name, offset, length in hits:
                digest = None
                if archive_path:
                    if name not in files:
                        if len(files) > 64:
                            for x in files.values():
                                x.close()
                            files.clear()
                        files[name] = system.open_input_file(f"{base}/{name}")
                    digest = parse(zlib.decompress(files[name].read_at(length, offset), 31))["payload_digest"]
                found.append((k, p, name, offset, length, digest))
            if not hits:
                found.append((k, p, None, None, None, None))
        for x in files.values():
            x.close()
        names = ["url_key", "page_id", "file", "offset", "length", "found_digest"]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 6, kinds)], names=names)

    # a given number of partitions is kept: what a key asks for is far larger than the key
    dealt = lambda x: x.repartition(n, "bin").groupBy("bin")
    x = dealt(asked).cogroup(dealt(blocks)).applyInArrow(run, "url_key string, page_id long, file string, offset long, length long, found_digest string")
    return x.withColumn("page_id", F.when(F.col("page_id") != NO_PAGE, F.col("page_id")))


def _cuts(directory: DataFrame, n: int) -> list[tuple[str, int]]:
    """At most n - 1 lines that cut the blocks evenly: quantiles over a hash of bounded size of their first lines."""
    rows = directory.select("first", "first_page").distinct().orderBy(F.xxhash64("first", "first_page")).limit(50 * n).collect()
    lines = sorted((r["first"], r["first_page"]) for r in rows)
    return sorted({lines[len(lines) * i // n] for i in range(1, n)}) if lines else []


def archive(pages: DataFrame) -> DataFrame:
    """The contract's query: writes the archives, reads them back, indexes the captures and finds each by its key."""
    spark = pages.sparkSession
    path, index = new_path(spark, "warc"), new_path(spark, "cdx")
    manifest = write_archives(pages, path)
    captures = persisted(read_archives(spark, path, manifest), "captures")
    directory = build_index(captures, index)
    found = lookup(captures, directory, index, path).select("file", "offset", "found_digest", F.col("url_key").alias("found_key"))
    return captures.join(found, ["file", "offset"], "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key",
        F.coalesce((F.col("found_digest") == F.col("payload_digest")) & (F.col("found_key") == F.col("url_key")), F.lit(False)).alias("in_index"),
    )
