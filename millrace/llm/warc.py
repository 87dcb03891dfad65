"""WARC archives: written with revisits for repeated payloads, read back by boundary-chain verification.

Archives are real files in the shared folder, one gzip member for each record (or plain records). To read
them, tasks scan byte ranges, not knowing where records begin: each place that looks like a record is a
candidate, parsed as far as its end, which gives its successor's offset. Payloads may hold anything that
looks like a record, so a candidate counts only if the chain of successors from the start of its file
reaches it. Chains are followed inside each range by the range's own task; from range to range by pointer
jumping: each round joins jumps with jumps and doubles their reach, so that a file of n ranges takes
log2(n) rounds.

Defined cases: a null html is the empty payload; null or odd URLs are percent-encoded; a null page_id is
read back as null and is never referred to; equal payloads of less than ``least`` bytes are all responses; rows
that repeat page_id and payload of a response are responses too; an empty table gives no archive and an
empty result; a damaged or cut archive gives the records up to the damage.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import Workspace, batch_rows

#: Payload bytes from which equal payloads are revisits; bytes of an archive and of the ranges it is read in.
LEAST, ARCHIVE, RANGE = 100, 64 << 20, 2 << 20
VERSION, MAGIC = b"WARC/1.1", b"WARC/1."
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
DATE = "1970-01-01T00:00:00Z"
AHEAD = 1 << 20

FOUND = "path string, range long, offset long, successor long, exit long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"
_FOUND = pa.schema([("path", pa.string()), ("range", pa.int64()), ("offset", pa.int64()), ("successor", pa.int64()), ("exit", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def record(kind: str, page_id: int | None, url: str | None, html: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; revisits carry the HTTP head alone, with digest and length of the full payload in the record's head."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if kind == "revisit" else http + html
    lines = [f"WARC-Type: {kind}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    lines += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int] | None:
    """Head, start and end of the block of the record at a place; None if there is no whole record."""
    if not data.startswith(MAGIC, at):
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        head[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    a = stop + 4
    z = a + int(length)
    return (head, a, z) if data[z : z + 4] == b"\r\n\r\n" else None


class Reader:
    """A window of a file that grows as more bytes are asked for."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.size = file, start, file.size()
        self.data = file.read_at(max(0, min(end, self.size) - start), start)

    def more(self) -> bool:
        got = self.file.read_at(min(AHEAD, self.size - self.start - len(self.data)), self.start + len(self.data))
        self.data += got
        return bool(got)

    def plain(self, at: int) -> tuple[bytes, int] | None:
        """A plain record at a place of the window: its bytes and where the next begins."""
        while True:
            got = parse(self.data, at)
            if got:
                return self.data[at : got[2] + 4], got[2] + 4
            head = self.data.find(b"\r\n\r\n", at)
            length = next((x.partition(b":")[2].strip() for x in self.data[at : max(at, head)].lower().split(b"\r\n") if x.startswith(b"content-length:")), b"")
            if head >= 0 and (not length.isdigit() or len(self.data) >= head + 8 + int(length)) or head < 0 and len(self.data) - at > 64 << 10:
                return None
            if not self.more():
                return None

    def zipped(self, at: int) -> tuple[bytes, int] | None:
        """A gzip member at a place of the window that holds just one record."""
        z, out, pos = zlib.decompressobj(31), bytearray(), at
        try:
            while not z.eof:
                if pos >= len(self.data) and not self.more():
                    return None
                chunk = self.data[pos : pos + (64 << 10)]
                out += z.decompress(chunk)
                if not out.startswith(MAGIC[: len(out)]):
                    return None
                pos += len(chunk)
        except zlib.error:
            return None
        return bytes(out), pos - len(z.unused_data)


def scan(file, path: str, start: int, end: int) -> list[list]:
    """Candidate records that begin in a byte range, each with its successor and with where its chain leaves the range."""
    r = Reader(file, start, end + 3)  # a magic may straddle the end
    zipped = file.read_at(3, 0) == GZIP
    magic, rows, at = GZIP if zipped else MAGIC, [], -1
    limit = end - start
    while 0 <= (at := r.data.find(magic, at + 1)) < limit:
        got = r.zipped(at) if zipped else r.plain(at)
        head = parse(got[0]) if got else None
        if head is None or zipped and head[2] + 4 != len(got[0]):
            continue
        h, block = head[0], got[0][head[1] : head[2]]
        kind, refers = h.get("warc-type", ""), h.get("x-refers-to-page-id")
        payload = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else block
        if kind == "revisit":
            size, digest = int(h.get("x-payload-length", "0")), h.get("warc-payload-digest", "").partition(":")[2]
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        page = h.get("x-page-id")
        rows.append([path, start, start + at, start + got[1], None, kind, int(page) if page else None, h.get("warc-target-uri"), size, digest, int(refers) if refers else None])
    leaves: dict[int, int | None] = {}
    for row in reversed(rows):
        row[4] = leaves[row[2]] = leaves.get(row[3]) if row[3] < end else row[3] if row[3] < r.size else None
    return rows


def write(pages: DataFrame, ws: Workspace, least: int = LEAST, archive: int = ARCHIVE, zipped: bool = True) -> DataFrame:
    """Writes the archives and returns their manifest (path, bytes, records).

    Each attempt of a task writes files of its own; the manifest, which is written once, names those that count.
    """
    spark = pages.sparkSession
    batch_rows(spark, 500)
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    repeated = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(repeated, "digest", "left")
    refers = F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first"))
    rows = rows.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("refers_to"))
    folder = ws.path("archives")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count, done = None, "", 0, 0, []
        store, root = fs.FileSystem.from_uri(folder)

        def close() -> None:
            out.close()
            done.append((path, size, count))

        for b in batches:
            for page_id, url, body, digest, n, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or size > archive:
                    if out is not None:
                        close()
                    path = f"{uuid.uuid4().hex}.warc{'.gz' if zipped else ''}"
                    out, size, count = store.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                data = record("response" if refers_to is None else "revisit", page_id, url, body or b"", digest, n, refers_to)
                data = member(data) if zipped else data
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    manifest = rows.mapInArrow(run, "path string, bytes long, records long").select(F.concat(F.lit(folder + "/"), "path").alias("path"), "bytes", "records")
    return ws.save(manifest, "manifest")


def candidates(archives: DataFrame, ws: Workspace, span: int = RANGE) -> DataFrame:
    """Candidate records of archives (path, bytes), found range by range."""
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(span).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + span, "bytes").alias("end"))
    n = max(1, min(100_000, ranges.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, own = fs.FileSystem.from_uri(path)
                with store.open_input_file(own) as file:
                    rows = scan(file, path, start, end)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

    return ws.save(ranges.repartition(n).mapInArrow(run, FOUND), "candidates")


def reachable(found: DataFrame, ws: Workspace, span: int = RANGE) -> DataFrame:
    """The candidates that the chain of successors reaches from offset 0 of their file.

    Jumps lead from a candidate to where its chain leaves its range. Reached entries and jumps double
    their reach each round; then each range, bounded by its bytes, is walked from its entry.
    """
    farthest = found.agg(F.max("offset")).first()[0] or 0
    found = found.withColumn("file", F.xxhash64("path"))  # short rows for what is joined again and again
    jumps = ws.save(found.where("exit is not null").select("file", F.col("offset").alias("a"), F.col("exit").alias("b")), "jumps0")
    entries = ws.save(found.where("offset = 0").select("file", F.col("offset").alias("a")), "entries0")
    rounds = math.ceil(math.log2(farthest // span + 2))
    for k in range(1, rounds + 1):
        further = entries.join(jumps, ["file", "a"]).select("file", F.col("b").alias("a"))
        entries = ws.save(entries.union(further).distinct(), f"entries{k}")
        if k < rounds:
            then = ws.read(f"jumps{k - 1}", jumps).select("file", F.col("a").alias("b"), F.col("b").alias("c"))
            jumps = ws.save(jumps.join(then, ["file", "b"]).select("file", "a", F.col("c").alias("b")), f"jumps{k}")
    entries = entries.select("file", (F.col("a") - F.col("a") % span).alias("range"), F.col("a").alias("entry"))

    def walk(table: pa.Table) -> pa.Table:
        place = {o: i for i, o in enumerate(table.column("offset").to_pylist())}
        following, keep = table.column("successor").to_pylist(), []
        at = table.column("entry")[0].as_py()
        while at in place:
            keep.append(place[at])
            at = following[place[at]]
        return table.take(pa.array(keep, pa.int64())).select(_FOUND.names)

    return found.join(entries, ["file", "range"]).groupBy("file", "range").applyInArrow(walk, FOUND)


def read(archives: DataFrame, ws: Workspace, span: int = RANGE) -> DataFrame:
    """The records of the archives, verified."""
    return reachable(candidates(archives, ws, span), ws, span)


def op2(spark: SparkSession, pages: DataFrame) -> DataFrame:
    ws = Workspace(spark)
    return read(write(pages, ws), ws).selectExpr("page_id", "payload_bytes", "payload_digest", "kind record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
