"""WARC archives: writing with segments and revisits, reading back, reassembly.

Writing: each page's HTTP response, in chunked transfer framing, becomes a WARC
record; a block of over ``segment_bytes`` is cut to a first record and
continuation records. A payload that another page holds too becomes a revisit
that refers to that page's record. Each record is a gzip member of its own, so
any of them can be read from its offset. Rows of about ``ROW_BYTES`` of members
go through Spark's text writer to archives of at most ``ARCHIVE_ROWS`` rows on
any file system that Spark writes to; a lost task leaves no half-written file.

Reading: Spark's text reader unpacks an archive as a stream and hands it on in
pieces, cut where a record seems to begin; records are parsed by content length
from those pieces, so a payload may hold anything, and a task holds a record at
a time. Continuation records are grouped by the identifier of the record that
they continue, ordered by segment number, and checked against the total length;
then chunked transfer framing is decoded. Only segmented records are shuffled,
and a group holds the segments of one record.

Defined cases: a null or empty payload is a response without bytes; a null url
leaves the target out; pages without an id have records with an empty id and
revisit a page with one, or hold their own payload where no page has one; of
equal payloads with one largest id on several rows all of these rows hold it.
Rows that are equal in id, url and payload are the same record, stored and read
as often. Payloads of any length go in segments; an empty table gives no archive
and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_map, pa_schema, written

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Shorter payloads are stored again rather than revisited.
REVISIT_BYTES = 1000
#: Gzip members of about so many bytes make a row of the writer, and so many rows at most an archive.
ROW_BYTES = 1 << 20
ARCHIVE_ROWS = 1024
#: The last byte of a gzip member is the highest of its length, which is 0 below 16 MB: it ends the writer's rows.
MEMBER_END = "\0"
MOST_SEGMENT_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
BROADCAST_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, type string, uri string, refers_to string, payload_digest string, "
    "origin_id string, segment int, total_length long, block binary, error string"
)


# --- formats -------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[at : at + size]), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are passed over. ValueError if it is cut short."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(parts)
        part = framed[end + 2 : end + 2 + size]
        if size < 0 or len(part) < size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk cut short")
        parts.append(part)
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Payload and headers (names in lower case) of an HTTP response; ValueError where its framing is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP headers cut short")
    headers = header_fields(head.split(b"\r\n")[1:])
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = unchunked(body)
    return body, headers


def header_fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in b" \t" and last and line.strip():
            found[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("ascii", "replace")
            found[last] = value.strip().decode("utf-8", "replace")
    return found


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields, block, error) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {}, b"", "no version line"
            return
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line.rstrip(b"\r\n"))
        fields = header_fields(lines)
        if not re.fullmatch(r"\d+", fields.get("content-length", "")):
            yield fields, b"", "no content length"
            return
        length = int(fields["content-length"])
        block = stream.read(length)
        yield fields, block, None if len(block) == length else "cut short"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {clean(str(value))}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A header value without control characters, which become percent codes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def sha1_base32(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_name(page_id: str | None, uri: str | None, sha1: bytes) -> str:
    """The record id of a page: known to whoever knows its id, address and payload digest."""
    mark = hashlib.sha1((uri or "").encode() + b"\0" + sha1).hexdigest()[:16]
    return f"urn:page:{'' if page_id is None else page_id}:{mark}"


def page_records(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, segment_bytes: int) -> list[bytes]:
    """All records of a page: a response in one or more segments, or a revisit."""
    common: list[tuple[str, object]] = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    digest = sha1_base32(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        fields = [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *common, ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Payload-Digest", digest), kind,
        ]
        return [record(fields, block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    out = []
    for number, at in enumerate(cuts, 1):
        last = number == len(cuts)
        if number == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *common, ("WARC-Payload-Digest", digest), kind]
            fields += [] if last else [("WARC-Segment-Number", 1)]
        else:
            fields = [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{number}>"), *common,
                ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", len(block) if last else None),
            ]
        out.append(record(fields, block[at : at + segment_bytes]))
    return out


# --- operators -----------------------------------------------------------------------------------


def with_revisits(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The pages with _refers_to: of equal payloads of ``least`` bytes and more the row with
    the largest id holds the payload, and the others get its id, and in _refers_url its address (of several
    rows with that id, the greatest). Rows that share that id all hold it; rows
    without an id revisit it, or hold their own where no row has an id."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    marked = pages.withColumn("_digest", F.when(F.octet_length(payload) >= least, F.unhex(F.sha1(payload))))
    repeated = (
        marked.where("_digest is not null")
        .groupBy("_digest")
        .agg(F.max(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first.id is not null")
        .select("_digest", "_first")
    )
    repeated = written(repeated, "repeated")
    # a digest, an address and what a hash table adds; beyond the bound the pages are shuffled by digest
    size = repeated.agg(F.sum(F.lit(120) + F.coalesce(F.octet_length("_first.url"), F.lit(0)))).first()[0] or 0
    joined = marked.join(F.broadcast(repeated) if size <= broadcast_bytes else repeated.hint("merge"), "_digest", "left")
    other = F.col("_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_first.id"))
    return joined.withColumns({"_refers_to": F.when(other, F.col("_first.id")), "_refers_url": F.when(other, F.col("_first.url"))}).drop("_first")


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    archive_rows: int = ARCHIVE_ROWS,
) -> None:
    """Write a WARC record (and its continuations) for every row to archives ``*.warc.gz`` under ``path``.

    Record ids are urn:page:<id>:<mark>, with a mark of address and payload, so a revisit can name the record it
    refers to.
    """
    if not 0 < segment_bytes <= MOST_SEGMENT_BYTES:
        raise ValueError(f"segments hold 1 to {MOST_SEGMENT_BYTES} bytes")
    rows = with_revisits(
        pages.select(id_col, url_col, html_col), id_col=id_col, url_col=url_col, html_col=html_col, least=least, broadcast_bytes=broadcast_bytes
    ).select(
        F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.col("_refers_to").cast("string").alias("refers"), F.col("_refers_url").alias("refers_url"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                for row in batch.slice(at, step).to_pylist():
                    payload = (row["html"] or "").encode()
                    sha1 = hashlib.sha1(payload).digest()
                    refers = None if row["refers"] is None else page_name(row["refers"], row["refers_url"], sha1)
                    for one in page_records(page_name(row["id"], row["url"], sha1), row["url"], payload, refers, segment_bytes):
                        held.append(gzip.compress(one, 6, mtime=0))
                        size += len(held[-1])
                        if size >= ROW_BYTES:
                            yield member_row(held)
                            held, size = [], 0
        if held:
            yield member_row(held)

    packed = arrow_map(rows, run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", MEMBER_END).option("maxRecordsPerFile", archive_rows).text(path)
    _name_archives(pages.sparkSession, path)


def member_row(members: list[bytes]) -> pa.RecordBatch:
    """One row of gzip members, less the last byte, with which the writer ends each row."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])


def _name_archives(spark: SparkSession, path: str) -> None:
    """Give the files that the writer has committed the name of what they are; empty ones go."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def name(status) -> None:
        old = status.getPath()
        if not status.getLen():
            files.delete(old, False)
        elif not files.rename(old, spark._jvm.org.apache.hadoop.fs.Path(folder, old.getName().removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"no new name for {old}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(name, [s for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")]))


class Pieces(io.RawIOBase):
    """A stream of pieces: what has been read is let go."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def _take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def readline(self, size: int | None = -1) -> bytes:
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self._more():
                return self._take(len(self.held))
        return self._take(end + 1)

    def read(self, n: int = -1) -> bytes:
        while (n < 0 or len(self.held) < n) and self._more():
            pass
        return self._take(len(self.held) if n < 0 else n)


def stored_records(stream) -> Iterator[tuple]:
    """The values of RECORDS of each record of an uncompressed stream."""
    bare = lambda x: x.strip("<>") if x is not None else None
    for fields, block, error in parse(stream):
        number = fields.get("warc-segment-number")
        total = fields.get("warc-segment-total-length")
        yield (
            bare(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")),
            fields.get("warc-payload-digest"), bare(fields.get("warc-segment-origin-id")),
            int(number) if number else None, int(total) if total else None, block, error,
        )


#: Where a record seems to begin. It only decides how large the pieces of a stream are.
CUT = b"\r\n\r\nWARC/"


def _read(spark: SparkSession, path: str, schema: str, row, compressed: bool = True) -> DataFrame:
    """A row per stored record of the archives under ``path``; ``row`` makes it of the values of RECORDS."""
    kinds = pa_schema(schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """(archive, piece) in order, the cuts put back."""
        last = None
        for batch in batches:
            for name, piece in zip(batch.column(0), batch.column(1), strict=True):
                name, piece = name.as_py(), piece.as_py()
                yield name, piece if name != last else CUT + piece
                last = name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, archive in groupby(pieces(batches), key=itemgetter(0)):
            held, size = [], 0
            for found in stored_records(Pieces(piece for _, piece in archive)):
                held.append(row(found))
                size += len(found[8]) + 500
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    if compressed:  # one task streams an archive, as the codec can't be cut
        lines = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", CUT.decode()).text(path)
        files = lines.select(F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("piece"))
    else:
        files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("name"), F.col("content").alias("piece"))
    return arrow_map(files, run, schema)


def read_archives(spark: SparkSession, path: str, compressed: bool = True) -> DataFrame:
    """RECORDS of the archives ``*.gz`` under ``path``, in one gzip member or many, each streamed by one task; without
    ``compressed``, of files that are not packed, each read as a whole (2 GB at most). A record cut short ends its
    archive, with ``error`` set."""
    return _read(spark, path, RECORDS, lambda found: found, compressed)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records (columns of RECORDS): segments joined by origin identifier in order of their number.

    Segments that are missing, and lengths that don't add up to the total, give one row with a null block and
    ``error`` set. Identical repeats of a whole record's segments give a row for each repeat. The table is
    read twice: pass one that is written.
    """
    alone = records.where("segment is null and (type is null or type <> 'continuation')")
    parts = records.where("segment is not null or type = 'continuation'").withColumn("origin", F.coalesce("origin_id", "record_id"))
    grouped = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block", "total_length", "type", "uri", "payload_digest", "error"))).alias("parts")
    )
    kinds = pa_schema(RECORDS)
    names = [f.name for f in kinds]

    def joined(origin: str | None, parts: list[dict]) -> Iterator[tuple]:
        first = next((p for p in parts if p["segment"] == 1 and p["type"] != "continuation"), parts[0])
        about = (origin, first["type"], first["uri"], None, first["payload_digest"], None, None)
        by: dict[int | None, list[dict]] = {}
        for p in parts:
            by.setdefault(p["segment"], []).append(p)
        totals = {p["total_length"] for p in parts if p["total_length"] is not None}
        numbers = [*by]
        again = {len(x) for x in by.values()}
        error = next((p["error"] for p in parts if p["error"]), None)
        if None in by or numbers != [*range(1, len(numbers) + 1)] or not totals or first["type"] == "continuation":
            error = error or "segments are missing"
        elif len(again) > 1 or len(totals) > 1 or any(x["block"] != p[0]["block"] for p in by.values() for x in p):
            error = error or "segments disagree"
        block = None
        if not error:
            block = b"".join(p[0]["block"] for p in by.values())
            if len(block) != next(iter(totals)):
                block, error = None, f"{sum(len(p[0]['block']) for p in by.values())} bytes of {next(iter(totals))}"
        for _ in range(1 if error else again.pop()):
            yield (*about, None if error else len(block), block, error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = [*joined(batch.column(0)[row].as_py(), batch.column(1)[row].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return alone.unionByName(arrow_map(grouped, run, RECORDS))


PAYLOADS = (
    "record_id string, type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"
)


def payload_of(
    record_id: str | None, kind: str | None, uri: str | None, refers_to: str | None, said: str | None, block: bytes | None, error: str | None, with_payload: bool
) -> tuple:
    """The values of PAYLOADS of a whole record."""
    payload, size, digest = None, None, None
    try:
        if block is None:
            raise ValueError(error or "no block")
        payload, headers = http_payload(block)
        if kind == "revisit":
            size, payload = int(headers["content-length"]), None
            digest = base64.b32decode((said or "").removeprefix("sha1:")).hex()
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if said and said != sha1_base32(payload):
                error = error or "digest differs"
    except (ValueError, KeyError) as e:
        payload, error = None, error or str(e)
    return record_id, kind, uri, refers_to, payload if with_payload else None, size, digest, error


def payloads(whole: DataFrame, with_payload: bool = True) -> DataFrame:
    """Decoded payloads of whole records (PAYLOADS): HTTP framing taken off, the digest (lower-case hex SHA-1)
    checked against the record's. A revisit has no payload of its own: its length and digest are those stored.
    """
    kinds = pa_schema(PAYLOADS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                out = [
                    payload_of(r["record_id"], r["type"], r["uri"], r["refers_to"], r["payload_digest"], r["block"], r["error"], with_payload)
                    for r in batch.slice(at, step).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return arrow_map(whole, run, PAYLOADS)


def stored(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """PAYLOADS of the archives under ``path``: records read, segments reassembled, framing decoded.

    Whole records are decoded where they are read; of segments alone the blocks are written for the grouping.
    """
    segment = ", segment int, total_length long, origin_id string, block binary, said string"

    def row(found: tuple) -> tuple:
        record_id, kind, uri, refers_to, said, origin, number, total, block, error = found
        if number is None and kind != "continuation":
            return *payload_of(record_id, kind, uri, refers_to, said, block, error, with_payload), None, None, None, None, None
        return record_id, kind, uri, refers_to, None, None, None, error, number if number is not None else -1, total, origin, block, said

    read = written(_read(spark, path, PAYLOADS + segment, row), "records")
    names = [c.split()[0] for c in PAYLOADS.split(", ")]
    parts = read.where("segment is not null").select(
        "record_id", "type", "uri", "refers_to", F.col("said").alias("payload_digest"), "origin_id",
        F.when(F.col("segment") >= 0, F.col("segment")).alias("segment"), "total_length", "block", "error",
    )
    return read.where("segment is null").select(*names).unionByName(payloads(reassemble(parts), with_payload))
