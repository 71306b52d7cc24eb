"""WARC archives: a deduplicating writer and a salvage reader.

Each page becomes a record in a gzip member of its own.  Of pages with equal payloads the one with the largest id is a
``response``, the others are ``revisit`` records that keep the HTTP head (and so the payload's length) and its digest.
Files are written by Spark's text writer, whose line separator is set to the zero byte that a member ends with, so the
files are plain concatenations of members in any file system that Spark can write.

The reader takes members and bare records alike, in time linear in the file.  A member is first inflated in chunks for its extent and
checksum, then once more for its records, which leave as they come.  Whatever fails a check (gzip CRC and length, version line,
Content-Length, record end, block digest) is skipped up to the next valid record: inside a member at the next version line of what was
inflated, else at the next offset of the file with a valid member or record.  Of a damaged or cut member the records with a right block digest
are recovered.  All bytes between are logged as gaps.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.llm.common import arrow_batches, materialise, remove, shared_folder, small, tidy

#: A file is closed after so many records; a task reads one file at once.
FILE_RECORDS = 2000
#: A header has an end within so many bytes; members are inflated in chunks of that many.
HEADER_BYTES, _CHUNK = 1 << 20, 1 << 18
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """The bytes of a record; payload digest and HTTP Content-Length are those of the full payload in either kind."""
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte (an empty member follows if its length field would not)."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


class Bad(ValueError):
    pass


def _parse(data: bytes | bytearray, at: int, more: Callable[[], bool] = lambda: False, strict: bool = False) -> tuple[dict, bytes, int]:
    """(fields, block, end) of the record at an offset; more: appends to the data, false at its end; strict: with a block digest only."""
    while len(data) - at < 10 and more():
        pass
    if data[at : at + 7] != _VERSION or data[at + 7 : at + 10] not in (b"0\r\n", b"1\r\n"):
        raise Bad("no version line")
    seen = at
    while (end := data.find(b"\r\n\r\n", seen, at + HEADER_BYTES)) < 0:
        seen = max(at, len(data) - 3)
        if len(data) >= at + HEADER_BYTES or not more():
            raise Bad("the header has no end")
    try:
        head = bytes(data[at:end]).decode()
    except UnicodeDecodeError as e:
        raise Bad("a header that is not text") from e
    fields = {}
    for line in head.split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise Bad("a header line without a colon")
        fields[key.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdecimal()):
        raise Bad("no Content-Length")
    start = end + 4
    stop = start + int(size)
    while len(data) < stop + 4 and more():
        pass
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("the block's length is not Content-Length")
    block = bytes(data[start:stop])
    want = fields.get("warc-block-digest", "")
    known = want.lower().startswith("sha1:")
    if known and want[5:] != digest(block):
        raise Bad("the block's digest differs")
    if strict and not known:
        raise Bad("no block digest in a damaged member")
    return fields, block, stop + 4


def _inflate(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, 0) as they come, at the end (b"", offset behind the member); Bad for damage and a cut."""
    d, view, step = zlib.decompressobj(31), memoryview(data), 1 << 10
    while at < len(data):
        chunk = view[at : at + step]
        at += len(chunk)
        step = min(2 * step, _CHUNK)
        while True:
            try:
                out = d.decompress(chunk, _CHUNK)
            except zlib.error as e:
                raise Bad(f"gzip: {e}") from e
            if out:
                yield out, 0
            chunk = d.unconsumed_tail
            if d.eof or not chunk:
                break
        if d.eof:
            yield b"", at - len(d.unused_data)
            return
    raise Bad("gzip: cut off")


def _inner(data: bytes, at: int, strict: bool) -> Iterator[tuple]:
    """("record" or "gap", inflated start, end, (fields, block) or reason) of a member; strict for a damaged one."""
    chunks = _inflate(data, at)
    buf, base = bytearray(), 0

    def more() -> bool:
        try:
            out, _ = next(chunks)
        except (Bad, StopIteration):
            return False
        buf.extend(out)
        return bool(out)

    pos, bad, reason = 0, -1, ""
    while pos < len(buf) or more():
        try:
            fields, block, end = _parse(buf, pos, more, strict)
        except Bad as e:
            if bad < 0:
                bad, reason = base + pos, str(e)
            while (nxt := buf.find(_VERSION, pos + 1)) < 0:
                pos = max(pos, len(buf) - len(_VERSION))
                if not more():
                    break
            pos = nxt if nxt >= 0 else len(buf)
        else:
            if bad >= 0:
                yield "gap", bad, base + pos, reason
                bad = -1
            yield "record", base + pos, base + end, (fields, block)
            pos = end
        if pos > _CHUNK:
            del buf[:pos]
            base, pos = base + pos, 0
    if bad >= 0:
        yield "gap", bad, base + len(buf), reason


def _member(data: bytes, at: int) -> tuple[int, str, Iterator[tuple]]:
    """(end, what is wrong or "", rows of _inner) of the member at an offset; Bad for a damaged one without a record."""
    end, fault = at, ""
    try:
        for _, stop in _inflate(data, at):
            end = stop or end
    except Bad as e:
        fault = str(e)
    rows = _inner(data, at, bool(fault))
    if fault:
        first = next((x for x in rows if x[0] == "record"), None)
        if first is None:
            raise Bad(fault)
        rows = chain([first], (x for x in rows if x[0] == "record"))
    return end, fault, rows


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, int | None, int | None]]:
    """("record", start, end, (fields, block), inner start, inner end) and ("gap", start, end, reason, inner start, inner end), in order.

    Offsets are those of the file, the inner ones of the inflated member (None for bare records and gaps between).  Together they cover
    the data; records of a damaged member have no extent of their own, as the gap behind them is the whole member.
    """
    at, bad, reason = 0, -1, ""
    places = {_MAGIC: -1, _VERSION: -1}
    while at < len(data):
        fault = ""
        try:
            if data[at : at + 3] == _MAGIC:
                end, fault, rows = _member(data, at)
            else:
                fields, block, end = _parse(data, at)
                rows = iter([("record", None, None, (fields, block))])
        except Bad as e:
            fault, rows = str(e), None
        if rows is not None:
            if bad >= 0:
                yield "gap", bad, at, reason, None, None
                bad = -1
            for kind, a, b, x in rows:
                yield kind, at, at if fault else end, x, a, b
        if fault:
            if bad < 0:
                bad, reason = at, fault
            for what, place in places.items():
                if place <= at:
                    found = data.find(what, at + 1)
                    places[what] = found if found >= 0 else len(data)
            at = min(places.values())
        else:
            at = end
    if bad >= 0:
        yield "gap", bad, len(data), reason, None, None


def write(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Writes (page_id, url, html) as archives into a new folder.

    A null html is an empty payload, a null url leaves its header out.  A null page_id takes no part in the
    deduplication: it is a response that nothing refers to.  Of repeated rows with the largest id each is a response.
    """
    arrow_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # 20 bytes a page are grouped; the payloads stay where they are unless a revisit list is too large to broadcast
    key = src.where("page_id is not null").select("page_id", F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("sha"))
    last = key.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = key.join(last, "sha").where("page_id < refers_to").select(F.col("page_id").alias("pid"), "sha", "refers_to").distinct()
    rows = src.withColumn("own", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    rows = rows.join(small(revisits), (F.col("page_id") == F.col("pid")) & (F.col("own") == F.col("sha")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        for batch in batches:
            out = [member(record(*x))[:-1] for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (rows.mapInArrow(tidy(run), "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", file_records).text(path))


_SCHEMA = "file string, start long, end long, inner_start long, inner_end long, gap string, fields map<string,string>, payload_bytes long, payload_digest string, block binary"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]


def _payload(fields: dict, block: bytes) -> tuple[int | None, str | None]:
    """Length and digest of a record's payload: of what was read, or for a revisit of what its record says."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return len(block), digest(block)
    if fields.get("warc-type") == "revisit":
        told = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return int(told[0]) if told and told[0].isdigit() else None, fields.get("warc-payload-digest", "").partition(":")[2] or None
    return len(body), digest(body)


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row for each record and each gap (then with its reason) of the archives in a folder; an empty folder gives none."""
    arrow_batches(spark)
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows, held = batch.column(0)[k].as_py(), [], 0
                for kind, a, b, x, i, j in salvage(batch.column(1)[k].as_py()):
                    if kind == "gap":
                        rows.append((name, a, b, i, j, x, None, None, None, None))
                    else:
                        rows.append((name, a, b, i, j, None, list(x[0].items()), *_payload(*x), x[1] if blocks else None))
                        held += len(x[1]) if blocks else 0
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(tidy(run), _SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, n_gaps) of each page, from archives written and read back.

    Lengths and digests of responses are computed from the payload that was read; those of revisits are what the record
    says of the payload that it refers to.  n_gaps counts the quarantined byte gaps of all archives.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/docsearch-{uuid.uuid4().hex}/archives"
    write(pages, path)
    atexit.register(remove, spark, path)
    number = lambda name: F.expr(f"try_cast(regexp_extract(fields['{name}'], '^<urn:page:(-?[0-9]*)>$', 1) as long)")
    log = materialise(read(spark, path, blocks=False).select(number("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest", F.col("fields")["warc-type"].alias("record_type"), number("warc-refers-to").alias("refers_to"), "gap"), "records")
    return log.where("gap is null").drop("gap").withColumn("n_gaps", F.lit(log.where("gap is not null").count()))
