"""WARC (operator 7): archives written by Spark tasks, and a reader that salvages what damage leaves.

Archives are gzip members, one for each record, in files of the shared folder. The first record of a payload is a
response, later ones of an equal payload are revisits that refer to it. The reader takes plain archives and members of
any number of records, and checks each of them (gzip's sum, version line, length, block digest). After a failed check it
looks for the next valid version line or member, goes on there, and logs the bytes between as a quarantined gap, in a
member by places in its unpacked bytes. Of a member that is cut off or damaged the records before the fault are kept,
after damage only those whose block digest proves them. Members are unpacked piece by piece: a record and a piece are
held, not the member. A record of over MAX_RECORD bytes counts as damage; that is above what a cell of a table can hold, so the
writer makes none. `page_round_trip` fails unless each archive gives as many records as were written to it.

Null html is an empty payload; html and urls of any length up to that are written whole. Rows that share the smallest page_id of a payload are all responses; a null page_id is
later than all others. An empty table writes no file and reads as no rows. Other columns of pages are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import SHARE, join_spread, new_folder, put_file, schema_of, written

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: A version line inside of what should be a header.
BROKEN = re.compile(rb"\r\nWARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
#: A file is closed when it has so many bytes.
FILE_BYTES = 32 << 20
#: A record of more bytes counts as damage: a cell holds fewer than 2 GiB, and headers little more.
MAX_RECORD = 1 << 32
#: Bytes of an archive that are unpacked at once.
PIECE = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(value: object) -> str:
    """One line: what would end a header line, or could not be written, goes in per cent form."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, sha: str) -> bytes:
    """A whole record. A revisit has the HTTP head only; the payload's size and digest are in its header."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", header_value(url or "")), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("X-Payload-Length", len(payload))]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields.append(("Content-Length", len(block)))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class _Write:
    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes = folder, file_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0

        def close() -> pa.RecordBatch:
            # a name that no other attempt has: a file counts only if the attempt's row arrives
            name = f"{uuid.uuid4().hex}.warc.gz"
            put_file(self.folder, name, b"".join(held))
            return pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page, url, html, revisit, refers_to in zip(*(batch.column(n) for n in ("page_id", "url", "html", "revisit", "refers_to"))):
                payload = html.as_py()
                held.append(member(record_bytes(page.as_py(), url.as_py(), payload, refers_to.as_py(), revisit.as_py(), digest(payload))))
                size += len(held[-1])
                count += 1
                if size >= self.file_bytes:
                    yield close()
                    held, size, count = [], 0, 0
        if held:
            yield close()


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns file, records, bytes of the archives, and
    the folder. Payloads of min_bytes or more are written once; the others are all responses."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html")).withColumn("_sha", F.sha1("html"))
    long_enough = F.octet_length("html") >= min_bytes
    shared = rows.where(long_enough).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"), F.lit(True).alias("_met")).where("_n > 1")
    # written, so that Spark knows its size and sends it around only if it is small
    shared = written(shared, "warc-shared")
    hot = shared.where(F.col("_n") > rows.count() / SHARE).select("_sha")  # a payload that many pages have is dealt to several tasks
    marked = join_spread(rows, shared.select("_sha", "_first", "_met"), "_sha", by=["page_id", "url"], hot=hot, how="left")
    revisit = F.col("_met").isNotNull() & long_enough & ~F.col("page_id").eqNullSafe(F.col("_first"))
    out = marked.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_first")).alias("refers_to"))
    files = written(out.mapInArrow(_Write(folder, file_bytes), "file string, records bigint, bytes bigint"), "warc-files")
    return files.select(F.concat(F.lit(folder + "/"), "file").alias("path"), "records", "bytes")


@dataclass
class Found:
    """A record, or a gap with the reason: bytes of the archive and, in a member, of what it unpacks to (else None)."""

    start: int
    end: int
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""
    inside_start: int | None = None
    inside_end: int | None = None


class Source:
    """Bytes by place: of memory, or of a file that is read piece by piece."""

    def __init__(self, data: bytes | None = None, path: str = ""):
        self.data, self.file = data, None
        if data is None:
            fs, at = pafs.FileSystem.from_uri(path)
            self.file = fs.open_input_file(at)
        self.size = len(data) if data is not None else self.file.size()
        self.total: int | None = self.size

    def read(self, at: int, n: int) -> bytes:
        if self.data is not None:
            return self.data[at : at + n]
        self.file.seek(at)
        return self.file.read(min(n, max(0, self.size - at)))

    def forget(self, at: int) -> None:
        """Bytes before a place won't be read again."""

    def find(self, what: re.Pattern[bytes], at: int) -> int:
        """The first place from at on where what begins, or the end."""
        size = 1 << 10  # what is near is found without a look at all that follows
        while window := self.read(at, size):
            if m := what.search(window):
                return at + m.start()
            if len(window) < size:
                return at + len(window)
            at += len(window) - 16
            self.forget(at)
            size = min(READ, 4 * size)
        return at


class Member(Source):
    """The unpacked bytes of the gzip member at a place of a source, from the first that wasn't forgotten on.

    Once read to its end, `end` is where it ends in the source and `fault` what is wrong with it ('' if nothing)."""

    def __init__(self, source: Source, at: int):
        self.source, self.at = source, at
        self.z, self.fed, self.rest = zlib.decompressobj(31), at, b""
        self.held, self.start, self.end, self.fault = bytearray(), 0, -1, ""
        self.total = None  # how many bytes it unpacks to, once that is known

    def read(self, at: int, n: int) -> bytes:
        while self.end < 0 and len(self.held) < at + n - self.start:
            self.more()
        return bytes(self.held[at - self.start : at - self.start + n])

    def forget(self, at: int) -> None:
        if at - self.start >= READ:  # in large steps, for what stays is moved
            del self.held[: at - self.start]
            self.start += at - self.start

    def more(self) -> None:
        """Unpack another piece, of READ bytes at most."""
        if not self.rest:
            self.rest = self.source.read(self.fed, PIECE)
            self.fed += len(self.rest)
        if not self.rest:
            self.end, self.fault = self.fed, "member is cut off"
            return
        before, piece = self.z.copy(), self.rest
        try:
            self.held += self.z.decompress(piece, READ)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.end = self.fed - len(self.z.unused_data)
        except zlib.error as e:
            self.fault = f"member is damaged: {re.sub(r'Error -?[0-9]+ while decompressing data: ', '', str(e))}"
            for k in range(len(piece)):  # what comes before the fault
                try:
                    self.held += before.decompress(piece[k : k + 1])
                except zlib.error:
                    self.end = self.fed - len(piece) + k
                    return


def parse_record(source: Source, at: int) -> tuple[dict[str, str], bytes, int, str]:
    """Header fields (names lower-cased), block, the record's length, and what is wrong with it ('' if nothing)."""
    size = 1 << 12
    while (end := (data := source.read(at, size)).find(b"\r\n\r\n")) < 0:
        if not VERSION_LINE.match(data):
            return {}, b"", 0, "no version line"
        # a header ends before the next version line: what a run of broken headers costs is their length, not its square
        if BROKEN.search(data):
            return {}, b"", 0, "header line has no colon"
        if len(data) < size or size > MAX_RECORD:
            return {}, b"", 0, "header has no end"
        size *= 4
    if not VERSION_LINE.match(data):
        return {}, b"", 0, "no version line"
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            return {}, b"", 0, "header line has no colon"
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        return {}, b"", 0, "no content length"
    length = int(fields["content-length"])
    if length > MAX_RECORD:
        return {}, b"", 0, "record is too long"
    if source.total is not None and at + end + 8 + length > source.total:  # nothing is read for a length that can't be
        return {}, b"", 0, "record is cut off"
    body = data[end + 4 :] if len(data) >= end + 8 + length else source.read(at + end + 4, length + 4)
    block, after = body[:length], body[length : length + 4]
    if len(block) < length or after != b"\r\n\r\n":
        return {}, b"", 0, "record is cut off"
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        return {}, b"", 0, "block digest differs"
    return fields, block, end + 8 + length, ""


def unpacked_records(m: Member, start: int, end: int, fault: str) -> Iterator[Found]:
    """Records and gaps of the member from start to end, in order. What follows a fault is a gap without an end inside."""
    at, gap, why = 0, -1, ""
    damaged = fault.startswith("member is damaged")
    while m.read(at, 1):
        fields, block, length, bad = parse_record(m, at)
        if not bad and damaged and not fields.get("warc-block-digest", "").startswith("sha1:"):
            bad = "no digest proves the record of a damaged member"
        if bad:
            if gap < 0:
                gap, why = at, bad
            at = m.find(VERSION_LINE, at + 1)
            m.forget(at)
            continue
        if gap >= 0:
            yield Found(start, end, reason=why, inside_start=gap, inside_end=at)
            gap = -1
        yield Found(start, end, fields, block, inside_start=at, inside_end=at + length)
        at += length
        m.forget(at)
    if fault:
        yield Found(start, end, reason=fault, inside_start=gap if gap >= 0 else at)
    elif gap >= 0 or not at:
        yield Found(start, end, reason=why or "empty member", inside_start=max(gap, 0), inside_end=at)


def salvage(source: Source) -> Iterator[Found]:
    """Records and gaps of an archive (gzip members or plain), in order; together they cover all of its bytes."""
    at, gap, why = 0, -1, ""
    mark = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")
    while at < source.size:
        head, found = source.read(at, 16), iter(())
        bad, end = "no member or version line", -1
        if head.startswith(MAGIC):
            m = Member(source, at)
            m.read(0, READ)
            whole = m
            if m.end < 0:  # a long one is unpacked twice, so that its end and its fault are known before its records
                whole = Member(source, at)
                while whole.end < 0:
                    whole.more()
                    whole.start, whole.held = whole.start + len(whole.held), bytearray()
            m.total = whole.start + len(whole.held)
            # what follows a fault may begin before the place where the fault showed
            bad, end = whole.fault, source.find(mark, at + 1) if whole.fault else whole.end
            found = unpacked_records(m, at, end, bad)
            if bad:
                first = [x for x in (next(found), next(found, None)) if x]  # the gap before a record, if any, and the record
                if any(not x.reason for x in first):
                    found, bad = chain(first, found), ""
        elif VERSION_LINE.match(head):
            fields, block, length, bad = parse_record(source, at)
            if not bad:
                end = at + length
                found = iter([Found(at, end, fields, block)])
        if bad:  # bytes that only look like a member, or one of which nothing is left
            if gap < 0:
                gap, why = at, bad
            at = source.find(mark, at + 1)
            continue
        if gap >= 0:
            yield Found(gap, at, reason=why)
            gap = -1
        yield from found
        at = end
    if gap >= 0:
        yield Found(gap, source.size, reason=why)


READ_SPARK, READ_ARROW = schema_of(path="string", start="long", end="long", inside_start="long", inside_end="long", reason="string", record_type="string", record_id="string", target_uri="string", refers_to="string", payload_digest="string", payload_bytes="long", payload="binary")


class _Read:
    def __init__(self, payloads: bool):
        self.payloads = payloads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for x in salvage(Source(path=path)):
                    row = {"path": path, "start": x.start, "end": x.end, "inside_start": x.inside_start, "inside_end": x.inside_end, "reason": x.reason or None}
                    if not x.reason:
                        body = x.block.partition(b"\r\n\r\n")[2] if x.fields.get("content-type", "").startswith("application/http") else x.block
                        kind = x.fields.get("warc-type")
                        said = x.fields.get("warc-payload-digest", "")
                        row |= {"record_type": kind, "record_id": x.fields.get("warc-record-id"), "target_uri": x.fields.get("warc-target-uri"), "refers_to": x.fields.get("warc-refers-to")}
                        row |= {"payload_digest": said.removeprefix("sha1:") if kind == "revisit" else digest(body), "payload_bytes": int(x.fields.get("x-payload-length") or 0) if kind == "revisit" else len(body)}
                        if self.payloads:
                            row["payload"] = body
                            held += len(body)
                    rows.append(row)
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap (reason) of the archives named in paths (path): start and end are
    bytes of the archive, inside_start and inside_end bytes of the unpacked member in them (null in plain archives)."""
    spark = paths.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paths.select("path").repartition(n).mapInArrow(_Read(payloads), READ_SPARK)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of a folder's files; their content is not read here."""
    return spark.read.format("binaryFile").load(folder).select("path")


def page_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    An archive that gives back fewer or more records than were written to it is an error: no row is lost in silence."""
    files = write_archives(pages, min_bytes)
    every = written(read_archives(files, payloads=False), "warc-read")
    read = every.where("reason is null")
    each = read.groupBy("path").agg(F.count("*").alias("_n"))
    short = files.join(each, "path", "left").where("coalesce(_n, 0) <> records").select("path", "records", "_n").take(5)
    if short:
        raise RuntimeError(f"archives that did not give back what was written (path, written, read): {[tuple(r) for r in short]}; first gaps: {[tuple(r) for r in every.where('reason is not null').select('path', 'start', 'end', 'reason').take(5)]}")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
