"""WARC archives: records with payload digests and revisits, and a reader that salvages damaged files.

Writing: every page becomes one record. Pages whose payloads are equal and long enough refer to the one that is
stored in full. Records (gzip members, or plain) are rows of Spark's text sink, whose line separator is an empty
member or the record terminator, so files are committed by Spark as they are in any other job, and a lost
executor costs its tasks only.

Reading: a file (plain, or gzip with any number of records in a member) is walked from record to record. Where a check
fails (version line, header, lengths, terminator, digest, gzip checks), the reader searches for the next version line or
member that passes its checks, goes on there, and logs the bytes between as a quarantined gap. It does the same within
what a member holds, and of a member that is cut or fails gzip's checks it keeps the records whose own digests hold.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import Corruption
from .common import scratch_path, ship, written

VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_STEP = 1 << 16
#: A byte of deflate holds fewer bytes than this (1032 at most).
_RATIO = 1040
NOTHING = gzip.compress(b"", mtime=0)
END = "\r\n\r\n"
RECORD_ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"

RECORDS = "file string, start long, stop long, inner_start long, inner_stop long, kind string, record_type string, record_id string, refers_to string, payload_digest string, payload binary, why string"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_bytes: int = 1000) -> DataFrame:
    """One row per page with its record's text without the terminator: page_id, record.

    Of pages with equal payloads (SHA-1 and length) of at least min_bytes bytes, the one with the largest id is a
    response and the others revisit it. A null html is an empty payload, a null url an empty target. A null id is
    never the largest; where all are null, and where rows repeat the largest id, each is a response.
    """
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size"))
    stored = page.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("stored_id"))
    found = page.join(stored, ["digest", "size"], "left")
    revisit = F.col("stored_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = lambda value: F.coalesce(value.cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), text(F.col("size")), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(VERSION.decode() + "\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit(f"<{RECORD_ID}"), text(F.col("page_id")), F.lit(">"))),
        line("WARC-Date", F.lit(NO_DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{RECORD_ID}"), text(F.col("stored_id")), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", text(F.octet_length(block))),
    )
    return found.select("page_id", F.concat(head, F.lit("\r\n"), block).alias("record"))


def _placed(batches: Iterator[pa.RecordBatch], most_records: int, most_bytes: int) -> Iterator[tuple[int, int, bytes]]:
    """A task's records with their terminators, each with its file's number and its place there. A file has no more than
    most_records records and most_bytes bytes, or one record."""
    file = place = size = 0
    for batch in batches:
        for record in batch.column(0):
            text = (record.as_py() + END).encode()
            if place and (place == most_records or size + len(text) > most_bytes):
                file, place, size = file + 1, 0, 0
            yield file, place, text
            place, size = place + 1, size + len(text)


def _members(batches: Iterator[pa.RecordBatch], most_records: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The records' gzip members, a row each. The sink begins a file after every most_records rows: where one is full
    of bytes before, empty rows fill it up."""
    rows, held, size = 0, [], 0
    for file, place, text in _placed(batches, most_records, most_bytes):
        empty = file * most_records + place - rows
        held += [b""] * empty + [gzip.compress(text, 6, mtime=0)]
        rows, size = rows + empty + 1, size + len(held[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
            held, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])


def _numbered(batches: Iterator[pa.RecordBatch], most_records: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The records without their terminators, a row each, with their files' numbers."""
    names, files, held, size = ["file", "value"], [], [], 0
    for file, _, text in _placed(batches, most_records, most_bytes):
        files.append(file)
        held.append(text[: -len(END)].decode())
        size += len(text)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(held, pa.string())], names=names)
            files, held, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(held, pa.string())], names=names)


def write_warc(records: DataFrame, path: str, *, records_per_file: int = 2000, bytes_per_file: int = 1 << 28, compressed: bool = True) -> int:
    """Writes the rows of `record` as WARC files below path: compressed, one gzip member a record, or plain. Returns
    how many there were. Bounded files keep a reader's memory bounded: a file has no more than bytes_per_file bytes
    before compression, or one record.

    The records are computed once, whatever their sizes. The sink counts records, not bytes: compressed files that are
    full of bytes before are filled up with empty members. Nothing may stand between plain records, so plain files lie
    in folders, one for each number of a file in its task.
    """
    ship(records.sparkSession)
    bounds, seen = (records_per_file, bytes_per_file), Observation()
    rows = records.observe(seen, F.count(F.lit(1)).alias("n")).select("record")
    if compressed:
        # The sink writes a string's bytes as they are; between two it puts a member that holds nothing.
        values = rows.mapInArrow(lambda batches: _members(batches, *bounds), "value binary").select(F.col("value").cast("string"))
        values.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(path)
    else:
        values = rows.mapInArrow(lambda batches: _numbered(batches, *bounds), "file long, value string")
        values.write.partitionBy("file").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)
    return seen.get.get("n") or 0


def _header(raw: bytes, start: int) -> tuple[dict[bytes, bytes], int] | None:
    """The record's named fields and where its block begins, or None. A line that begins with a space or tab goes on
    with the field before it."""
    version = _VERSION_LINE.match(raw, start)
    if not version:
        return None
    fields, at, last = {}, version.end(), None
    while (stop := raw.find(b"\r\n", at)) > at:
        if raw[at : at + 1] in (b" ", b"\t"):
            if last is None:
                return None
            fields[last] = (fields[last] + b" " + raw[at:stop].strip()).strip()
        else:
            name, colon, value = raw[at:stop].partition(b":")
            if not colon:
                return None
            last = name.strip().lower()
            fields[last] = value.strip()
        at = stop + 2
    return (fields, at + 2) if stop == at else None


def _bare(value: bytes | None) -> str | None:
    return value.decode("utf-8", "replace").strip("<>").removeprefix(RECORD_ID) if value else None


def _digest(value: bytes) -> tuple[str, str]:
    """Algorithm and lower-case hex digits of a digest that is labelled and spelled in hex or base32."""
    text = value.decode("ascii", "replace")
    name, colon, digits = text.partition(":")
    name, digits = (name.lower().replace("-", ""), digits) if colon else ("sha1", text)
    size = hashlib.new(name).digest_size if name in _ALGORITHMS else 0
    if size and len(digits.rstrip("=")) == -(-size * 8 // 5):
        try:
            return name, base64.b32decode(digits.rstrip("=").upper() + "=" * (-len(digits.rstrip("=")) % 8)).hex()
        except binascii.Error:
            pass
    return name, digits.lower()


_ALGORITHMS = ("md5", "sha1", "sha256", "sha512")


def _holds(wanted: tuple[str, str], content: bytes) -> bool:
    return hashlib.new(wanted[0], content).hexdigest() == wanted[1]


def parse_record(raw: bytes, start: int) -> tuple[dict, int, bool] | str:
    """The record that begins at start, where it ends and whether a digest of it was checked, or which check it fails.
    Digests by other algorithms than MD5, SHA-1, SHA-256 and SHA-512 aren't checked."""
    head = _header(raw, start)
    if not head:
        return "version line or header"
    fields, block_at = head
    if not fields.get(b"warc-type") or not fields.get(b"warc-record-id"):
        return "named fields"
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return "content length"
    stop = block_at + int(size)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return "terminator"
    block = raw[block_at:stop]
    of_block, of_payload = _digest(fields.get(b"warc-block-digest", b"")), _digest(fields.get(b"warc-payload-digest", b""))
    checked = of_block[0] in _ALGORITHMS and bool(of_block[1])
    if checked and not _holds(of_block, block):
        return "block digest"
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get(b"content-type", b"").startswith(b"application/http") else block
    digest = of_payload[1]
    if kind != "revisit":
        if of_payload[0] in _ALGORITHMS and digest:
            checked = True
            if not _holds(of_payload, payload):
                return "payload digest"
        digest = digest if of_payload[0] == "sha1" and digest else hashlib.sha1(payload).hexdigest()
    record = {"record_type": kind, "record_id": _bare(fields.get(b"warc-record-id")), "refers_to": _bare(fields.get(b"warc-refers-to")), "payload_digest": digest, "payload": payload}
    return record, stop + 4, checked


def _readable(inflate, part: bytes, most: int) -> bytes:
    """What comes before the error in a part: zlib tells nothing of a call that fails, so the calls get shorter."""
    held = b""
    for step in (1 << 10, 1):
        at = 0
        try:
            while at < len(part) and len(held) < most:
                before = inflate.copy()
                held += inflate.decompress(part[at : at + step], most - len(held))
                at += step
        except zlib.error:
            inflate, part = before, part[at : at + step]
    return held


def _member(raw: bytes, start: int, most: int | None) -> tuple[bytes, int, str]:
    """What the gzip member at start holds, where it ends, and which check it fails, if any: it then holds what could
    be read."""
    inflate, held, at = zlib.decompressobj(31), [], start
    if most is None:
        most = (len(raw) - start) * _RATIO
    try:
        while not inflate.eof and at < len(raw) and most > 0:
            part, before = raw[at : at + _STEP], inflate.copy()
            held.append(inflate.decompress(part, most))
            most -= len(held[-1])
            at += len(part) - len(inflate.unused_data) - len(inflate.unconsumed_tail)
    except zlib.error as error:
        held.append(_readable(before, part, most))
        return b"".join(held), at, f"gzip: {error}"
    if not inflate.eof:
        return b"".join(held), at, "gzip: longer than allowed" if most <= 0 else "gzip: truncated"
    return b"".join(held), at, ""


def _inside(held: bytes, sure: bool) -> tuple[list[dict], list[dict]]:
    """Records and gaps of what a member holds. Unless sure, records without a checked digest are gaps."""
    records, gaps, at, gap, why = [], [], 0, None, ""
    while at < len(held):
        got = parse_record(held, at)
        if isinstance(got, str) or not (sure or got[2]):
            if gap is None:
                gap, why = at, got if isinstance(got, str) else "no digest"
            line = _VERSION_LINE.search(held, at + 1)
            at = line.start() if line else len(held)
            continue
        if gap is not None:
            gaps.append({"inner_start": gap, "inner_stop": at, "why": f"in member: {why}"})
            gap = None
        records.append({**got[0], "inner_start": at, "inner_stop": got[1]})
        at = got[1]
    if gap is not None:
        gaps.append({"inner_start": gap, "inner_stop": len(held), "why": f"in member: {why}"})
    return records, gaps


def salvage(raw: bytes, *, most: int | None = None) -> Iterator[dict]:
    """All that a file holds: records (kind "record") and gaps (kind "gap"), each with start, stop, and for gaps why.
    Starts and stops are places in the file, whose spans cover it without overlap. What is in a member has the member's
    span, and inner_start and inner_stop, places in what it holds. Of a member that fails gzip's checks, which is a gap,
    the records that could be read have the gap's span. A member that holds more than `most` bytes fails; without
    `most`, none is too long."""
    at, gap, why, read = 0, None, "", []
    while at < len(raw):
        records: list[dict] = []
        gaps: list[dict] = []
        if raw.startswith(_MEMBER, at):
            held, stop, failed = _member(raw, at, most)
            records, gaps = _inside(held, not failed)
            if not failed and gaps and not records:
                failed, gaps = gaps[0]["why"], []
        else:
            got = parse_record(raw, at)
            failed = got if isinstance(got, str) else ""
            if not failed:
                records, stop = [got[0]], got[1]
        if not failed:
            if gap is not None:
                yield {"kind": "gap", "start": gap, "stop": at, "why": why}
                yield from ({"kind": "record", "start": gap, "stop": at, **record} for record in read)
                gap, read = None, []
            yield from ({"kind": "record", "start": at, "stop": stop, **record} for record in records)
            yield from ({"kind": "gap", "start": at, "stop": stop, **inner} for inner in gaps)
            at = stop
            continue
        read += records
        if gap is None:
            gap, why = at, failed
        line = _VERSION_LINE.search(raw, at + 1)
        ahead = [x for x in (raw.find(_MEMBER, at + 1), line.start() if line else -1) if x >= 0]
        at = min(ahead, default=len(raw))
    if gap is not None:
        yield {"kind": "gap", "start": gap, "stop": len(raw), "why": why}
        yield from ({"kind": "record", "start": gap, "stop": len(raw), **record} for record in read)


def _salvage_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"file": pa.string(), "start": pa.int64(), "stop": pa.int64(), "inner_start": pa.int64(), "inner_stop": pa.int64(), "kind": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload": pa.binary(), "why": pa.string()}
    schema = pa.schema(list(kinds.items()))
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, held = [], 0
            for row in salvage(content.as_py() or b""):
                rows.append({"file": path.as_py(), **row})
                held += len(row.get("payload") or b"")
                if len(rows) >= 1000 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark, path: str) -> DataFrame:
    """Records and gaps of all files below path (see RECORDS and salvage). A task holds as many files at a time as fit
    into spark.sql.execution.arrow.maxBytesPerBatch, or a larger one; Spark refuses files over
    spark.sql.sources.binaryFile.maxLength."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_salvage_files, RECORDS)


def quarantined(records: DataFrame) -> DataFrame:
    """The log of byte gaps: file, start, stop, inner_start, inner_stop (within a member, else null), why."""
    return records.filter("kind = 'gap'").select("file", "start", "stop", "inner_start", "inner_stop", "why")


def resolved(records: DataFrame) -> DataFrame:
    """Each page's record with its full payload's length and digest, revisits taking them from what they refer to:
    page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit whose record was lost keeps the
    digest from its header and has no length."""
    own = records.filter("kind = 'record'").select(
        F.expr("try_cast(record_id AS long)").alias("page_id"), F.octet_length("payload").cast("long").alias("size"), "payload_digest", "record_type", F.expr("try_cast(refers_to AS long)").alias("refers_to")
    )
    own = written(own, "warc-index")  # read three times below, and small
    stored = own.filter("record_type = 'response'").groupBy(F.col("page_id").alias("stored_id")).agg(F.max("size").alias("stored_size"))
    plain = own.filter("record_type <> 'revisit'").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    again = own.filter("record_type = 'revisit'").join(stored, F.col("refers_to") == F.col("stored_id"), "left")
    return plain.unionByName(again.select("page_id", F.col("stored_size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def archive_pages(pages: DataFrame, *, min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Writes an archive of the pages into the shared folder (or path), and what its reader finds: see resolved.
    Raises Corruption unless the reader finds as many records as were written, and no gap."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    wanted, seen = write_warc(page_records(pages, min_bytes=min_bytes), path), Observation()
    out = resolved(read_warc(spark, path).observe(seen, F.count_if(F.col("kind") == "record").alias("records"), F.count_if(F.col("kind") == "gap").alias("gaps")))
    found = seen.get
    records, gaps = found.get("records") or 0, found.get("gaps") or 0
    if gaps or records != wanted:
        raise Corruption(f"{wanted} records were written below {path}; its reader found {records} and {gaps} gaps")
    return out
