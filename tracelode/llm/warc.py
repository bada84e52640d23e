"""WARC archives: a writer of gzip members and a salvage reader (operator 2).

The reader takes byte ranges of archives. A range owns the records that begin in it, so a large archive is read by
many tasks. Where a record fails its checks, the reader looks for the next gzip member that decompresses or
version line whose header is sound, whichever is nearer, and goes on from there. What it skips it logs as a gap with the check that
failed; gaps() lists the bytes that no sound record covers, with these reasons.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, stored, text_of
from .files import attempt_path, create, reader

VERSION = b"WARC/1.1"
#: Fixed names of the format: gzip's magic bytes and the profile of revisits of equal payloads.
MAGIC = b"\x1f\x8b\x08"
PLAIN = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
WINDOW = 1 << 20
#: A record's bytes, and a plain record's header's, that a task holds at most; longer ones are quarantined with this as their reason.
RECORD_BYTES, HEADER_BYTES = 1 << 30, 1 << 20


@dataclass
class Failure:
    """A place where a sound record was expected, and the check that failed."""

    start: int
    reason: str


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def coded(self) -> bool:
        """Whether the HTTP header says that the payload is in a coding."""
        head = self.block.partition(b"\r\n\r\n")[0] if "application/http" in self.headers.get("content-type", "") else b""
        return re.search(rb"(?im)^(transfer|content)-encoding\s*:", head) is not None

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header, if the block has one."""
        if "application/http" in self.headers.get("content-type", ""):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return VERSION + b"\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, with no time stamp: equal records give equal bytes."""
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def _headers(data: bytes, at: int = 0) -> tuple[dict[str, str], int] | None:
    """The header of the record at a place and where its block begins; None where it is not sound. A line that begins with white space goes on the one before."""
    stop = data.find(b"\r\n\r\n", at) if _VERSION_LINE.match(data, at) else -1
    if stop < 0:
        return None
    head = data[at:stop]
    out: dict[str, str] = {}
    last = ""
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] = f"{out[last]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            return None
        last = name.strip().lower()
        out[last] = value.strip()
    if not out.get("content-length", "").isdigit() or not out.get("warc-type"):
        return None
    return out, stop + 4


def digest_of(value: str | None) -> tuple[str, bytes] | None:
    """The algorithm and the bytes of a digest, written in base 16 or 32; None for one that cannot be read, as of an unknown algorithm."""
    kind, colon, text = (value or "").strip().partition(":")
    kind, text = kind.lower().replace("-", ""), text.strip()
    if not colon or kind not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(kind).digest_size
    try:
        if len(text) == 2 * size:
            return kind, bytes.fromhex(text)
        bare = text.rstrip("=").upper()
        if len(bare) == -(-8 * size // 5):
            return kind, base64.b32decode(bare + "=" * (-len(bare) % 8))
    except ValueError:
        pass
    return None


def _disagrees(value: str | None, what: bytes) -> bool:
    """Whether a digest can be read and is another one."""
    known = digest_of(value)
    return known is not None and hashlib.new(known[0], what).digest() != known[1]


def _checked(data: bytes, start: int = 0) -> tuple[Record | None, str, int]:
    """The record at a place of some bytes, or why there is none: header, length, end mark, digests; and where it ends.

    The block's digest is checked for every record. The payload's is where no block digest can be read, but not for revisits and segments, whose payload is
    elsewhere, nor for blocks in a transfer or content coding, as writers differ in which form they take.
    """
    found = _headers(data, start)
    if found is None:
        return None, "no sound header", 0
    headers, at = found
    end = at + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, "length does not match", 0
    record = Record(0, 0, headers, data[at:end])
    whole = digest_of(headers.get("warc-block-digest"))
    if whole is not None:
        if _disagrees(headers["warc-block-digest"], record.block):
            return None, "warc-block-digest does not match", 0
    elif headers["warc-type"] != "revisit" and "warc-segment-number" not in headers and not record.coded and _disagrees(headers.get("warc-payload-digest"), record.payload):
        return None, "warc-payload-digest does not match", 0
    return record, "", end + 4


class _Window:
    """A file read in pieces, from any place on."""

    def __init__(self, path: str):
        self.file = reader(path)
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def get(self, start: int, length: int) -> bytes:
        if start < self.at or start + length > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(length, WINDOW))
        return self.data[start - self.at : start - self.at + length]

    def find(self, mark: bytes, start: int, stop: int) -> int:
        """The first place of a mark that begins in start..stop, or -1."""
        while start < stop:
            data = self.get(start, min(WINDOW, stop - start + len(mark) - 1, self.size - start))
            i = data.find(mark)
            if i >= 0:
                return start + i if start + i < stop else -1
            if start + len(data) >= min(self.size, stop + len(mark) - 1):
                return -1
            start += max(1, len(data) - len(mark) + 1)
        return -1


def _inflate(window: _Window, start: int, most: int) -> tuple[bytes, int] | str:
    """A gzip member's data and where it ends; what is wrong where it is broken, cut off or longer than `most`."""
    inflater, out, at, total = zlib.decompressobj(31), [], start, 0
    try:
        while not inflater.eof:
            piece = window.get(at, min(1 << 16, window.size - at))
            if not piece:
                return "gzip member is cut off"
            out.append(inflater.decompress(piece, most - total + 1))
            total += len(out[-1])
            if total > most:
                return f"longer than {most} bytes"
            at += len(piece) - len(inflater.unused_data) - len(inflater.unconsumed_tail)
    except zlib.error:
        return "broken gzip member"
    return b"".join(out), at


def _in_member(data: bytes, at: int, end: int) -> Iterator[Record | Failure]:
    """The sound records of a gzip member's data, and of each stretch without one where it begins and why.

    Several records of one member share its bytes in proportion to their own, so that what is lost inside it is a gap as well.
    """
    place = lambda i: at + i * (end - at) // len(data)
    here, whole = 0, True
    while here < len(data):
        record, why, stop = _checked(data, here)
        if record is not None:
            record.start, record.end, whole = place(here), place(stop), True
            yield record
            here = stop
            continue
        if whole:
            yield Failure(place(here), why)
        here, whole = data.find(PLAIN, here + 1), False
        if here < 0:
            return
    if not data:
        yield Failure(at, "no sound header")


def _plain(window: _Window, at: int, most: int, most_header: int) -> tuple[Record | None, int, str]:
    """The record that begins at a place and where it ends, or why there is none."""
    size = 1 << 14
    while True:
        data = window.get(at, min(size, window.size - at))
        if (found := _headers(data)) is not None:
            break
        if b"\r\n\r\n" in data or len(data) < size:
            return None, at, "no sound header"
        if size >= most_header:
            return None, at, f"header longer than {most_header} bytes"
        size = min(8 * size, most_header)
    end = at + found[1] + int(found[0]["content-length"]) + 4
    if end - at > most:
        return None, at, f"longer than {most} bytes"
    if end > window.size:
        return None, at, "length does not match"
    record, why, _ = _checked(window.get(at, end - at))
    return record, end, why


def salvage(path: str, start: int = 0, stop: int | None = None, most: int = RECORD_BYTES, most_header: int = HEADER_BYTES) -> Iterator[Record | Failure]:
    """The sound records that begin in start..stop, in order, and of each stretch without one where it begins and why.

    Where there is none, the search goes on at the next mark of a gzip member or a version line, and the mark says how to read it. A record (or member) of more than
    `most` bytes, or one whose header has more than `most_header`, is not read, and said so. A range that begins inside a record may find what only looks like one, or a failure that is
    none, as the record before covers it; chained() and gaps() drop those.
    """
    window = _Window(path)
    stop = window.size if stop is None else min(stop, window.size)
    ahead = {}  # the next place of either mark, looked for again once it is passed

    def nearest(at: int) -> int:
        for mark in (MAGIC, PLAIN):
            if mark not in ahead or 0 <= ahead[mark] < at:
                ahead[mark] = window.find(mark, at, stop)
        return min((x for x in ahead.values() if x >= 0), default=-1)

    at, whole = (start if start == 0 else nearest(start)), True
    while 0 <= at < stop:
        if window.get(at, len(MAGIC)) == MAGIC:
            got = _inflate(window, at, most)
            found, end = ([Failure(at, got)], at) if isinstance(got, str) else (list(_in_member(got[0], at, got[1])), got[1])
        else:
            record, end, why = _plain(window, at, most, most_header)
            if record is not None:
                record.start, record.end = at, end
            found = [Failure(at, why)] if record is None else [record]
        if any(isinstance(x, Record) for x in found):
            yield from found
            at, whole = end, True
            continue
        if whole:
            yield from found[:1]
        at, whole = nearest(at + 1), False


def scan_warc(archives: DataFrame, payloads: bool = False, most: int = RECORD_BYTES, most_header: int = HEADER_BYTES) -> DataFrame:
    """Records of archives (path string, bytes long) and failed checks, read by ranges, each range by any task.

    path, start, end (bytes of the record), record_type, record_id, target_uri, refers_to (string, as in the headers),
    payload_digest (of the header: bare hex), payload_bytes and payload_sha1 (of the payload itself; null for
    revisits, which have none), headers map, failure (the check that failed at start; such rows have no more than this and the path) and, if
    asked for, payload binary. Records that lie inside another one are still there. No archives give no rows; a null path is skipped; archives are taken
    once each, however often they are named.
    """
    schema = "path string, start long, end long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload_sha1 string, headers map<string,string>, failure string"
    schema += ", payload binary" * payloads

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                rows, held = [], 0
                for r in salvage(path, first, first + RANGE_BYTES, most, most_header):
                    if isinstance(r, Failure):
                        rows.append({"path": path, "start": r.start, "end": r.start, "failure": r.reason})
                        continue
                    h, revisit = r.headers, r.headers["warc-type"] == "revisit"
                    own = {} if revisit else {"payload_bytes": len(r.payload), "payload_sha1": hashlib.sha1(r.payload).hexdigest()}
                    rows.append({"path": path, "start": r.start, "end": r.end, "record_type": h["warc-type"], "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload_digest": _bare(h.get("warc-payload-digest")), "headers": list(h.items()), **own, **({"payload": r.payload} if payloads else {})})
                    held += len(r.block) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    text = ("path", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_sha1", "failure")
    names = [x.split()[0] for x in schema.replace("map<string,string>", "map").split(", ")]
    special = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    kind = pa.schema([(n, special.get(n) or (pa.string() if n in text else pa.int64())) for n in names])
    firsts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))
    wanted = archives.where("path is not null and bytes > 0").groupBy("path").agg(F.max("bytes").alias("bytes")).select("path", F.explode(firsts).alias("first"))
    parts = max(shuffle_partitions(archives.sparkSession), 1)
    return wanted.repartition(parts, "path", "first").mapInArrow(ranges, schema)


def _bare(value: str | None) -> str | None:
    """A digest in lower-case base 16 without its algorithm; one that cannot be read as it is."""
    known = digest_of(value)
    return known[1].hex() if known else (value or "").rpartition(":")[2].lower() or None


def read_warc(archives: DataFrame, payloads: bool = False, most: int = RECORD_BYTES) -> DataFrame:
    """The records of scan_warc() alone, without those that lie inside another one."""
    return chained(scan_warc(archives, payloads, most)).drop("failure")


def chained(found: DataFrame) -> DataFrame:
    """Drops failures, and records that begin inside an earlier one of their archive. One archive's records are ordered by a task."""
    records = found.where("failure is null") if "failure" in found.columns else found
    before = F.max("end").over(Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("_before", before).where("_before is null or _before <= start").drop("_before")


def gaps(found: DataFrame, archives: DataFrame) -> DataFrame:
    """The quarantined bytes: path, start, end of what no record of scan_warc() covers, up to the end of each archive, and the reason, the first failed check there."""
    ends = archives.where("path is not null").groupBy("path").agg(F.max("bytes").alias("start")).withColumn("end", F.col("start"))
    both = chained(found).select("path", "start", "end").unionByName(ends)
    before = F.max("end").over(Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    free = both.select("path", F.coalesce(before, F.lit(0)).alias("_from"), F.col("start").alias("_to")).where("_from < _to")
    failed = found.where("failure is not null").select(F.col("path").alias("_path"), F.col("start").alias("_at"), "failure")
    # both sides have a row for each damaged place alone
    joined = free.join(failed, (F.col("path") == F.col("_path")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")), "left")
    first = F.min(F.struct("_at", "failure"))["failure"]
    return joined.groupBy("path", F.col("_from").alias("start"), F.col("_to").alias("end")).agg(F.coalesce(first, F.lit("no mark of a record")).alias("reason"))


def write_warc(pages: DataFrame, least: int = 1000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each page (page_id, url, html) and returns the archives: path, bytes, records.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at least `least` bytes that
    with the largest page_id (null last) is a response and the others revisit it; of rows that tie there, each is a
    response. A null url or page_id is left out of the headers that name it. Other columns are not looked at.
    Payloads move once, dealt by their digest; a payload that very many pages share is split by Spark's skew join, since
    only the digest's largest page_id meets it.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    page = page.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("long", F.octet_length("html") >= least)
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("html").alias("html")).where(F.octet_length("html") >= least)
    thin = thin.groupBy(F.sha1(F.col("html").cast("binary")).alias("_digest")).agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1")
    joined = page.join(thin, (F.col("digest") == F.col("_digest")) & F.col("long"), "left")
    rows = joined.select("page_id", "url", "html", "digest", F.when(F.col("original") > F.coalesce("page_id", F.lit(-(1 << 63))), F.col("original")).alias("original"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, done, count = None, "", 0, 0
        finished = []
        for b in batches:
            for page_id, url, html, digest, original in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "original")), strict=True):
                payload = html.encode()
                headers = {"WARC-Type": "response" if original is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": "1970-01-01T00:00:00Z"}
                if url is not None:
                    headers["WARC-Target-URI"] = " ".join(url.split())
                headers["WARC-Payload-Digest"] = f"sha1:{digest}"
                headers["Content-Type"] = "application/http; msgtype=response"
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                if original is None:
                    block += payload
                else:
                    headers |= {"WARC-Refers-To": f"<urn:page:{original}>", "WARC-Profile": PROFILE, "X-Payload-Length": str(len(payload))}
                headers["WARC-Block-Digest"] = f"sha1:{hashlib.sha1(block).hexdigest()}"
                if out is None:
                    path = attempt_path(folder, ".warc.gz")
                    out, done, count = create(path), 0, 0
                data = member(record_bytes(headers, block))
                out.write(data)
                done, count = done + len(data), count + 1
                if done >= file_bytes:
                    out.close()
                    finished.append((path, done, count))
                    out = None
        if out is not None:
            out.close()
            finished.append((path, done, count))
        if finished:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*finished, strict=True)], ["path", "bytes", "records"])

    return stored(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-list")


def page_records(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has no payload of its own; its header X-Payload-Length states the full length. Archives that were just written have no
    damage: a gap in them is an error.
    """
    archives = write_warc(pages)
    found = stored(scan_warc(archives, payloads=False), "records")
    if (lost := gaps(found, archives).first()) is not None:
        raise RuntimeError(f"{lost.path}: bytes {lost.start} to {lost.end} cannot be read back: {lost.reason}")
    records = chained(found)
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        F.coalesce("payload_bytes", F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
