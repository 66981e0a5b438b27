"""ARC archives read and turned into WARC, and WARC archives written and read."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh_path, materialise, ready_workers, salted_join

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 1000
#: Fields of an ARC record line, by the version in the archive's first record (fixed by the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_LEGEND = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Page rows in one Arrow batch, bytes of payload in one archive, and bytes that are unpacked at once.
BATCH_ROWS, ARCHIVE_BYTES, PIECE_BYTES = 200, 32 << 20, 1 << 16
#: What pages without them get as address and date.
ARC_IP, ARC_DATE = "0.0.0.0", "20240101000000"
#: Stands between a page's URL and its id in an ARC line.
IDENTITY = "#page-id="
#: A gzip member that holds nothing (fixed by the format).
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])

T = TypeVar("T")


class ArchiveError(ValueError):
    """An archive that doesn't follow its format."""


@dataclass
class ArcRecord:
    fields: dict[str, str]
    payload: bytes


def arc_header(name: str, date: str, version: int) -> bytes:
    """The version record that an ARC archive begins with."""
    body = f"{version} 0 tallyloom\n{ARC_LEGEND[version]}\n".encode()
    line = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        line += ["200", "-", "-", "0", name]
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, payload: bytes) -> bytes:
    line = [url, ip, date, kind]
    if version == 2:
        line += ["200", "-", "-", "0", "-"]
    return " ".join([*line, str(len(payload))]).encode() + b"\n" + payload + b"\n"


class ByteStream:
    """Lines and runs of bytes of a stream that comes in pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def line(self) -> bytes | None:
        """The next line with its end, or what is left without one; None at the end."""
        seen = 0
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                end = len(self.held) - 1
                break
        return self.take(end + 1) or None

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        while len(self.held) < n and self._more():
            pass
        with memoryview(self.held) as held:
            out = bytes(held[:n])
        del self.held[:n]
        return out


def unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces: as they are, or of all its gzip members."""
    view = memoryview(data).cast("B")
    if view[:2] != b"\x1f\x8b":
        for at in range(0, len(view), PIECE_BYTES):
            yield bytes(view[at : at + PIECE_BYTES])
        return
    inflate, open_member = zlib.decompressobj(31), False
    for at in range(0, len(view), PIECE_BYTES):
        rest = bytes(view[at : at + PIECE_BYTES])
        while rest:
            got, open_member = inflate.decompress(rest), not inflate.eof
            if got:
                yield got
            rest = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    if open_member:
        raise ArchiveError("a gzip member has no end")


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive, plain or gzip, after its version record, by their lines and declared lengths.

    The version record names the version, which says what fields a record line has. URLs may
    hold spaces, so a line is split from its right end. Blank lines between records are skipped.
    """
    stream, version = ByteStream(unpacked(data)), 0
    while (raw := stream.line()) is not None:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            continue
        if not raw.endswith(b"\n"):
            raise ArchiveError("an ARC record line has no end")
        if not version:
            values = line.rsplit(" ", 1)
            if not line.startswith("filedesc://") or not values[-1].isdigit():
                raise ArchiveError("an ARC archive must begin with its version record")
            length = int(values[-1])
            block = stream.take(length)
            said = block.split(b"\n", 1)[0].split(b" ", 1)[0]
            if not said.isdigit() or int(said) not in ARC_FIELDS:
                raise ArchiveError(f"unknown ARC version {said!r}")
            version = int(said)
        else:
            names = ARC_FIELDS[version]
            values = line.rsplit(" ", len(names) - 1)
            if len(values) != len(names) or not values[-1].isdigit():
                raise ArchiveError(f"not an ARC record line: {line[:80]!r}")
            fields = dict(zip(names, values, strict=True))
            length = int(fields["length"])
            block = stream.take(length)
            if len(block) == length:
                yield ArcRecord(fields, block)
        if len(block) != length:
            raise ArchiveError("an ARC record is shorter than it says")


def warc_date(date: str) -> str:
    """WARC form of an ARC date of 14 digits, or of 12 or fewer: the missing ones are the earliest."""
    if not re.fullmatch(r"\d{4,14}", date):
        raise ArchiveError(f"not an ARC date: {date!r}")
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: str) -> str:
    """The same identifier each time that the same record is made."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record, its lengths declared."""
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def converted(arc: ArcRecord, holder: str | None) -> bytes:
    """The WARC record that stands for an ARC record: a response, or a revisit of the holder's response."""
    url, page = split_identity(arc.fields["url"])
    sha1 = hashlib.sha1(arc.payload).digest()
    digest = "sha1:" + base64.b32encode(sha1).decode()
    fields = {
        "WARC-Record-ID": record_id("page", page) if page else record_id(url, arc.fields["date"]),
        "WARC-Date": warc_date(arc.fields["date"]),
        "WARC-Target-URI": url,
        "WARC-IP-Address": arc.fields["ip"],
        "WARC-Payload-Digest": digest,
        "Content-Type": arc.fields["type"],
        "X-Page-ID": page,
    }
    if holder is None:
        return warc_record("response", fields | {"WARC-Block-Digest": digest}, arc.payload)
    more = {
        "WARC-Profile": REVISIT_PROFILE,
        "WARC-Refers-To": record_id("page", holder),
        "X-Refers-To-Page": holder,
        "X-Payload-Length": str(len(arc.payload)),
    }
    return warc_record("revisit", fields | more, b"")


def warc_info(name: str, date: str) -> bytes:
    """The warcinfo record that stands for an archive's version record."""
    fields = {"WARC-Record-ID": record_id("file", name), "WARC-Date": warc_date(date), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return warc_record("warcinfo", fields, b"software: tallyloom\r\nformat: WARC File Format 1.1\r\n")


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of a WARC archive, plain or gzip, by their declared lengths."""
    stream = ByteStream(unpacked(data))
    while (raw := stream.line()) is not None:
        if not raw.startswith(b"WARC/"):
            raise ArchiveError("not a WARC record")
        fields = {}
        while (raw := stream.line()) not in (b"\r\n", None):
            name, _, value = raw.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[name] = value
        block = stream.take(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or stream.take(4) != b"\r\n\r\n":
            raise ArchiveError("a WARC record has another length than it says")
        yield fields, block


def clean_url(url: str | None) -> str:
    """A URL that fits on an ARC line: line ends and controls are escaped; null: urn:none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def with_identity(url: str | None, page_id: object) -> str:
    """The URL of an ARC line that also carries the row's id, as a fragment: archived URLs have none of their own."""
    return f"{clean_url(url)}{IDENTITY}{'' if page_id is None else page_id}"


def split_identity(url: str) -> tuple[str, str]:
    """URL and id of with_identity(); a URL without one has an empty id."""
    plain, mark, page = url.rpartition(IDENTITY)
    return (plain, page) if mark else (url, "")


def in_runs(items: Iterable[tuple[int, T]], limit: int) -> Iterator[list[T]]:
    """The items in runs whose sizes add up to at most limit, or one larger item."""
    run: list[T] = []
    held = 0
    for size, item in items:
        if run and held + size > limit:
            yield run
            run, held = [], 0
        run.append(item)
        held += size
    if run:
        yield run


def members(records: Iterable[bytes]) -> bytes:
    """A gzip file with a member for each record, so that a reader can begin at any."""
    out = []
    for record in records:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += [squeeze.compress(record), squeeze.flush()]
    return b"".join(out)


def written(archives: DataFrame, path: str) -> None:
    """Write a file for each binary value, by Spark's own writer, so that any store and any lost task will do.

    Its text writer puts a line end after each value; that is made an empty gzip member here.
    """
    archives.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files that written() made."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = ARC_DATE, limit: int = ARCHIVE_BYTES) -> None:
    """Write gzip ARC archives of all pages under path, of versions 1 and 2 in turn, each of at most
    limit bytes of payload or one longer page."""
    ready_workers(pages.sparkSession, BATCH_ROWS)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[str, bytes]]]:
        for batch in batches:
            for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                yield len(payload) + 1000, (with_identity(url.as_py(), page.as_py()), payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = TaskContext.get().partitionId() % 2 + 1
        for some in in_runs(sized(batches), limit):
            head = arc_header(f"{uuid.uuid4().hex}.arc.gz", date, version)
            archive = members([head, *(arc_record(version, url, ARC_IP, date, "text/html", payload) for url, payload in some)])
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["value"])
            version = 3 - version

    written(pages.select("page_id", "url", "html").mapInArrow(run, "value binary"), path)


def arc_digests(arcs: DataFrame, page_id_type: str) -> DataFrame:
    """path, ordinal, page_id, digest (bare SHA-1) and n (bytes) of the records of ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                got = [(split_identity(r.fields["url"])[1] or None, hashlib.sha1(r.payload).digest(), len(r.payload)) for r in read_arc(content.as_buffer())]
                ids, digests, sizes = zip(*got, strict=True) if got else ((), (), ())
                columns = [[path] * len(got), list(range(len(got))), list(ids), list(digests), list(sizes)]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "ordinal", "page_id", "digest", "n"])

    found = arcs.mapInArrow(run, "path string, ordinal int, page_id string, digest binary, n long")
    return found.withColumn("page_id", F.col("page_id").cast(page_id_type))


def revisits(digests: DataFrame, least_bytes: int) -> DataFrame:
    """(path, marks): of each file the records that are revisits, as (ordinal, holder).

    Of records with equal payloads of at least least_bytes, that of the largest page_id is the
    response and the others revisit it. Decided on digests alone; those of a common page are dealt
    over salts.
    """
    large = digests.where(F.col("n") >= least_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("_weight")).where(F.col("_weight") > 1)
    groups = materialise(groups.where(F.col("holder").isNotNull()), "holders")
    spread = F.xxhash64("path", "ordinal")
    met = salted_join(large, groups.select("digest", "holder"), ["digest"], groups.select("digest", "_weight"), spread)
    met = met.where(F.col("page_id").isNull() | (F.col("page_id") != F.col("holder")))
    return met.groupBy("path").agg(F.collect_list(F.struct("ordinal", F.col("holder").cast("string").alias("holder"))).alias("marks"))


def write_warc(arcs: DataFrame, marks: DataFrame, path: str) -> None:
    """Convert each ARC file to a gzip WARC archive under path: a warcinfo record for its version record,
    then a record for each of its own, the marked ones as revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, marked in zip(batch.column("content"), batch.column("marks").to_pylist(), strict=True):
                holders = {m["ordinal"]: m["holder"] for m in marked or ()}
                records = (converted(arc, holders.get(i)) for i, arc in enumerate(read_arc(content.as_buffer())))
                archive = members([warc_info(f"{uuid.uuid4().hex}.warc.gz", ARC_DATE), *records])
                yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["value"])

    written(arcs.join(marks, "path", "left").select("content", "marks").mapInArrow(run, "value binary"), path)


def read_warc_pages(spark: SparkSession, path: str, page_id_type: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the page records under path.

    A response's digest is computed from its block again and must be the one it carries.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows(content: pa.Buffer) -> Iterator[tuple]:
        for fields, block in read_warc(content):
            kind = fields["WARC-Type"]
            if kind == "warcinfo":
                continue
            sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
            if kind == "response" and hashlib.sha1(block).digest() != sha1:
                raise ArchiveError("a WARC payload differs from its digest")
            size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(block)
            yield fields["X-Page-ID"] or None, size, sha1.hex(), kind, fields.get("X-Refers-To-Page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                columns = list(zip(*rows(content.as_buffer()), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return (
        files(spark, path)
        .select("content")
        .mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
        .withColumn("page_id", F.col("page_id").cast(page_id_type))
        .withColumn("refers_to", F.col("refers_to").cast(page_id_type))
    )


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as ARC archives, convert these to WARC archives, and read the latter back.

    pages: page_id, url, html; other columns are ignored. Returns a row for each row: page_id,
    payload_bytes, payload_digest (bare lower-case hex SHA-1 of the full payload), record_type,
    refers_to. Null html is an empty payload; null url becomes urn:none; a null page_id comes back
    as null and never holds a payload for others unless all are null; of repeated rows with one
    page_id all are responses; an empty table gives no rows. The table has neither address nor date,
    so ARC lines carry 0.0.0.0 and ARC_DATE.

    Archives hold at most limit bytes of payload, or one longer page, a gzip member a record, and are
    read as streams. Payloads are bytes from the first ARC record on, of any encoding. Which record
    is a revisit is decided on digests, and only the decision goes back to the ARC file's reader.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    arc_path, warc_path = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc_path, limit=limit)
    arcs = files(spark, arc_path)
    digests = materialise(arc_digests(arcs, kind), "digests")
    write_warc(arcs, materialise(revisits(digests, least_bytes), "revisits"), warc_path)
    return read_warc_pages(spark, warc_path, kind)
