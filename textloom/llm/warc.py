"""WARC archives in seekable Zstandard bundles, written and read by Spark.

A bundle is one file of independent Zstandard frames, each holding whole WARC records, then an index (record identifier to
frame, offset within the frame, length) in a skippable frame, then the seek table in the public seekable format's
layout. Any zstd tool reads such a file from end to end; a reader that knows the footer decompresses just the frames it needs.

Spark's text sink writes the files, so they go to any store that Spark writes to. It puts a separator behind each row: the rows are
frames that end with the head of a skippable frame, whose content the separator is, and in the last row the separator is the seek table's own last number.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote_from_bytes

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, raw, scratch

#: Bytes of records in a frame, beyond which the next record starts another; a larger record has one of its own.
FRAME = 256 << 10
#: Frames in a bundle at most (64 MB of records, unless single ones are larger): what a task reads at once.
FRAMES = 256
# Fixed values of the Zstandard and seekable formats: magic numbers (little-endian), flag of checksums in the seek table.
_SKIPPABLE, _INDEX, _SEEK_TABLE, _SEEKABLE, _CHECKSUMS = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1, 0x80
_SEPARATOR = struct.pack("<I", _SEEKABLE)
_FILLER = struct.pack("<II", _SKIPPABLE, len(_SEPARATOR))
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<III")
_PLACE = struct.Struct("<IIIH")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def base32_sha1(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The identifier of a page's record; rows that repeat a page and its payload share it."""
    return f"urn:x-page:{'null' if page_id is None else page_id}:{digest}"


def page_of(identifier: str) -> int | None:
    """The page that an identifier names."""
    page = identifier.split(":")[2]
    return None if page == "null" else int(page)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None, captured: str) -> tuple[str, bytes]:
    """Identifier and bytes of a response record, or of a revisit record if ``payload`` is None."""
    name = record_id(page_id, digest)
    target = quote_from_bytes(url.encode("utf-8", "surrogateescape"), safe="!#$%&'()*+,-./:;=?@[]_~") if url else name
    headers = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", captured), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is None:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return name, _record(headers, http + (payload or b""))


class BundleWriter:
    """Turns records into the rows of bundles: each call of ``add`` or ``end`` gives the rows that are complete."""

    def __init__(self, captured: str, frame: int = FRAME, frames: int = FRAMES):
        self.captured, self.frame, self.frames = captured, frame, frames
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._open()

    def _open(self) -> None:
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[bytes] = []
        self.waiting: bytes | None = None  # the last finished frame: whether it ends its bundle is not known yet
        self.rows = 0
        self.records: list[bytes] = []
        self.size = 0

    def _entry(self, frame: bytes, content: bytes = b"") -> bytes:
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return frame

    def _put(self, name: str, record: bytes) -> None:
        frame = 2 * self.rows  # every frame of records is followed by one of filling
        encoded = name.encode()
        self.index.append(_PLACE.pack(frame, self.size, len(record), len(encoded)) + encoded)
        self.records.append(record)
        self.size += len(record)

    def _close_frame(self) -> Iterator[bytes]:
        content = b"".join(self.records)
        self.records, self.size = [], 0
        if self.waiting is not None:
            yield self.waiting + _FILLER
        if self.rows:
            self._entry(_FILLER + _SEPARATOR)
        self.waiting = self._entry(self.zstd.compress(content), content)
        self.rows += 1

    def _close(self) -> Iterator[bytes]:
        index = zstandard.compress(b"".join(self.index), 3)
        last = self.waiting + self._entry(struct.pack("<II", _INDEX, len(index)) + index)
        table = b"".join(_ENTRY.pack(*e) for e in self.entries)
        footer = _FOOTER.pack(len(self.entries), _CHECKSUMS, _SEEKABLE)
        yield last + struct.pack("<II", _SEEK_TABLE, len(table) + len(footer)) + table + footer[: -len(_SEPARATOR)]
        self._open()

    def add(self, name: str, record: bytes) -> Iterator[bytes]:
        if not self.rows and not self.records:
            about = "urn:x-page:warcinfo:" + base32_sha1(name.encode())
            self._put(about, _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{about}>"), ("WARC-Date", self.captured), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(name, record)
        if self.size >= self.frame:
            yield from self._close_frame()
            if self.rows == self.frames:
                yield from self._close()

    def end(self) -> Iterator[bytes]:
        if self.records:
            yield from self._close_frame()
        if self.rows:
            yield from self._close()


class Bundle:
    """A bundle's frames by number and its index, taken from its end; only frames that are asked for are decompressed."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        count, flags, magic = _FOOTER.unpack(self.content[-_FOOTER.size :])
        if magic != _SEEKABLE:
            raise ValueError("not a seekable bundle")
        entry = _ENTRY if flags & _CHECKSUMS else struct.Struct("<II")
        table = len(content) - _FOOTER.size - count * entry.size
        self.frames, at = [], 0
        for found in entry.iter_unpack(self.content[table : -_FOOTER.size]):
            self.frames.append((at, *found))
            at += found[0]
        if at != table - 8 or self.content[at : at + 4] != struct.pack("<I", _SEEK_TABLE):
            raise ValueError("the seek table does not cover the bundle")

    def frame(self, k: int) -> bytes:
        at, packed, size, *check = self.frames[k]
        out = zstandard.decompress(self.content[at : at + packed], max_output_size=size) if size else b""
        if len(out) != size or (check and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check[0]):
            raise ValueError(f"frame {k} is damaged")
        return out

    def index(self) -> Iterator[tuple[str, int, int, int]]:
        """Identifier, frame, offset in the frame and length of every record."""
        at, packed, *_ = self.frames[-1]
        magic, size = struct.unpack("<II", self.content[at : at + 8])
        if magic != _INDEX or size + 8 != packed:
            raise ValueError("a bundle without an index")
        held = zstandard.decompress(self.content[at + 8 : at + packed])
        at = 0
        while at < len(held):
            frame, offset, length, n = _PLACE.unpack_from(held, at)
            at += _PLACE.size + n
            yield held[at - n : at].decode(), frame, offset, length


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and the block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _page(headers: dict[str, str], block: bytes) -> tuple:
    """The row of a page's record; a response's digest and length are those of the payload that is there."""
    name, kind = headers["warc-record-id"].strip("<>"), headers["warc-type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(_HTTP_LENGTH.search(http)[1])
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {name} is damaged")
    refers = page_of(headers["warc-refers-to"].strip("<>")) if kind == "revisit" else None
    return name, page_of(name), headers.get("warc-target-uri"), kind, size, digest, refers, payload if kind == "response" else None


_ROW = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    if not with_payload:
        columns[-1] = [None] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, captured: str = "1970-01-01T00:00:00Z", frame: int = FRAME, frames: int = FRAMES) -> None:
    """Write a record for every row of ``pages(page_id, url, html)`` as bundles below ``path``.

    The payload is the html in UTF-8, null counts as empty. Of equal payloads of ``min_bytes`` bytes at least, the row with the smallest page_id becomes a
    response record with the payload, the others revisit records that name it; smaller payloads are all responses.
    A null page_id comes after all others. Rows that repeat the smallest page_id and its payload are one capture: all of them are responses with one
    identifier. A null url becomes the record's own identifier. An empty table gives no bundle; other columns are not read.

    Winners are found from digests alone. The one exchange of texts is their join with the digests that occur more than once, which
    Spark splits where one digest holds much of the table.
    """
    bound_batches(pages.sparkSession, 200)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), raw("html").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    kept = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep_id", F.lit(True).alias("several"))
    joined = rows.join(kept, "digest", "left")
    revisit = F.col("several").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    dealt = joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "n_bytes", "keep_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(captured, frame, frames)
        for batch in batches:
            for page, url, payload, digest, size, keep in zip(*(batch.column(k) for k in range(6)), strict=True):
                record = page_record(page.as_py(), url.as_py(), payload.as_py(), base64.b32encode(digest.as_py()).decode(), size.as_py(), keep.as_py(), captured)
                for row in writer.add(*record):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["row"])
        for row in writer.end():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["row"])

    packed = dealt.mapInArrow(pack, "row binary").select(F.col("row").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", frames).option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR.decode("latin-1")).option("compression", "none").text(path)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    bound_batches(spark, 4)
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every page's record below ``path``: ``(record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload)``.

    Frames are decompressed one after another and their checksums compared; a damaged bundle, frame or payload raises.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                bundle = Bundle(content.as_py())
                places: dict[int, list[tuple[int, int]]] = {}
                for _, frame, offset, length in bundle.index():
                    places.setdefault(frame, []).append((offset, length))
                for frame, held in places.items():
                    data = bundle.frame(frame)
                    parsed = [parse_record(data[at : at + n]) for at, n in held]
                    rows = [_page(*x) for x in parsed if x[0]["warc-type"] in ("response", "revisit")]
                    if rows:
                        yield _batch(rows, with_payload)

    return _bundles(spark, path).mapInArrow(unpack, _ROW)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, path, frame, offset, length)`` of every record, offset and length within the decompressed frame."""
    schema = pa.schema([("record_id", pa.string()), ("path", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(name, where.as_py(), *place) for name, *place in Bundle(content.as_py()).index()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _bundles(spark, path).mapInArrow(read, "record_id string, path string, frame long, offset long, length long")


def fetch_records(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records named in ``ids(record_id)``, in ``read_archive``'s columns: only the frames that hold one are decompressed."""
    wanted = archive_index(spark, path).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    # A bundle's records are bounded by its frames.
    places = wanted.groupBy("path").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, held in zip(batch.column(0), batch.column(1), strict=True):
                bundle, frames, rows = Bundle(content.as_py()), {}, []
                for place in held.as_py():
                    data = frames.get(place["frame"])
                    if data is None:
                        frames = {place["frame"]: (data := bundle.frame(place["frame"]))}
                    headers, block = parse_record(data[place["offset"] : place["offset"] + place["length"]])
                    if headers["warc-type"] != "warcinfo":
                        rows.append(_page(headers, block))
                if rows:
                    yield _batch(rows, True)

    sorted_places = places.select("path", F.sort_array("places").alias("places"))
    return _bundles(spark, path).join(sorted_places, "path").select("content", "places").mapInArrow(pick, _ROW)


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages are archived in the shared folder, then read back."""
    from .common import table

    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep_id
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, (k // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - k % 4 * 5)) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep_id THEN keep_id END AS refers_to
FROM p
"""
