"""Seekable Zstandard bundles of WARC records (operator 7).

Records are grouped into frames of about ``FRAME`` bytes that are compressed one by
one; a bundle is frames and a seek table in a skippable frame at its end, as in the
seekable Zstandard format, so any Zstandard reader can also read it from the start.
The index maps a record to (bundle, frame, offset in the frame, length): to read it,
only that frame is decompressed.

Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest
page_id is a response, the others revisit it and hold no payload. Which is which is
found on digests alone; the pages move once, to be joined with that.

Bundles are rows of a table in the shared folder, as a store that only Spark can
reach takes no other files from a task; ``export`` writes them as files where the
folder is mounted.

Defined results: null html is an empty payload; a page without an id ranks last;
rows that repeat a page_id and a payload are of the same type; line breaks in a URL
are removed and a null URL is named after its page; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillvault.llm.common import task_base, written

LEAST = 100
FRAME = 1 << 18
BUNDLE = 1 << 23
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BUNDLE_TYPE = "bundle string, data binary, records array<struct<page_id:long,frame:int,offset:int,length:int>>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the payload's full length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "null" if page_id is None else str(page_id)
    target = "".join((url or f"urn:page:{name}").split("\r")).replace("\n", "")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    block = head + (payload if refers_to is None else b"")
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Bundle:
    """Frames that are gathered, and the places of their records."""

    frames: list[bytes] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    places: list[dict] = field(default_factory=list)
    open: bytearray = field(default_factory=bytearray)
    coder: zstandard.ZstdCompressor = field(default_factory=lambda: zstandard.ZstdCompressor(level=LEVEL))

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > FRAME:
            self.close_frame()
        self.places.append({"page_id": page_id, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(self.coder.compress(bytes(self.open)))
            self.sizes.append(len(self.open))
            self.open = bytearray()

    @property
    def size(self) -> int:
        return sum(map(len, self.frames))

    def bytes(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes))
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the bundle's last bytes."""
    count, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    begin = len(data) - 9 - width * count
    kind, size = struct.unpack("<II", data[begin - 8 : begin])
    if kind != SKIPPABLE_MAGIC or size != len(data) - begin:
        raise ValueError("damaged seek table")
    out, at = [], 0
    for i in range(count):
        packed, whole = struct.unpack_from("<II", data, begin + width * i)
        out.append((at, packed, whole))
        at += packed
    return out


def frame_of(data: bytes, number: int) -> bytes:
    at, packed, whole = seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=whole)


def record_at(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, by decompressing its frame alone."""
    return frame_of(data, frame)[offset : offset + length]


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines if ": " in line)}


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def parse(frame: bytes) -> Iterator[tuple]:
    """(page_id, payload bytes, digest, type, refers_to, offset, length) of the records; digests are checked."""
    at = 0
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        version, *lines = frame[at : body - 4].decode().split("\r\n")
        head = _fields(lines)
        end = body + int(head["content-length"])
        if not version.startswith("WARC/") or frame[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"damaged record at {at}")
        payload = frame.index(b"\r\n\r\n", body, end) + 4
        http = _fields(frame[body : payload - 4].decode().split("\r\n"))
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(frame[payload:end]).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
        refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
        yield _page(head["warc-record-id"]), int(http["content-length"]), digest, kind, refers, at, end + 4 - at
        at = end + 4


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle, number, base = Bundle(), 0, task_base(0)

    def row() -> pa.RecordBatch:
        name = f"pages-{base:06d}-{number:05d}"
        records = pa.array([bundle.places], pa.list_(pa.struct([("page_id", pa.int64()), *((n, pa.int32()) for n in ("frame", "offset", "length"))])))
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([bundle.bytes()], pa.binary()), records], ["bundle", "data", "records"]
        )

    for batch in batches:
        ids, urls, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for page_id, url, html, digest, refers_to in zip(ids, urls, batch.column(2), digests, refers):
            bundle.add(page_id, record(page_id, url, html.as_py().encode(), digest, refers_to))
            if bundle.size >= BUNDLE:
                yield row()
                bundle, number = Bundle(), number + 1
    if bundle.places:
        yield row()


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages as a written table of bundles (bundle, data, records)."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].alias("url"),
        F.coalesce(pages[html_col], F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    small = rows.filter(F.octet_length("html") >= LEAST).select("page_id", "digest")
    # Counted per digest before the shuffle, so a group of any size is a row a task.
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1")
    revisits = small.join(firsts, "digest").filter("page_id IS NULL OR page_id > refers_to")
    revisits = revisits.filter("refers_to IS NOT NULL").select(
        F.col("page_id").alias("of"), F.col("digest").alias("equal"), "refers_to"
    )
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("equal"))
    typed = rows.join(revisits.distinct(), same, "left").select("page_id", "url", "html", "digest", "refers_to")
    return written(typed.mapInArrow(_bundles, _BUNDLE_TYPE), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, with its place."""
    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "bundle string, frame int, offset int, length int"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                for number in range(len(seek_table(data))):
                    rows = [
                        (page, n, digest, kind, refers, name, number, offset, length)
                        for page, n, digest, kind, refers, offset, length in parse(frame_of(data, number))
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return bundles.select("bundle", "data").mapInArrow(run, schema)


def index(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle, frame, offset, length) of every record."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*")


def read_at(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, record): the records of ``wanted`` (page_id), each by its frame alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                for r in row["wanted"]:
                    found.append((r["page_id"], record_at(row["data"], r["frame"], r["offset"], r["length"])))
            if found:
                ids, records = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(records, pa.binary())], ["page_id", "record"])

    places = index(bundles).join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    # A bundle has as many records as fit its size, so its list is bounded.
    per_bundle = places.groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("wanted"))
    return bundles.select("bundle", "data").join(per_bundle, "bundle").select("data", "wanted").mapInArrow(
        run, "page_id long, record binary"
    )


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes ``<folder>/<bundle>.warc.zst``; ``folder`` is mounted on every executor. Safe to repeat."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, data in zip(names, batch.column(1)):
                place = f"{folder}/{name}.warc.zst"
                with open(f"{place}.{task_base(0)}.part", "wb") as out:
                    sizes.append(out.write(data.as_py()))
                os.replace(out.name, place)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["bundle", "bytes"])

    return bundles.select("bundle", "data").mapInArrow(run, "bundle string, bytes long")


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes the pages to bundles and reads every record back."""
    return read_bundles(write_bundles(pages, **columns))
