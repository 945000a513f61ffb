"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of a few records, and a seek table in a skippable frame at its
end. A record's place is its bundle, its frame and its offset in the frame once that is decompressed, so one record is
read by decompressing one frame. Bundles are the rows of a Parquet table, which any store that Spark can write holds.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairnflow.llm.common import broadcast_if_small, lookup, parts, saved

#: Fixed values of the seekable Zstandard format: magic numbers of the skippable frame and of the seek table's footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records from which a frame, and of frames from which a bundle, is closed; a longer record has its own frame.
FRAME, BUNDLE = 128 << 10, 4 << 20
#: Payloads from so many bytes on are stored once.
MIN_PAYLOAD = 100
DATE = "1970-01-01T00:00:00Z"
BUNDLES = "bundle_id string, bundle binary, places array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record: a response with the payload, or a revisit, whose block is an HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at `offset`."""
    stop = data.index(b"\r\n\r\n", offset)
    first, *lines = data[offset:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record starts here")
    head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    size = int(head["content-length"])
    return head, data[stop + 4 : stop + 4 + size], stop + 8 + size


class BundleWriter:
    """Gathers records into frames and frames into a bundle."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.start()

    def start(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_size = self.size = 0
        self.places: list[dict] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.places.append({"page_id": page_id, "frame": len(self.frames), "offset": self.open_size, "length": len(data)})
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_size))
            self.size += len(packed)
            self.open, self.open_size = [], 0

    def bundle(self) -> dict:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        data = b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table
        out = {"bundle_id": hashlib.sha256(data).hexdigest()[:32], "bundle": data, "places": self.places}
        self.start()
        return out


def seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(start, end) of each frame, as the footer at the bundle's end tells."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != FOOTER or flags:
        raise ValueError("no seek table")
    sizes = struct.unpack(f"<{2 * n}I", bundle[-9 - 8 * n : -9])[::2]
    ends = list(accumulate(sizes))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def read_frame(bundle: bytes, frame: int, table: list[tuple[int, int]] | None = None) -> bytes:
    start, end = (table or seek_table(bundle))[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start:end])


def _record_row(head: dict[str, str], block: bytes) -> dict:
    name = head["warc-record-id"][len("<urn:page:") : -1]
    body = block.index(b"\r\n\r\n") + 4
    size = next(int(x[16:]) for x in block[:body].split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest, payload, refers = head["warc-payload-digest"].removeprefix("sha256:"), None, None
    if head["warc-type"] == "response":
        payload = block[body:]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {name} is damaged")
    else:
        refers = int(head["warc-refers-to"][len("<urn:page:") : -1])
    return {"page_id": int(name) if name else None, "url": head["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": refers, "payload": payload}


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first): the rows whose payload a page of smaller id holds too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")).where((F.col("bytes") >= MIN_PAYLOAD) & F.col("page_id").isNotNull())
    keys = saved(keys.select("page_id", "digest"), "warc-keys")
    groups = saved(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("page_id").alias("first")).where("rows > 1"), "warc-groups")
    found = lookup(keys, groups, "digest", "rows", max(1, keys.count()))
    return saved(found.where("page_id > first").select("page_id", "digest", "first").distinct(), "warc-revisits")


def write_archive(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html); returns the bundles' table with the records' places.

    Of rows with equal payloads of MIN_PAYLOAD bytes or more, that of the smallest page_id is a response and the others
    revisit it; rows that share the smallest id are all responses, and rows of null ids are always responses. Null html
    is an empty payload. Other columns are not stored. Tasks write whole bundles; a task that runs again writes the same.
    """
    again = broadcast_if_small(revisits(pages)).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    rows = rows.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "html", "digest", "first")

    out = to_arrow_schema(StructType.fromDDL(BUNDLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()
        for batch in parts(batches):
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(page_id, record(page_id, url, html.encode(), digest, first, first is not None))
                if writer.size >= BUNDLE:
                    yield pa.RecordBatch.from_pylist([writer.bundle()], schema=out)
        if writer.places:
            yield pa.RecordBatch.from_pylist([writer.bundle()], schema=out)

    return saved(rows.mapInArrow(run, BUNDLES), "warc-bundles")


def _records(placed: DataFrame, payloads: bool) -> DataFrame:
    """The records at the places of `placed` (bundle, places): each frame that holds one is decompressed, once."""
    out = to_arrow_schema(StructType.fromDDL(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for data, places in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                table, at = seek_table(data), sorted(places.as_py(), key=lambda p: (p["frame"], p["offset"]))
                for frame, own in groupby(at, key=lambda p: p["frame"]):
                    text, rows = read_frame(data, frame, table), []
                    for place in own:
                        head, block, end = parse(text, place["offset"])
                        rows.append(_record_row(head, block))
                        if rows[-1]["page_id"] != place["page_id"] or end != place["offset"] + place["length"]:
                            raise ValueError(f"the map's record {place['page_id']} is not at its place")
                        if not payloads:
                            rows[-1]["payload"] = None
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return placed.mapInArrow(run, RECORDS)


def read_archive(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of `bundles`, each from the frame and offset that the map has for it.

    Payloads are checked against their digests, and returned if asked for; those of revisits are null. Null ids are null
    again, null urls and payloads empty. Repeated ids give a record each, and no bundles give no records.
    """
    return _records(bundles.select("bundle", "places"), payloads)


def archive_index(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle_id, frame, offset, length) of each record."""
    return bundles.select("bundle_id", F.explode("places").alias("p")).select("p.page_id", "bundle_id", "p.frame", "p.offset", "p.length")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the page_ids in `wanted`, with payloads: only the frames that hold them are decompressed.

    Ids that no record has give no rows, nor do null ids; a repeated wanted id counts once, and an id of two records gives
    both.
    """
    places = archive_index(bundles).join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    by_bundle = places.groupBy("bundle_id").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("at"))
    return _records(bundles.select("bundle_id", "bundle").join(by_bundle, "bundle_id").select("bundle", "at"), True)
