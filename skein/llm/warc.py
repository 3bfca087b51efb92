"""WARC archives as seekable Zstandard bundles.

Writing. Records of a partition are grouped into frames of about a megabyte,
each compressed on its own; a bundle is a run of such frames that ends with a
seek table in a skippable frame (sizes and checksums of all frames, the public
seekable format), so any Zstandard reader reads the whole and ours reads one
frame by its number. The index table maps each record's id to its bundle, its
frame and its place inside the unpacked frame. Every attempt of a task writes
bundles of names of its own, and only those that the index names belong to the
archive: an attempt that was lost leaves a file that nobody reads.

Of records with equal payloads of at least ``LEAST`` bytes the one with the
largest id is the response; the others are revisits that hold its record id and
the payload's digest and length, but no payload. A record's id is a URN of the
row's id and a digest of url and payload.

Reading. ``read_bundles`` reads all frames that the index names, ``fetch`` only
those that hold the asked records. Digests of responses are computed again from
the bytes read. A frame that cannot be unpacked, or whose bytes differ from the
checksum, is one row with its problem; the other frames are not touched by it.

Defined results: a null payload is empty; a null url has no target header; a
url that is no printable ASCII is kept exactly in a header of its own; ids are
compared as they are in the table (a null id is smaller than any); rows with
the same id and payload are records of the same kind; rows that are equal in
all three columns are one record written as often as it occurs. Other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote_plus

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common
from skein.plans import session

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Unpacked bytes from which a frame ends, packed bytes from which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Unpacked bytes that one reading task takes.
TASK_BYTES = 64 << 20
LEVEL = 3

# Fixed values of the formats.
_SKIPPABLE, _SEEKABLE, _CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"

INDEX = "record_id string, page_id string, record_type string, bundle string, frame int, start long, length long"
RECORDS = (
    "record_id string, record_type string, page_id string, url string, payload binary, payload_bytes long, payload_digest string, "
    "refers_to string, bundle string, frame int, problem string"
)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"".join((_VERSION, head.encode(), b"\r\n", block, b"\r\n\r\n"))


def _target(url: str | None) -> list[tuple[str, str]]:
    if url is None:
        return []
    if url and all("!" <= c <= "~" for c in url):
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")), ("X-Target-Bytes", base64.b64encode(url.encode()).decode())]


def page_record(record_id: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit; ``digest`` is the payload's SHA-1 in hexadecimal digits."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *_target(url)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers_to:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    else:
        block += payload or b""
    return _record(fields, block)


class Bundle:
    """One file of independent frames and their seek table; frames are counted from 0."""

    def __init__(self, folder: str, date: str):
        store, where = fs.FileSystem.from_uri(folder)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        store.create_dir(where, recursive=True)
        self.out = store.open_output_stream(f"{where}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.written = 0
        info = b"software: skein\r\nformat: WARC File Format 1.1\r\n"
        self.open = [_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info)]
        self.open_bytes = len(self.open[0])

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and start of the record in it."""
        place = len(self.frames), self.open_bytes
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        plain = b"".join(self.open)
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.written += len(packed)
        self.open, self.open_bytes = [], 0

    def close(self) -> None:
        if self.open:
            self._end_frame()
        body = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), _CHECKED, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if bundle is not None and bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                bundle = bundle or Bundle(folder, date)
                record = page_record(r["record_id"], r["url"], r["payload"], r["size"], r["sha1"], r["refers_to"], date)
                frame, start = bundle.add(record)
                rows.append((r["record_id"], r["page_id"], "revisit" if r["refers_to"] else "response", bundle.name, frame, start, len(record)))
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        if bundle is not None:
            bundle.close()
        common.tidy()

    return run


def _record_id(page_id: Column, url: Column, key: Column) -> Column:
    own = F.substring(F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), key), 256), 1, 32)
    return F.concat(F.lit(_URN), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(":"), own)


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST, date: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``; the index is its table ``index``."""
    common.extra(pages, ("page_id", "url", "html"))
    spark = pages.sparkSession
    common.ship(spark)
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), payload.alias("payload"))
    key = F.sha2("payload", 256)
    long = F.octet_length("payload") >= least
    # Only the ids travel to find the response of a payload; the payloads are moved once, by the join.
    top = rows.where(long).groupBy(key.alias("same")).agg(F.max(F.struct("page_id", "url")).alias("top"))
    # A short payload meets nothing: its key is the row's own, so that no key is hot.
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.sha2(F.concat(F.coalesce("url", F.lit("")), F.col("payload")), 256)))
    told = rows.select("*", F.sha1("payload").alias("sha1"), key.alias("key"), F.octet_length("payload").cast("long").alias("size"), F.when(long, key).otherwise(alone).alias("same"))
    met = told.join(top.hint("shuffle_hash"), "same", "left")
    later = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    sent = met.select(
        _record_id(F.col("page_id"), F.col("url"), F.col("key")).alias("record_id"), F.col("page_id").cast("string").alias("page_id"), "url", F.when(~later, F.col("payload")).alias("payload"),
        "size", "sha1", F.when(later, _record_id(F.col("top.page_id"), F.col("top.url"), F.col("key"))).alias("refers_to"),
    )
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    sent.mapInArrow(_write(f"{folder}/bundles", stamp), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


class Reader:
    """Random access to one bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        store, where = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{where}/{name}")
        size = self.file.size()
        count, kind, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{name}: no seek table")
        width = 12 if kind & _CHECKED else 8
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.sums = [struct.unpack_from("<I", table, k * width + 8)[0] if width == 12 else None for k in range(count)]
        sizes = [struct.unpack_from("<II", table, k * width) for k in range(count)]
        self.sizes, at = [], 0
        for packed, plain in sizes:
            self.sizes.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.sizes[number]
        found = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        if len(found) != plain or (self.sums[number] is not None and xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != self.sums[number]):
            raise ValueError("the frame's bytes differ from its checksum")
        return found


def _headers(raw: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in raw.decode().split("\r\n")) if k}


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and where the next one starts; ValueError if it is malformed."""
    if not data.startswith(_VERSION, at):
        raise ValueError("no record starts here")
    end = data.index(b"\r\n\r\n", at)
    fields = _headers(data[at + len(_VERSION) : end])
    start, stop = end + 4, end + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    kind, url = fields["warc-type"], fields.get("warc-target-uri")
    if "x-target-bytes" in fields:
        url = base64.b64decode(fields["x-target-bytes"]).decode()
    found = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "url": url, "page_id": None, "payload": None, "payload_bytes": None, "payload_digest": None, "refers_to": None, "problem": None}
    found["page_id"] = page_of(found["record_id"])
    if kind in ("response", "revisit"):
        body = data.index(b"\r\n\r\n", start, stop) + 4
        size = int(_headers(data[data.index(b"\r\n", start) + 2 : body - 4])["content-length"])
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        found["refers_to"] = fields["warc-refers-to"].strip("<>") if kind == "revisit" else None
        if kind == "response":
            found["payload"] = data[body:stop]
            read = hashlib.sha1(found["payload"]).hexdigest()
            if read != digest or len(found["payload"]) != size:
                found["problem"] = "the payload differs from its digest"
            digest, size = read, len(found["payload"])
        found |= {"payload_bytes": size, "payload_digest": digest}
    return found, stop + 4


def page_of(record_id: str) -> str | None:
    if not record_id.startswith(_URN):
        return None
    return unquote_plus(record_id[len(_URN) :].rpartition(":")[0]) or None


def _found(rows: list[dict]) -> pa.RecordBatch:
    names = [c.split() for c in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names], [n for n, _ in names])


def _read(folder: str, with_payload: bool):
    """Rows (bundle, frame, starts): all records of a frame, or those at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            for r in batch.to_pylist():
                rows, place = [], {"bundle": r["bundle"], "frame": r["frame"]}
                try:
                    if name != r["bundle"]:
                        name, reader = None, Reader(folder, r["bundle"])
                        name = r["bundle"]
                    data = reader.frame(r["frame"])
                    if r["starts"] is None:
                        at = 0
                        while at < len(data):
                            found, at = parse_record(data, at)
                            rows.append(found | place)
                    else:
                        rows += [parse_record(data, at)[0] | place for at in r["starts"]]
                except (ValueError, KeyError, IndexError, OSError, struct.error, zstandard.ZstdError) as problem:
                    rows.append(place | {"problem": f"{type(problem).__name__}: {problem}"[:200]})
                if not with_payload:
                    for x in rows:
                        x["payload"] = None
                yield _found(rows)
        common.tidy()

    return run


def _spread(frames: DataFrame, unpacked: int) -> DataFrame:
    """Frames in tasks of about ``TASK_BYTES``, neighbours together."""
    tasks = max(frames.sparkSession.sparkContext.defaultParallelism, -(-unpacked // TASK_BYTES))
    return frames.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")


def read_bundles(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archive (columns ``RECORDS``), pages and damaged frames alike, without the bundles' own descriptions."""
    common.ship(spark)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    unpacked = index.agg(F.sum("length")).first()[0] or 0
    frames = index.select("bundle", "frame", F.lit(None).cast("array<long>").alias("starts")).distinct()
    found = _spread(frames, unpacked).mapInArrow(_read(f"{folder}/bundles", with_payload), RECORDS)
    return found.where("problem is not null or record_type <> 'warcinfo'")


def fetch(spark: SparkSession, folder: str, record_ids: DataFrame) -> DataFrame:
    """The records of the given ids (column record_id), reading only the frames that hold them; unknown ids give no row."""
    common.ship(spark)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    asked = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    # A frame has a bounded number of records: its size is.
    frames = asked.groupBy("bundle", "frame").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return _spread(frames, 0).mapInArrow(_read(f"{folder}/bundles", True), RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    folder = session.scratch(spark, "warc")
    write_bundles(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    back = read_bundles(spark, folder, with_payload=False)
    referred = F.nullif(F.url_decode(F.regexp_extract("refers_to", rf"^{_URN}(.*):[0-9a-f]+$", 1)), F.lit(""))
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", referred.cast("long").alias("refers_to"))


OP13_SQL = r"""
with told as (
  select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
), topped as (
  select *, max(page_id) over (partition by payload) as top from told
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, sha1(payload) as payload_digest,
  case when payload_bytes < 1000 or top is not distinct from page_id then 'response' else 'revisit' end as record_type,
  case when payload_bytes < 1000 or top is not distinct from page_id then null else top end as refers_to
from topped
"""
