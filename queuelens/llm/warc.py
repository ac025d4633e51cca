"""Dictionary-compressed WARC archives: a Zstandard dictionary from the records, then one frame per record.

Files
    An archive is a folder of part files. Each part starts with a skippable frame (magic 0x184D2A5D) that holds the
    dictionary, followed by a warcinfo record and the records, each compressed on its own, so that any record can be
    read alone. Spark's text writer puts the parts down, with its commit protocol and on every file system Spark knows: a line is a
    frame, and the line separator is itself a whole, empty skippable frame (``SEPARATOR``; all of its bytes are ASCII). A
    reader of Zstandard passes over it, and Spark's text reader splits a part there, so that a large part is read by many
    tasks. Compressed data that would hold the separator by chance is cut into further blocks at that place. (The parts keep Spark's
    names, since a ``.zst`` ending would make the text reader apply a codec of its own.)

Dictionary
    Trained on the first ``SAMPLE_BYTES`` of about ``SAMPLE_RECORDS`` records (at most twice as many), those with the
    smallest hashes over the whole table. It steers the compression only. Too few records to train on give an archive without the dictionary frame.

Copies
    Each row is compressed once, as a response, and stored with its digests. Rows with equal payloads (SHA-256 and
    length) of at least ``min_bytes`` are brought together by digest only: the smallest id (null last; of repeated ids the row that
    was read first) keeps its response, the others become revisit records that name it. Digests with many copies are looked up in a
    broadcast of at most ``MOST_HOT`` rows, which also drops their payloads before the shuffle; the others are joined.

Reading checks lengths and the digest of every payload, and raises ``ValueError`` on a record that is broken.

Edge cases: a null payload is empty; a null id or url has no header and reads back as null; control characters and spaces of a url are
percent-encoded; repeated rows are records of their own; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.session import scratch_dir

from .common import materialize

#: An empty skippable frame: magic 0x184D2A50 and length 0, little-endian.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
DICTIONARY_MAGIC = struct.pack("<I", 0x184D2A5D)
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 110 << 10
MOST_HOT, OUT_BYTES = 10_000, 8 << 20
LEVEL = 3
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
ID_FIELD, REFERS_FIELD = "Row-Id", "Refers-To-Row-Id"

CODED = "at bigint, id bigint, url string, digest string, payload_bytes bigint, key binary, frame binary"
RECORDS = ("id bigint, url string, record_id string, record_type string, date string, payload_bytes bigint, "
           "payload_digest string, refers_to bigint, refers_to_record string, payload binary")


# --- records --------------------------------------------------------------------------------

def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(at: int, row_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row_id}/{at}/{digest}')}>"


def _uri(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7F]", lambda m: b"%%%02X" % m[0][0], url.encode())


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1"]
    lines += [name.encode() + b": " + (value if isinstance(value, bytes) else str(value).encode())
              for name, value in fields if value is not None]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def _fields(kind: str, at: int, row_id: int | None, url: str | None, digest: str, date: str) -> list[tuple[str, object]]:
    return [("WARC-Type", kind), ("WARC-Record-ID", record_id(at, row_id, digest)), ("WARC-Date", date),
            ("WARC-Target-URI", None if url is None else _uri(url)), (ID_FIELD, row_id),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]


def response(at: int, row_id: int | None, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    return _record(_fields(RESPONSE, at, row_id, url, digest, date), _http(len(payload)) + payload)


def revisit(at: int, row_id: int | None, url: str | None, size: int, digest: str, date: str, of_at: int, of_id: int | None,
            of_url: str | None) -> bytes:
    fields = _fields(REVISIT, at, row_id, url, digest, date)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(of_at, of_id, digest)), (REFERS_FIELD, of_id),
               ("WARC-Refers-To-Target-URI", None if of_url is None else _uri(of_url)), ("WARC-Refers-To-Date", date)]
    return _record(fields, _http(size))


def _headers(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """(first line, fields, rest)."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("a header block without an end")
    first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return first, {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}, rest


def parsed(data: bytes) -> dict[str, object] | None:
    """A response or revisit record as a row; None for other kinds of record."""
    first, fields, rest = _headers(data)
    size = int(fields["content-length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record with a wrong length or version")
    kind = fields["warc-type"]
    if kind not in (RESPONSE, REVISIT):
        return None
    _, http, payload = _headers(rest[:size])
    digest, length = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if kind == RESPONSE and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    number = {name: int(fields[name.lower()]) if name.lower() in fields else None for name in (ID_FIELD, REFERS_FIELD)}
    return {"id": number[ID_FIELD], "url": fields.get("warc-target-uri"), "record_id": fields["warc-record-id"],
            "record_type": kind, "date": fields["warc-date"], "payload_bytes": length, "payload_digest": digest,
            "refers_to": number[REFERS_FIELD], "refers_to_record": fields.get("warc-refers-to"),
            "payload": payload if kind == RESPONSE else None}


# --- frames ---------------------------------------------------------------------------------

class Codec:
    """Compresses and expands records with one dictionary (empty: none)."""

    def __init__(self, dictionary: bytes):
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
        self.expander = zstandard.ZstdDecompressor(dict_data=held)

    def frame(self, record: bytes) -> bytes:
        out = self.compressor.compress(record)
        step = 1 << 14
        while SEPARATOR in out:
            # end a block inside every separator of the record, then also in ever shorter runs
            cuts = sorted({m.start() + 3 for m in re.finditer(re.escape(SEPARATOR), record)} | set(range(step, len(record), step)))
            made = self.compressor.compressobj(size=len(record))
            out = b"".join(made.compress(record[a:b]) + made.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
                           for a, b in zip([0, *cuts], [*cuts, len(record)])) + made.flush()
            step = max(1, step // 3)
        return out

    def record(self, frame: bytes) -> bytes:
        return self.expander.decompress(frame)


def dictionary_frame(dictionary: bytes) -> bytes:
    for level in range(1, 23):
        body = zstandard.ZstdCompressor(level=level).compress(dictionary)
        if SEPARATOR not in body:
            return DICTIONARY_MAGIC + struct.pack("<I", len(body)) + body
    raise ValueError("the dictionary cannot be written without the separator")


def trained(records: list[bytes]) -> bytes:
    """A dictionary from sample records; empty if they are too few or too short."""
    if not records:
        return b""
    try:
        size = min(DICTIONARY_BYTES, max(1 << 10, sum(map(len, records)) // 10))
        return zstandard.train_dictionary(size, records, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _out(rows: Iterable[dict], schema: pa.Schema, size_of: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``OUT_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[size_of] or b"") + 200
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


# --- writing --------------------------------------------------------------------------------

def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
          date: str = "1970-01-01T00:00:00Z", path: str | None = None) -> str:
    """Write an archive of all rows and return its folder (by default below the shared work folder)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    # a hash range that about SAMPLE_RECORDS rows fall into; the limit bounds what repeated rows could add
    share = int(min(1.0, SAMPLE_RECORDS / max(1, rows.count())) * (1 << 40)) + 1
    chosen = (rows.where(F.pmod(F.xxhash64("id", "payload"), F.lit(1 << 40)) < share)
              .select(F.substring("payload", 1, SAMPLE_BYTES).alias("payload"))
              .limit(2 * SAMPLE_RECORDS).collect())
    dictionary = trained([response(k, k, "http://example.org/", bytes(r.payload), sha1_base32(r.payload), date)
                          for k, r in enumerate(chosen)])
    coded_schema = pa.schema([("at", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
                              ("payload_bytes", pa.int64()), ("key", pa.binary()), ("frame", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(dictionary)

        def coded() -> Iterator[dict]:
            for batch in batches:
                for at, row_id, url, payload in zip(*[batch.column(c) for c in ("at", "id", "url", "payload")]):
                    at, row_id, url, payload = at.as_py(), row_id.as_py(), url.as_py(), payload.as_py()
                    digest = sha1_base32(payload)
                    yield {"at": at, "id": row_id, "url": url, "digest": digest, "payload_bytes": len(payload),
                           "key": hashlib.sha256(payload).digest(),
                           "frame": codec.frame(response(at, row_id, url, payload, digest, date))}

        yield from _out(coded(), coded_schema, "frame")

    coded = materialize(rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(encode, CODED), "warc-coded")
    placed = _with_first(coded, min_bytes)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(dictionary)

        def values() -> Iterator[dict]:
            for n, batch in enumerate(batches):
                if not n:
                    if dictionary:
                        yield {"value": dictionary_frame(dictionary)}
                    yield {"value": codec.frame(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                                         ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                                                        b"format: WARC File Format 1.1\r\n"))}
                for row in batch.to_pylist():
                    first = row.pop("first")
                    frame = row["frame"] if first is None else codec.frame(revisit(
                        row["at"], row["id"], row["url"], row["payload_bytes"], row["digest"], date, first["at"], first["id"], first["url"]))
                    yield {"value": frame}

        yield from _out(values(), pa.schema([("value", pa.binary())]), "value")

    path = path or scratch_dir(spark, "warc")
    (placed.mapInArrow(lines, "value binary").select(F.col("value").cast("string")).write
     .option("lineSep", SEPARATOR.decode()).option("compression", "none").option("maxRecordsPerFile", 0).text(path))
    return path


def _with_first(coded: DataFrame, min_bytes: int) -> DataFrame:
    """``coded`` with ``first`` (id, at, url) of the response that a row is a copy of; null for responses."""
    groups = materialize(coded.where(F.col("payload_bytes") >= min_bytes).groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at", "url")).alias("f"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("key", F.struct("f.id", "f.at", "f.url").alias("first"), "copies"), "warc-copies")
    limit = 1000
    while groups.where(F.col("copies") > limit).count() > MOST_HOT:
        limit *= 2
    hot = F.broadcast(groups.where(F.col("copies") > limit).select(F.col("key").alias("hot_key"), F.col("first").alias("hot")))
    copy_of_hot = F.col("hot").isNotNull() & (F.col("hot.at") != F.col("at"))
    met = (coded.join(hot, F.col("key") == F.col("hot_key"), "left").drop("hot_key")
           .withColumn("frame", F.when(~F.coalesce(copy_of_hot, F.lit(False)), F.col("frame")))
           # rows already looked up get keys of their own, which meet nothing and spread evenly
           .withColumn("key", F.when(F.col("hot").isNull(), F.col("key")).otherwise(
               F.concat("key", F.col("at").cast("string").cast("binary")))))
    found = met.join(groups.where(F.col("copies") <= limit).select("key", F.col("first").alias("cold")), "key", "left")
    first = F.coalesce("hot", "cold")
    return found.select("at", "id", "url", "digest", "payload_bytes", "frame",
                        F.when(first["at"] != F.col("at"), first).alias("first"))


# --- reading --------------------------------------------------------------------------------

def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary of an archive, from the first frame of a part (all parts have the same one)."""
    head = _frames(spark, path).first()
    if head is None or bytes(head.frame[:4]) != DICTIONARY_MAGIC:
        return b""
    return zstandard.ZstdDecompressor().decompress(bytes(head.frame[8:]))


def _frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary").alias("frame"))


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Response and revisit records of an archive, see ``RECORDS``; payloads (of responses) on request."""
    dictionary = read_dictionary(spark, path)
    known = zstandard.ZstdCompressionDict(dictionary).dict_id() if dictionary else 0
    columns = [c for c in RECORDS.split(", ") if payloads or not c.startswith("payload ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in columns)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(dictionary)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for value in batch.column(0):
                    frame = value.as_py()
                    if not frame or frame[:4] == DICTIONARY_MAGIC:
                        continue
                    if zstandard.get_frame_parameters(frame).dict_id != known:
                        raise ValueError("a record of another dictionary")
                    row = parsed(codec.record(frame))
                    if row is not None:
                        yield row if payloads else {**row, "payload": None}

        yield from _out(rows(), schema, "payload")

    return _frames(spark, path).mapInArrow(decode, ", ".join(columns))


# Base 32 from the hex digest: each run of five hex digits (20 bits) gives four letters.
SQL = """
WITH pages_read AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha1(html), 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), 'string_agg', '')
    AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM pages_read
"""
