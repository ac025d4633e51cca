import base64
import glob
import hashlib
import io
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from queuelens.llm import warc

PAGES = "page_id bigint, url string, html string"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def expected(rows, min_bytes=0):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        key = (page_id is None, page_id or 0)
        if data not in first or key < first[data]:
            first[data] = key
    out, taken = [], set()
    for page_id, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        lead = first[data] == (page_id is None, page_id or 0) and data not in taken
        if lead:
            taken.add(data)
        lead = lead or len(data) < min_bytes
        out.append((page_id, len(data), digest, "response" if lead else "revisit",
                    None if lead or first[data][0] else first[data][1]))
    return sorted(out, key=repr)


def read_back(spark, path):
    return sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in warc.read(spark, path).collect()], key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [f"<p>{' '.join(rng.choice('alpha beta gamma delta'.split()) for _ in range(rng.randint(1, 90)))} ü{k}</p>" for k in range(60)]
    rows = [(k, f"http://h{k % 7}/{k}", texts[k % 45]) for k in range(200)]
    rows += [(1000 + k, None, "hot") for k in range(150)]
    rows += [(5, "http://a b\r\nX: y/\x7f", None), (6, "", ""), (None, "http://none/", "only one"), (None, None, "hot"),
             (7, "u", "twice"), (7, "u", "twice"), (7, "v", "twice"), (9000, "u", "z" * 3_000_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_round_trip_and_copies(spark, rows, min_bytes):
    df = pages_of(spark, rows).repartition(5).select("*", F.lit(1).alias("at"), F.lit(2).alias("key"), F.lit(3).alias("first"))
    path = warc.write(df, min_bytes=min_bytes)
    assert read_back(spark, path) == expected(rows, min_bytes)
    records = warc.read(spark, path, payloads=True).collect()
    by_record = {r.record_id: r for r in records}
    assert len(by_record) == len(rows)
    for r in records:
        if r.record_type == "revisit":
            lead = by_record[r.refers_to_record]
            assert lead.record_type == "response" and lead.payload_digest == r.payload_digest and r.payload is None
    html = {}
    for page_id, _, text in rows:
        html.setdefault(page_id, set()).add((text or "").encode())
    assert all(bytes(r.payload) in html[r.id] for r in records if r.record_type == "response")


def test_hot_digests_are_looked_up(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "MOST_HOT", 3)
    assert read_back(spark, warc.write(pages_of(spark, rows))) == expected(rows)


def test_parts_are_plain_zstandard(spark, rows):
    path = warc.write(pages_of(spark, rows).repartition(2))
    kinds = 0
    for name in glob.glob(path.removeprefix("file:") + "/part-*"):
        data = open(name, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
        expander = zstandard.ZstdDecompressor(dict_data=dictionary)
        text = expander.stream_reader(io.BytesIO(data[8 + size:]), read_across_frames=True).read()
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            length = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1") and rest[length:length + 4] == b"\r\n\r\n"
            kinds += fields[b"WARC-Type"] in (b"response", b"revisit")
            text = rest[length + 4:]
    assert kinds == len(rows)


def test_large_parts_are_split(spark, rows):
    path = warc.write(pages_of(spark, rows * 5).coalesce(1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1009", "4096", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = warc.read(spark, path)
            assert found.rdd.getNumPartitions() > 3 and found.count() == 5 * len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_payloads_that_hold_the_separator(spark):
    rng = random.Random(5)
    rows = [(k, "u", rng.randbytes(rng.randint(0, 3000)) + warc.SEPARATOR * (k % 3 + 1) + rng.randbytes(40) + warc.SEPARATOR[:k % 8])
            for k in range(40)]
    plain = warc.Codec(b"")
    assert any(warc.SEPARATOR in plain.compressor.compress(r[2]) for r in rows)
    assert not any(warc.SEPARATOR in plain.frame(r[2]) for r in rows)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html binary")
    found = warc.read(spark, warc.write(df), payloads=True).collect()
    assert sorted((r.id, bytes(r.payload)) for r in found) == sorted((r[0], r[2]) for r in rows)


def test_damage_is_seen(spark):
    record = warc.response(0, 1, "u", b"text", warc.sha1_base32(b"text"), "d")
    assert warc.parsed(record)["payload"] == b"text"
    for bad in (record.replace(b"text\r\n", b"TEXT\r\n"), record[:-1], b"no header"):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_few_and_no_pages(spark):
    one = [(1, "u", "a")]
    assert read_back(spark, warc.write(pages_of(spark, one))) == expected(one)
    assert read_back(spark, warc.write(pages_of(spark, []))) == []


def test_dictionary_pays(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    records = [warc.response(k, k, r.url, r.html.encode(), "", "d") for k, r in enumerate(pages)]
    small = [r[:1500] for r in records]
    codec, plain = warc.Codec(warc.trained(small[::2])), warc.Codec(b"")
    assert sum(len(codec.frame(r)) for r in small[1::2]) < 0.8 * sum(len(plain.frame(r)) for r in small[1::2])
