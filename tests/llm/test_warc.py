"""WARC bundles: round trips, revisits, random access, damage, other readers, and the query's SQL."""

from __future__ import annotations

import hashlib
import io
from pathlib import Path

import duckdb
import zstandard
from pyspark.sql import functions as F

from skein.llm import warc

SF = "/root/testdata/sf0.001"
LONG = "<p>" + "x" * 1200
AWKWARD = [
    (1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "short"), (4, "http://a/4", "short"), (5, "http://a/ü b\r\nX: y", LONG), (9, "", LONG), (7, "http://a/%20?q=1#f", LONG),
    (None, "http://a/none", LONG), (11, "http://b", "é" * 500), (12, "http://b", "é" * 500), (13, "http://c", "\r\n\r\nWARC/1.1\r\n" * 200), (14, "http://d", "y" * 999), (15, "http://d", "y" * 999),
    (16, "http://e", "z" * 3_000_000), (20, "http://f", LONG + "!"), (20, "http://f", LONG + "!"), (None, "n1", "w" * 1000), (None, "n2", "w" * 1000),
]


def plain_version(rows):
    top = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, -1), -1 if i is None else i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        first = top.get(html, i) if len(data) >= 1000 else i
        revisit = first != (-1 if i is None and len(data) >= 1000 else i)
        out.append((i, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def pages_of(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.withColumns({"payload": F.lit(1), "same": F.lit(2), "top": F.lit(3), "size": F.lit("s"), "key": F.lit(4)})


def as_long(column):
    return None if column is None else int(column)


def test_awkward_pages_come_back(spark, tmp_path):
    folder = str(tmp_path / "archive")
    index = warc.write_bundles(pages_of(spark, AWKWARD), folder)
    assert index.count() == len(AWKWARD)
    back = warc.read_bundles(spark, folder).collect()
    found = sorted(((as_long(r["page_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], as_long(warc.page_of(r["refers_to"] or ""))) for r in back), key=repr)
    assert found == plain_version(AWKWARD) and all(r["problem"] is None for r in back)
    texts = {(i, u): (h or "").encode() for i, u, h in AWKWARD}
    responses = {r["record_id"]: r for r in back if r["record_type"] == "response"}
    for r in back:
        payload = r["payload"] if r["record_type"] == "response" else responses[r["refers_to"]]["payload"]
        assert bytes(payload) == texts[as_long(r["page_id"]), r["url"]]
        assert r["record_type"] == "response" or r["payload"] is None


def test_records_are_fetched_by_id_from_their_frames_alone(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "archive")
    rows = [(k, f"http://h/{k}", f"page {k} " * 3000) for k in range(400)]
    index = warc.write_bundles(pages_of(spark, rows).coalesce(1), folder)
    assert index.select("bundle", "frame").distinct().count() > 4
    asked = index.where("page_id in ('7', '399', '200')").select("record_id").unionByName(spark.createDataFrame([("urn:x-page:7:none",)], "record_id string"))
    found = warc.fetch(spark, folder, asked).collect()
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in found} == {(str(k), f"page {k} " * 3000) for k in (7, 200, 399)}
    assert len({(r["bundle"], r["frame"]) for r in found}) <= 3


def test_bundles_are_plain_zstandard_and_attempts_that_were_lost_are_not_read(spark, tmp_path):
    folder = tmp_path / "archive"
    warc.write_bundles(pages_of(spark, AWKWARD), str(folder))
    whole = sorted((folder / "bundles").iterdir())
    records = 0
    for path in whole:
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True) as stream:
            data, at = stream.read(), 0
        while at < len(data):
            found, at = warc.parse_record(data, at)
            records += found["record_type"] != "warcinfo"
    assert records == len(AWKWARD)
    (folder / "bundles" / "bundle-lost.warc.zst").write_bytes(whole[0].read_bytes()[:100])
    assert warc.read_bundles(spark, str(folder)).count() == len(AWKWARD)


def test_damage_stays_inside_its_frame(spark, tmp_path):
    folder = tmp_path / "archive"
    rows = [(k, f"http://h/{k}", hashlib.sha256(str(k).encode()).hexdigest() * 400) for k in range(200)]
    index = warc.write_bundles(pages_of(spark, rows).coalesce(1), str(folder))
    per = {(r["bundle"], r["frame"]): r["count"] for r in index.groupBy("bundle", "frame").count().collect()}
    path = next(Path(folder, "bundles").iterdir())
    data = bytearray(path.read_bytes())
    data[40] ^= 0xFF
    path.write_bytes(bytes(data))
    back = warc.read_bundles(spark, str(folder)).collect()
    damaged = [r for r in back if r["problem"]]
    assert len(damaged) == 1 and (damaged[0]["bundle"], damaged[0]["frame"]) == (path.name, 0)
    assert len(back) - 1 == len(rows) - per[path.name, 0] and len(per) > 3


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "archive")
    assert warc.write_bundles(pages_of(spark, AWKWARD).limit(0), folder).count() == 0
    assert warc.read_bundles(spark, folder).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    wanted = con.sql(warc.OP13_SQL).fetchall()
    found = warc.op13_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
