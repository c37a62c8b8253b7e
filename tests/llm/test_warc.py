import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import common, warc


def expected(pages):
    firsts, out = {}, []
    for p, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and p is not None:
            firsts[data] = min(p, firsts.get(data, p))
    for p, _, html in pages:
        data = (html or "").encode()
        first = firsts.get(data)
        revisit = first is not None and first != p
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (1, "https://user@www.Example.com:80/a b?x=1#frag", "<p>" + "é" * 100), (2, "http://www.example.com/a b?x=1", "<p>" + "é" * 100), (3, None, None), (4, "", ""), (5, "no url", "short"), (6, "http://a.b/", "short"),
    (7, "http://a.b/", "x" * 99), (8, "http://a.b/", "x" * 99), (9, "http://a.b/", "x" * 100), (10, "http://a.b/\r\nInjected: 1", "x" * 100), (10, "http://a.b/\r\nInjected: 1", "x" * 100), (None, "http://c.d", "x" * 100), (11, "http://z.z/" + "q" * 3000, "y\r\n\r\n" * 60_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")


def test_round_trip(spark, pages):
    path = common.new_folder(spark, "w")
    captures = warc.write(pages, path, roll=2000)
    shards = warc.index(captures, path, block_lines=2)
    found = warc.lookup(shards, pages.select(warc.urlkey(F.col("url")).alias("urlkey")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, captures.collect()), key=str)
    rows = warc.read(found, path).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == expected(PAGES)
    bodies = {r["page_id"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
    assert bodies[11].decode() == PAGES[-1][2] and bodies[3] == b""


def test_a_hot_url_over_many_blocks(spark):
    rows = spark.createDataFrame([(i, "http://hot.example/x" if i % 3 else f"http://h{i}.example/", f"page {i}") for i in range(600)], "page_id long, url string, html string")
    path = common.new_folder(spark, "w")
    shards = warc.index(warc.write(rows, path), path, block_lines=7)
    keys = spark.createDataFrame([("example,hot)/x",), ("example,h3)/",), ("nowhere)/",)], "urlkey string")
    assert sorted(r["page_id"] for r in warc.lookup(shards, keys).collect()) == sorted([3] + [i for i in range(600) if i % 3])


def test_query_and_empty(spark, sf, pages):
    own = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op8_warc(spark, sf).collect()), key=str) == expected(own)
    path = common.new_folder(spark, "w")
    shards = warc.index(warc.write(pages.limit(0), path), path)
    assert warc.read(warc.lookup(shards, spark.createDataFrame([("a",)], "urlkey string")), path).count() == 0


def test_files_are_gzip_members(spark, pages):
    path = common.new_folder(spark, "w")
    captures = warc.write(pages, path).collect()
    fs, folder = common.filesystem(path)
    for name in {c["filename"] for c in captures}:
        whole = gzip.decompress(open(f"{folder}/{name}", "rb").read())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.count(b"WARC/1.1\r\n") == 1 + sum(c["filename"] == name for c in captures)


def test_url_keys(spark):
    cases = {"https://user@www.Example.com:80/a b?x=1#frag": "com,example,www)/a%20b?x=1", "http://a.b": "b,a)/", "http://a.b?q": "b,a)/?q", "no url": ")no%20url", None: ")"}
    rows = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("k", warc.urlkey(F.col("url")))
    assert {r["url"]: r["k"] for r in rows.collect()} == cases


def test_staged_folders_can_be_discarded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_FOLDERS", [])
    staged = common.written(spark.range(5), "some")
    assert staged.count() == 5 and len(common._FOLDERS) == 1
    folder = common.filesystem(common._FOLDERS[0])[1]
    common.new_folder(spark, "never-made")
    assert common.discard() == 1 and common.discard() == 0
    assert common.filesystem(f"file://{folder}")[0].get_file_info(folder).type == common.pafs.FileType.NotFound
