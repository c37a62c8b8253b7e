"""WARC archives with a two-level capture index.

Records are gzip members of their own in ``.warc.gz`` files. The index has a line per
capture, sorted by a key of the URL with its host reversed, in compressed blocks of equal
numbers of lines; a sparse directory has the first key and the place of each block. To look
up a key: binary search over the shards, then over a shard's directory, then read and
scan the few blocks that can hold it, then read the records by their ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_PAYLOAD = 100
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "urlkey string, page_id long, filename string, offset long, length long"
ARROW_CAPTURES = pa.schema([("urlkey", pa.string()), ("page_id", pa.int64()), ("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
SHARDS = "path string, directory string, first_key string, last_key string, lines long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


def urlkey(url: Column) -> Column:
    """com,example,www)/path?query of a URL; user, port and fragment go. No host: the URL itself after a parenthesis; null: a parenthesis."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, scheme + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(url, scheme + r"[^/?#]*", "")
    path = F.when((host != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), r"\s", "%20")


def resolve(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first: first is the smallest page_id of all pages with this payload where it is another's, else null.

    Payloads under 100 bytes have no first. Rows that repeat the smallest page_id are responses too.
    A null page_id revisits, if any other page has its payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= LEAST_PAYLOAD)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left")
    return joined.withColumn("first", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first")))


def _record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    ident = f"<urn:x-page:{'none-' + uuid.uuid4().hex if page_id is None else page_id}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    fields = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": ident, "WARC-Date": DATE, "WARC-Target-URI": re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-none", "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    if first is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{first}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """A record's fields, and its payload (None for a revisit); digests are held against what was read."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    response = fields["WARC-Type"] == "response"
    number = lambda name: int(m[1]) if (m := re.search(r"x-page:(-?\d+)>", fields.get(name, ""))) else None
    url = fields["WARC-Target-URI"]
    return {
        "page_id": number("WARC-Record-ID"), "url": None if url == "urn:x-none" else url, "payload_bytes": len(payload) if response else size, "payload_digest": hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].partition(":")[2],
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if response else None,
    }


def write(pages: DataFrame, path: str, roll: int = 128 << 20) -> DataFrame:
    """Writes a record per page; returns the written table of captures: urlkey, page_id, filename, offset, length."""
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nformat: WARC File 1\r\n\r\n\r\n"

    def run(batches):
        fs, folder = common.filesystem(path)
        fs.create_dir(folder, recursive=True)
        out, at, name = None, 0, None
        for whole in batches:
            for b in common.slices(whole, "payload", 8 << 20):
                rows = []
                for r in b.to_pylist():
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        out.write(member := gzip.compress(info % str(uuid.uuid4()).encode(), mtime=0))
                        at = len(member)
                    out.write(member := gzip.compress(_record(r["page_id"], r["url"], r["payload"], r["digest"], r["first"]), 6, mtime=0))
                    rows.append((r["urlkey"], r["page_id"], name, at, len(member)))
                    at += len(member)
                    if at >= roll:
                        out.close()
                        out = None
                if rows:
                    yield _batch(rows, ARROW_CAPTURES)
        if out is not None:
            out.close()

    rows = resolve(pages).withColumn("urlkey", urlkey(F.col("url")))
    return common.written(rows.select("page_id", "url", "payload", "digest", "first", "urlkey").mapInArrow(run, CAPTURES), "captures")


def index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures into compressed blocks and a sparse directory; returns the written table of shards.

    Captures are dealt out by range of (urlkey, page_id): one very common URL spreads over many shards.
    """
    out = pa.schema([("path", pa.string()), ("directory", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int64())])

    def run(batches):
        fs, folder = common.filesystem(path)
        fs.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        sink, at, entries, held, lines, last = None, 0, [], [], 0, None

        def flush() -> int:
            block = zlib.compress("".join(f"{json.dumps(x)}\n" for x in held).encode(), 6)
            entries.append((held[0][0], at, len(block)))
            sink.write(block)
            held.clear()
            return len(block)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    sink = fs.open_output_stream(f"{folder}/index-{name}.z", compression=None)
                held.append(row)
                lines, last = lines + 1, row[0]
                if len(held) == block_lines:
                    at += flush()
        if sink is not None:
            if held:
                at += flush()
            sink.close()
            common.put_json(f"{path}/directory-{name}.json", entries)
            yield _batch([(f"{path}/index-{name}.z", f"{path}/directory-{name}.json", entries[0][0], last, lines)], out)

    ordered = captures.select(*ARROW_CAPTURES.names).repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")
    return common.written(ordered.mapInArrow(run, SHARDS), "index")


class _Index:
    """A task's view of the index: holds one shard's directory and one block at a time."""

    def __init__(self, shards: list[tuple]):
        self.shards = sorted(shards, key=lambda s: (s[2], s[3]))
        self.firsts = [s[2] for s in self.shards]
        self.at = self.entries = self.keys = self.place = self.block = None

    def _directory(self, i: int) -> None:
        if self.at != i:
            self.entries, self.at = common.get_json(self.shards[i][1]), i
            self.keys = [e[0] for e in self.entries]

    def _block(self, i: int, j: int) -> list[list]:
        if self.place != (i, j):
            fs, path = common.filesystem(self.shards[i][0])
            with fs.open_input_file(path) as f:
                f.seek(self.entries[j][1])
                text = zlib.decompress(f.read(self.entries[j][2])).decode()
            self.block, self.place = [json.loads(x) for x in text.splitlines()], (i, j)
        return self.block

    def blocks(self, key: str):
        """(shard, block) of all blocks that may hold a key. Ranges of shards may meet in a key, but don't cross."""
        i = bisect_right(self.firsts, key) - 1
        while i > 0 and self.shards[i - 1][3] >= key:
            i -= 1
        while 0 <= i < len(self.shards) and self.firsts[i] <= key:
            if key <= self.shards[i][3]:
                self._directory(i)
                j = max(0, bisect_left(self.keys, key) - 1)
                while j < len(self.keys) and self.keys[j] <= key:
                    yield i, j
                    j += 1
            i += 1

    def captures(self, i: int, j: int, key: str):
        """The captures of a key in a block."""
        self._directory(i)
        block = self._block(i, j)
        k = bisect_left(block, key, key=lambda x: x[0])
        while k < len(block) and block[k][0] == key:
            yield tuple(block[k])
            k += 1


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """All captures of the distinct values of keys.urlkey, found by binary search. Keys that the index lacks give no row, and repeated or null keys no more rows.

    Directories give the blocks of each key, and blocks are dealt out over tasks, so that a URL of very
    many captures is no one task's. The driver and each task see one row per shard, as many as there were partitions.
    """
    listed = [tuple(r) for r in shards.collect()]
    places = pa.schema([("urlkey", pa.string()), ("shard", pa.int32()), ("block", pa.int32())])

    def batched(rows, schema: pa.Schema):
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 4096:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    def blocks(batches):
        index = _Index(listed)
        yield from batched(((key, i, j) for b in batches for key in b.column("urlkey").to_pylist() for i, j in index.blocks(key)), places)

    def captures(batches):
        index = _Index(listed)
        yield from batched((row for b in batches for key, i, j in zip(*(c.to_pylist() for c in b.columns)) for row in index.captures(i, j, key)), ARROW_CAPTURES)

    wanted = keys.select("urlkey").filter("urlkey is not null").distinct().repartitionByRange("urlkey").sortWithinPartitions("urlkey")
    found = wanted.mapInArrow(blocks, "urlkey string, shard int, block int")
    return found.repartition("shard", "block").sortWithinPartitions("shard", "block", "urlkey").mapInArrow(captures, CAPTURES)


def tasks_for(captures: DataFrame, task_bytes: int = 16 << 20) -> int:
    """Tasks that read captures of a written table at about task_bytes of archive each."""
    return max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // task_bytes))


def read(captures: DataFrame, path: str, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """The records of captures, by range reads in the order of the files.

    Rows of captures are small and what they stand for is not: the number of tasks follows
    the archives' bytes (see ``tasks_for``), not the rows'.
    """
    schema = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    out = pa.schema(schema)

    def run(batches):
        fs, folder = common.filesystem(path)
        name = handle = None
        for b in batches:
            rows, size = [], 0
            for r in b.to_pylist():
                if r["filename"] != name:
                    name, handle = r["filename"], fs.open_input_file(f"{folder}/{r['filename']}")
                handle.seek(r["offset"])
                found = parse(gzip.decompress(handle.read(r["length"])))
                rows.append(tuple(found[k] for k in out.names))
                size += len(found["payload"] or b"") * payloads
                if size > 4 << 20:
                    yield _batch(rows, out)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, out)

    tasks = tasks or tasks_for(captures)
    ordered = captures.select("filename", "offset", "length").repartitionByRange(tasks, "filename", "offset").sortWithinPartitions("filename", "offset")
    return ordered.mapInArrow(run, RECORDS if payloads else RECORDS.rpartition(",")[0])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, indexed, looked up by their URLs' keys and read back: a row per page."""
    pages = common.table(spark, sf_dir, "pages")
    path = common.new_folder(spark, "warc")
    captures = write(pages, path)
    shards = index(captures, path)
    found = lookup(shards, pages.select(urlkey(F.col("url")).alias("urlkey")))
    return read(found, path, payloads=False, tasks=tasks_for(captures)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
