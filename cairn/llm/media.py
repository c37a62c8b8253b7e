"""Media columns: a Spark data source over directories of media archives.

Archives are ZIP files of stored members. The source plans byte ranges of the
archives as partitions; a range owns the members whose header begins in it, as the
archive's own central directory tells. Members stream out as Arrow batches of bounded
bytes. A member that can't be read is read again by its offset, on its own, without
touching the others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import warnings
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "key string, archive string, offset long, media binary, error string"
ARROW = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


# -- the image format -----------------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(data: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image, 64 samples a row, of data padded with zeros to a positive multiple of 64; its true length is a text chunk."""
    rows = max(1, -(-len(data) // WIDTH))
    grid = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    grid[:, 1:] = flat.reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"Length\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(grid, level)) + _chunk(b"IEND", b"")


def samples_of(png: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows x 64) and the unpadded length."""
    at, body, n, rows = len(PNG), [], None, 0
    if png[:at] != PNG:
        raise ValueError("not a PNG")
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            rows = struct.unpack(">IIBBBBB", data)[1]
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            n = int(data[7:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    grid = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, WIDTH + 1)
    if grid[:, 0].any():
        raise ValueError("row filters are not supported")
    samples = np.ascontiguousarray(grid[:, 1:])
    return samples, samples.size if n is None else n


def feature_of(samples: np.ndarray) -> str:
    """Mean, spread, an 8-bin histogram and a 64-bit average hash of the column means: equal samples, equal string."""
    counts = np.bincount(samples.ravel() >> 5, minlength=8)
    # integer sums, so that the values don't depend on the order of summation
    total, n = int(samples.sum(dtype=np.int64)), samples.size
    squares = int((samples.astype(np.int64) ** 2).sum())
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns * WIDTH > total).tobytes().hex()
    return f"{total / n:.4f}:{max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f}:{'-'.join(map(str, counts))}:{bits}"


# -- the data source ------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.archive, self.start, self.end))


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 32 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.attempts = int(options.get("attempts", 4))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def archives(self) -> list[tuple[str, int]]:
        """In each folder below the path the committed archives if a manifest tells them, else all ZIP files; with their sizes."""
        fs, path = common.filesystem(self.path)
        found = [x for x in fs.get_file_info(common.pafs.FileSelector(path, recursive=True)) if x.is_file]
        manifests = [x.path for x in found if x.base_name.startswith("_manifest")]
        zips = [x for x in found if x.base_name.endswith(".zip")]
        folder = lambda p: p.rpartition("/")[0]
        told = {folder(m) for m in manifests}
        names: set[str] = set()
        for m in manifests:
            with fs.open_input_stream(m) as src:
                names |= {f"{folder(m)}/{n}" for n in json.loads(src.read())}
        zips = [x for x in zips if x.path in names or folder(x.path) not in told]
        return sorted((x.path, x.size) for x in zips)

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(size, at + self.split)) for p, size in self.archives() for at in range(0, size, self.split)]

    def read(self, part: Range | None):
        if part is None:  # there are no archives
            return
        archive = _Archive(common.filesystem(self.path)[0], part.archive, self.attempts)
        try:
            members, error = archive.retried(lambda h: zipfile.ZipFile(h).infolist())
            if members is None:
                if not self.permissive:
                    raise OSError(f"{part.archive}: {error}")
                if part.start == 0:  # one row tells of an archive that has no readable directory
                    yield _batch([(None, part.archive, 0, None, error)])
                return
            rows, size = [], 0
            for info in sorted((i for i in members if part.start <= i.header_offset < part.end), key=lambda i: i.header_offset):
                data, error = archive.retried(lambda h, info=info: read_member(h, info))
                if data is None and not self.permissive:
                    raise OSError(f"{part.archive} at {info.header_offset}: {error}")
                rows.append((info.filename.rpartition(".")[0] or None, part.archive, info.header_offset, data, error))
                size += len(data or b"")
                if size >= self.batch or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
        finally:
            archive.close()


class _Archive:
    """One archive's handle, opened anew after an error."""

    def __init__(self, fs, path: str, attempts: int):
        self.fs, self.path, self.attempts, self.handle = fs, path, attempts, None

    def retried(self, read) -> tuple:
        """(what ``read`` of the handle gives, None), or (None, the last error) after all attempts."""
        error = None
        for attempt in range(self.attempts):
            try:
                if self.handle is None:
                    self.handle = self.fs.open_input_file(self.path)
                return read(self.handle), None
            except (OSError, ValueError, zipfile.BadZipFile, pa.ArrowException) as e:
                error = f"{type(e).__name__}: {e}"
                self.close()
                time.sleep(0.05 * 2**attempt)
        return None, error

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
            self.handle = None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), ARROW)], schema=ARROW)


def read_member(handle, info: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes by its offset, held against its checksum."""
    handle.seek(info.header_offset)
    head = handle.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    name, extra = struct.unpack_from("<HH", head, 26)
    handle.seek(info.header_offset + 30 + name + extra)
    data = handle.read(info.compress_size)
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise ValueError("the member's checksum differs")
    return data


class ArchiveWriter(DataSourceArrowWriter):
    """Each attempt writes archives of its own names; the manifest of the commit lists those that count."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.roll = int(options.get("archivebytes", 128 << 20))

    def write(self, batches) -> Written:
        fs, path = common.filesystem(self.path)
        fs.create_dir(path, recursive=True)
        names, archive, out = [], None, None
        for batch in batches:
            for key, media in zip(batch.column("key"), batch.column("media")):
                if archive is None:
                    names.append(f"media-{uuid.uuid4().hex}.zip")
                    out = fs.open_output_stream(f"{path}/{names[-1]}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # equal names are fine: offsets tell members apart
                    archive.writestr(zipfile.ZipInfo(f"{key.as_py() or ''}.png"), media.as_py() or b"")
                if archive.start_dir >= self.roll or len(archive.filelist) >= 50_000:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        common.put_json(f"{self.path}/_manifest-{uuid.uuid4().hex}.json", [n for m in messages if m for n in m.archives])

    def abort(self, messages) -> None:
        fs, path = common.filesystem(self.path)
        for n in (n for m in messages if m for n in m.archives):
            fs.delete_file(f"{path}/{n}")


class MediaArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


# -- the operator ---------------------------------------------------------------------


def encode(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, media): every whole text as UTF-8 in an 8-bit grey image."""
    out = pa.schema([("key", pa.string()), ("media", pa.binary())])

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 8 << 20):
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([png_of(x.as_buffer() if x.is_valid else b"") for x in b.column("text")], pa.binary())], schema=out)

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "key string, media binary")


def write_media(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Stores each row's text as a media member in archives under path."""
    df.sparkSession.dataSource.register(MediaArchives)
    encode(df, key, text).write.format("media_archives").mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stored members: key, archive, offset, media, error (null unless mode is permissive and all attempts failed)."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored members, from their decoded samples."""
    out = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for key, m in zip(b.column("key").to_pylist(), b.column("media")):
                png = m.as_buffer().to_pybytes()
                samples, n = samples_of(png)
                payload = samples.tobytes()
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), out)], schema=out)

    kept = media.filter("media is not null").select("key", "media")
    return kept.mapInArrow(run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media and read back: one row each; null texts count as empty, null ids stay null, repeated rows are members of their own."""
    path = common.new_folder(spark, "media")
    write_media(common.table(spark, sf_dir, "documents"), path)
    return features(read_media(spark, path)).select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
