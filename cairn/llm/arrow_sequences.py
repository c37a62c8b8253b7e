"""Token ids as Arrow IPC files of equal-length sequences and masks.

A shard is an Arrow file whose batches hold fixed-size lists: ``ids`` (unsigned 16 or 32
bits), ``mask`` (false on the padding that ends a shard) and ``last`` (true on a document's
last id). All batches but the last have the same number of sequences, so that sequence i
is row ``i % rows`` of batch ``i // rows``, found without reading others and, on a local
file, without a copy. A companion file has the ids of a shard's documents in order.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder, default_tokenizer

LENGTH = 1024
ROWS = 64
#: Bytes of ids after which a shard is closed.
ROLL = 256 << 20
SHARDS = "shard long, path string, docs_path string, docs long, sequences long, tokens long"


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length))])


class _Shard:
    """Gathers ids and writes full batches as they come."""

    def __init__(self, sink, length: int, rows: int, kind: pa.DataType):
        self.length, self.rows, self.schema, self.kind = length, rows, _schema(length, kind), kind
        self.writer = ipc.new_file(sink, self.schema)
        self.ids, self.last, self.held, self.tokens, self.sequences = [], [], 0, 0, 0

    def add(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents' ids in a row; ``bounds`` has where each begins, and the total."""
        last = np.zeros(len(ids), bool)
        last[bounds[1:] - 1] = True
        self.ids.append(ids)
        self.last.append(last)
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= self.rows * self.length:
            self.flush(self.rows)

    def flush(self, rows: int, end: bool = False) -> None:
        if not self.held:
            return
        ids, last = np.concatenate(self.ids), np.concatenate(self.last)
        step = rows * self.length
        until = len(ids) if end else len(ids) // step * step
        for at in range(0, until, step):
            part, tail = ids[at : at + step], last[at : at + step]
            n = len(part)
            short = -n % self.length
            if short:
                part, tail = np.pad(part, (0, short)), np.pad(tail, (0, short))
            mask = np.arange(len(part)) < n
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((part, self.kind), (mask, pa.bool_()), (tail, pa.bool_()))]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            self.sequences += len(lists[0])
        self.ids, self.last, self.held = [ids[until:]], [last[until:]], len(ids) - until

    def close(self) -> None:
        self.flush(self.rows, end=True)
        self.writer.close()


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, length: int = LENGTH, rows: int = ROWS, roll: int = ROLL) -> DataFrame:
    """Encodes every whole text (null: empty), appends end_id, and writes ids in ascending doc_id order (null first).

    Returns the written table of shards, in order: shard, path, docs_path, docs, sequences,
    tokens. Documents are dealt out by range of doc_id, and equal ids by their text, so that
    one id on many rows is no hot range. A shard is closed after the batch of documents that takes its ids to
    ``roll`` bytes. A retried task writes files of new names; only those of tasks that ended well are in
    the table.
    """
    out = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs_path", pa.string()), ("docs", pa.int64()), ("sequences", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        encoder = Encoder.of(tokenizer)
        kind = pa.uint16() if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else pa.uint32()
        fs, folder = common.filesystem(path)
        fs.create_dir(folder, recursive=True)
        part, shard, made = TaskContext.get().partitionId(), None, 0

        def closed() -> pa.RecordBatch:
            shard.close()
            docs.close()
            sink.close()
            docs_sink.close()
            row = ((part << 32) + made, f"{path}/ids-{name}.arrow", f"{path}/docs-{name}.arrow", count, shard.sequences, shard.tokens)
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, out)], schema=out)

        for whole in batches:
            for b in common.slices(whole, "text", 4 << 20):
                if shard is None:
                    name, count, made = uuid.uuid4().hex, 0, made + 1
                    sink, docs_sink = fs.open_output_stream(f"{folder}/ids-{name}.arrow"), fs.open_output_stream(f"{folder}/docs-{name}.arrow")
                    shard, docs = _Shard(sink, length, rows, kind), ipc.new_file(docs_sink, pa.schema([("doc_id", pa.int64())]))
                docs.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id")], names=["doc_id"]))
                ids, bounds = encoder.encode(b.column("text"), end_id)
                shard.add(ids.astype(kind.to_pandas_dtype()), bounds)
                count += b.num_rows
                if shard.tokens * kind.bit_width // 8 >= roll:
                    yield closed()
                    shard = None
        if shard is not None:
            yield closed()

    rows_in = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows_in.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return common.written(ordered.mapInArrow(run, SHARDS), "shards")


def read(shards: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver sees one row per shard, to number their first ids; each shard is one task's to read.
    """
    spark = shards.sparkSession
    table, start = [], 0
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        table.append((r["path"], r["docs_path"], start))
        start += r["tokens"]
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from _documents(r["path"], r["docs_path"], r["start"], out)

    listed = spark.createDataFrame(table, "path string, docs_path string, start long").repartition(max(1, len(table)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _opened(uri: str):
    fs, path = common.filesystem(uri)
    return pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)


def _documents(path: str, docs_path: str, start: int, out: pa.Schema):
    docs = ipc.open_file(_opened(docs_path))
    keys = (k for i in range(docs.num_record_batches) for k in docs.get_batch(i).column(0).to_pylist())
    file, carried = ipc.open_file(_opened(path)), []  # parts of a document that goes on
    for i in range(file.num_record_batches):
        b = file.get_batch(i)
        mask, last = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("mask", "last"))
        ids = b.column("ids").flatten().to_numpy()[mask].astype("<u4")
        ends = np.flatnonzero(last[mask]) + 1
        rows, at = [], 0
        for end in ends.tolist():
            whole = b"".join([*carried, ids[at:end].tobytes()])
            rows.append((next(keys), start, len(whole) // 4, zlib.crc32(whole)))
            start, at, carried = start + len(whole) // 4, end, []
        carried.append(ids[at:].tobytes())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), out)], schema=out)


class Sequences:
    """Random access to one shard: ``s[i]`` is (ids, mask) of sequence i, views of the mapped file where the file is local."""

    def __init__(self, uri: str):
        self.file = ipc.open_file(_opened(uri))
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = self.file.get_batch(i // self.rows)
        at = i % self.rows
        return b.column("ids")[at].values.to_numpy(), b.column("mask")[at].values.to_numpy(zero_copy_only=False)


def op3_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as Arrow sequences and read back from the files: a row per document."""
    return read(write(common.table(spark, sf_dir, "documents"), common.new_folder(spark, "sequences"), default_tokenizer()))
