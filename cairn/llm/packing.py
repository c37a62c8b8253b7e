"""Best-fit packing by sums of squares: documents into sequences of at most ``capacity`` tokens.

Each piece goes where the sum, over residual gaps, of the squared number of open
sequences with that gap becomes smallest; a sequence opens only where no open one has room.
Pieces are taken longest first. Groups of bounded size are packed independently, so
that packing is a distributed job; what a group loses is a few open sequences at its end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder, default_tokenizer

CAPACITY = 1024
GROUP = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, in the order given; sequences count from 0.

    Lengths are 1 to capacity. Of equally good places the one with the smallest gap wins,
    and of its sequences the one that came to this gap last.
    """
    n_open = np.zeros(capacity + 1, np.int64)  # open sequences by gap, 1 to capacity - 1
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        before, after = n_open[s:], n_open[: capacity - s + 1]
        change = 2 * (after - before) + 2  # one sequence goes from gap g to gap g - s
        change[0] = 1 - 2 * before[0]  # a sequence is filled, and is open no more
        change[before == 0] = np.iinfo(np.int64).max
        if not before[:-1].any():  # a new one opens
            change[-1] = 0
        gap = s + int(change.argmin())
        if gap == capacity:
            which, made = made, made + 1
        else:
            which = members[gap].pop()
            n_open[gap] -= 1
        if gap > s:
            members[gap - s].append(which)
            n_open[gap - s] += 1
        place[i], offset[i] = which, capacity - gap
    return place, offset


def pieces(df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A text (null: empty) is encoded and end_id appended. Texts of up to capacity tokens are
    one piece; longer ones are cut into pieces of capacity tokens, the first of which takes
    what is left over and may be shorter.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    out = pa.schema(fields)

    def run(batches):
        encoder = Encoder.of(tokenizer)
        for whole in batches:
            for b in common.slices(whole, "text", 4 << 20):
                ids, bounds = encoder.encode(b.column("text"), end_id)
                n = np.diff(bounds)
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = (n - (count - 1) * capacity)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                at = bounds[:-1][row] + start
                data, ends = memoryview(ids.astype("<u4").tobytes()), (at + length) * 4
                crc = [zlib.crc32(data[i:j]) for i, j in zip((at * 4).tolist(), ends.tolist())]
                columns = [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:  # the pieces lie one after another in ids
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, bounds[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=out)
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset; columns of these names are replaced, and all others stay.

    Reads ``pieces`` twice: give it a written table. Rows need not be distinct: each is
    placed. Every sequence is gapless from 0. An empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    (dealt,) = common.unused(pieces.columns, "group")
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    # dealt out in turns from each partition on, which begin at different groups: no document or length can fill a group
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rest = rest.withColumn(dealt, (row + F.spark_partition_id().cast("long") * 7919) % groups)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns([dealt]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        place, offset = sum_of_squares(rows.column("length").to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array(((key[0].as_py() << 32) + place) * 2 + 1)).append_column("offset", pa.array(offset))

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = rest.groupBy(dealt).applyInArrow(run, f"{typed}, sequence_id long, offset long")
    return whole.unionByName(packed)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids): the packed sequences themselves, from pieces with ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("s"))
    return rows.select("sequence_id", F.col("s.doc_id").alias("doc_ids"), F.flatten("s.ids").alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens: a row per piece."""
    found = common.written(pieces(common.table(spark, sf_dir, "documents"), default_tokenizer()), "pieces")
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
