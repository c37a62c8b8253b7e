"""Quality classifier by supervised subword embeddings.

Word n-grams (one and two words) and character n-grams (three to five bytes) hash into
buckets; each bucket has a learned vector, a document is the mean of its n-grams' vectors,
and a softmax over a linear map gives the class. Vectors and map are trained together by
stochastic gradient descent in numpy. Two equal words in a row share one bucket,
whatever the word, so that repetition itself is a feature.

Scoring needs, of each bucket, only the difference of the two classes' scores: one
float table of fixed size (1 MB by default) goes to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: An odd multiplier of 64 bits, 2**64 divided by the golden ratio.
MIX = np.uint64(0x9E3779B97F4A7C15)
POLY = 0x100000001B3
CHARS = (3, 4, 5)


@dataclass(frozen=True)
class Params:
    """Bounds of the fit: per class at most rows labelled documents, none of over chars characters, so that the driver gets 2 * rows * chars characters at most.

    Of their n-grams at most bags bytes are kept between epochs; those of other documents are made anew each time.
    """

    rows: int = 2500
    chars: int = 40_000
    bits: int = 18
    width: int = 16
    epochs: int = 6
    rate: float = 0.4
    seed: int = 11
    bags: int = 256 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Buckets of the n-grams of many texts at once."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.up = self.down = np.empty(0, np.uint64)

    def groups(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Yields (buckets, first, last) for each kind of n-gram: text i has buckets[first[i]:last[i]]."""
        if len(self.up) <= len(data):
            size = max(1 << 20, len(data) + 1)
            self.up, self.down = _powers(size, POLY), _powers(size, pow(POLY, -1, 1 << 64))
        wide = data.astype(np.uint64)
        packed = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16) if len(data) > 2 else np.empty(0, np.uint64)
        for n in CHARS:
            if n > 3:
                packed = packed[:-1] | wide[n - 1 :] << np.uint64(8 * (n - 1)) if len(packed) else packed
            yield (packed + np.uint64(n << 48)) * MIX >> self.shift, starts, np.maximum(starts, ends - n + 1)
        black = np.zeros(len(data) + 2, bool)
        black[1:-1] = data > 32
        edges = np.flatnonzero(black[1:] != black[:-1])
        begin, end = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(wide * self.up[: len(data)], out=sums[1:])
        words = (sums[end] - sums[begin]) * self.down[begin] * MIX
        first, last = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
        yield words >> self.shift, first, last
        if len(words) > 1:
            pairs = (words[:-1] * np.uint64(31) + words[1:]) * MIX >> self.shift
            pairs[words[:-1] == words[1:]] = 0
            yield pairs, first, np.maximum(first, last - 1)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a blank after each, their starts and ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), starts, starts + sizes


@dataclass
class Model:
    bits: int
    table: np.ndarray  # of each bucket, what it adds to the log odds of class 1
    bias: float

    def scores(self, texts: list[bytes], hasher: Hasher) -> np.ndarray:
        """Probability of class 1; a text without n-grams gets that of the bias alone."""
        data, starts, ends = _joined(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, first, last in hasher.groups(data, starts, ends):
            if len(buckets):
                sums = np.zeros(len(buckets) + 1)
                np.cumsum(self.table[buckets], out=sums[1:], dtype=np.float64)
                total += sums[np.minimum(last, len(buckets))] - sums[np.minimum(first, len(buckets))]
            count += last - first
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))


def fit(texts: list[bytes], labels: np.ndarray, params: Params = Params()) -> Model:
    """Gradient descent, one document a step; without rows of both classes the score is the share of class 1 (no rows: a half)."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Model(params.bits, np.zeros(1 << params.bits, np.float32), float(np.log(share / (1 - share))))
    hasher, kept, held = Hasher(params.bits), {}, 0

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        if i in kept:
            return kept[i]
        found = [b[f[0] : l[0]] for b, f, l in hasher.groups(*_joined([texts[i]]))]
        ids, counts = np.unique(np.concatenate(found), return_counts=True)
        made = ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)
        if held + 8 * len(ids) <= params.bags:
            kept[i], held = made, held + 8 * len(ids)
        return made

    rng = np.random.default_rng(params.seed)
    vectors = rng.uniform(-1 / params.width, 1 / params.width, (1 << params.bits, params.width)).astype(np.float32)
    out, bias = np.zeros((2, params.width), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))  # both classes count alike
    steps, step = params.epochs * len(texts), 0
    for _ in range(params.epochs):
        for i in rng.permutation(len(texts)):
            rate = params.rate * (1 - step / steps)
            step += 1
            ids, share_of = bag(int(i))
            own = vectors[ids]
            mean = share_of @ own
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= rate * weight[labels[i]]
            # a mean over many n-grams moves each vector little: scale its step by their number
            vectors[ids] = own - np.outer(share_of * np.float32(min(len(ids), 50)), p @ out)
            out -= np.outer(p, mean)
            bias -= p * 0.1
    return Model(params.bits, (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, params: Params) -> tuple[list[bytes], np.ndarray]:
    """Labelled texts outside the held-out fold, at most params.rows of each class, chosen by a hash of doc_id.

    doc_id labelled twice counts once, with the smaller label, and so does one on many rows, with the smallest
    of its texts; null labels and null ids don't count.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(params.seed))
    picked = [known.filter(F.col("label") == k).orderBy(order, "doc_id").limit(params.rows) for k in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * params.rows rows of two numbers
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= params.chars).select("doc_id", text).join(few, "doc_id")
    got = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()  # as many rows as few has at most
    got.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    return [bytes(r["text"]) for r in got], np.array([r["label"] for r in got], np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", params: Params = Params()) -> Model:
    return fit(*training_rows(docs, labels, label, params), params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text (null: empty); other columns of docs are not looked at. A null doc_id is not held out; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        hasher = None
        for whole in batches:
            hasher = hasher or Hasher(shared.value.bits)
            for b in common.slices(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores([x or b"" for x in b.column("text").to_pylist()], hasher))], schema=out)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; the model learns only from labelled rows outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
