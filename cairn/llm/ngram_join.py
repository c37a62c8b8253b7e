"""Similarity join of documents by the Jaccard index of their word n-grams: a chosen-path join.

1. Texts with equal sets of n-grams are one class, represented once. A class has a
   sketch: ``hashes`` tokens, of which two classes share the more, the more alike they are.
2. From the root, each node of a random tree chooses some token positions; a class goes
   on to a child for each chosen position, named by the token it has there. Paths that only
   one class took end. Buckets of at most ``limit`` classes are compared by brute force.
   In a larger one, classes near a centre (the majority's tokens of a cluster in a sample of
   the bucket) are linked with it and leave, and so are, but stay, those from which one of
   these could still be in reach: the number of differing tokens is a metric, so no pair is
   lost. What stays goes on down to ``depth``; what is still large then is compared block
   against block. Runs repeat until pairs at the threshold are found with the target
   probability. Later runs leave out buckets whose classes are already connected.
3. Pairs whose sketches may agree connect candidate groups. Within these all pairs are
   compared exactly, once, in blocks of bounded numbers of classes and n-grams, which gives
   each class's number of links and the final groups.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .tokens import Encoder

MIX = np.uint64(0x9E3779B97F4A7C15)
POLY = 0x100000001B3
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Pairs that are connected at a time, and cells of a table of classes by n-grams: a group of near copies has pairs by the square of its size.
PAIRS, CELLS = 1 << 17, 1 << 22


@dataclass(frozen=True)
class Params:
    words: int = 5
    threshold: float = 0.8
    hashes: int = 64
    recall: float = 0.9999
    depth: int = 2
    limit: int = 1000
    block: int = 1500  # classes a block of a large bucket
    sample: int = 128  # classes of a large bucket that its centres are made from
    centres: int = 4  # centres of a large bucket
    inner: int = 18  # differing tokens up to which a class leaves with a centre
    exact_block: int = 300_000  # n-grams a block of a candidate group
    exact_classes: int = 3000  # classes a block of a candidate group
    first_runs: int = 4
    seed: int = 1

    def agreement(self, k: int) -> float:
        """Probability that a pair at the threshold has ``k`` equal tokens in its sketches."""
        return math.comb(self.hashes, k) * self.threshold**k * (1 - self.threshold) ** (self.hashes - k)

    def met(self, k: int) -> float:
        """Probability that two sketches of ``k`` equal tokens share a path of ``depth`` nodes in one run."""
        q = 1.0
        for _ in range(self.depth):
            q = 1 - (1 - q / (self.threshold * self.hashes)) ** k
        return q

    @property
    def agree(self) -> int:
        """Least number of equal tokens of a candidate pair: a pair at the threshold has fewer with half of the probability 1 - recall at most."""
        least, tail = 0, self.agreement(0)
        while tail <= (1 - self.recall) / 2:
            least += 1
            tail += self.agreement(least)
        return max(1, least)

    @property
    def runs(self) -> int:
        """Runs until the tree's misses, over all numbers of equal tokens (every run reads the same sketch), are less than what ``agree`` leaves of 1 - recall."""
        pairs = [(self.agreement(k), 1 - self.met(k)) for k in range(self.agree, self.hashes + 1)]
        rest = max((1 - self.recall) / 2, 1 - self.recall - sum(self.agreement(k) for k in range(self.agree)))
        runs = 1
        while sum(p * miss**runs for p, miss in pairs) > rest:
            runs += 1
        return runs


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- sets of n-grams ------------------------------------------------------------------


class Shingler:
    """Distinct hashes of the n-grams of a text's words, sorted. A text of fewer words has one n-gram of all; without words, none."""

    def __init__(self, words: int):
        self.words, self.up, self.down = words, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def words_of(self, text: bytes) -> np.ndarray:
        """A hash of each word."""
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        if len(self.up) <= n:
            size = max(1 << 16, 2 * n)
            for name, base in (("up", POLY), ("down", pow(POLY, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        black = np.zeros(n + 2, bool)
        black[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edges = np.flatnonzero(black[1:] != black[:-1])
        begin, end = edges[::2], edges[1::2]
        if not len(begin):
            return np.empty(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return _mix((sums[end] - sums[begin]) * self.down[begin])

    def __call__(self, text: bytes) -> np.ndarray:
        word = self.words_of(text)
        if not len(word):
            return word
        k = min(self.words, len(word))
        grams = np.full(len(word) - k + 1, k, np.uint64)
        for i in range(k):
            grams = _mix(grams * MIX + word[i : len(word) - k + 1 + i])
        return np.unique(grams)


def sketch(grams: np.ndarray, hashes: int) -> np.ndarray:
    """For each of ``hashes`` random orders, 32 bits of the first n-gram's place."""
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    odd = _mix(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        for j in range(hashes):
            out[j] = min(out[j], ((part * odd[j]) >> np.uint64(32)).min())
    return out


def signatures(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, text_key, id (of the class; null without words), grams, sketch of every whole text."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("id", pa.int64()), ("grams", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        Encoder.forget()  # a worker may have packed another run's documents before
        shingles = Shingler(params.words)
        for whole in batches:
            for b in common.slices(whole, "text", 4 << 20):
                rows = []
                for doc, key, text in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text")):
                    grams = shingles(text.as_buffer() if text.is_valid else b"")
                    if len(grams):
                        ident = int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)
                        rows.append((doc, key, ident, len(grams), sketch(grams, params.hashes).tobytes()))
                    else:
                        rows.append((doc, key, None, 0, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), out)], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, id long, grams long, sketch binary")


# -- candidate groups -----------------------------------------------------------------


def _tokens(column: pa.Array, hashes: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(array.to_pylist()), np.uint32).reshape(len(array), hashes)


def _children(paths: np.ndarray, tokens: np.ndarray, params: Params, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the children of each row's node: position i is chosen if a hash of node and i is small."""
    places = np.arange(1, params.hashes + 1, dtype=np.uint64)
    draw = _mix(paths[:, None] ^ _mix(places)[None, :]) >> np.uint64(11)
    chosen = draw < np.uint64(int(2**53 / (params.threshold * params.hashes)))
    if least:  # the root always has a child, else the run is lost
        chosen[np.arange(len(draw)), draw.argmin(axis=1)] = True
    row, place = np.nonzero(chosen)
    key = _mix(_mix(paths[row] + places[place] * MIX) ^ tokens[row, place].astype(np.uint64))
    return row, key.view(np.int64)


LEVEL = pa.schema([("key", pa.int64()), ("id", pa.int64())])
REACHED = pa.schema([*LEVEL, ("centre", pa.int64())])


def _first_level(classes: DataFrame, runs: range, params: Params) -> DataFrame:
    """(key, id) of all classes and runs."""

    def run(batches):
        roots = _mix(np.array([params.seed * 1_000_003 + r for r in runs], np.uint64))
        for b in batches:
            tokens, ids = _tokens(b.column("sketch"), params.hashes), b.column("id").to_numpy()
            for root in roots:
                row, key = _children(np.full(len(ids), root, np.uint64), tokens, params, least=1)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row])], schema=LEVEL)

    return classes.select("id", "sketch").mapInArrow(run, "key long, id long")


def _next_level(rows: DataFrame, params: Params) -> DataFrame:
    """(key, id) one level down, of rows (key, id, sketch)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                row, key = _children(b.column("key").to_numpy().view(np.uint64), _tokens(b.column("sketch"), params.hashes), params)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(b.column("id").to_numpy()[row])], schema=LEVEL)

    return rows.select("key", "id", "sketch").mapInArrow(run, "key long, id long")


def _shared(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows of keys with two classes or more that groups (id, component) don't connect all, with the number n of the key's rows.

    Most keys have one class and end here: only two numbers a row are shuffled before that.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    kept = common.written(rows.join(sizes, "key"), "buckets")
    if groups is None:
        return kept
    own = kept.join(groups, "id", "left").select("key", F.coalesce("component", "id").alias("group"))
    mixed = own.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
    return common.written(kept.join(mixed, "key", "left_semi"), "buckets")


def _stars(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row connected with each row, by the pairs or by its ``label`` so far."""
    own = np.flatnonzero(label != np.arange(len(label)))
    left, right = np.concatenate([left, own]), np.concatenate([right, label[own]])
    label = np.arange(len(label))
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
    while (label[label] != label).any():
        label = label[label]
    return label


def _compared(tokens: np.ndarray, sizes: np.ndarray, agree: int):
    """Pairs of rows of one bucket whose sketches agree in enough places, some PAIRS at a time; buckets lie one after another."""
    rest = np.concatenate([np.arange(n, 0, -1) for n in sizes]) if len(sizes) else np.empty(0, int)
    left, right, held, rows = [], [], 0, np.arange(len(rest))
    for d in range(1, int(sizes.max(initial=0))):
        rows = rows[rest[rows] > d]
        same = (tokens[rows] == tokens[rows + d]).sum(axis=1) >= agree
        left.append(rows[same])
        right.append(rows[same] + d)
        held += len(left[-1])
        if held >= PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _crossed(tokens: np.ndarray, left: np.ndarray, right: np.ndarray, agree: int):
    """Pairs of a row of ``left`` and one of ``right`` whose sketches agree in enough places, PAIRS at a time at most."""
    step, others = max(1, PAIRS // (len(right) + 1)), tokens[right]
    for at in range(0, len(left), step):
        same = np.stack([(others == t).sum(axis=1) >= agree for t in tokens[left[at : at + step]]])
        a, b = np.nonzero(same)
        yield left[at + a], right[b]


def _bucket_edges(rows: DataFrame, params: Params) -> DataFrame:
    """Edges that connect the classes of each bucket that may be alike, of rows (key, i, j, own, id, sketch) sorted by bucket.

    Where i and j differ, the classes of block i are compared with those of block j; else all of the bucket.
    """

    def run(batches):
        held: list[pa.Table] = []

        def edges(t: pa.Table):
            key = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            sizes = np.diff(np.append(starts, t.num_rows))
            ids, tokens, label = t.column("id").to_numpy(), _tokens(t.column("sketch"), params.hashes), np.arange(t.num_rows)
            whole = key[1, starts] == key[2, starts]
            rows = np.flatnonzero(np.repeat(whole, sizes))
            for left, right in _compared(tokens[rows], sizes[whole], params.agree):
                label = _stars(label, rows[left], rows[right])
            own = t.column("own").to_numpy()
            for at in np.flatnonzero(~whole):
                rows = np.arange(starts[at], starts[at] + sizes[at])
                for left, right in _crossed(tokens, rows[own[rows] == key[1, starts[at]]], rows[own[rows] == key[2, starts[at]]], params.agree):
                    label = _stars(label, left, right)
            far = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], schema=EDGE)

        last = lambda t: tuple(t.column(c)[-1].as_py() for c in ("key", "i", "j"))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                t = pa.Table.from_batches([whole.slice(at, 4096)])
                table = pa.concat_tables([*held, t])
                k, i, j = last(table)
                # the last bucket may go on in the next batch
                own = (table.column("key").to_numpy() == k) & (table.column("i").to_numpy() == i) & (table.column("j").to_numpy() == j)
                cut = int(np.flatnonzero(~own)[-1]) + 1 if not own.all() else 0
                if cut:
                    yield edges(table.slice(0, cut))
                held = [table.slice(cut)]
        if held and held[0].num_rows:
            yield edges(held[0])

    return rows.select("key", "i", "j", "own", "id", "sketch").mapInArrow(run, "a long, b long")


def centres_of(tokens: np.ndarray, params: Params) -> np.ndarray:
    """Sketches of the majority's tokens of the largest clusters of some rows."""
    out, rest = [], tokens
    while len(rest) > 1 and len(out) < params.centres:
        apart = (rest[:, None] != rest[None]).sum(axis=2)
        most = int((apart <= params.hashes // 2).sum(axis=1).argmax())
        near = rest[apart[most] <= params.hashes // 2]
        if len(near) < 2:
            break
        middle = np.empty(params.hashes, np.uint32)
        for i in range(params.hashes):
            values, counts = np.unique(near[:, i], return_counts=True)
            middle[i] = values[counts.argmax()]
        out.append(middle)
        rest = rest[(rest != middle).sum(axis=1) > params.hashes // 2] if (apart[most] > params.hashes // 2).any() else rest[:0]
    return np.array(out, np.uint32).reshape(-1, params.hashes)


def _reached(large: DataFrame, sketches: DataFrame, params: Params) -> DataFrame:
    """(key, id, centre) of the rows of large buckets: a row for each centre that the class is linked with, and one of a null centre if it stays.

    A class leaves with the first centre that differs from it in ``inner`` tokens at most. Any class that may be
    like it differs from this centre in no more than ``inner`` and the tokens that a candidate pair may differ in, and is linked with it.
    Rows of a hot bucket are spread over tasks, and its centres repeated for each part.
    """
    outer = params.inner + params.hashes - params.agree
    few = large.filter(F.pmod(F.xxhash64("id", "key"), F.col("n")) < params.sample).join(sketches, "id").select("key", "n", "id", "sketch")
    found = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("centres", pa.binary())])

    def centres(t: pa.Table) -> pa.Table:
        made = centres_of(_tokens(t.sort_by("id").column("sketch"), params.hashes), params)
        return pa.table([t.column("key").slice(0, 1), t.column("n").slice(0, 1), pa.array([made.tobytes()], pa.binary())], schema=found)

    parts = F.ceil(F.col("n") / params.limit).cast("int")
    at = few.groupBy("key").applyInArrow(centres, "key long, n long, centres binary")
    at = at.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "centres")
    rows = large.select("key", "id", F.pmod(F.xxhash64("id", F.lit(3)), parts).cast("int").alias("part")).join(sketches, "id").join(at, ["key", "part"], "left")

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                key, ids, tokens = b.column("key").to_numpy(), b.column("id").to_numpy(), _tokens(b.column("sketch"), params.hashes)
                made = [np.frombuffer(c or b"", np.uint32).reshape(-1, params.hashes) for c in b.column("centres").to_pylist()]
                stays, out = np.ones(len(ids), bool), []
                for k in range(params.centres):
                    rows = np.flatnonzero(stays & np.array([len(m) > k for m in made]))
                    if not len(rows):
                        break
                    apart = (tokens[rows] != np.stack([made[r][k] for r in rows])).sum(axis=1)
                    near = rows[apart <= outer]
                    out.append((near, _mix(key[near].view(np.uint64) + np.uint64(k + 1) * MIX).view(np.int64)))
                    stays[rows[apart <= params.inner]] = False
                for rows, centre in out:
                    yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(ids[rows]), pa.array(centre)], schema=REACHED)
                rows = np.flatnonzero(stays)
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(ids[rows]), pa.nulls(len(rows), pa.int64())], schema=REACHED)

    return rows.select("key", "id", "sketch", "centres").mapInArrow(run, "key long, id long, centre long")


def _run(classes: DataFrame, runs: range, params: Params, groups: DataFrame | None = None) -> DataFrame:
    """Edges that the runs find among classes (id, sketch), but for those within groups. Centres of large buckets are nodes of edges too."""
    level, leaves, linked = _shared(_first_level(classes, runs, params), groups), [], []
    # from here on only the classes that met another count
    sketches = common.written(classes.select("id", "sketch").join(level.select("id").distinct(), "id", "left_semi"), "sketches")

    def leaf(rows: DataFrame) -> DataFrame:
        leaves.append(rows.filter(F.col("n") <= params.limit).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "id"))
        return rows.filter(F.col("n") > params.limit)

    for depth in range(1, params.depth + 1):
        large = leaf(level)
        if large.isEmpty():
            break
        reached = common.written(_reached(large, sketches, params), "reached")
        linked.append(reached.filter("centre is not null").select(F.col("id").alias("a"), F.col("centre").alias("b")))
        large = leaf(_shared(reached.filter("centre is null").select("key", "id"), groups))
        if large.isEmpty():
            break
        if depth < params.depth:
            level = _shared(_next_level(large.join(sketches, "id"), params), groups)
        else:
            blocks = F.ceil(F.col("n") / params.block).cast("int")
            own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
            dealt = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            leaves.append(dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id"))
    buckets = leaves[0]
    for x in leaves[1:]:
        buckets = buckets.unionByName(x)
    ordered = buckets.join(sketches, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    edges = _bucket_edges(ordered, params)
    if linked:
        both = linked[0]
        for x in linked[1:]:
            both = both.unionByName(x)
        # a class meets a few centres in each run: one edge for the class, the rest between centres, which are few
        stars = common.written(both.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("all")), "stars")
        between = stars.select(F.col("all")[0].alias("b"), F.explode("all").alias("a")).filter("a != b").select("a", "b")
        edges = edges.unionByName(stars.select("a", F.col("all")[0].alias("b"))).unionByName(between)
    return edges.distinct()


def candidate_groups(classes: DataFrame, params: Params) -> DataFrame:
    """(id, component) of the classes (id, sketch) that may be like another."""
    first = min(params.first_runs, params.runs)
    edges = common.written(_run(classes, range(first), params), "links")
    groups = components(edges)
    if params.runs > first:
        more = common.written(_run(classes, range(first, params.runs), params, groups), "links")
        groups = components(edges.unionByName(more))
    return groups


# -- exact comparison -----------------------------------------------------------------


def _linked(sets: list[np.ndarray], own: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of links of each set, and the smallest row that it is connected with.

    ``own`` is each set's block, i or j; blocks i and j are compared with each other, and with themselves if equal.
    """
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code, minlength=len(values)) > 1
    keep = often[code]  # an n-gram of one set alone is in no intersection
    code, row = (np.cumsum(often) - 1)[code[keep]], row[keep]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    rows_i, rows_j = np.flatnonzero(own == i), np.flatnonzero(own == j)
    common_grams = np.zeros((len(rows_i), len(rows_j)), np.int32)
    width = min(2048, max(64, CELLS // len(sets)))
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(code, (at, at + width))
        dense = np.zeros((len(sets), min(width, int(often.sum()) - at)), np.float32)
        dense[row[lo:hi], code[lo:hi] - at] = 1
        others = dense[rows_j].T
        for top in range(0, len(rows_i), 512):
            common_grams[top : top + 512] += (dense[rows_i[top : top + 512]] @ others).astype(np.int32)  # 2048 at most: exact
    # whole numbers, so that pairs at the threshold itself are links: common / union >= n / d
    n, d = Fraction(str(threshold)).limit_denominator(10**6).as_integer_ratio()
    count, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    step = max(1, PAIRS // (len(rows_j) + 1))
    for top in range(0, len(rows_i), step):
        part = rows_i[top : top + step]
        links = common_grams[top : top + step].astype(np.int64) * (n + d) >= n * (sizes[part][:, None] + sizes[rows_j][None, :])
        if i == j:
            links[np.arange(len(part)), np.arange(top, top + len(part))] = False
        count[part] += links.sum(axis=1)
        if i != j:
            count[rows_j] += links.sum(axis=0)
        left, right = np.nonzero(links)
        label = _stars(label, part[left], rows_j[right])
    return count, label


def exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, params: Params) -> DataFrame:
    """(id, links, near): links of each class of a candidate group counted block by block, and a class it is connected with.

    ``classes`` has (id, doc_id, text_key, grams), with a document of each class; the sets are made again from its text.
    """
    out = pa.schema([("id", pa.int64()), ("grams", pa.binary())])

    def sets(batches):
        shingles = Shingler(params.words)
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t.as_buffer() if t.is_valid else b"").tobytes() for t in b.column("text")], pa.binary())], schema=out)

    members = common.written(classes.join(groups, "id"), "members")
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.sum("grams") / params.exact_block), F.ceil(F.count("*") / params.exact_classes)).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    # members grow with the documents: a merge join at every size
    wanted = members.select(F.col("id"), F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).hint("merge")
    found = texts.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "text").mapInArrow(sets, "id long, grams binary").dropDuplicates(["id"])
    dealt = members.select("id", "component").join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    result = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("near", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
        grams = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        count, label = _linked(grams, own, t.column("i")[0].as_py(), t.column("j")[0].as_py(), params.threshold)
        return pa.table([ids, count, ids[label]], schema=result)

    return dealt.join(found, "id").groupBy("component", "i", "j").applyInArrow(compare, "id long, links long, near long")


def join(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """A row per document: doc_id, class_id, copy_of, n_links, text_key.

    copy_of is the smallest doc_id of the documents with an equal set of n-grams; n_links
    the number of other such sets at or over the threshold; class_id the smallest doc_id
    of all documents that links connect. Texts without words (null, empty, blank) are alone:
    class_id and copy_of are their own doc_id. Texts of fewer words than an n-gram have one n-gram.
    """
    seen = common.written(signatures(docs, params), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("first")
    classes = common.written(seen.filter("id is not null").groupBy("id").agg(first, F.min("grams").alias("grams"), F.min("sketch").alias("sketch")).select("id", "first.doc_id", "first.text_key", "grams", "sketch"), "classes")
    groups = candidate_groups(classes.select("id", "sketch"), params)
    exact = common.written(exact_links(docs, classes.drop("sketch"), groups, params), "exact")
    links = exact.groupBy("id").agg(F.sum("links").alias("n_links"))
    final = components(exact.select(F.col("id").alias("a"), F.col("near").alias("b")))
    named = classes.select("id", F.col("doc_id").alias("copy_of")).join(final, "id", "left").join(links, "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    named = common.written(named.join(least, "component").select("id", "component", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    out = seen.select("doc_id", "text_key", "id").join(named, "id", "left")
    alone = lambda c: F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", alone("class_id"), alone("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", "component")


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents without near copies: of each class one row of the smallest doc_id stays; texts without words (null, empty, blank) all stay.

    Of repeated rows one stays; a null doc_id comes last. Columns of any names stay. An empty table stays empty.
    """
    doc, key, text_key = common.unused(docs.columns, "doc", "key", "text_key")
    found = common.written(join(docs, params).filter("component is not null"), "joined")
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("least")
    kept = common.written(found.groupBy("component").agg(least).select(F.col("least.doc_id").alias(doc), F.col("least.text_key").alias(key)).distinct(), "kept")
    same = lambda d, k: (F.col(k) == F.col(key)) & F.col(d).eqNullSafe(F.col(doc))
    repeated = found.join(kept, same("doc_id", "text_key"), "left_semi").groupBy("doc_id", "text_key").count().filter("count > 1")
    rows = docs.withColumn(text_key, F.xxhash64("text"))
    word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = rows.filter(word).join(kept, same("doc_id", text_key), "left_semi")
    if not repeated.isEmpty():
        some = some.dropDuplicates(["doc_id", text_key])
    return some.unionByName(rows.filter(~word)).select(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: five-word n-grams, a Jaccard index of 0.8 or more."""
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links")
