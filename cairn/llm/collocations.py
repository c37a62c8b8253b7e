"""Phrase collocations by prefix-free parsing.

Texts are parsed into chunks: pieces between punctuation, and long pieces cut where a word's
hash says so, each chunk reaching three words into the next one. Equal chunks become one, with
their number: n-grams are counted inside distinct chunks, times that number. A chunk owns the
n-grams that begin before its overlap, so that each occurrence counts once.

One row for each word that a chunk owns, the up to four words from there on, gives the counts of all
n-grams. Rows are dealt out by their first word, or by more words where a sample of chunks says that
the first ones are too common for one part. In its part a row has its place by one number, made
of hashes of its first words, the first two and the first three: rows that begin with a phrase stand together,
perhaps with others of the same hash, and are told apart by their words. A phrase that goes over the
end of a batch, or over parts, is added up from its sums there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: Words of a piece up to which it is one chunk; one in so many words begins a chunk in longer ones, and no chunk owns more than MOST.
SHORT, TRIGGER, MOST = 16, 16, 256
#: Rows of three words at most, at the ends of chunks, or of four very common ones, that are added up in memory before they are dealt out.
ROWS = 200_000
#: Chunks in the sample for common beginnings, and rows in it that make one.
SAMPLE, COMMON = 5_000, 8
#: Bits of a row's number behind those for its first one, two, three and four words.
BEHIND = (40, 20, 0, 0)
_UPPER, _ENDS = range(65, 91), b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, what ends a piece to line feeds, tabs to blanks.
FLAT = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if b in _UPPER else b for b in range(256))
#: Blanks to zero bytes, the smallest ones, so that all that begins with a phrase stands together in order; a word's own zero bytes to tabs.
KEYED = bytes(0 if b == 32 else 9 if b == 0 else b for b in range(256))
PLAIN = bytes(32 if b == 0 else 0 if b == 9 else b for b in range(256))


def parse(piece: bytes):
    """(chunk, owned) of a piece whose words have one blank between."""
    n = piece.count(b" ") + 1
    if n <= SHORT:
        yield piece, n
        return
    words, begin = piece.split(b" "), 0
    for i in range(1, n + 1):
        if i == n or i - begin == MOST or zlib.crc32(words[i]) % TRIGGER == 0:
            yield b" ".join(words[begin : i + LONGEST - 1]), i - begin
            begin = i


def _clean(text: bytes) -> bytes:
    """Pieces with line feeds between, one blank between words and none around them."""
    text = text.translate(FLAT)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.replace(b"\n ", b"\n").replace(b" \n", b"\n").strip(b" ")


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, owned, times): the distinct chunks of all texts by language."""
    out = pa.schema([("lang", pa.string()), ("chunk", pa.binary()), ("owned", pa.int32()), ("times", pa.int64())])

    def each(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 4 << 20):
                pieces: dict[str, Counter] = {}
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                    pieces.setdefault(lang, Counter()).update(_clean(text).split(b"\n"))
                for lang, times in pieces.items():
                    times.pop(b"", None)
                    yield from owned(lang, times)

    def owned(lang: str, times: Counter):
        pieces, many = pa.array(times, pa.binary()), np.fromiter(times.values(), np.int64, len(times))
        words = pc.count_substring(pieces, " ").to_numpy(zero_copy_only=False).astype(np.int32) + 1
        short = words <= SHORT
        parts: Counter = Counter()
        for piece, n in zip(pieces.filter(pa.array(~short)).to_pylist(), many[~short].tolist()):
            for part in parse(piece):
                parts[part] += n
        chunks, sizes = zip(*parts) if parts else ((), ())
        for found in ((pieces.filter(pa.array(short)), words[short], many[short]), (chunks, sizes, list(parts.values()))):
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found[0]), pa.string()), *(pa.array(c, f.type) for c, f in zip(found, list(out)[1:]))], schema=out)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(each, "lang string, chunk binary, owned int, times long").groupBy("lang", "chunk", "owned").agg(F.sum("times").alias("times"))


def _gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
    """data[begin:end] of each pair, as strings or binary values."""
    sizes = end - begin
    offsets = np.append(0, np.cumsum(sizes))
    if offsets[-1] >= 1 << 31:
        raise OverflowError("over 2 GB of words in one batch")
    offsets = offsets.astype(np.int32)
    at = np.repeat(begin.astype(np.int32) - offsets[:-1], sizes)
    at += np.arange(offsets[-1], dtype=np.int32)
    return pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string or binary column."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), bounds


class _Hashed:
    """64-bit hashes of any stretches of data, by sums over its beginnings."""

    ODD = 0x9E3779B97F4A7C15

    def __init__(self, data: np.ndarray):
        powers = lambda of: np.cumprod(np.append(np.uint64(1), np.full(len(data), of, np.uint64)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * powers(self.ODD)[:-1], dtype=np.uint64))
        self.back = powers(pow(self.ODD, -1, 1 << 64))

    def __call__(self, begin: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.back[begin] ^ seed
        for shift in (31, 29):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def _starts(b: pa.RecordBatch) -> tuple[pa.Table, Callable[[int, np.ndarray], np.ndarray], np.ndarray]:
    """(lang, gram, times, near) of each owned word of the chunks, hash(words, rows) of so many first words of these rows, and how many words each row has. Rows are in order of near: those that begin alike stand together, for they are packed better so."""
    data, bounds = _bytes(b.column("chunk"))
    low, high = int(bounds[0]), int(bounds[-1])
    data, bounds = np.frombuffer(KEYED, np.uint8)[data[low:high]], bounds - low
    gaps = np.flatnonzero(data == 0)
    begin, end = np.sort(np.concatenate([bounds[:-1], gaps + 1])), np.sort(np.concatenate([bounds[1:], gaps]))
    first = np.searchsorted(begin, bounds)  # of each chunk, the first of its words
    chunk = np.repeat(np.arange(b.num_rows), np.diff(first))
    coded, hashed = b.column("lang").dictionary_encode(), _Hashed(data)
    seeds = np.array([zlib.crc32(lang.encode()) for lang in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()][chunk]
    last = first[chunk + 1] - 1

    def known(words: int, rows: np.ndarray) -> np.ndarray:
        return hashed(begin[rows], end[np.minimum(rows + words - 1, last[rows])], seeds[rows])

    mine = np.flatnonzero(np.arange(len(begin)) - first[chunk] < b.column("owned").to_numpy()[chunk])
    half = np.uint64(32)
    near = known(1, mine) >> half << half | known(2, mine) >> half
    order = np.argsort(near)
    mine, near = mine[order], near[order]
    owner = pa.array(chunk[mine])
    words = np.minimum(last[mine] + 1 - mine, LONGEST)
    table = pa.table([b.column("lang").take(owner), _gather(data, begin[mine], end[mine + words - 1], pa.string()), b.column("times").take(owner), pa.array(near)], names=["lang", "gram", "times", "near"])
    return table, lambda n, rows: known(n, mine[rows]), words


def _common(chunks: DataFrame, n: int) -> list[np.ndarray]:
    """Hashes of the beginnings, of one to four words, that have over a quarter of one of n even parts of the rows, by about SAMPLE chunks: one in so many, by a hash."""
    one_in = max(1, chunks.count() // SAMPLE)
    few = chunks.filter(F.pmod(F.xxhash64("lang", "chunk", "owned"), F.lit(one_in)) == 0)
    rows = few.select("lang", "chunk", "owned", "times").limit(2 * SAMPLE).toArrow()
    found: list[list[np.ndarray]] = [[] for _ in range(LONGEST)]
    for whole in rows.combine_chunks().to_batches():
        for b in common.slices(whole, "chunk", 1 << 18):
            _, known, words = _starts(b)
            for size, own in enumerate(found, 1):
                own.append(known(size, np.flatnonzero(words >= size)))
    out = []
    for own in found:
        hashes, rows_of = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_counts=True)
        out.append(hashes[rows_of >= max(COMMON, sum(map(len, found[0])) / (4 * n))])
    return out


def beginnings(chunks: DataFrame) -> DataFrame:
    """(lang, gram, times, split, shared, place): the up to four words from each owned word on, zero bytes between, in order of place in each part. split: so many of its first words are common, alone and together, and what begins with them lies in several parts (shared)."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = chunks.sparkSession.sparkContext.broadcast(_common(chunks, n))  # at most 4 n numbers for each number of words
    out = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("gram", pa.string()), ("times", pa.int64()), ("split", pa.int32())])

    def placed(t: pa.Table, known: Callable[[int, np.ndarray], np.ndarray], words: np.ndarray) -> pa.Table:
        rows, part, split = np.arange(len(words)), np.empty(len(words), np.int32), np.zeros(len(words), np.int32)
        for n_words, of in enumerate(often.value, 1):
            rows = rows[words[rows] >= n_words]
            h = known(n_words, rows)
            part[rows] = h % np.uint64(n)
            rows = rows[of[np.searchsorted(of[:-1], h)] == h] if len(of) else rows[:0]
            split[rows] = n_words
        return t.append_column("part", pa.array(part)).append_column("split", pa.array(split))

    def sent(t: pa.Table):
        yield from t.select(out.names).combine_chunks().to_batches(20_000)

    def added(tables: list[pa.Table]) -> tuple[pa.Table, pa.Table]:
        """Sums: of what stood once, and of what stood several times."""
        t = pa.concat_tables(tables).group_by(["near", "lang", "gram"], use_threads=False).aggregate([("times", "sum"), ("part", "min"), ("split", "min"), ("times", "count")])
        t = t.rename_columns(["near", "lang", "gram", "times", "part", "split", "rows"])
        t = t.take(pa.array(np.argsort(t.column("near").to_numpy())))
        again = pc.greater(t.column("rows"), 1)
        return tuple(t.filter(which).select(tables[0].column_names) for which in (pc.invert(again), again))

    def each(batches):
        held: list[pa.Table] = []
        for whole in batches:
            for b in common.slices(whole, "chunk", 1 << 18):
                t, known, words = _starts(b)
                t = placed(t, known, words)
                few = pa.array((words < LONGEST) | (t.column("split").to_numpy() == LONGEST))
                yield from sent(t.filter(pc.invert(few)))
                held.append(t.filter(few))
                if sum(map(len, held)) >= ROWS:
                    once, again = added(held)
                    yield from sent(once)
                    held = [again]  # likely to come again
                    if len(again) > ROWS // 2:
                        yield from sent(again)
                        held = []
        if held:
            for t in added(held):
                yield from sent(t)

    rows = chunks.select("lang", "chunk", "owned", "times").mapInArrow(each, "part int, lang string, gram string, times long, split int")
    low = lambda words: F.xxhash64("lang", F.substring_index("gram", "\0", words)).bitwiseAND(F.lit((1 << 20) - 1))
    place = F.shiftleft(F.xxhash64("lang", F.substring_index("gram", "\0", 1)), BEHIND[0]).bitwiseOR(F.shiftleft(low(2), BEHIND[1])).bitwiseOR(low(3))
    return rows.repartitionById(n, "part").select("lang", "gram", "times", "split", (F.col("split") > 0).alias("shared"), place.alias("place")).sortWithinPartitions("place")


def counted(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of one to four words that stand ``least`` times, from ``beginnings``."""
    out = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

    def each(batches):
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("lang").dictionary_encode()
            langs, lang, times, split, place = coded.dictionary, coded.indices.to_numpy(), b.column("times").to_numpy(), b.column("split").to_numpy(), b.column("place").to_numpy()
            data, bounds = _bytes(b.column("gram"))
            begin, end = bounds[:-1], bounds[1:]
            gaps = np.flatnonzero(data[: end[-1]] == 0)
            gap = np.searchsorted(gaps, begin)
            more = np.searchsorted(gaps, end) - gap
            gaps, rows = np.append(gaps, 0), np.arange(b.num_rows)
            for words in range(1, LONGEST + 1):
                rows = rows[more[rows] >= words - 1]
                if not len(rows):
                    break
                to = np.where(more[rows] == words - 1, end[rows], gaps[np.minimum(gap[rows] + words - 1, len(gaps) - 1)])
                keys = _gather(data, begin[rows], to, pa.binary()).dictionary_encode()
                pair = keys.indices.to_numpy().astype(np.int64) * len(langs) + lang[rows]
                if len(keys.dictionary) * len(langs) > 8 * b.num_rows:
                    names, pair = np.unique(pair, return_inverse=True)
                else:
                    names = np.arange(len(keys.dictionary) * len(langs))
                f, keep = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
                np.add.at(f, pair, times[rows])
                run = place >> BEHIND[words - 1]
                keep[pair[np.isin(run[rows], run[[0, -1]]) | (split[rows] >= words)]] = True  # these may go on in other batches
                keep |= f >= least
                kept = np.flatnonzero(keep & (f > 0))
                found = [k.translate(PLAIN).decode() for k in keys.dictionary.take(pa.array(names[kept] // len(langs))).to_pylist()]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(names[kept] % len(langs))), pa.array(found, pa.string()), pa.array([words] * len(found), pa.int32()), pa.array(f[kept], pa.int64())], schema=out)
                rows = rows[keep[pair]]

    parts = rows.select("lang", "gram", "times", "split", "place").mapInArrow(each, "lang string, phrase string, words int, f long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def scored(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that no longer one stands for."""
    several = counts.filter("words > 1").withColumnRenamed("f", "a").withColumn("_w", F.split("phrase", " "))
    part = lambda at, n: F.array_join(F.slice("_w", at, n), " ")
    cuts = several.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "_k", part(F.lit(1), F.col("_k")).alias("_first"), part(F.col("_k") + 1, F.col("words") - F.col("_k")).alias("_rest"))
    of = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"])
    cuts = cuts.withColumn("_twice", exact("a") * F.lit(2_000_000)).withColumn("_both", exact("l") + exact("r")).withColumn("score", F.expr("_twice div _both"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: F.array_join(F.slice("_w", at, n), " "))))
    longer = several.filter("words > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = best.join(longer, ["lang", "phrase"], "left")
    return left.filter(F.col("_longer").isNull() | (exact("_longer") * F.lit(100) < exact("a") * F.lit(share))).drop("_longer")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's phrases, best first.

    A null text is empty, a null language is ``und``; repeated rows count each. Pieces without words give
    nothing, and an empty table no rows. Other columns of docs are not looked at, doc_id neither.
    """
    chunks = common.written(dictionary(docs), "dictionary", compression="zstd")
    counts = common.written(counted(beginnings(chunks), least), "counts")
    n = chunks.groupBy("lang").agg(F.sum(F.col("owned").cast("long") * F.col("times")).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored(counts, share).withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language in all documents."""
    return collocations(common.table(spark, sf_dir, "documents"))


#: The same rows in SQL.
SQL = rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
    g AS (SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
    c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE words > 1 AND f >= {LEAST}),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
    v AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score FROM cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = x JOIN g r ON r.lang = cuts.lang AND r.phrase = y),
    b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS phrase, max(a) AS longer FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS o) WHERE m < words AND o + m - 1 <= words GROUP BY 1, 2),
    n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
    z AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {SHARE} * a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= {TOP}"""
