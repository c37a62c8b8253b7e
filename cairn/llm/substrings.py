"""Substring dedup by repeated-phrase automata: words inside windows that an earlier document has go.

A window is 13 words in a row. Each window names one of its runs of seven words, the one
with the smallest hash, so that equal windows of any two documents name equal runs. Then

1. runs that stand in one document alone are left out (a sort by run; its ranges are even,
   however common a run is);
2. what is left is the fragments around recurring runs: the windows that name one run. Equal
   fragments become one, with the smallest and largest doc_id;
3. fragments are dealt out by their run. A task confirms which phrases recur in different
   documents (whole fragments, or single windows where fragments of a run differ), compiles
   them into an Aho-Corasick automaton over words, and streams its fragments through: each window
   of an occurrence gets the smallest doc_id that has it;
4. documents take up what was found in their fragments, and drop covered words.

No window is lost between shards, since equal windows have the same run. Runs with more than
``crowd`` different fragments are matched window by window instead, in a join that Spark can split.
Hashes find candidates; windows are compared word by word. Fragments are known by 128 bits.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import Words, smallest

WINDOW, RUN = 13, 7
#: Different fragments of one run up to which one automaton holds them, and bytes of fragments after which it is closed.
CROWD, BYTES = 2_000, 1 << 20
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def fragments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, fragment, first, count): hash of a run, hash of all words of the fragment around it, its first word and its number of windows."""
    none = np.empty(0, np.int64)
    n = len(words.hash) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), none, none
    runs = words.grams(RUN)
    whole = np.flatnonzero(words.text[:n] == words.text[WINDOW - 1 :])
    place = np.empty(n, np.int64)
    step = int(_PLACE) - WINDOW
    for at in range(0, n, step):  # places count within blocks; of equal hashes the first wins
        part = runs[at : min(at + step, n) + WINDOW - RUN]
        place[at : at + step] = at + (smallest((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), WINDOW - RUN + 1) & _PLACE).astype(np.int64)
    place = place[whole]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else none
    first, count = whole[new], np.diff(np.append(new, len(place)))
    return runs[place[new]], words.runs(first, first + count + WINDOW - 2), first, count


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _named(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, runs): the runs that two documents at least have, by document; a few others may be among them."""
    out = pa.schema([("run", pa.int64()), ("doc_id", pa.int64())])

    def each(batches):
        for whole in batches:
            for b in common.slices(whole, "text", SLICE):
                words = Words(_texts(b.column("text")))
                run, _, first, _ = fragments(words)
                owner = words.text[first]
                order = np.lexsort((run, owner))
                run, owner = run[order], owner[order]
                new = np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])]) if len(run) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(run[new].view(np.int64)), b.column("doc_id").take(pa.array(owner[new]))], schema=out)

    def twice(batches):
        # rows come sorted by run; the first and last of a range may go on in the next one, and stay
        held, before = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            run = b.column("run").to_numpy()
            same = run[1:] == run[:-1]
            stay = np.concatenate([[before is None or run[0] == before], same])
            stay[:-1] |= same
            keep = np.flatnonzero(stay[:-1])
            before = run[-2] if len(run) > 1 else before
            held = b.slice(b.num_rows - 1)
            yield b.take(pa.array(keep))
        if held is not None:
            yield held

    found = _named(docs.filter("doc_id is not null")).mapInArrow(each, "run long, doc_id long")
    dealt = found.repartitionByRange("run", "doc_id").sortWithinPartitions("run", "doc_id").mapInArrow(twice, "run long, doc_id long")
    return dealt.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def passages(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, fragment, doc_id, words): the fragments around each document's recurring runs."""
    out = pa.schema([("run", pa.int64()), ("fragment", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary())])

    def each(batches):
        for whole in batches:
            for b in common.slices(whole, "text", SLICE):
                words = Words(_texts(b.column("text")))
                run, fragment, first, count = fragments(words)
                keep = np.flatnonzero(np.isin(run.view(np.int64), b.column("runs").flatten().to_numpy()))
                last = first + count + WINDOW - 2
                texts = [words.between(i, j) for i, j in zip(first[keep].tolist(), last[keep].tolist())]
                owner = b.column("doc_id").take(pa.array(words.text[first[keep]]))
                yield pa.RecordBatch.from_arrays([pa.array(run[keep].view(np.int64)), pa.array(fragment[keep].view(np.int64)), owner, pa.array(texts, pa.binary())], schema=out)

    return _named(docs).join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(each, "run long, fragment long, doc_id long, words binary")


def _confirmed(group: list[list[int]], run: list[int], low: list[int], high: list[int]) -> dict[tuple, tuple[int, int]]:
    """Recurring phrases, as numbers of words, with the smallest doc_id that has them and their number of windows.

    Where a run has one fragment alone, all that is in it recurs or nothing. Else its windows are confirmed one by one.
    """
    phrases: dict[tuple, tuple[int, int]] = {}
    seen: dict[tuple, list[int]] = {}
    for i, (words, r, a, z) in enumerate(zip(group, run, low, high)):
        if (i and run[i - 1] == r) or (i + 1 < len(run) and run[i + 1] == r):
            for j in range(len(words) - WINDOW + 1):
                w = tuple(words[j : j + WINDOW])
                if (s := seen.get(w)) is None:
                    seen[w] = [a, z]
                else:
                    s[0], s[1] = min(s[0], a), max(s[1], z)
        elif a < z:
            phrases[tuple(words)] = a, len(words) - WINDOW + 1
    phrases.update((w, (a, 1)) for w, (a, z) in seen.items() if a < z)
    return phrases


def _searched(texts: list[bytes], run: list[int], low: list[int], high: list[int]) -> list[list[int | None]]:
    """For each window of each fragment the smallest doc_id that has it; null for windows of one document alone. Fragments come in order of run."""
    numbers: dict[bytes, int] = {}
    group = [[numbers.setdefault(w, len(numbers)) for w in t.split(b" ")] for t in texts]
    phrases = _confirmed(group, run, low, high)
    out: list[list[int | None]] = [[None] * (len(words) - WINDOW + 1) for words in group]
    if phrases:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, value in phrases.items():
            automaton.add_word(w, value)
        automaton.make_automaton()
        for words, found in zip(group, out):
            for end, (a, n) in automaton.iter(tuple(words)):
                last = end - WINDOW + 2
                found[last - n : last] = [a] * n
    return out


def located(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(run, fragment, least): of each of the fragment's windows the smallest doc_id that has it. ``distinct`` has run, fragment, words, low and high.

    Runs with more than ``crowd`` fragments are left to ``crowded``: they give one row with nulls.
    """
    out = pa.schema([("run", pa.int64()), ("fragment", pa.int64()), ("least", pa.list_(pa.int64()))])

    def search(t: pa.Table):
        run, texts = t.column("run").to_numpy(), t.column("words").to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sizes = np.diff(np.append(starts, len(run)))
        many = np.repeat(sizes > crowd, sizes)
        if many.any():
            one = run[starts[sizes > crowd]]
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.nulls(len(one), pa.int64()), pa.nulls(len(one), out.field("least").type)], schema=out)
            t = t.filter(pa.array(~many))
            yield from search(t.combine_chunks()) if t.num_rows else ()
            return
        low, high, runs = t.column("low").to_pylist(), t.column("high").to_pylist(), run.tolist()
        total = np.cumsum([len(x) for x in texts])
        ends = np.append(starts[1:], len(run)).tolist()
        at = 0
        for to in ends:  # an automaton is closed after some bytes, between runs
            if to == len(texts) or total[to - 1] - (total[at - 1] if at else 0) > BYTES:
                least = _searched(texts[at:to], runs[at:to], low[at:to], high[at:to])
                part = t.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column("run").combine_chunks(), part.column("fragment").combine_chunks(), pa.array(least, pa.list_(pa.int64()))], schema=out)
                at = to

    def each(batches):
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            run = t.column("run").to_numpy()
            cut = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
            if cut:
                yield from search(t.slice(0, cut).combine_chunks())
            held = t.slice(cut, crowd + 1)  # one more than an automaton takes tells enough
        if held is not None and held.num_rows:
            yield from search(held.combine_chunks())

    dealt = distinct.select("run", "fragment", "words", "low", "high").repartition("run").sortWithinPartitions("run")
    return dealt.mapInArrow(each, "run long, fragment long, least array<long>")


def crowded(distinct: DataFrame) -> DataFrame:
    """As ``located``, for runs with any number of fragments: an aggregation and a join by window."""
    ws = F.split(F.col("words").cast("string"), " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda j: F.array_join(F.slice(ws, j, WINDOW), " "))
    rows = distinct.select("run", "fragment", "low", "high", F.posexplode(windows).alias("at", "window"))
    least = rows.groupBy("window").agg(F.min("low").alias("a"), F.max("high").alias("z")).select("window", F.when(F.col("a") < F.col("z"), F.col("a")).alias("a"))
    met = rows.join(least, "window").groupBy("run", "fragment").agg(F.array_sort(F.collect_list(F.struct("at", "a"))).alias("s"))
    return met.select("run", "fragment", F.col("s.a").alias("least"))


def marks(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, found): of each document with words to remove its fragments, each with the windows of it that a smaller doc_id has, as bits.

    A staged table: what the steps before have staged and shuffled is gone from disk as soon as no later step reads it.
    """
    steps = common.Steps()
    rows = steps.written(passages(docs, steps.written(recurring(docs), "runs")), "passages", compression="zstd")
    steps.drop("runs")
    distinct = steps.written(rows.groupBy("run", "fragment", "words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "fragments", compression="zstd")
    least = steps.written(located(distinct, crowd), "least")
    many = steps.written(least.filter("fragment is null").select("run").distinct(), "crowds")
    least = least.unionByName(crowded(distinct.join(many, "run", "left_semi")))
    least = least.filter(F.exists("least", lambda a: a.isNotNull()))
    bits = sum((F.when(F.get("least", F.lit(j)) < F.col("doc_id"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(WINDOW - RUN + 1)), F.lit(0))
    found = rows.select("run", "fragment", "doc_id").join(least, ["run", "fragment"]).select("doc_id", "fragment", bits.alias("bits")).filter("bits > 0")
    found = steps.written(found.groupBy("doc_id").agg(F.collect_set(F.struct("fragment", "bits")).alias("found")), "found")
    steps.drop("passages", "fragments", "least", "crowds")
    return found


def removed(words: Words, run: tuple, found: list[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
    """Which words are covered by a window that was found."""
    _, fragment, first, count = run
    steps = np.zeros(len(words.hash) + 1, np.int64)
    owner, codes = words.text[first], fragment.view(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(found) + 1))
    for i, own in enumerate(found):
        if own is None:
            continue
        a, b = bounds[i], bounds[i + 1]
        order = np.argsort(own[0])
        keys, bits = own[0][order], own[1][order]
        at = np.minimum(np.searchsorted(keys, codes[a:b]), len(keys) - 1)
        hit = np.where(keys[at] == codes[a:b], bits[at], 0)
        for j in range(WINDOW - RUN + 1):
            start = first[a:b][(hit >> j) & 1 == 1] + j
            np.add.at(steps, start, 1)
            np.add.at(steps, start + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def apply(docs: DataFrame, found: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and kept with ``texts``) of every row of docs."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * texts)

    def each(batches):
        for whole in batches:
            for b in common.slices(whole, "text", SLICE):
                words, own = Words(_texts(b.column("text"))), []
                for i, x in enumerate(b.column("found")):
                    s = x.values if x.is_valid else None
                    own.append(None if s is None else (s.field("fragment").to_numpy(), s.field("bits").to_numpy()))
                gone = removed(words, fragments(words), own) if any(x is not None for x in own) else np.zeros(len(words.hash), bool)
                n, cut, kept = [], [], []
                for i in range(b.num_rows):
                    ws, g = words.of(i), gone[words.first[i] : words.first[i + 1]]
                    n.append(len(ws))
                    cut.append(int(g.sum()))
                    kept.append(b" ".join(ws if not cut[-1] else [w for w, x in zip(ws, g.tolist()) if not x]))
                digest = [hashlib.sha256(k).hexdigest() for k in kept]
                columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary()).cast(pa.string())] * texts, schema=out)

    rows = _named(docs).join(found, "doc_id", "left").select("doc_id", "text", "found")
    return rows.mapInArrow(each, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def dedup(docs: DataFrame, crowd: int = CROWD, texts: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed and the SHA-256 of the kept words, one blank between; with ``texts`` the kept words themselves.

    A word goes if a window of 13 words covers it whose words also stand, in a row, in a
    document with a smaller doc_id. A null text is empty. Texts of fewer than 13 words keep all.
    Rows with the same doc_id are one document to each other: they remove nothing from one another.
    A null doc_id compares with none: such a row loses nothing and removes nothing. An empty table gives
    no rows. Other columns of docs are not looked at.
    """
    return apply(docs, marks(docs, crowd), texts)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that an earlier one has in a window of 13."""
    return dedup(common.table(spark, sf_dir, "documents"))


#: The same rows in SQL.
SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
    m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
    cut AS (SELECT DISTINCT doc_id, i + o AS p FROM w JOIN m USING (k), (SELECT unnest(range(0, 13)) AS o) WHERE least < doc_id),
    gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM cut GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE [ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
    FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id"""
