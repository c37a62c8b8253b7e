"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source x language x topic), the cells' weights are
raked until their sums by source, by language and by topic agree with the targets, and
documents are sampled with the probability that their cell's calibrated weight asks for.

There may be as many sources as the corpus has; languages are those listed and one more
for all others, topics a fixed number. So the sources' factors never leave Spark: a round
is one job over a table with a row per source, which gives the driver one number for each
language and topic. Every size of input takes the same way.

Topics are clusters of the documents' word vectors: the words of a text, each by the
logarithm of its count, hash into a vector of fixed length, the mean of the language goes
off, and k-means runs over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import Shingler

AXES = ("source", "lang", "topic")
#: A cell table of so many rows at most is broadcast to the documents; beyond it the same join shuffles.
SMALL = 50_000
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}
OTHER = ""


@dataclass(frozen=True)
class Topics:
    """Parameters of the topic model: 2**bits topics, vectors of ``width`` whole numbers of length ``unit``."""

    bits: int = 3
    width: int = 64
    unit: int = 1000
    rounds: int = 6

    @property
    def count(self) -> int:
        return 1 << self.bits


@dataclass
class TopicModel:
    languages: tuple[str, ...]
    means: np.ndarray  # of each language, and of the others
    centres: np.ndarray
    topics: Topics = field(default_factory=Topics)

    def nearest(self, lang: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector without its language's mean; of equally near ones the first."""
        apart = vectors - self.means[lang]
        return (apart @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)


def word_vector(shingles: Shingler, text: bytes, topics: Topics) -> tuple[int, np.ndarray]:
    """(words of a text, its vector): 0 and zeros without words."""
    words = shingles.words_of(text)
    if not len(words):
        return 0, np.zeros(topics.width, np.int16)
    kinds, counts = np.unique(words, return_counts=True)
    weight = np.log1p(counts) * np.where(kinds >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    made = np.bincount((kinds % np.uint64(topics.width)).astype(np.int64), weight, topics.width)
    return len(words), np.rint(made * (topics.unit / max(np.sqrt((made**2).sum()), 1e-9))).astype(np.int16)


def language_of(lang: Column, languages: tuple[str, ...]) -> Column:
    """A listed language, or OTHER for all others and null."""
    return F.when(lang.isin(*languages), lang).otherwise(F.lit(OTHER)) if languages else F.lit(OTHER)


def _code(lang: Column, languages: tuple[str, ...]) -> Column:
    out = F.lit(len(languages))
    for i, x in enumerate(languages):
        out = F.when(lang == x, i).otherwise(out)
    return out.cast("int")


def vectors(docs: DataFrame, languages: tuple[str, ...], topics: Topics) -> DataFrame:
    """(source, lang, tokens, vector) of every whole text; lang is the language's number."""
    out = pa.schema([("source", pa.string()), ("lang", pa.int32()), ("tokens", pa.int64()), ("vector", pa.binary())])

    def run(batches):
        shingles = Shingler(1)
        for whole in batches:
            for b in common.slices(whole, "text", 4 << 20):
                made = [word_vector(shingles, t.as_buffer() if t.is_valid else b"", topics) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("source"), b.column("lang"), pa.array([n for n, _ in made], pa.int64()), pa.array([v.tobytes() for _, v in made], pa.binary())], schema=out)

    rows = docs.select(F.coalesce("source", F.lit("")).alias("source"), _code(F.col("lang"), languages).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "source string, lang int, tokens long, vector binary")


def _numbers(column: pa.Array, topics: Topics) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, topics.width)


def _sums(table: DataFrame, group, groups: int, topics: Topics) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums of the vectors) of each of ``groups`` groups; ``group(lang, vectors)`` gives each row's. Whole numbers, so that their order does not matter."""
    out = pa.schema([("g", pa.int32()), ("rows", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        rows, sums = np.zeros(groups, np.int64), np.zeros((groups, topics.width), np.int64)
        for b in batches:
            v = _numbers(b.column("vector"), topics).astype(np.int64)
            own = group(b.column("lang").to_numpy(), v)
            rows += np.bincount(own, minlength=groups)
            np.add.at(sums, own, v)
        yield pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int32()), pa.array(rows), pa.array(list(sums), pa.list_(pa.int64()))], schema=out)

    parts = table.filter("tokens > 0").select("lang", "vector").mapInArrow(run, "g int, rows long, sums array<long>")
    got = parts.groupBy("g").agg(F.sum("rows").alias("rows"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(topics.width))).collect()
    rows, sums = np.zeros(groups, np.int64), np.zeros((groups, topics.width), np.int64)
    for r in got:
        rows[r["g"]], sums[r["g"]] = r["rows"], [r[f"s{i}"] for i in range(topics.width)]
    return rows, sums


def learn_topics(table: DataFrame, languages: tuple[str, ...], topics: Topics) -> TopicModel:
    """K-means over all rows of ``vectors``, from the orthants of the first ``bits`` places; a topic that loses all rows keeps its centre."""
    rows, sums = _sums(table, lambda lang, v: lang, len(languages) + 1, topics)
    means = sums / np.maximum(rows, 1)[:, None]
    model = TopicModel(languages, means, np.zeros((topics.count, topics.width)), topics)

    def orthant(lang: np.ndarray, v: np.ndarray) -> np.ndarray:
        return ((v - means[lang])[:, : topics.bits] > 0) @ (1 << np.arange(topics.bits))

    for r in range(topics.rounds):
        group, centres, n = (orthant if r == 0 else model.nearest), model.centres, len(languages) + 1
        # by topic and language, for the vectors are summed with their language's mean
        rows, sums = _sums(table, lambda lang, v, group=group: group(lang, v) * n + lang, topics.count * n, topics)
        rows, apart = rows.reshape(-1, n), sums.reshape(topics.count, n, -1) - rows.reshape(topics.count, n, 1) * means
        total = rows.sum(axis=1)
        new = np.where(total[:, None] > 0, apart.sum(axis=1) / np.maximum(total, 1)[:, None], centres)
        model = TopicModel(languages, means, new, topics)
    return model


def topic_cells(table: DataFrame, model: TopicModel) -> DataFrame:
    """(source, lang, topic, tokens): the tokens of each cell, of rows of ``vectors``."""
    out = pa.schema([("source", pa.string()), ("lang", pa.int32()), ("topic", pa.int32()), ("tokens", pa.int64())])

    def run(batches):
        for b in batches:
            own = model.nearest(b.column("lang").to_numpy(), _numbers(b.column("vector"), model.topics))
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("lang"), pa.array(own, pa.int32()), b.column("tokens")], schema=out)

    rows = table.mapInArrow(run, "source string, lang int, topic int, tokens long")
    return rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))


def topic_and_tokens(text: Column, lang: Column, model: TopicModel) -> Column:
    """A struct of topic and tokens of a text (null: empty)."""
    topics = model.topics
    kind = pa.struct([("topic", pa.int32()), ("tokens", pa.int64())])

    @F.arrow_udf("struct<topic int, tokens long>")
    def judged(texts: pa.Array, langs: pa.Array) -> pa.Array:
        shingles = Shingler(1)
        made = [word_vector(shingles, t.as_buffer() if t.is_valid else b"", topics) for t in texts]
        own = model.nearest(langs.to_numpy(zero_copy_only=False), np.array([v for _, v in made]).reshape(-1, topics.width))
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array([n for n, _ in made], pa.int64())], fields=list(kind))

    return judged(text.cast("binary"), _code(lang, model.languages))


# -- raking ---------------------------------------------------------------------------


def language_targets(tokens: np.ndarray, languages: dict[str, float]) -> np.ndarray:
    """Shares of the listed languages, and of all others: those get their token share, the listed ones that occur the rest in proportion to their weights."""
    total = tokens.sum() or 1.0
    others = tokens[-1] / total
    weights = np.where(tokens[:-1] > 0, np.maximum(0.0, np.array(list(languages.values()), float)), 0.0)
    listed = (1 - others) * weights / weights.sum() if weights.sum() else tokens[:-1] / total
    return np.append(listed, others)


def fit_table(table: np.ndarray, rows: np.ndarray, columns: np.ndarray, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Factors by which a table's cells come to the sums by row and by column; a row or column of zeros stays so."""
    factor = np.ones_like(table)
    for _ in range(rounds):
        for axis, target in ((1, rows), (0, columns)):
            now = (table * factor).sum(axis=axis)
            by = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            factor = factor * (by[:, None] if axis == 1 else by[None, :])
        if np.abs((table * factor).sum(axis=1) - rows).max() < tolerance:
            break
    return factor


def rake(sources: DataFrame, tokens: np.ndarray, languages: np.ndarray, topics: np.ndarray, rounds: int = 60, tolerance: float = 1e-6) -> np.ndarray:
    """The factor of each (language, topic) with which all three marginals hold.

    ``sources`` has (source, share, cells): the target share of a source, and its tokens by language and
    topic in an array of structs (at, tokens). A cell's weight is its tokens times the factor of its
    language and topic, scaled so that the source comes to its share. A round scales the sources, and
    fits the sums by language and topic. Where targets contradict each other through empty cells, the last round's factors are what comes out.
    """
    factor = np.ones(tokens.shape)
    for _ in range(rounds):
        weights = scaled(sources, factor).select(F.explode("cells").alias("c")).groupBy("c.at").agg(F.sum("c.weight").alias("weight")).collect()
        now = np.zeros(tokens.size)
        for r in weights:
            now[r["at"]] = r["weight"]
        now = now.reshape(tokens.shape)
        if max(np.abs(now.sum(axis=1) - languages).max(), np.abs(now.sum(axis=0) - topics).max()) < tolerance:
            break
        factor = factor * fit_table(now, languages, topics)
        factor /= factor.max() or 1.0
    return factor


def scaled(sources: DataFrame, factor: np.ndarray) -> DataFrame:
    """The sources with a weight in each struct of cells; weights of a source come to its share."""
    by = F.array(*(F.lit(float(x)) for x in factor.ravel()))
    raw = F.transform("cells", lambda c: F.struct(c["at"].alias("at"), c["tokens"].alias("tokens"), (c["tokens"] * F.element_at(by, c["at"] + 1)).alias("weight")))
    out = sources.select("source", "share", raw.alias("cells"))
    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["weight"])
    own = F.when(total > 0, F.col("share") / total).otherwise(F.lit(0.0))
    return out.withColumn("_own", own).select("source", F.transform("cells", lambda c: c.withField("weight", c["weight"] * F.col("_own"))).alias("cells"))


def scale_for(cells: DataFrame, budget: float) -> float:
    """s so that the sum of tokens * min(1, s * ratio) is ``budget``, for cells (tokens, ratio); infinity if even all tokens are no more.

    The sum rises with s ever more slowly, so that steps along its slope come to s from below, and end there.
    """
    s = 0.0
    for _ in range(100):
        over = F.col("ratio") * F.lit(s) >= 1
        full, rest = cells.agg(F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(~over, F.col("tokens") * F.col("ratio")))).first()
        full, rest = float(full or 0.0), float(rest or 0.0)
        if rest <= 0:
            return s if s and full >= budget else float("inf")
        step = (budget - full) / rest
        if step <= s * (1 + 1e-12):
            return s
        s = step
    return s


def probabilities(cells: DataFrame, keep: float, source_power: float, languages: dict[str, float], topic_power: float, topics: int) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) of the cells (source, lang, topic, tokens); lang is the language's number."""
    width = len(languages) + 1
    found = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()  # at most width * topics rows
    tokens = np.zeros((width, topics))
    for r in found:
        tokens[r["lang"], r["topic"]] = r["tokens"]
    total = tokens.sum()
    at = F.struct((F.col("lang") * topics + F.col("topic")).alias("at"), "tokens")
    # an entry of cells for each language and topic at most
    sources = cells.filter("tokens > 0").groupBy("source").agg(F.pow(F.sum("tokens").cast("double"), F.lit(source_power)).alias("raised"), F.sort_array(F.collect_list(at)).alias("cells"))
    sources = common.written(sources, "sources")
    raised = sources.agg(F.sum("raised")).first()[0] or 1.0
    sources = sources.select("source", (F.col("raised") / F.lit(float(raised))).alias("share"), "cells")
    by_topic = np.power(tokens.sum(axis=0), topic_power) * (tokens.sum(axis=0) > 0)
    factor = rake(sources, tokens, language_targets(tokens.sum(axis=1), languages), by_topic / (by_topic.sum() or 1.0))
    long = scaled(sources, factor).select("source", F.explode("cells").alias("c"))
    ratio = F.col("c.weight") * F.lit(float(total)) / F.col("c.tokens")
    out = common.written(long.select("source", F.floor(F.col("c.at") / topics).cast("int").alias("lang"), (F.col("c.at") % topics).cast("int").alias("topic"), "c.tokens", "c.weight", ratio.alias("ratio")), "weights")
    s = scale_for(out, keep * float(total))
    chance = F.when(F.col("ratio") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) if s == float("inf") else F.least(F.lit(1.0), F.lit(s) * F.col("ratio"))
    return out.select(*AXES, "tokens", "weight", chance.alias("probability"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, keep: float = 0.6, source_power: float = 0.7, languages: dict[str, float] = LANGUAGES, topic_power: float = 0.9, seed: int = 3, topics: Topics = Topics(), name: str = "mix") -> DataFrame:
    """The rows with a struct column ``name``: source, lang, topic, tokens, weight, probability and kept; columns of any other names stay.

    A null source counts as the empty string. Null and unlisted languages are one category (the empty
    string), which aims at its token share, so that none is lost; the listed ones that occur share the rest by
    the weights given. Sources and topics aim at their token shares raised to a power. About ``keep`` of
    all tokens stay. Whether a document stays depends on its cell, doc_id and seed alone, so that repeated rows
    share one fate. Documents of no tokens (null, empty and blank texts) never stay, and have neither weight nor probability
    where their cell has no tokens. An empty table gives no rows.
    """
    if name in docs.columns:
        raise ValueError(f"a column is named {name} already")
    listed = tuple(languages)
    table = common.written(vectors(docs, listed, topics), "vectors")
    model = learn_topics(table, listed, topics)
    cells = common.written(topic_cells(table, model), "cells")
    chances = common.written(probabilities(cells, keep, source_power, languages, topic_power, topics.count), "chances")
    source, lang, topic, weight, probability = common.unused([*docs.columns, name], "source", "lang", "topic", "weight", "probability")
    own = common.let(topic_and_tokens(F.col("text"), F.col("lang"), model), lambda t: F.struct(F.coalesce("source", F.lit("")).alias("source"), language_of(F.col("lang"), listed).alias("lang"), t["topic"].alias("topic"), t["tokens"].alias("tokens")))
    number = F.element_at(F.array(*map(F.lit, (*listed, OTHER))), F.col("lang") + 1)
    renamed = chances.select(F.col("source").alias(source), number.alias(lang), F.col("topic").alias(topic), F.col("weight").alias(weight), F.col("probability").alias(probability))
    met = (F.col(name)["source"] == F.col(source)) & (F.col(name)["lang"] == F.col(lang)) & (F.col(name)["topic"] == F.col(topic))
    found = docs.withColumn(name, own).join(F.broadcast(renamed) if chances.count() <= SMALL else renamed, met, "left")
    kept = (F.col(name)["tokens"] > 0) & (uniform(F.col("doc_id"), seed) < F.coalesce(probability, F.lit(0.0)))
    column = F.col(name).withField("weight", F.col(weight)).withField("probability", F.col(probability)).withField("kept", kept)
    return found.select(*docs.columns, column.alias(name))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns."""
    (name,) = common.unused(docs.columns, "mix")
    return mix(docs, name=name, **options).filter(F.col(name)["kept"]).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, calibrated weight of the cell, probability and whether it is sampled."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    out = mix(docs)
    return out.select("doc_id", *(F.col("mix")[n].alias(n) for n in ("source", "lang", "topic", "tokens", "weight", "probability", "kept")))
