"""Rules as a table: dictionaries that a catalogue brings at run time, joined with titles by runs of words.

A rule is a row: kind (reject, type, language or a name of the catalogue's own), rank (its place among the labels of its kind), label and
term. Terms are whole words of normalised titles. The table is small beside the titles: while it is, Spark
broadcasts it, and titles are not shuffled before they have met it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.rules import titles as T

SCHEMA = "kind string, rank int, label string, term string"


def table(spark: SparkSession, rules: T.Rules = T.Rules()) -> DataFrame:
    """The dictionaries of ``rules`` as a table."""
    kinds = (("reject", rules.reject), ("type", rules.types), ("language", rules.languages))
    return spark.createDataFrame([(kind, rank, label, term) for kind, labels in kinds for rank, (label, terms) in enumerate(labels) for term in terms], SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue's own rules, one JSON object a line; terms are normalised, and rows that lack one are left out."""
    rows = spark.read.schema(SCHEMA).json(path).withColumn("term", text.normalise(F.col("term")))
    return rows.filter(F.col("kind").isNotNull() & F.col("label").isNotNull() & (F.col("term") != "")).withColumn("rank", F.coalesce("rank", F.lit(0)))


def hits(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """(norm, kind, rank, label, term, place) of every rule's term in every distinct title (column norm); place counts words from 0."""
    size = lambda c: F.size(F.split(c, " "))
    rows = rules.select("kind", "rank", "label", "term").distinct()
    longest = rows.agg(F.max(size("term")).alias("_longest"))  # one row
    words = titles.select("norm").filter(F.col("norm") != "").distinct().crossJoin(F.broadcast(longest)).select("norm", "_longest", F.posexplode(F.split("norm", " ")).alias("place", "_w"))
    ends = F.sequence(F.lit(1), F.least("_longest", size("norm") - F.col("place")))
    runs = words.select("norm", "place", F.explode(F.transform(ends, lambda n: F.array_join(F.slice(F.split("norm", " "), F.col("place") + 1, n), " "))).alias("term"))
    return runs.join(rows, "term").select("norm", "kind", "rank", "label", "term", "place")


def first_label(found: DataFrame, kind: str) -> DataFrame:
    """(norm, label, term) of the kind's first label by rank, with its first term in the title, of those at one place the longest."""
    order = F.struct("rank", "place", (-F.length("term")).alias("n"))
    return found.filter(F.col("kind") == kind).groupBy("norm").agg(F.min_by(F.struct("label", "term"), order).alias("f")).select("norm", "f.label", "f.term")


def labels(found: DataFrame, kind: str) -> DataFrame:
    """(norm, labels): all labels of the kind, sorted."""
    return found.filter(F.col("kind") == kind).groupBy("norm").agg(F.array_sort(F.collect_set("label")).alias("labels"))
