"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, mixing, ngram_join, packing, quality_rules, secrets
from cairn.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the level of their stratum go: null, empty and blank texts among them. Repeated rows share one fate; an empty table stays empty."""
    return quality_rules.keep(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of the n-gram Jaccard join connect, the smallest doc_id stays (null last), and of repeated rows one. Texts without words stay; an empty table stays empty."""
    return ngram_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars, where there is one, follows. Null texts stay null, repeated rows stay repeated, an empty table empty."""
    out = secrets.redact(docs, secrets.train(secrets.samples(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics come to their target weights. Texts without words go; null sources and languages are categories; repeated rows share one fate; an empty table stays empty."""
    return mixing.sample(docs, keep=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' pieces in sequences of at most 1024 tokens. A null text is empty and has one piece, its end; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(common.written(packing.pieces(docs, default_tokenizer()), "pieces"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing", mix), ("best-fit packing", pack)]

#: SQL can't express the join's random tree nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begin = common.table(spark, sf_dir, "documents"), common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard_since(begin)  # what the stage has staged, and the stage before: only this table is read on
    return STAGES[-1][1](spark, docs, sf_dir)
