"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

A document fails the base rules (too few words, or most of them in repeated three-word
windows), or the rules at the level chosen for its stratum. A level fixes the cutoffs of
all rules at once, laxer ones first; a document has the level that is the first to reject
it by any rule. On the labelled holdout, levels are tested in order, from the laxest on,
by the exact binomial bound: level t stands if at most ``risk`` of the documents labelled
good are rejected by its rules together, at an error probability of ``delta`` over the
number of strata. Testing in a fixed order needs no correction for the number of levels,
and the bound holds for the union of rules, so that with probability 1 - delta no
stratum's chosen level rejects more than ``risk`` of its good documents.

Strata are languages. Those with fewer good labels than a level needs even without a
rejection are merged, fewest first, until they have them; the number of merged strata
divides delta. Where all labels together are too few there is no level, and only the base rules count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRATA = ("en", "de", "fr", "es")
#: Rules reject values above a cutoff; all values are whole numbers, the larger the worse. Of each, the cutoffs of the first and of the last level.
PATH = {"symbols": (200, 10), "repeats": (500, 100), "lines": (500, 150), "capitals": (300, 40), "long_words": (200, 120), "short_words": (160, 115)}
RULES = tuple(PATH)
LEVELS = 21


def _dropped(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included; each word counts once.

    Windows are sorted by a 64-bit hash with their places: n log n of the words, whatever the text.
    """
    def covered(windows: Column) -> Column:
        def twice(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, k: ((k > 0) & same(e, k - 1)) | same(e, k + 1)), lambda e: e["i"]))

        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        total = F.aggregate(let(let(placed, twice), steps), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(total)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(windows(w), covered)))


def features(text: Column) -> Column:
    """A struct of counts of a text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counts = F.struct(by_words.alias("w"), by_lines.alias("x"), (F.length(text) - _dropped(text, BLANKS)).cast("long").alias("word_chars"), _dropped(text, SYMBOLS).cast("long").alias("n_symbols"), _dropped(text, CAPITALS).cast("long").alias("n_capitals"))
    return let(counts, lambda c: F.struct(c["w"]["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["x"]["n_dup_lines"].alias("n_dup_lines"), c["w"]["n_repeat_words"].alias("n_repeat_words"), c["x"]["n_lines"].alias("n_lines"), c["n_capitals"].alias("n_capitals")))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def rule_values(q: Column) -> Column:
    """The value of each of RULES, 0 to 1000."""
    share = lambda a, b: F.when(b > 0, F.least(F.lit(1000).cast("long"), F.floor(1000 * a / b))).otherwise(F.lit(0).cast("long"))
    length = F.when(q["n_words"] > 0, F.floor(20 * q["word_chars"] / q["n_words"])).otherwise(F.lit(100).cast("long"))
    return F.array(
        share(q["n_symbols"], q["word_chars"]), share(q["n_repeat_words"], q["n_words"]), share(q["n_dup_lines"], q["n_lines"]), share(q["n_capitals"], q["word_chars"]),
        F.least(F.lit(1000).cast("long"), length), F.greatest(F.lit(0).cast("long"), 200 - length),
    )


def stratum(lang: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise(F.lit("other"))


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Natural log of P(X <= k) for X binomial (n, p); 0 where k >= n * p, which no test accepts."""
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))
    odds = math.log(p) - math.log1p(-p)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(acc["sum"], term) + F.log1p(F.exp(-F.abs(acc["sum"] - term)))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(F.aggregate(terms, start, step)["sum"])


def cutoff(rule: str, level: int) -> int:
    lax, strict = PATH[rule]
    return lax - (lax - strict) * level // (LEVELS - 1)


def level_of(values: Column) -> Column:
    """The first level whose cutoffs reject the values of RULES; LEVELS if none does."""
    def first(rule: str, value: Column) -> Column:
        return LEVELS - F.size(F.filter(F.array(*(F.lit(cutoff(rule, t)) for t in range(LEVELS))), lambda c: c < value))

    return F.least(*(first(r, F.get(values, i)) for i, r in enumerate(RULES)))


def labels_needed(risk: float, delta: float, strata: int = len(STRATA) + 1) -> int:
    """Good labels without any rejection that prove the risk in each of ``strata`` strata."""
    return math.ceil(math.log(delta / strata) / math.log1p(-risk))


def select_levels(good: DataFrame, risk: float, delta: float, strata: int = len(STRATA) + 1) -> DataFrame:
    """(stratum, merged, level): for each stratum that has a good label, its merged stratum and the strictest level that passes (null: none does).

    ``good`` has (stratum, level) of the holdout's documents labelled good. Strata, and so all
    rows after the first sum, are few: their number is that of languages told apart.
    """
    counts = good.groupBy("stratum", "level").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    needed = labels_needed(risk, delta, strata)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<stratum:string,merged:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        total, out = acc["sum"] + x["n"], F.concat(acc["out"], F.array(F.struct(x["stratum"].alias("stratum"), acc["at"].alias("merged"))))
        return F.when(total >= needed, F.struct((acc["at"] + 1).alias("at"), F.lit(0).cast("long").alias("sum"), out.alias("out"))).otherwise(F.struct(acc["at"].alias("at"), total.alias("sum"), out.alias("out")))

    dealt = sizes.agg(F.sort_array(F.collect_list(F.struct("n", "stratum"))).alias("s")).select(F.aggregate("s", start, add).alias("g"))
    # what is left over at the end joins the last stratum that has labels enough
    last = F.greatest(F.col("g")["at"] - 1, F.lit(0))
    merged = dealt.select(F.explode("g.out").alias("m"), last.alias("last")).select("m.stratum", F.least("m.merged", "last").alias("merged"), (F.col("last") + 1).alias("strata"))
    by_level = counts.join(F.broadcast(merged), "stratum").groupBy("merged", "strata").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "n")).alias("by"))
    tried = by_level.select("merged", "strata", "n", "by", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    rejected = F.aggregate("by", F.lit(0).cast("long"), lambda a, e: a + F.when(e["level"] <= F.col("level"), e["n"]).otherwise(0))
    tested = tried.withColumn("log_p", log_binomial_tail(F.col("n"), rejected, risk))
    # more rejections never pass where fewer failed: the last level that passes ends the run of passing ones
    passed = tested.filter(F.col("log_p") <= F.log(F.lit(delta) / F.col("strata"))).groupBy("merged").agg(F.max("level").alias("level"))
    return merged.select("stratum", "merged").join(F.broadcast(passed), "merged", "left").select("stratum", "merged", "level")


def judge(docs: DataFrame, labels: DataFrame, columns: list[str], risk: float = 0.01, delta: float = 0.05, name: str = "quality_rules") -> DataFrame:
    """``columns`` of docs, with a struct column ``name`` of the counts, ``base_failed`` and ``kept``; columns of any other names stay.

    Counts of all documents are computed once and written. Null and unlisted languages are of stratum
    "other"; strata without good labels have no level. A doc_id labelled twice counts as its smaller
    label; null labels don't count; repeated rows are judged alike, each counting as a label where
    its doc_id has one. A null or empty text has no words and fails the base rules. An empty table gives no rows.
    """
    if name in columns:
        raise ValueError(f"a column is named {name} already")
    key, group, level, until = common.unused([*docs.columns, name], "key", "stratum", "level", "until")
    q = F.col(name)
    seen = docs.select(*columns, F.col("doc_id").alias(key), stratum(F.col("lang")).alias(group), features(F.col("text")).alias(name))
    seen = common.written(seen, "quality").withColumn(level, level_of(rule_values(q)))
    good = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("quality").alias("quality")).filter("quality = 1")
    # what fails the base rules is rejected anyway: levels are selected on the rest
    holdout = seen.filter(~base_failed(q)).select(key, F.col(group).alias("stratum"), F.col(level).alias("level")).join(good.select(key), key, "left_semi")
    chosen = select_levels(holdout, risk, delta).select(F.col("stratum").alias(group), F.col("level").alias(until))
    judged = seen.join(F.broadcast(chosen), group, "left")  # a row per stratum at most
    verdict = ~base_failed(q) & ~F.coalesce(F.col(level) <= F.col(until), F.lit(False))
    return judged.select(*columns, q.withField("base_failed", base_failed(q)).withField("level", F.col(level)).withField("kept", verdict).alias(name))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    (name,) = common.unused(docs.columns, "quality")
    return judge(docs, labels, docs.columns, name=name, **options).filter(F.col(name)["kept"]).select(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = judge(docs, labels, ["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col("quality_rules")[n].alias(n) for n in names))
