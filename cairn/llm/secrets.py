"""Secret scans with DataFrame expressions only.

Three fixed kinds of pattern find secrets by their form. Beside them, two character
Markov models, of random strings and of ordinary identifiers, are trained from labelled
samples. Every token of six characters or more is judged: one whose log-likelihood ratio
is over the cutoff of its length, chosen on samples held out, is a secret of kind
``markov``; what base spans cover of it already is theirs. Positions count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

#: Kinds in their order. The first is matched in full and then held to six characters of value; for the
#: other two a run that is too short holds no longer match, so that the pattern can ask for the length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models judge and are trained on.
TOKEN = r"[A-Za-z0-9+/_=-]{6,}"
#: Least lengths of the classes of tokens that have a cutoff each.
LENGTHS = (6, 8, 10, 12, 16, 20, 28)
#: Matches that are placed together: appending to an array copies it, so that long lists are built from parts.
PART = 128
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
CODES = 128


def _placed(gaps: Column, lengths: Column, kind: int) -> Column:
    """Spans from the lengths of the matches and of what stands before each, in linear time but for a factor of PART."""
    n = F.size(lengths)
    steps = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = lambda a, p: F.slice(a, p * PART + 1, PART)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    parts = F.transform(steps, lambda p: F.struct(cut(gaps, p).alias("gaps"), cut(lengths, p).alias("lengths")))
    none = F.array().cast("array<bigint>")
    at = F.aggregate(
        F.transform(parts, lambda p: total(p["gaps"]) + total(p["lengths"])), F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )["out"]

    def spans(part: Column, begin: Column) -> Column:
        both = F.arrays_zip(part["gaps"].alias("gaps"), part["lengths"].alias("lengths"))
        start = F.struct(begin.alias("at"), F.array().cast(SPAN).alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gaps"] + x["lengths"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gaps"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gaps"] + x["lengths"]).alias("end"))).cast(SPAN)).alias("out"),
        )
        return F.aggregate(both, start, step)["out"]

    return let(F.struct(parts.alias("parts"), at.alias("at")), lambda s: F.flatten(F.zip_with(s["parts"], s["at"], spans)))


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, kind, end) of all matches that ``keep`` accepts, from the lengths of what stands between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))

    def spans(both: Column) -> Column:
        got = _placed(long(F.slice(F.split(text, pattern, -1), 1, F.size(both["found"]))), long(both["found"]), kind)
        return let(got, lambda g: F.filter(g, lambda s, i: F.get(both["kept"], i))) if keep is not None else got

    own = F.struct(found.alias("found"), (F.transform(found, keep) if keep is not None else F.lit(None)).alias("kept"))
    if keep is not None:
        own = let(found, lambda f: F.struct(f.alias("found"), F.transform(f, keep).alias("kept")))
        any_kept = lambda b: F.exists(b["kept"], lambda k: k)
        return let(own, lambda b: F.when(any_kept(b), spans(b)).otherwise(F.array().cast(SPAN)))
    return F.when(text.rlike(pattern), let(own, spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    assign = F.when(text.rlike(ASSIGN), _matches(text, ASSIGN, 0, value)).otherwise(F.array().cast(SPAN))
    return F.sort_array(F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


def as_string(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _between(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    put = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    done = let(F.aggregate(spans, start, put), lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


# -- the models -----------------------------------------------------------------------


def samples(docs: DataFrame, documents: int = 2000, random_strings: int = 3000, seed: int = 5) -> DataFrame:
    """Labelled samples (token, label): 1 for random strings, 0 for ordinary identifiers.

    Ordinary are the tokens of at most ``documents`` documents, those of smallest hash, outside the
    base spans. Random are the values that the base patterns find in the same documents, and
    ``random_strings`` digests in hexadecimal, base 64 and capitals with digits, of 6 to 40 characters.
    """
    spark = docs.sparkSession
    few = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(documents)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few.distinct()), "doc_id", "left_semi").limit(documents)
    texts = texts.withColumn("spans", base_spans(F.col("text")))
    found = F.filter(F.transform("spans", lambda s: F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), lambda x: F.length(x) > 0)
    values = texts.select(F.explode(found).alias("m")).select(F.regexp_extract("m", r"([A-Za-z0-9+/_=-]{6,})[^A-Za-z0-9+/_=-]*$", 1).alias("token"), F.lit(1).alias("label"))
    plain = texts.select(F.explode(F.regexp_extract_all(_between(F.col("text"), F.col("spans"), " "), F.lit(TOKEN), F.lit(0))).alias("token"), F.lit(0).alias("label"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    forms = F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), F.upper(F.translate(F.substring(F.base64(F.unhex(digest)), 1, 20), "+/=", "AKZ")))
    size = F.when(F.col("id") % 2 == 0, 40).otherwise((6 + F.floor(F.col("id") / 6) % 35)).cast("int")
    made = spark.range(random_strings).select(F.substring(F.element_at(forms, (F.col("id") % 3 + 1).cast("int")), F.lit(1), size).alias("token"), F.lit(1).alias("label"))
    return values.unionByName(plain).unionByName(made)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of random to ordinary by pair of character codes (CODES * CODES numbers), and the cutoff of each class of LENGTHS."""

    ratios: tuple[float, ...]
    cutoffs: tuple[float, ...]


def fold(token: Column) -> Column:
    """True for the tokens that the models are trained on, false for those held out, a third of all distinct ones."""
    return F.pmod(F.xxhash64(token, F.lit(17)), F.lit(3)) > 0


def train(labelled: DataFrame, margin: float = 1.0, floor: float = 6.0) -> Model:
    """The models, from the samples of one fold, and their cutoffs, from those of the other.

    The cutoff of a class of lengths is ``margin`` over the largest ratio of a held-out ordinary token of that class
    or a shorter one, or over ``floor`` where that is more. Null tokens and other labels don't count.
    """
    labelled = common.written(labelled.filter("token is not null and label in (0, 1)"), "samples")
    ratios = learn(labelled.filter(fold(F.col("token"))))
    held = labelled.filter(~fold(F.col("token")) & (F.col("label") == 0) & F.col("token").rlike(f"^{TOKEN}$")).select("token").distinct()
    got = {r["at"]: r["most"] for r in held.groupBy(length_class(F.col("token")).alias("at")).agg(F.max(ratio_of(F.col("token"), _table(ratios))).alias("most")).collect()}
    return Model(tuple(ratios), tuple(margin + max([floor, *(v for k, v in got.items() if k <= i)]) for i in range(len(LENGTHS))))


def length_class(token: Column) -> Column:
    """The class of LENGTHS of a token."""
    n, out = F.length(token), F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _table(ratios) -> Column:
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")


def learn(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of random to ordinary by pair of character codes: CODES * CODES numbers.

    Counts of character pairs, with the token's beginning as code 0 and a half added to each of
    the 66 characters; without samples of a label its model is uniform. Other characters count nothing.
    """
    token = F.concat(F.lit("\0"), F.coalesce("token", F.lit("")))
    pairs = labelled.filter(F.col("label").isin(0, 1)).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, 2))).alias("pair")).filter(F.length("pair") == 2)
    counted = pairs.groupBy("label", F.ascii(F.substring("pair", 1, 1)).alias("a"), F.ascii(F.substring("pair", 2, 1)).alias("b")).count()
    counted = counted.filter((F.col("a") < CODES) & (F.col("b") < CODES))
    n = {(r["label"], r["a"], r["b"]): r["count"] for r in counted.collect()}  # at most 2 * CODES * CODES rows
    import math
    import string

    alphabet = [ord(c) for c in string.ascii_letters + string.digits + "+/_=-"]
    ratio = [0.0] * (CODES * CODES)
    for a in [0, *alphabet]:
        total = {k: sum(n.get((k, a, b), 0) for b in alphabet) for k in (0, 1)}
        for b in alphabet:
            p = [(n.get((k, a, b), 0) + 0.5) / (total[k] + 0.5 * len(alphabet)) for k in (0, 1)]
            ratio[a * CODES + b] = round(math.log(p[1] / p[0]), 6)
    return ratio


def ratio_of(token: Column, ratios: Column) -> Column:
    """Sum of the log-likelihood ratios of a token's character pairs."""
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(F.ascii(c).alias("a"), (acc["sum"] + F.element_at(ratios, acc["a"] * CODES + F.ascii(c) + 1)).alias("sum"))
    return F.aggregate(F.split(token, ""), start, step)["sum"]


def outside(spans: Column, base: Column) -> Column:
    """What base spans leave of each span."""
    def parts(s: Column) -> Column:
        met = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        begin = lambda o, i: F.when(i == 0, s["start"]).otherwise(F.greatest(s["start"], F.array_max(F.transform(F.slice(o, 1, i), lambda b: b["end"]))))
        end = lambda o, i: F.when(i < F.size(o), F.get(o, i)["start"]).otherwise(s["end"])
        cut = lambda o: F.transform(F.sequence(F.lit(0), F.size(o)), lambda i: F.struct(begin(o, i).alias("start"), s["kind"].alias("kind"), end(o, i).alias("end")))
        return F.filter(let(met, cut), lambda p: p["start"] < p["end"])

    return F.when(F.size(base) == 0, spans).otherwise(F.flatten(F.transform(spans, parts)))


def markov_spans(text: Column, base: Column, model: Model) -> Column:
    """Spans of the tokens whose ratio is at least the cutoff of their length, without what base spans cover."""
    table, cutoffs = _table(model.ratios), F.array(*map(F.lit, model.cutoffs))
    judged = _matches(text, TOKEN, 3, lambda m: ratio_of(m, table) >= F.get(cutoffs, length_class(m)))
    return let(judged, lambda spans: outside(spans, base))


def scan(docs: DataFrame, model: Model, names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """The rows with two more columns, the base spans and all spans (start, kind, end); columns of these names are replaced.

    A null or empty text has no spans. Repeated rows have equal spans; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(names[0], base_spans(text))
    return found.withColumn(names[1], F.sort_array(F.concat(names[0], markov_spans(text, F.col(names[0]), model))))


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """The rows with each secret in text replaced by mark; a null text stays null. Other columns, whatever their names, stay."""
    base, spans = common.unused(docs.columns, "base", "spans")
    found = scan(docs, model, (base, spans))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), _between(F.col("text"), F.col(spans), mark))).select(*docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs, train(samples(docs)))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_string(F.col("base_spans")), 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"))
