"""Titles to products by rule tables: rejection, type, language, and the join with set names.

Titles are classified once each, however many offers carry them. Rules become column
expressions; set names are found by joins: equal names first, then names that share a
word or a near word, of which only the pairs that survive the guards are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.rules import titles as T
from cairn.sources.staging import staged

RULES = T.Rules()
#: Near words have six letters at least and this similarity; names must be covered to this share and score this much.
NEAR_LETTERS, NEAR_RATIO, COVERAGE, SCORE = 6, 90.0, 0.6, 88


# -- rules ----------------------------------------------------------------------------


def rejection(norm: Column, raw: Column, rules: T.Rules = RULES) -> Column:
    """The first reason to reject, with the words found, as ``label (words)``; null if there is none."""
    number = F.when(raw.rlike(r"(?U)\b\d{1,3}\s*/\s*\d{1,3}\b"), "single (number in title)")
    several = F.when(norm.rlike(r"\b(?:[2-9]|[1-9]\d+)\s*x\b|\bx\s*(?:[2-9]|[1-9]\d+)\b"), "several units")
    named = lambda found: F.coalesce(*(F.concat(F.lit(f"{label} ("), text.first_of(found, terms), F.lit(")")) for label, terms in rules.reject))
    return F.coalesce(text.once(text.spotted(norm, (t for _, terms in rules.reject for t in terms)), named), number, several)


def types(norm: Column, rules: T.Rules = RULES) -> Column:
    """All product types named, in the order of the rules; a box with a full count of packs is a box."""
    packs = norm.rlike(f"{T.PACK_BOX}.*?{T.PACK_COUNT}|{T.PACK_COUNT}.*?{T.PACK_BOX}")
    named = lambda found: F.array(*(F.when(text.any_of(found, terms), F.lit(kind)) for kind, terms in rules.types), F.when(packs, F.lit(T.BOX_TYPE)))
    return F.array_distinct(F.array_compact(text.once(text.spotted(norm, (t for _, terms in rules.types for t in terms)), named)))


def product_type(norm: Column, rules: T.Rules = RULES) -> Column:
    first = F.get(types(norm, rules), F.lit(0))
    return F.when((first == T.ELITE_TYPE) & text.has_word(norm, rules.center_words), T.CENTER_TYPE).otherwise(first)


def spoken(norm: Column, rules: T.Rules = RULES) -> Column:
    """The first language that is spelled out."""
    # a term of several words says nothing where one of its words is a term of the same language
    short = {code: [t for t in terms if " " not in t or not {*t.split(" ")} & {*terms}] for code, terms in rules.languages}
    named = lambda found: F.coalesce(*(F.when(text.any_of(found, terms), F.lit(code)) for code, terms in short.items()))
    return text.once(text.spotted(norm, (t for terms in short.values() for t in terms)), named)


def language(norm: Column, raw: Column, rules: T.Rules = RULES) -> Column:
    """Of spelled-out words, else of a tag in brackets or between dashes, else of the last word; null if none is declared."""
    words = spoken(norm, rules)
    codes = "|".join(T.CODES)
    tag = F.lower(F.regexp_extract(raw, rf"(?iU)(?:[\(\[]\s*|\s[-–|/]\s*)({codes})\s*(?=[\)\]]|$|\s[-–|/])", 1))
    last = F.element_at(F.split(norm, " "), -1)
    return F.coalesce(words, F.when(tag != "", tag), F.when(last.isin(*T.CODES), last))


def pre_order(raw: Column) -> Column:
    return F.lower(raw).rlike(T.PRE_ORDER)


def of_brand(norm: Column, rules: T.Rules = RULES) -> Column:
    return text.has_part(norm, rules.brand) & ~text.has_part(norm, rules.other_games)


def candidate(norm: Column, rules: T.Rules = RULES) -> Column:
    """What is left of a title when noise goes: the set's name. Numbers go unless an ordinal word stands before or after; if nothing else is left they stay."""
    edge = lambda body: rf"(?<![a-z0-9])(?:{body})(?![a-z0-9])"
    out = F.regexp_replace(norm, edge(T.PRE_WORD), " ")
    out = F.regexp_replace(out, edge(T.SET_CODES), " ")
    out = F.regexp_replace(out, edge(T.SCRIPT_TAG), " ")
    words = F.filter(F.split(F.trim(out), r"\s+"), lambda w: (w != "") & ~w.isin(*rules.noise))

    def kept(ws: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            w, after = F.get(ws, i), F.coalesce(F.get(ws, i + 1), F.lit(""))
            before = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
            drop = w.rlike("^[0-9]+$") & ~before.isin(*T.ORDINAL_LEAD) & ~after.isin(*T.ORDINAL_TRAIL)
            return F.when(drop, acc).otherwise(F.concat(acc, F.array(w)))

        places = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        out = F.aggregate(places, F.array().cast("array<string>"), step)
        return F.array_join(F.when(F.size(out) > 0, out).otherwise(ws), " ")

    return F.element_at(F.transform(F.array(words), kept), 1)


def has_long_word(name: Column) -> Column:
    return F.exists(F.split(name, " "), lambda w: F.length(w) >= 3)


def without_series(name: Column, rules: T.Rules = RULES) -> Column:
    """The name after a leading series name; null if there is none or nothing follows."""
    rest = [F.when(name.startswith(s + " "), F.trim(F.substring(name, F.lit(len(s) + 2), F.length(name)))) for s in rules.series]
    out = F.coalesce(*rest)
    return F.when(out != "", out)


def segments(raw: Column) -> Column:
    """Parts of a title between separators, the longest first; none if there is one part only."""
    parts = F.filter(F.transform(F.split(raw, r"\s*(?:\||\s[-–—/]\s|[—:])\s*"), lambda p: F.trim(p)), lambda p: p != "")
    ordered = F.transform(F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda e: e["p"])
    return F.when(F.size(parts) > 1, ordered).otherwise(F.array().cast("array<string>"))


# -- the join with set names ----------------------------------------------------------


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, other) of distinct words of ``left`` and ``right`` (column word) that count as one word.

    Equal words meet by an equality join. A near pair has six letters or more and a similarity
    of 90, which leaves at most a tenth of the letters of both to insert or delete. So of one more
    parts than that of the one word, one stands whole in the other, moved by no more places: words of
    matching lengths meet by such a part, and edit distance and the exact similarity decide.
    """
    a, b = left.select("word").distinct(), right.select("word").distinct()
    same = a.join(b, "word").select("word", F.col("word").alias("other"))
    long = lambda df, name: df.filter(F.length("word") >= NEAR_LETTERS).select(F.col("word").alias(name), F.length("word").alias("_n"))
    # lengths that differ by no more than the letters to insert or delete
    lengths = F.filter(F.sequence(F.floor(F.col("_n") * 4 / 5).cast("int"), F.ceil(F.col("_n") * 5 / 4).cast("int")), lambda m: (m >= NEAR_LETTERS) & (F.abs(m - F.col("_n")) * 9 <= m + F.col("_n")))
    slack = F.floor((F.col("_n") + F.col("_m")) * int(100 - NEAR_RATIO) / 100).cast("int")
    each = lambda df: df.withColumn("_m", F.explode(lengths)).withColumn("_slack", slack)
    begin = lambda i, n: F.floor(i * n / (F.col("_slack") + 1)).cast("int")
    part = lambda w, at, i, n: F.substring(w, at + 1, begin(i + 1, n) - begin(i, n))
    parts = F.sequence(F.lit(0), F.col("_slack"))
    x = each(long(a, "word")).withColumn("_i", F.explode(parts)).select("word", F.col("_n").alias("_la"), F.col("_m").alias("_lb"), "_i", part(F.col("word"), begin(F.col("_i"), F.col("_n")), F.col("_i"), F.col("_n")).alias("_part"))
    y = each(long(b, "other")).withColumn("_i", F.explode(parts)).withColumn("_at", F.explode(F.transform(F.sequence(-F.col("_slack"), F.col("_slack")), lambda d: begin(F.col("_i"), F.col("_m")) + d))).filter("_at >= 0")
    y = y.select("other", F.col("_m").alias("_la"), F.col("_n").alias("_lb"), "_i", part(F.col("other"), F.col("_at"), F.col("_i"), F.col("_m")).alias("_part")).distinct()
    met = x.join(y, ["_la", "_lb", "_i", "_part"]).filter(F.col("word") != F.col("other")).select("word", "other").distinct()
    # similarity r leaves at most (1 - r) of the letters of both words to insert or delete; in whole numbers, 1 - 0.9 being less than 0.1
    bound = F.floor((F.length("word") + F.length("other")) * int(100 - NEAR_RATIO) / 100).cast("int")
    met = met.filter(F.levenshtein("word", "other") <= bound)
    return same.unionByName(met.filter(text.indel_ratio(F.col("word"), F.col("other")) >= NEAR_RATIO))


def _sides(a: Column, b: Column) -> Column:
    """both, a and b: the words that two names share and those of each alone, sorted and joined."""
    wa, wb = F.array_sort(F.array_distinct(F.split(a, " "))), F.array_sort(F.array_distinct(F.split(b, " ")))
    return F.struct(F.array_join(F.array_intersect(wa, wb), " ").alias("both"), F.array_join(F.array_except(wa, wb), " ").alias("a"), F.array_join(F.array_except(wb, wa), " ").alias("b"))


def _score(s: Column, letters: Column) -> Column:
    """The token set ratio of ``_sides`` if the words of one side alone have so many letters in common.

    The shared words stand before both: they are common as a whole, so that only the rest has to be compared, and
    their similarity to each side follows from lengths.
    """
    n, la, lb = F.length(s["both"]), F.length(s["a"]), F.length(s["b"])
    head = F.when(n > 0, n + 1).otherwise(0)
    whole = 200.0 * (head + letters) / (2 * head + la + lb)
    to = lambda m: F.when(n > 0, 200.0 * n / (n + head + m)).otherwise(0.0)
    return F.when((n > 0) & ((la == 0) | (lb == 0)), F.lit(100.0)).otherwise(F.greatest(whole, to(la), to(lb)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """100 if one's words are among the other's, else the best similarity of the shared words and of each side's words."""
    return F.element_at(F.transform(F.array(_sides(a, b)), lambda s: _score(s, text.common_letters(s["a"], s["b"]))), 1)


def token_set_bound(a: Column, b: Column) -> Column:
    """What the token set ratio can be at most, from shared words and lengths alone."""
    return F.element_at(F.transform(F.array(_sides(a, b)), lambda s: _score(s, F.least(F.length(s["a"]), F.length(s["b"])))), 1)


def match(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, alias, score) of the distinct names that match an alias (column alias, normalised, unique).

    An equal alias scores 100. Else every word of the name must be, nearly, in the alias, the
    alias must be covered to 60 %, and the score be 88 or more; of several the best score,
    then coverage, then the alias's order decide. Names meet aliases by one word alone, the one that
    fewest aliases hold: that loses nothing, for each word of the name has a partner. If an alias with
    a word of the name, or one near it, scores higher without meeting these conditions, the name has no set.
    """
    wanted = staged(names.select("name").distinct().filter(F.col("name").isNotNull() & (F.col("name") != "") & has_long_word(F.col("name"))))
    exact = wanted.join(aliases.select("alias"), F.col("name") == F.col("alias")).select("name", "alias", F.lit(100).alias("score"))
    rest = staged(wanted.join(exact, "name", "left_anti"))
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    left, right = words(rest, "name"), words(aliases.select("alias"), "alias")
    near = staged(near_words(left, right))
    n_left = left.groupBy("name").agg(F.count("*").alias("_names"))
    n_right = right.groupBy("alias").agg(F.count("*").alias("_aliases"))
    held = right.withColumnRenamed("word", "other")
    often = near.join(held.groupBy("other").agg(F.count("*").alias("_often")), "other").groupBy("word").agg(F.sum("_often").alias("_often"))
    rarest = left.join(often, "word").groupBy("name").agg(F.min_by("word", F.struct("_often", "word")).alias("word"))
    met = rarest.join(near, "word").join(held, "other").select("name", "alias").distinct()
    pairs = met.join(left, "name").join(near, "word").join(held, ["alias", "other"]).groupBy("name", "alias").agg(F.count_distinct("word").alias("_found"), F.count_distinct("other").alias("_covered"))
    pairs = pairs.join(n_left, "name").join(n_right, "alias").filter((F.col("_found") == F.col("_names")) & (F.col("_covered") >= COVERAGE * F.col("_aliases")))
    close = pairs.filter(token_set_bound(F.col("name"), F.col("alias")) >= SCORE).withColumn("_exact", token_set_ratio(F.col("name"), F.col("alias")))
    w = Window.partitionBy("name").orderBy(F.desc("_exact"), F.desc("_share"), "alias")
    scored = close.withColumn("score", F.floor("_exact").cast("int")).filter(F.col("score") >= SCORE).withColumn("_share", F.col("_covered") / F.col("_aliases"))
    first = staged(scored.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select("name", "alias", "score", "_exact"))
    # an alias that scores higher but fails a guard leaves the name without a set: names that score less than 100 meet all aliases of
    # their words, and are compared with those that could score higher
    under = first.filter("_exact < 100").select("name", "_exact")
    rivals = under.join(left, "name").join(near, "word").join(held, "other").select("name", "alias", "_exact").distinct()
    beaten = rivals.filter(token_set_bound(F.col("name"), F.col("alias")) > F.col("_exact")).filter(token_set_ratio(F.col("name"), F.col("alias")) > F.col("_exact"))
    return staged(exact.unionByName(first.join(beaten.select("name").distinct(), "name", "left_anti").select("name", "alias", "score")))


def match_series(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, alias, score, used): as a whole, else without a leading series name."""
    wanted = staged(names.select("name").distinct().withColumn("_rest", without_series(F.col("name"))))
    found = match(wanted.select("name").unionByName(wanted.filter("_rest is not null").select(F.col("_rest").alias("name"))), aliases)
    renamed = found.select(F.col("name").alias("_rest"), F.col("alias").alias("_alias"), F.col("score").alias("_score"))
    out = wanted.join(found, "name", "left").join(renamed, "_rest", "left")
    whole = F.col("alias").isNotNull()
    pick = lambda a, b: F.when(whole, F.col(a)).otherwise(F.col(b))
    out = out.select("name", pick("alias", "_alias").alias("alias"), pick("score", "_score").alias("score"), F.when(whole, F.col("name")).otherwise(F.col("_rest")).alias("used"))
    return out.filter("alias is not null")


def words_left(full: Column, used: Column) -> Column:
    """Words of ``full`` that occur there more often than in ``used``, in order."""
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    a, b = F.split(full, " "), F.split(used, " ")
    return F.array_join(F.filter(a, lambda w: count(a, w) > count(b, w)), " ")


def resolve(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(title, alias, score, used) of the titles (title, name) whose set is found: by the whole name, without its series, or by a segment of the title.

    A segment counts if the other words of the name are none, a series, or another name of
    the same set. ``aliases`` has alias and set_id.
    """
    rows = staged(rows.select("title", "name").distinct())
    whole = rows.join(match_series(rows, aliases), "name").select("title", "alias", "score", "used")
    rest = rows.join(whole, "title", "left_anti")
    parts = rest.select("title", F.col("name").alias("full"), F.posexplode(segments(F.col("title"))).alias("at", "_part")).withColumn("name", candidate(text.normalise(F.col("_part")))).filter((F.col("name") != "") & (F.col("name") != F.col("full")))
    ids = aliases.select("alias", "set_id")
    parts = staged(parts)
    hits = staged(parts.join(match_series(parts, aliases), "name").join(ids, "alias").withColumn("left", words_left(F.col("full"), F.col("used"))))
    others = match_series(hits.select(F.col("left").alias("name")), aliases).join(ids, "alias").select(F.col("name").alias("left"), F.col("set_id").alias("_other"))
    good = hits.join(others, "left", "left").filter((F.col("left") == "") | F.col("left").isin(*RULES.series) | (F.col("_other") == F.col("set_id")))
    w = Window.partitionBy("title").orderBy("at")
    return whole.unionByName(good.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select("title", "alias", "score", "used"))


def classify(titles: DataFrame, aliases: DataFrame, rules: T.Rules = RULES) -> DataFrame:
    """One row per distinct title: accepted, reason, product_type, language, set_id, set_name, release_date, set_matched, match_score, pre_order.

    ``aliases`` has alias, set_id, name, release_date and alias_lang. Checks run cheap first:
    only titles that pass the rules reach the joins.
    """
    norm, raw = F.col("norm"), F.col("title")
    rows = titles.select("title").filter("title is not null").distinct().withColumn("norm", text.normalise(raw))
    kinds = types(norm, rules)
    reason = F.coalesce(F.when(norm == "", "empty title"), F.when(text.has_part(norm, rules.other_games), "other game"), rejection(norm, raw, rules), F.when(F.size(kinds) == 0, "no product type"), F.when(F.size(kinds) > 1, "several product types"))
    rows = staged(rows.withColumn("reason", reason).withColumn("name", F.when(F.col("reason").isNull(), candidate(norm, rules))))
    aliases = staged(aliases)
    found = resolve(rows.filter("reason is null"), aliases).join(aliases.select("alias", "set_id", F.col("name").alias("_set"), "release_date", "alias_lang"), "alias")
    out = rows.join(found.select("title", "score", "set_id", "_set", "release_date", "alias_lang"), "title", "left")
    matched = F.col("set_id").isNotNull()
    late = F.coalesce(F.col("reason"), F.when(~text.has_part(norm, rules.brand) & ~matched, "not of the brand"), F.when(~matched & ~has_long_word(F.col("name")), "no set name"))
    spoken = F.coalesce(language(norm, raw, rules), F.when(F.col("alias_lang").isin(*T.ALIAS_LANGUAGES), F.col("alias_lang")), F.lit("en"))
    ok = F.col("reason").isNull()
    when = lambda c: F.when(ok, c)
    out = out.withColumn("reason", late)
    return out.select(
        "title", ok.alias("accepted"), "reason", when(product_type(norm, rules)).alias("product_type"), when(spoken).alias("language"), when(F.col("set_id")).alias("set_id"), when(F.coalesce("_set", F.initcap("name"))).alias("set_name"),
        when(F.col("release_date")).alias("release_date"), when(matched).alias("set_matched"), when(F.coalesce("score", F.lit(0))).alias("match_score"), pre_order(raw).alias("pre_order"),
    )
