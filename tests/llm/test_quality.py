import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_of_made_texts(spark):
    made = [None, "", " ", "\n\n", "a b c", "a b c a b c", "a a a a", "a\nb\na\n \n \na", "\x0b\x0cx\x1fy \x85 z\xa0w 🙂🙂 🙂🙂 🙂🙂"]

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "#%", "é", "\xa0"]), max_size=40))
    def gather(parts):
        made.append("".join(parts))

    gather()
    rows = spark.createDataFrame(list(enumerate(made)), "i int, text string").select("i", quality_rules.features(F.col("text")).alias("q"))
    assert {r["i"]: tuple(r["q"][n] for n in NAMES) for r in rows.collect()} == {i: counts(t) for i, t in enumerate(made)}


def test_rules_on_documents(spark, sf, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality_rules.op9_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        c = counts(texts[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == c
        assert r["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r["base_failed"] and r["kept"])


def test_levels_reject_and_keep_their_bound(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = quality_rules.op9_quality_rules(spark, sf).collect()
    passed = [r for r in got if not r["base_failed"]]
    bad = [r for r in passed if labels.get(r["doc_id"]) == 0]
    assert sum(not r["kept"] for r in bad) >= 0.4 * len(bad) > 0
    assert any(not r["kept"] for r in passed if r["doc_id"] not in labels)
    for s in {None, *lang.values()}:
        good = [r for r in passed if labels.get(r["doc_id"]) == 1 and s in (None, lang[r["doc_id"]])]
        assert sum(not r["kept"] for r in good) <= 0.01 * len(good)


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 10, 400, 5000) for k in (0, 1, 3, 20, 200) for p in (0.01, 0.1) if k <= n]
    for p in (0.01, 0.1):
        rows = [(n, k) for n, k, q in cases if q == p]
        got = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality_rules.log_binomial_tail(F.col("n"), F.col("k"), p).alias("log_p")).collect()
        for r in got:
            n, k = r["n"], r["k"]
            if k >= n * p:
                assert r["log_p"] == 0
            else:
                exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
                assert math.isclose(r["log_p"], math.log(exact), rel_tol=1e-6, abs_tol=1e-9)


def levels_by_hand(good, risk, delta):
    """stratum -> level, from lists of levels by stratum."""
    needed = math.ceil(math.log(delta / 5) / math.log(1 - risk))
    groups, held = [], []
    for s in sorted(good, key=lambda s: (len(good[s]), s)):
        held.append(s)
        if sum(len(good[x]) for x in held) >= needed:
            groups.append(held)
            held = []
    groups = [*groups[:-1], groups[-1] + held] if groups else [held]
    out = {}
    for g in groups:
        all_levels, best = [x for s in g for x in good[s]], None
        n = len(all_levels)
        for t in range(quality_rules.LEVELS):
            k = sum(x <= t for x in all_levels)
            log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk)
            if k >= n * risk or sum(math.exp(log(i)) for i in range(k + 1)) > delta / len(groups):
                break
            best = t
        out |= dict.fromkeys(g, best)
    return out


def test_levels_by_fixed_sequence(spark):
    rng = np.random.default_rng(1)
    for sizes in ({"en": 3000, "de": 700, "fr": 500, "es": 90, "other": 3}, {"en": 200, "de": 150}, {"en": 10}, {"en": 900, "de": 100, "es": 100}):
        good = {s: np.minimum(21, 21 - rng.exponential(1.2, n).astype(int)).clip(0).tolist() for s, n in sizes.items()}
        rows = spark.createDataFrame([(s, x) for s, v in good.items() for x in v], "stratum string, level int")
        got = {r["stratum"]: r["level"] for r in quality_rules.select_levels(rows, 0.01, 0.05).collect()}
        assert got == levels_by_hand(good, 0.01, 0.05)
    assert quality_rules.select_levels(spark.createDataFrame([], "stratum string, level int"), 0.01, 0.05).count() == 0


def test_level_of_values(spark):
    rng = np.random.default_rng(2)
    values = [[int(x) for x in v] for v in rng.exponential((60, 120, 150, 50, 90, 90), (500, 6))] + [[0] * 6, [1000] * 6]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v array<bigint>").select("i", quality_rules.level_of(F.col("v")).alias("t")).collect()
    for r in got:
        first = [t for t in range(quality_rules.LEVELS) if any(x > quality_rules.cutoff(k, t) for k, x in zip(quality_rules.RULES, values[r["i"]]))]
        assert r["t"] == (min(first) if first else quality_rules.LEVELS)


def test_rules_on_edges(spark, edge, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    none = labels.limit(0)
    kept = quality_rules.keep(edge, none)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} <= {5, None}
    odd = spark.createDataFrame([(5, None), (5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    assert quality_rules.judge(edge, odd, ["doc_id"]).count() == edge.count()
    assert quality_rules.keep(empty, none).count() == 0
    clash = edge.withColumns({c: F.lit(7) for c in ("_quality", "_key", "_stratum", "_level", "_until", "level", "_values")})
    kept = quality_rules.keep(clash, none)
    assert kept.columns == clash.columns and {r["_quality"] for r in kept.collect()} == {7}


def test_classifier_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality_model.op2_quality_model(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert sum(b == 0 for a, b in held if a == 0) / max(1, sum(a == 0 for a, _ in held)) >= 0.85


def test_classifier_does_not_learn_from_the_held_out_fold(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.train(docs, x, params=quality_model.Params(epochs=1)) for x in (labels, turned))
    assert (a.table == b.table).all() and a.bias == b.bias


def test_classifier_without_labels_and_edges(spark, edge, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.train(edge, labels.limit(0))
    assert {r["score"] for r in quality_model.score(edge, model).collect()} == {0.5}
    one = quality_model.fit([b"a b", b"c d"], np.array([1, 1]))
    assert quality_model.score(edge, one).count() == edge.count()
    assert quality_model.score(empty, one).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=6))
def test_scores_do_not_depend_on_the_batch(texts):
    rng = np.random.default_rng(0)
    model = quality_model.Model(12, rng.normal(size=1 << 12).astype(np.float32), 0.1)
    hasher = quality_model.Hasher(12)
    together = model.scores(texts, hasher)
    assert np.allclose(together, [model.scores([t], hasher)[0] for t in texts], atol=1e-9)


def hashed(parts, bits=18):
    return parts * int(quality_model.MIX) % 2**64 >> 64 - bits


def buckets_by_hand(data):
    """Every n-gram's bucket, one at a time."""
    out = []
    for n in quality_model.CHARS:
        for i in range(len(data) - n + 1):
            packed = int.from_bytes(data[i : i + n], "little")
            out.append(hashed(packed + (n << 48)))
    words = [sum(c * pow(quality_model.POLY, k, 2**64) for k, c in enumerate(w)) * int(quality_model.MIX) % 2**64 for w in re.findall(rb"[^\x00-\x20]+", data)]
    out += [w >> 46 for w in words]
    out += [0 if a == b else hashed((a * 31 + b) % 2**64) for a, b in zip(words, words[1:])]
    return out


def test_scores_equal_those_n_gram_by_n_gram(spark, edge):
    rng = np.random.default_rng(1)
    model = quality_model.Model(18, rng.normal(size=1 << 18).astype(np.float32), 0.25)
    got = [(r["doc_id"], r["score"]) for r in quality_model.score(edge, model).collect()]
    want = []
    for r in edge.collect():
        data = (r["text"] or "").encode()[:2000] if len(r["text"] or "") > 5000 else (r["text"] or "").encode()
        found = buckets_by_hand(data)
        want.append((r["doc_id"], len(r["text"] or "") > 5000, 1 / (1 + math.exp(-(0.25 + sum(float(model.table[b]) for b in found) / max(1, len(found)))))))
    assert len(got) == len(want)
    for (a, x), (b, long, y) in zip(got, want):
        assert a == b and (long or math.isclose(x, y, rel_tol=1e-5))


def test_repeated_labelled_rows_count_once(spark):
    few = [(i, f"good words number {i} here", 1) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in few] + [(1000 + i, f"junk junk {i} $$$") for i in range(30)] + [(7, f"copy {j}") for j in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in few] + [(1000 + i, 0) for i in range(30)] + [(7, 1)] * 50, "doc_id long, quality int")
    params = quality_model.Params(rows=40)
    texts, y = quality_model.training_rows(docs, labels, "quality", params)
    ids = [i for i in [*range(30), *range(1000, 1030)] if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(texts) == len(ids) and y.tolist() == [int(i < 1000) for i in ids]
    if 7 in ids:
        assert texts[ids.index(7)] == b"copy 0"


def test_bags_that_are_not_kept_change_nothing():
    texts = [f"{'good' if i % 2 else 'bad'} text {i}".encode() for i in range(12)]
    y = np.arange(12) % 2
    a, b = (quality_model.fit(texts, y, quality_model.Params(bags=n)) for n in (1 << 20, 200))
    assert np.array_equal(a.table, b.table) and a.bias == b.bias
