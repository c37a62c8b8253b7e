"""Collocations against counting by hand."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from cairn.llm import collocations


def brute(rows, top=2000, least=30, share=80):
    lower = {c: c + 32 for c in range(65, 91)}
    f, n = {}, Counter()
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n["und" if lang is None else lang] += len(ws)
            own.update(tuple(ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in found.items()):
                continue
            score, _, l, r = min(((2_000_000 * a) // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "a\x00b", "\x01", "ü", "日本", "x", "machine", "learning", "rate"]
    def sentence():
        ws = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.4:
            ws[1:1] = ["new", "york", "city"]
        if rng.random() < 0.2:
            ws += ["a\x00b", "\x01", "a\x00b", "\x01"]
        return rng.choice([" ", "  ", "\t", " \t "]).join(ws)
    texts = [rng.choice([". ", ",", "\n", "\x0b", "?", " ;"]).join(sentence() for _ in range(rng.randrange(1, 12))) for _ in range(250)]
    return [(rng.choice(["en", "en", "de", None, "und"]), t) for t in texts] + [("en", None), ("fr", ""), ("a\nb", "q w e " * 200), (None, " \t\n.")]


@pytest.mark.parametrize("least", [30, 3])
def test_equal_to_counting_by_hand(spark, prose, least):
    df = spark.createDataFrame([(1, t, l, "x") for l, t in prose], "doc_id long, text string, lang string, phrase string")
    assert got(df, least=least, top=40) == brute(prose, least=least, top=40)


def test_small_batches_long_pieces_and_cuts(spark, prose, monkeypatch):
    monkeypatch.setattr(collocations, "SHORT", 2)
    monkeypatch.setattr(collocations, "TRIGGER", 3)
    rows = [*prose, ("en", "same " * 5000), ("en", " ".join(f"w{i % 7} v{i % 3}" for i in range(4000)))]
    for most in (1, 4):
        monkeypatch.setattr(collocations, "MOST", most)
        df = spark.createDataFrame([(l, t) for l, t in rows], "lang string, text string")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            assert got(df) == brute(rows)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_beginning_that_fills_ranges_is_dealt_out(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de"]), f"a common beginning of w{rng.randrange(5)} x{rng.randrange(10**6)}") for _ in range(900)] + [("en", f"rare w{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        assert collocations.beginnings(collocations.dictionary(df)).filter("shared").count() > 100
        assert got(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_rows_are_sorted_by_one_number(spark, prose):
    df = spark.createDataFrame([(l, t) for l, t in prose], "lang string, text string")
    rows = collocations.beginnings(collocations.dictionary(df))
    assert dict(rows.dtypes)["place"] == "bigint"
    parts = [[r["place"] for r in part] for part in rows.select("place").rdd.glom().collect()]
    assert sum(map(len, parts)) > 100 and all(part == sorted(part) for part in parts)
    # one word, two words and three words each have their bits, and few meet there by chance
    places = {}
    for r in rows.select("lang", "gram", "place").distinct().collect():
        for n, behind in zip((1, 2, 3), collocations.BEHIND):
            places.setdefault((r["lang"], *r["gram"].split("\0")[:n], n), set()).add(r["place"] >> behind if len(r["gram"].split("\0")) >= n else None)
    assert all(len(found - {None}) <= 1 for found in places.values())


def test_phrases_that_meet_in_one_place(spark):
    grams = [("en", "a\0x", 0), ("en", "b\0x", 0), ("de", "a\0x", 0), ("en", "c", 1 << 41)] * 40 + [("en", "d\0y\0z\0z", 1 << 42), ("en", "e\0y\0z\0z", 1 << 42)] * 29
    rows = spark.createDataFrame([(l, g, 1, 0, p) for l, g, p in sorted(grams, key=lambda r: r[2])], "lang string, gram string, times long, split int, place long").coalesce(1)
    for size in (3, 7, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(tuple(r) for r in collocations.counted(rows).collect()) == [("de", "a", 1, 40), ("de", "a x", 2, 40), ("en", "a", 1, 40), ("en", "a x", 2, 40), ("en", "b", 1, 40), ("en", "b x", 2, 40), ("en", "c", 1, 40)]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_short_beginnings_are_added_in_portions(spark, prose, monkeypatch):
    monkeypatch.setattr(collocations, "ROWS", 5)
    df = spark.createDataFrame([(l, t) for l, t in prose], "lang string, text string")
    assert got(df, least=3) == brute(prose, least=3)


def test_beginnings_that_fill_a_quarter_of_a_part_are_common(spark):
    df = spark.createDataFrame([("en", f"w{i % 20} x{i}") for i in range(400)], "lang string, text string")
    chunks = collocations.dictionary(df)
    assert [len(found) for found in collocations._common(chunks, 40)] == [20, 0, 0, 0]
    assert [len(found) for found in collocations._common(chunks, 4)] == [0, 0, 0, 0]


def test_each_occurrence_is_owned_once():
    rng = random.Random(1)
    for _ in range(200):
        ws = [f"w{rng.randrange(30)}".encode() for _ in range(rng.randrange(1, 900))]
        parts = list(collocations.parse(b" ".join(ws)))
        assert sum(o for _, o in parts) == len(ws) and all(0 < o <= max(collocations.MOST, collocations.SHORT) for _, o in parts)
        seen = [tuple(c.split(b" ")[i : i + 4]) for c, o in parts for i in range(o)]
        assert seen == [tuple(ws[i : i + 4]) for i in range(len(ws))]


def test_large_numbers_are_exact(spark):
    big = 10**13 + 7
    counts = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, big), ("en", "b c", 2, 35), ("en", "c", 1, 40), ("en", "a b c", 3, 33)], "lang string, phrase string, words int, f long")
    rows = {r["phrase"]: r for r in collocations.scored(counts).collect()}
    assert rows["a b"]["score"] == int(Fraction(2_000_000 * big, 5 * big + 1)) and rows["a b"]["l"] == 3 * big
    assert "b c" not in rows  # 33 of its 35 lie inside a b c
    assert (rows["a b c"]["score"], rows["a b c"]["l"], rows["a b c"]["r"]) == (0, 3 * big, 35)  # both cuts score 0: the first counts


def test_odd_documents(spark, edge, empty):
    rows = [(r["lang"], r["text"]) for r in edge.collect()]
    assert got(edge, least=2) == brute(rows, least=2)
    assert got(empty) == []


def test_documents(documents):
    assert got(documents) == brute([(r["lang"], r["text"]) for r in documents.collect()])
