"""Substring dedup against comparing all windows."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from cairn.llm import common, substrings
from cairn.llm.words import Words

SCHEMA = "doc_id long, text string, run long, found string"


def brute(rows):
    split = [(d, re.findall("[^ \t-\r]+", t or "")) for d, t in rows]
    least = {}
    for d, ws in split:
        for i in range(len(ws) - 12):
            if d is not None:
                k = tuple(ws[i : i + 13])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - 12):
            if d is not None and least[tuple(ws[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r)[:4] for r in substrings.dedup(df, **options).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["ü", "日本", "\x00", "\x1c", "a.b"]
    passages = [[rng.choice(words) for _ in range(rng.choice([12, 13, 14, 20, 55, 90]))] for _ in range(12)]
    rows = []
    for d in range(160):
        ws = []
        for _ in range(rng.randrange(0, 5)):
            ws += [rng.choice(words) for _ in range(rng.randrange(0, 25))]
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = rng.choice(words)
            ws += p[rng.randrange(0, 3) :]
        rows.append((d - 20, "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in ws)))
    rows += [(500, rows[30][1]), (501, rows[30][1]), (-50, rows[31][1]), (33, rows[34][1]), (40, rows[60][1]), (None, rows[35][1]), (None, rows[35][1]), (502, None), (503, ""), (504, "x " * 400), (505, "x " * 13), (506, "x " * 12), (507, "y " * 60 + "x " * 14)]
    return rows


@pytest.mark.parametrize("crowd", [2000, 3, 0])
def test_equal_to_all_windows(spark, texts, crowd):
    assert got(frame(spark, texts), crowd=crowd) == brute(texts)


def test_small_batches_and_automata(spark, texts, monkeypatch):
    monkeypatch.setattr(substrings, "BYTES", 1)
    monkeypatch.setattr(substrings, "SLICE", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert got(frame(spark, texts).repartition(7)) == brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_passage_in_all_documents(spark):
    rng = random.Random(8)
    line = " ".join(f"p{i}" for i in range(40))
    rows = [(d, " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(9))) + f" {line} " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(9))) for d in range(600)]
    for crowd in (2000, 20):
        assert got(frame(spark, rows), crowd=crowd) == brute(rows)


def test_steps_give_back_their_disk(spark, texts):
    def shuffles():
        local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {p for d in local for p in Path(d.getAbsolutePath()).rglob("shuffle_*")}

    shared = Path(common.filesystem(common.shared_dir(spark))[1])
    folders, files, key = set(shared.iterdir()), shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = substrings.dedup(frame(spark, texts), crowd=3)
    assert [p.name.split("-")[1] for p in set(shared.iterdir()) - folders] == ["found"]
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffles() - files):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key) == "false"
    for _ in range(2):  # what is left on disk is all that a result needs, however often it is computed
        assert sorted((tuple(r) for r in df.collect()), key=str) == brute(texts)


def test_kept_words(spark):
    a = " ".join(f"a{i}" for i in range(20))
    out = {r["doc_id"]: r["kept"] for r in substrings.dedup(frame(spark, [(1, a), (2, f"start {a}\nend")]), texts=True).collect()}
    assert out == {1: a, 2: "start end"}


def test_odd_documents(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(edge) == brute(rows)
    assert got(empty) == []


def test_documents(documents):
    assert got(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_windows_name_runs_by_their_words_alone():
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randrange(9)}" for _ in range(rng.randrange(60))).encode() for _ in range(80)]
    words = Words(texts)
    run, fragment, first, count = substrings.fragments(words)
    named = {}
    covered = 0
    for r, a, n in zip(run.tolist(), first.tolist(), count.tolist()):
        assert 1 <= n <= substrings.WINDOW - substrings.RUN + 1
        for j in range(a, a + n):
            w = words.between(j, j + 12)
            assert named.setdefault(w, r) == r
            covered += 1
    assert covered == sum(max(0, len(t.split()) - 12) for t in texts)
    assert all(words.of(i) == t.split() for i, t in enumerate(texts))


def test_hashes_do_not_depend_on_segments(monkeypatch):
    from cairn.llm import words

    texts = [b"a bb ccc dddd " * 50, b"", b" x ", b"z" * 500]
    whole = Words(texts).hash
    monkeypatch.setattr(words, "SEGMENT", 16)
    assert np.array_equal(Words(texts).hash, whole)
