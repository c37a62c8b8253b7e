import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import ngram_join
from cairn.llm.components import components
from cairn.llm.tokens import Encoder, default_tokenizer


def shingles(text):
    w = text.encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(texts, threshold=0.8):
    """doc -> (class_id, copy_of, n_links)"""
    classes = defaultdict(list)
    for k, t in texts.items():
        if (s := shingles(t)) is not None:
            classes[s].append(k)
    sets, firsts = list(classes), [min(v) for v in classes.values()]
    parent = {f: f for f in firsts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, holders = [0] * len(sets), defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(firsts[i]), find(firsts[j])))
                parent[b] = a
    out = {k: (k, k, 0) for k in texts}
    for i, s in enumerate(sets):
        for k in classes[s]:
            out[k] = (find(firsts[i]), firsts[i], links[i])
    return out


def planted(seed=0):
    """Groups of near copies of many sizes and degrees, exact copies, a shared passage, odd texts."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, passage = [], words(80)
    for size in (1, 2, 3, 5, 9, 70):
        base = words(rng.randrange(60, 300))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 50) + 1)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [texts[3]] * 4 + ["", "  ", "two words", "two words", "two  words", "one"]
    texts += [" ".join(words(100) + passage + words(100)) for _ in range(20)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def result(spark, texts, params=ngram_join.Params()):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in ngram_join.join(rows, params).collect()}


def test_equals_brute_force_on_planted_copies(spark):
    texts = planted()
    assert result(spark, texts) == brute(texts)


def test_small_limits_block_against_block(spark):
    texts = planted(4)
    params = ngram_join.Params(limit=6, block=20, exact_block=2000, exact_classes=25, sample=8, depth=2, first_runs=3)
    assert result(spark, texts, params) == brute(texts)


def near_pages(groups, words=120, seed=3):
    """Groups of near copies with up to three words changed, and pages that share a passage."""
    rng = random.Random(seed)
    texts, passage = [], [f"p{i}" for i in range(20)]
    for size in groups:
        base = [f"g{size}w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [" ".join([f"q{rng.randrange(10**6)}" for _ in range(15)] + passage) for _ in range(150)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_large_buckets_by_centres(spark):
    texts = near_pages((300, 120))
    params = ngram_join.Params(limit=40, block=60, exact_classes=90, sample=32)
    want = brute(texts)
    assert max(v[2] for v in want.values()) > 50
    assert result(spark, texts, params) == want


def test_centres_lose_no_pair():
    rng = np.random.default_rng(4)
    params = ngram_join.Params()
    base = rng.integers(0, 1 << 32, 64, dtype=np.uint32)
    rows = np.tile(base, (200, 1))
    for r in rows:
        at = rng.permutation(64)[: rng.integers(0, 40)]
        r[at] = rng.integers(0, 1 << 32, len(at), dtype=np.uint32)
    made = ngram_join.centres_of(rows[:60], params)
    assert len(made) >= 1 and (made[0] != base).sum() <= 8
    apart = (rows[:, None] != made[None]).sum(axis=2)
    gone = apart <= params.inner
    near = apart <= params.inner + params.hashes - params.agree
    alike = (rows[:, None] == rows[None]).sum(axis=2) >= params.agree
    for a, b in zip(*np.nonzero(alike)):
        if gone[a].any():
            k = int(gone[a].argmax())
            assert near[b, k]
    assert len(ngram_join.centres_of(rows[:1], params)) == 0


def test_recall_just_over_the_threshold(spark):
    """Pairs of an index of 0.80 to 0.85: nearly all are found."""
    rng, texts = random.Random(8), {}
    for i in range(400):
        words = [f"r{i}w{j}" for j in range(100 + i % 40)]
        more = rng.randrange(len(words) // 6, len(words) // 5)
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(words + [f"e{i}w{j}" for j in range(more)])
    want = brute(texts)
    assert all(v[2] == 1 for v in want.values())
    got = result(spark, texts)
    assert sum(got[k] == want[k] for k in want) >= 0.995 * len(want)


def test_recall_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in ngram_join.join(rows).collect()}
    assert got == brute(texts)


def test_documents(spark, sf, texts):
    got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in ngram_join.op7_ngram_join(spark, sf).collect()}
    assert got == brute(texts)


def test_one_of_each_and_edges(spark, edge, empty):
    kept = ngram_join.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]
    clash = edge.selectExpr("*", "1 AS _text_key", "2 AS _doc", "3 AS _key", "4 AS text_key")
    again = ngram_join.one_of_each(clash)
    assert again.columns == clash.columns and {tuple(r)[-4:] for r in again.collect()} == {(1, 2, 3, 4)} and again.count() == kept.count()
    assert ngram_join.join(edge).count() == edge.count()
    assert ngram_join.one_of_each(empty).count() == 0
    texts = planted(2)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert {r["doc_id"] for r in ngram_join.one_of_each(rows).collect()} == {k for k, v in want.items() if v[0] == k}


def test_pairs_at_the_threshold_are_links():
    for k in (*range(1, 400), 1999, 4000):
        whole = np.arange(5 * k, dtype=np.uint64)
        for own, i, j in (([0, 0], 0, 0), ([0, 1], 0, 1)):
            assert ngram_join._linked([whole[: 4 * k], whole], np.array(own), i, j, 0.8)[0].tolist() == [1, 1]
            assert ngram_join._linked([whole[: 4 * k - 1], whole], np.array(own), i, j, 0.8)[0].tolist() == [0, 0]


def test_texts_at_the_threshold_are_links(spark):
    texts = {}
    for k in (3, 6, 7, 12, 25):
        words = [f"t{k}x{i}" for i in range(5 * k + 4)]
        texts[10 * k], texts[10 * k + 1] = " ".join(words[: 4 * k + 4]), " ".join(words)
    assert brute(texts) == {d: (d - d % 10, d, 1) for d in texts}
    assert result(spark, texts) == brute(texts)


def test_recall_at_the_threshold():
    from math import comb

    params = ngram_join.Params()
    chance = [comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(65)]
    rng, missed = np.random.default_rng(5), 0.0
    for k, c in enumerate(chance):
        # the tree by simulation: shared children of a root, and theirs
        shared = rng.binomial(k, 1 / (0.8 * 64), 200_000)
        alive = rng.random(200_000) < 1 - (1 - 1 / (0.8 * 64)) ** (k * shared.astype(float)) if params.depth == 2 else shared > 0
        missed += c * (1.0 if k < params.agree else (1 - alive.mean()) ** params.runs)
    assert missed <= 1.1 * (1 - params.recall)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", " ", "\n", "é", "\t\t"]), max_size=60))
def test_shingles(parts):
    text = "".join(parts)
    assert len(ngram_join.Shingler(5)(text.encode())) == len(shingles(text) or ())


def test_sketches_estimate_the_index():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    off = []
    for share in (0.5, 0.8, 0.9):
        n = int(1000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 1000 - n).astype(np.uint64)])
        off.append((ngram_join.sketch(a, 512) == ngram_join.sketch(b, 512)).mean() - share)
    assert max(map(abs, off)) < 0.08


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, rng.randrange(501, 900)) for _ in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


class _Rows:
    """Runs what mapInArrow is given over one batch."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def _peak(run):
    """(result, MB) at the peak of what numpy and Python allocate."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("crossed", [False, True])
def test_pairs_of_a_group_of_near_copies_are_not_held_at_once(crossed):
    n, rng = (3000 if crossed else 4000), np.random.default_rng(1)
    own = np.arange(n) % 2
    sketches = np.tile(rng.integers(0, 2**32, 64).astype(np.uint32), (n, 1))
    sketches[:, 0] = np.arange(n)
    columns = {"key": np.zeros(n, int) if crossed else np.arange(n) // 1000, "i": np.zeros(n, int), "j": np.full(n, int(crossed)), "own": own, "id": np.arange(n), "sketch": [s.tobytes() for s in sketches]}
    edges, most = _peak(lambda: ngram_join._bucket_edges(_Rows(pa.RecordBatch.from_pydict(columns)), ngram_join.Params()))
    want = {(i, 0 if crossed else i // 1000 * 1000) for i in range(n)}
    assert {e for b in edges for e in zip(b["a"].to_pylist(), b["b"].to_pylist())} == {(a, b) for a, b in want if a != b}
    assert most < 40


def test_blocks_of_near_copies_are_compared_in_bounded_memory():
    rng = np.random.default_rng(1)
    base = np.arange(1, 61, dtype=np.uint64)
    sets = [np.append(base, np.uint64(1000 + i)) for i in range(6000)]
    (count, label), most = _peak(lambda: ngram_join._linked(sets, rng.permutation(np.arange(6000) % 2), 0, 1, 0.8))
    assert (count == 3000).all() and not label.any()
    assert most < 90


def test_a_worker_gives_back_its_encoder(spark):
    Encoder.of(default_tokenizer())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_key": [2], "text": [b"a b c"]})
    (made,) = ngram_join.signatures(_Rows(batch), ngram_join.Params())
    assert made.num_rows == 1 and not Encoder._made
