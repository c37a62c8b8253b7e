import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing, sharding


def word_hash(word):
    """The library's hash of a word, computed with whole numbers of Python."""
    m = (1 << 64) - 1

    def spread(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return x ^ (x >> 31)

    return spread(sum((c + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(word.encode())) & m)


def topics_by_hand(rows, languages):
    """Topic and tokens of each (text, lang), by k-means in plain numpy."""
    n, lang = [], np.array([languages.index(x) if x in languages else len(languages) for _, x in rows])
    made = np.zeros((len(rows), 64))
    for i, (text, _) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n.append(len(words))
        for w, k in Counter(words).items():
            h = word_hash(w)
            made[i, h % 64] += np.log1p(k) * (1 if h >> 40 & 1 else -1)
        if words:
            made[i] = np.rint(made[i] * (1000 / np.sqrt((made[i] ** 2).sum())))
    n = np.array(n)
    apart = made - np.array([made[(lang == k) & (n > 0)].mean(axis=0) if ((lang == k) & (n > 0)).any() else np.zeros(64) for k in range(len(languages) + 1)])[lang]
    topic, centres = (apart[:, :3] > 0) @ (1, 2, 4), np.zeros((8, 64))
    for _ in range(6):
        centres = np.array([apart[(topic == t) & (n > 0)].mean(axis=0) if ((topic == t) & (n > 0)).any() else centres[t] for t in range(8)])
        topic = ((apart[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return topic, n


def raked_by_hand(cells, targets, rounds=5000):
    """Weights of cells {(source, lang, topic): tokens}, each axis in turn."""
    weight = dict(cells)
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            now = Counter()
            for k, w in weight.items():
                now[k[axis]] += w
            weight = {k: w * target[k[axis]] / now[k[axis]] if now[k[axis]] else 0.0 for k, w in weight.items()}
    return weight


def test_query_against_brute_force(spark, documents):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in mixing.op6_mixing(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    keys = sorted(docs)
    languages = list(mixing.LANGUAGES)
    topic, n = topics_by_hand([(docs[k]["text"], docs[k]["lang"]) for k in keys], languages)
    cells, cell = Counter(), {}
    for k, t, m in zip(keys, topic.tolist(), n.tolist()):
        cell[k] = (docs[k]["source"] or "", docs[k]["lang"] if docs[k]["lang"] in languages else "", t)
        cells[cell[k]] += m
        assert (rows[k]["source"], rows[k]["lang"], rows[k]["topic"], rows[k]["tokens"]) == (*cell[k], m)
    assert len({c[2] for c in cells}) >= 4
    total, sums = sum(cells.values()), [Counter(), Counter(), Counter()]
    for c, m in cells.items():
        for axis in range(3):
            sums[axis][c[axis]] += m
    other = sums[1][""] / total
    listed = {x: w for x, w in mixing.LANGUAGES.items() if sums[1][x]}
    targets = [{k: v**0.7 for k, v in sums[0].items()}, {x: (1 - other) * w / sum(listed.values()) for x, w in listed.items()} | {"": other}, {k: v**0.9 for k, v in sums[2].items()}]
    targets = [{k: v / sum(t.values()) for k, v in t.items()} for t in targets]
    weight = raked_by_hand(cells, targets, 300)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        got = sum(m * min(1.0, mid * weight[c] * total / m) for c, m in cells.items() if m)
        low, high = (mid, high) if got < 0.6 * total else (low, mid)
    for k, r in rows.items():
        m = cells[cell[k]]
        if m:
            assert abs(r["weight"] - weight[cell[k]]) < 1e-5
            assert abs(r["probability"] - min(1.0, high * weight[cell[k]] * total / m)) < 2e-3
        u = int(hashlib.md5(f"{k}:3".encode()).hexdigest()[:8], 16) / 2**32
        assert r["kept"] == (r["tokens"] > 0 and u < r["probability"])
    assert abs(sum(r["tokens"] * r["probability"] for r in rows.values() if r["tokens"]) / total - 0.6) < 1e-6


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "source string, lang int, topic int, tokens long")


def test_raking_meets_all_marginals(spark):
    rng = np.random.default_rng(0)
    cells = [(f"s{a}", b, c, int(rng.integers(1, 10_000))) for a in range(40) for b in range(5) for c in range(3) if rng.random() < 0.9]
    got = mixing.probabilities(cells_of(spark, cells), 0.5, 0.7, mixing.LANGUAGES, 0.9, 3).collect()
    assert len(got) == len(cells)
    for axis, power in ((0, 0.7), (2, 0.9)):
        tokens, weight = Counter(), Counter()
        for r in got:
            tokens[r[axis]] += r["tokens"]
            weight[r[axis]] += r["weight"]
        total = sum(v**power for v in tokens.values())
        assert all(abs(weight[k] - v**power / total) < 2e-6 for k, v in tokens.items())
    all_tokens = sum(c[3] for c in cells)
    assert abs(sum(r["weight"] for r in got if r["lang"] == 4) - sum(c[3] for c in cells if c[1] == 4) / all_tokens) < 2e-6
    assert abs(sum(r["tokens"] * r["probability"] for r in got) / all_tokens - 0.5) < 1e-9


def test_scale_meets_the_budget(spark):
    rng = np.random.default_rng(1)
    rows = [(int(t), float(r)) for t, r in zip(rng.integers(1, 1000, 30), rng.random(30) * 3)]
    cells = spark.createDataFrame(rows, "tokens long, ratio double")
    total = sum(t for t, _ in rows)
    for keep in (0.05, 0.4, 0.8, 0.99):
        s = mixing.scale_for(cells, keep * total)
        assert abs(sum(t * min(1, s * r) for t, r in rows) / total - keep) < 1e-9
    assert mixing.scale_for(cells, total + 1.0) == float("inf")


def test_all_sizes_and_joins_give_one_result(spark, documents, monkeypatch):
    a = sorted(mixing.mix(documents).select("doc_id", "mix.*").collect())
    monkeypatch.setattr(mixing, "SMALL", 0)
    b = sorted(mixing.mix(documents.repartition(3)).select("doc_id", "mix.*").collect())
    assert [r["kept"] for r in a] == [r["kept"] for r in b]
    assert all(x["topic"] == y["topic"] and abs((x["probability"] or 0) - (y["probability"] or 0)) < 1e-9 for x, y in zip(a, b))


def test_mixing_edges(edge, empty):
    clash = edge.withColumns({c: F.lit(7) for c in ("_mix", "_source", "_lang", "_weight", "_probability", "topic", "tokens")})
    out = mixing.mix(clash).collect()
    assert len(out) == edge.count() and not any(r["mix"]["kept"] for r in out if r["doc_id"] in (2, 3, 4)) and {r["_mix"] for r in out} == {7}
    assert mixing.sample(clash).columns == clash.columns
    assert mixing.sample(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(edge.withColumn("mix", F.lit(1)))


def test_null_and_unlisted_languages_can_stay(spark):
    words = lambda i: " ".join(f"w{i * 31 + j}" for j in range(40 + i % 50))
    rows = [(i, words(i), ("en", "de", None, "pt", "en", "fr")[i % 6], "hot" if i % 6 == 2 else f"s{i % 4}") for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "mix.*").collect()
    own = [r for r in out if r["lang"] == ""]
    assert {r["doc_id"] % 6 for r in own} == {2, 3}
    assert all(r["probability"] > 0 for r in own) and all(any(r["kept"] for r in own if r["doc_id"] % 6 == k) for k in (2, 3))
    targets = lambda *tokens: mixing.language_targets(np.array(tokens, float), mixing.LANGUAGES).tolist()
    assert targets(60, 20, 0, 0, 20) == pytest.approx([0.8 * 5 / 7, 0.8 * 2 / 7, 0, 0, 0.2])
    assert targets(0, 0, 0, 0, 4) == pytest.approx([0, 0, 0, 0, 1.0])


def test_table_is_filled_by_turns():
    shards, slots = ("c", "a", "b"), 13
    order = {}
    for s in shards:
        d = hashlib.md5(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        order[s] = [(offset + j * skip) % slots for j in range(slots)]
    owner = {}
    while len(owner) < slots:
        for s in sorted(shards):
            if len(owner) < slots:
                owner[next(x for x in order[s] if x not in owner)] = s
    assert [shards[i] for i in sharding.fill(shards, slots=slots)] == [owner[i] for i in range(slots)]


def test_table_is_even_weighted_and_stable(spark):
    full = sharding.fill(sharding.SHARDS)
    sizes = np.bincount(full, minlength=64)
    assert sizes.max() - sizes.min() <= 1
    weighted = np.bincount(sharding.fill(("a", "b", "c"), {"a": 2, "c": 0}, 1009), minlength=3)
    assert weighted[2] == 0 and abs(weighted[0] - 2 * weighted[1]) <= 2
    less = tuple(s for s in sharding.SHARDS if s != "shard-010")
    changed = sharding.moved(spark, sharding.SHARDS, less)
    assert sizes[10] <= changed.count() < sizes[10] + 0.15 * sharding.SLOTS
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(("a",), slots=12)


def test_placement(spark, sf, texts, edge, empty):
    table = sharding.fill(sharding.SHARDS)
    for r in sharding.op10_sharding(spark, sf).collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table[slot]])
    clash = edge.withColumn("slot", F.lit("x"))
    out = sharding.place(clash, F.col("doc_id"))
    assert out.count() == edge.count() and out.filter("shard is null").count() == 0
    assert sharding.place(empty, F.col("doc_id")).count() == 0
