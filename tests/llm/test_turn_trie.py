"""The prefix trie against one built in plain Python."""

import hashlib
import random
import zlib

import pytest

from cairn.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes, children = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
            if d:
                children.setdefault(ts[: d - 1], set()).add(ts[:d])
    saved, leaves = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, ())
        saved[p] = sum(saved[k] for k in kids) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in turn_trie.trie(df, **options).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    pool = [[(rng.choice(["user", "system", None]), rng.choice(["hi", "ünï 日本", "", None, "a:b", "yes"])) for _ in range(12)] for _ in range(4)]
    rows = []
    for c in [*range(150), -3, -5, -11, 10**15, 10**15 + 1]:
        talk = list(rng.choice(pool))[: rng.randrange(1, 13)]
        if rng.random() < 0.3:
            talk[rng.randrange(len(talk))] = ("user", str(rng.random()))
        rows += [(c, i * 3, role, text) for i, (role, text) in enumerate(talk)]
    rows += [(200, None, "user", "no number"), (200, 5, "user", "a"), (200, 5, "user", "b"), (200, None, None, None), (203, 1, "x", "y"), (203, 1, "x", "y"), (None, 1, "a", "b"), (210, 0, None, None)]
    rng.shuffle(rows)
    return rows


def long_talks():
    rng = random.Random(6)
    base = [("user", f"turn {i} {rng.random()}") for i in range(300)]
    rows = []
    for c in range(1000, 1040):
        talk = base[: rng.choice([1, 63, 64, 65, 127, 128, 129, 192, 300])] + [("user", f"own {c % 6} {i}") for i in range(rng.choice([0, 0, 1, 70]))]
        rows += [(c, i, *t) for i, t in enumerate(talk)]
    return rows


@pytest.mark.parametrize("shard", [2048, 5, 1])
def test_equal_to_a_plain_trie(spark, talks, shard):
    assert got(frame(spark, talks), shard=shard) == brute(talks)


@pytest.mark.parametrize("shard", [2048, 7])
def test_long_conversations(spark, shard):
    rows = long_talks()
    assert got(frame(spark, rows).repartition(9), shard=shard) == brute(rows)


def test_one_conversation_over_many_ranges(spark):
    rows = [(5, i, "u", f"{i % 50}") for i in range(3000)] + [(c, i, "u", "0") for c in (2, 8, 6) for i in range(12)]
    assert got(frame(spark, rows).repartition(5)) == brute(rows)


def test_copies_and_empty_tables(spark, talks):
    rows = [(c, i, "u", f"t{i}") for c in range(400) for i in range(10)]
    assert got(frame(spark, rows), shard=64) == brute(rows)
    assert got(frame(spark, talks).limit(0)) == []
    only = [(6, 0, "a", "b")]  # rebuilt from nothing, it may come out without turns
    assert got(frame(spark, only)) == brute(only)


def test_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(df) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
