import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


SAMPLES = [
    "", "no secret", "token=token:abcdefgh", "token==abcdef", "Password: 'hunter2x' and api_key=\"0123456789abcdef01234567\"", "🙂 secret = xyzzy1 ü token:ab",
    "AKIAAKIA" + "X" * 12 + " AKIA" + "Z" * 15, "a" * 24 + "g" + "0" * 23, "x" * 50 + "deadbeef" * 5, "tokentoken=abcdef apikey=aaaaaa API-KEY=aaaaaa", "secret=a.b/c_d-e+f=\nsecret:\tnope123",
]


def test_base_spans_equal_the_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string").withColumn("s", secrets.as_string(secrets.base_spans(F.col("text"))))
    assert {r["i"]: r["s"] for r in rows.collect()} == {i: base(t) for i, t in enumerate(SAMPLES)}


def test_base_spans_of_made_texts(spark):
    made = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["token", "secret", "=", ":", " ", '"', "abc", "f00d" * 7, "AKIA", "QWERTY12" * 2, "é", "\n", "passwd"]), max_size=12))
    def gather(parts):
        made.append("".join(parts))

    gather()
    rows = spark.createDataFrame(list(enumerate(made)), "i int, text string").withColumn("s", secrets.as_string(secrets.base_spans(F.col("text"))))
    assert {r["i"]: r["s"] for r in rows.collect()} == {i: base(t) for i, t in enumerate(made)}


def test_many_matches_in_one_text(spark):
    for n in (127, 128, 129, 300, 1000):
        text = " ü ".join(f"token={i:06d}" if i % 3 else f"key AKIA{'X' * 16}{i % 7}" for i in range(n))
        rows = spark.createDataFrame([(text,)], "text string").select(secrets.as_string(secrets.base_spans(F.col("text"))))
        assert rows.first()[0] == base(text)


@pytest.fixture(scope="module")
def model(documents):
    return secrets.train(secrets.samples(documents))


def test_documents(spark, sf, texts):
    for r in secrets.op5_secrets(spark, sf).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k + ":") for k in secrets.KINDS[:3])
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def ratio_by_hand(model, token):
    return sum(model.ratios[ord(a) * 128 + ord(b)] for a, b in zip("\0" + token, token))


def spans_by_hand(model, text):
    """All spans: the base ones, and of each judged token what they leave."""
    found = [tuple(map(int, x.split(":")[1:])) + (x.split(":")[0],) for x in filter(None, base(text).split(","))]
    covered, out = {i for a, b, _ in found for i in range(a, b)}, [(a, secrets.KINDS.index(k), b) for a, b, k in found]
    for m in re.finditer(secrets.TOKEN, text):
        at = max(i for i, least in enumerate(secrets.LENGTHS) if len(m[0]) >= least)
        if ratio_by_hand(model, m[0]) >= model.cutoffs[at] - 1e-9:
            start = None
            for i in range(m.start(), m.end() + 1):
                if i < m.end() and i not in covered:
                    start = i if start is None else start
                elif start is not None:
                    out.append((start, 3, i))
                    start = None
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_markov_spans_against_brute_force(spark, sf, texts, model, documents):
    for r in secrets.op5_secrets(spark, sf).collect():
        assert r["spans"] == spans_by_hand(model, texts[r["doc_id"]])
    made = ["x " + "Zq7" * 9 + "a1b2c3d4" * 4 + "Kx9Q" * 3 + " y", "Q7zK2p" + "f00dbeef" * 3 + "W8vX3m", "zX9kQ2 plain words only here", "AKIA" + "Q" * 18 + "kx7Zq2Pw9L", ""]
    rows = secrets.scan(spark.createDataFrame([(t,) for t in made], "text string"), model).select("text", secrets.as_string(F.col("spans")).alias("s"))
    assert all(r["s"] == spans_by_hand(model, r["text"]) for r in rows.collect())


def test_markov_models_tell_random_from_ordinary(spark, model, texts):
    import random

    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hit = lambda t: ratio_by_hand(model, t) >= model.cutoffs[max(i for i, least in enumerate(secrets.LENGTHS) if len(t) >= least)]
    for n, least in ((10, 0.9), (14, 0.95), (32, 0.97)):
        assert sum(hit("".join(rng.choice(alphabet) for _ in range(n))) for _ in range(400)) >= 400 * least
    masked = lambda t: "".join(" " if any(a <= i < b for a, b in s) else c for s in [[tuple(map(int, x.split(":")[1:])) for x in filter(None, base(t).split(","))]] for i, c in enumerate(t)) if base(t) else t
    ordinary = [w for t in texts.values() for w in re.findall(secrets.TOKEN, masked(t))]
    assert sum(map(hit, ordinary)) <= 0.0005 * len(ordinary) + 2


def test_redaction_and_edges(spark, edge, empty, model):
    rows = spark.createDataFrame([(1, 'x token = "abcdef0123456789abcdef0123456789" ü y', 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in secrets.redact(rows, model).collect()}
    assert got[1]["text"] == 'x [SECRET]" ü y' and got[2]["text"] is None and got[3]["text"] == "" and got[1]["spans"] == 5
    assert secrets.redact(edge, model).columns == edge.columns and secrets.redact(edge, model).count() == edge.count()
    clash = edge.withColumns({c: F.lit(7) for c in ("_base", "_spans", "base_spans", "_secrets_base")})
    assert secrets.redact(clash, model).columns == clash.columns and {r["_base"] for r in secrets.redact(clash, model).collect()} == {7}
    assert secrets.scan(empty, secrets.train(secrets.samples(empty))).count() == 0
