import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import arrow_sequences, common, packing
from cairn.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


PARTS = st.one_of(st.sampled_from([" ", "\n", "\t", "  ", "\n\n", "'s", "'ll", "a", "bc", "Zebra", ".", ",!", "9", "2024", "é", "日", "\u3000", "\u2003", "\xa0", "\x85", "\x1c", "\x0b", "<|endoftext|>", "<|endof", "ß", "🙂"]), st.characters(codec="utf-8"))
TEXT = st.lists(PARTS, max_size=25).map("".join)
PLAIN = Tokenizer.from_file(default_tokenizer())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_batches_equal_the_bare_library_call(batch):
    ids, bounds = Encoder.of(default_tokenizer()).encode(pa.array(batch, pa.string()), 7)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [PLAIN.encode(t or "", add_special_tokens=False).ids + [7] for t in batch]


def test_special_strings_and_slices(plain):
    batch = pa.array(["x", "a <|endoftext|> b", "<|endof", "text|>", None, "tail  ", "  head", "end\n\n", "\nnext"])
    for at in range(len(batch)):
        ids, bounds = Encoder.of(default_tokenizer()).encode(batch.slice(at), 0)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [ids_of(plain, t) + [0] for t in batch.slice(at).to_pylist()]
    assert 50256 in ids_of(plain, batch[1].as_py())


def test_the_cache_stays_bounded(monkeypatch):
    from cairn.llm import tokens

    monkeypatch.setattr(tokens, "MOST_CHUNKS", 50)
    e = Encoder(default_tokenizer())
    for i in range(30):
        text = " ".join(f"w{i // 2 + j // 20}x{j}" for j in range(40))
        assert e.encode(pa.array([text]), 0)[0].tolist() == PLAIN.encode(text).ids + [0]
        assert len(e.cache) <= 50


def test_sequences_read_back(spark, sf, texts, plain):
    start = 0
    got = {r["doc_id"]: r for r in arrow_sequences.op3_arrow_sequences(spark, sf).collect()}
    for k in sorted(texts):
        ids = ids_of(plain, texts[k]) + [0]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_random_access_and_edges(spark, edge, empty, plain):
    shards = arrow_sequences.write(edge, common.new_folder(spark, "s"), default_tokenizer(), length=16, rows=4)
    stream = []
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        s = arrow_sequences.Sequences(r["path"])
        assert len(s) == r["sequences"]
        part = [s[i] for i in range(len(s))]
        assert all(len(ids) == len(mask) == 16 for ids, mask in part)
        stream += [x for ids, mask in part for x in ids[mask].tolist()]
        with pytest.raises(IndexError):
            s[len(s)]
    rows = sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert stream == [x for r in rows for x in ids_of(plain, r["text"]) + [0]]
    back = arrow_sequences.read(shards).collect()
    assert len(back) == len(rows) and max(r["start"] + r["n_tokens"] for r in back) == len(stream)
    assert arrow_sequences.read(arrow_sequences.write(empty, common.new_folder(spark, "s"), default_tokenizer())).count() == 0


def test_shards_roll(spark, documents, texts, plain):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        shards = arrow_sequences.write(documents, common.new_folder(spark, "s"), default_tokenizer(), roll=30_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shards.count() > 5
    at = 0
    for r in sorted(arrow_sequences.read(shards).collect(), key=lambda r: r["doc_id"]):
        ids = ids_of(plain, texts[r["doc_id"]]) + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def check_packing(rows, texts, plain, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, t in texts.items():
        ids = ids_of(plain, t) + [2]
        parts = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == capacity for r in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, sf, texts, plain):
    rows = packing.op4_packing(spark, sf).collect()
    used = check_packing(rows, texts, plain)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert used <= 1.05 * least + 2


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 457), ("sf0.1", 4465)])
def test_few_sequences(spark, sf, most):
    found = common.written(packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), default_tokenizer()), "pieces")
    assert packing.pack(found).filter("sequence_id % 2 = 1").select("sequence_id").distinct().count() <= most


def test_groups_are_even(spark):
    rows = spark.range(64 * 20, numPartitions=64).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "5L AS length", "0L AS ids_crc32")
    groups = {}
    for r in packing.pack(common.written(rows, "p"), group=20).collect():
        groups.setdefault((r["sequence_id"] // 2) >> 32, []).append(r)
    assert len(groups) == 64 and max(map(len, groups.values())) <= 40


def test_packing_edges(spark, edge, empty):
    found = common.written(packing.pieces(edge, default_tokenizer(), with_ids=True), "p")
    packed = packing.pack(found, group=3)
    assert packed.count() == found.count()
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    clash = found.selectExpr("*", "1 AS _group", "2 AS sequence_id", "3 AS `offset`", "4 AS _key")
    out = packing.pack(common.written(clash, "p"), group=3)
    assert out.count() == found.count() and {(r["_group"], r["_key"]) for r in out.collect()} == {(1, 4)} and len(set(out.columns)) == len(out.columns)
    assert packing.pack(common.written(packing.pieces(empty, default_tokenizer()), "p")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_takes_the_best_place(lengths):
    place, offset = packing.sum_of_squares(np.array(lengths, np.int64), 12)
    gaps = {}
    for s, p, o in zip(lengths, place.tolist(), offset.tolist()):
        def score(now):
            return sum(sum(g == k for g in now.values()) ** 2 for k in range(1, 12))

        room = [p2 for p2, g in gaps.items() if g >= s and g < 12] or [len(gaps)]  # a sequence opens only where none has room
        best = min(score(gaps | {p2: gaps.get(p2, 12) - s}) for p2 in room)
        assert p in room
        assert gaps.get(p, 12) >= s and 12 - gaps.get(p, 12) == o
        gaps[p] = gaps.get(p, 12) - s
        assert score(gaps) == best


def test_packing_keeps_large_ids_beside_null_ones(spark):
    big = (1 << 62) + 1
    rows = spark.createDataFrame([(big, "a b c"), (None, "d e f"), (big + 2, None)], "doc_id long, text string")
    out = packing.pack(common.written(packing.pieces(rows, default_tokenizer()), "p")).collect()
    assert {r["doc_id"] for r in out} == {big, None, big + 2}
