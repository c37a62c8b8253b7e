"""Substring search by the index against looking at every title."""

import random

from cairn.operators import text_index


def test_equal_to_contains(spark, tmp_path):
    rng = random.Random(8)
    words = ["Alpha", "beta", "ÆON", "aaa", "ab", "x", "Storm Emerald", "日本語の", "100%", "a_b"]
    titles = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) or None) for i in range(300)]
    text_index.write(spark.createDataFrame(titles, "product_key long, title string"), str(tmp_path / "i"))
    names = ["alp", "a", "AB", "aaaa", "rm em", "本語", "日本語の", "0%", "a_b", "%", "zzz", "beta beta", "", None, "x x", "Storm Emerald", "storm emeraldx"]
    got = {tuple(r) for r in text_index.search(spark, str(tmp_path / "i"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(n, i) for n in names if n for i, t in titles if t and n.lower() in t.lower()}


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    text_index.write(spark.createDataFrame([(i, f"title number {i}") for i in range(500)], "product_key long, title string"), str(tmp_path / "i"))
    wanted = text_index.asked(spark.createDataFrame([("number 77",)], "name string")).cache()
    met = text_index.postings(spark, str(tmp_path / "i"), wanted, "long")
    met.collect()
    few = wanted.select("bucket").distinct().count()
    assert 0 < few < text_index.BUCKETS
    files = {f.split("bucket=")[1].split("/")[0] for f in met.inputFiles() if "bucket=" in f}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200] and files
