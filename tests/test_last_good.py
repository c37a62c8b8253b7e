"""Last good snapshots by shop, as a log of runs."""

import os

import pytest

from cairn.sources import sinks

ROW = "shop_key long, product_key long, total_dkk decimal(18,2)"


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_files_grow_with_tasks_and_not_with_shops(spark, tmp_path):
    path = str(tmp_path / "good")
    rows = spark.range(5_000).selectExpr("id % 1000 AS shop_key", "id AS product_key", "cast(id as decimal(18,2)) AS total_dkk").repartition(4)
    sinks.write_last_good(rows, path)
    assert len(files(path)) <= 4 and sinks.read_last_good(spark, path).count() == 5_000


@pytest.mark.parametrize("most", [1, 2, 100])
def test_each_shop_has_its_last_run_alone(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(sinks, "RUNS", most)
    path, want = str(tmp_path / "good"), {}
    for run, shops in enumerate([(1, 2, 3), (2, None), (), (3, 4), (1, 2), (2,)]):
        rows = [(s, run * 10 + i) for s in shops for i in range(2)]
        sinks.write_last_good(spark.createDataFrame([(s, p, None) for s, p in rows], ROW), path)
        want |= {s: sorted(p for t, p in rows if t == s) for s in shops}
        got = {}
        for r in sinks.read_last_good(spark, path).collect():
            assert r["stale"]
            got.setdefault(r["shop_key"], []).append(r["product_key"])
        assert {s: sorted(p) for s, p in got.items()} == want
    assert most > 2 or sum(n.startswith("data-") for n in os.listdir(path)) <= 2 * most + 2


def test_nothing_written_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.read_last_good(spark, str(tmp_path / "none"))
