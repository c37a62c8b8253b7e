"""Products found by their names."""

import random

import pytest

from cairn.operators import users
from tests.measured import total


def table(spark, titles):
    return spark.createDataFrame(list(enumerate(titles)), "product_key long, title string")


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@pytest.mark.parametrize("few", [10_000, 0])
def test_find_equals_a_plain_search(spark, monkeypatch, few):
    monkeypatch.setattr(users, "FEW_NAMES", few)
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcAB ") for _ in range(n))
    titles = [made(rng.randrange(0, 9)) for _ in range(150)] * 2 + ["Straße", "ÉTÉ bis"]
    names = [made(rng.randrange(1, 6)) for _ in range(80)] + titles[:5] + ["été", "é", "zz", "STRASSE"]
    rng.shuffle(titles)

    def plain(name):
        equal = [i for i, t in enumerate(titles) if t.lower() == name.lower()]
        return min(equal or [i for i, t in enumerate(titles) if t and name.lower() in t.lower()], default=None)

    got = {r["name"]: r["product_key"] for r in users.find(table(spark, titles), names_of(spark, names)).collect()}
    assert got == {n: plain(n) for n in names if n and plain(n) is not None}


def test_equal_titles_are_searched_once(spark):
    few = table(spark, [f"title {i % 20}" for i in range(40)])
    many = table(spark, [f"title {i % 20}" for i in range(4_000)])
    names = names_of(spark, ["tle 1", "e 7", "4", "nothing"])
    made = [total(users.find(t, names), "Generate", "numOutputRows") for t in (few, many)]
    assert made[0] == made[1] > 0


def test_places_are_not_shuffled_for_few_names(spark):
    titles = table(spark, [f"title number {i}" for i in range(3_000)])
    names = names_of(spark, ["ber 1", "e 7", "4", "nothing"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert total(users.find(titles, names), "Exchange", "shuffleRecordsWritten") < 5 * 3_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
