from decimal import Decimal

from pyspark.sql import functions as F

from cairn.operators import runs


def test_reports(spark):
    rows = [("a", 0, True, None, Decimal(5), True, "p"), ("a", 1, False, "case", Decimal(5), False, "q"), ("a", 2, True, None, None, False, "r"), ("b", 3, True, None, Decimal(5), False, "s"), ("b", 4, False, "case", None, False, "t"), ("b", 5, False, "empty", None, False, "t")]
    df = spark.createDataFrame(rows, "shop_key string, seq int, accepted boolean, reason string, amount_dkk decimal(18,2), set_matched boolean, product_key string")
    assert tuple(runs.counters(df).first()) == (2, 3, 1, 1)
    assert [tuple(r) for r in runs.rejections(df).collect()] == [("case", 2), ("empty", 1)]
    counts, first = runs.shop_report(df, "a")
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"accepted": 1, "rejected": 1, "no_rate": 1} and [r["seq"] for r in first.collect()] == [0]


def test_orders_and_names(spark):
    sets = spark.createDataFrame([("x", False, None, 9), ("y", True, "2020-01-01", 1), ("z", True, None, 5), ("w", True, "2021-01-01", 1)], "set_name string, matched boolean, release_date string, offer_count int")
    assert [r["set_name"] for r in runs.ordered_sets(sets).collect()] == ["w", "y", "z", "x"]
    products = spark.createDataFrame([("s", "upc", "en"), ("s", "etb", "fr"), ("s", "etb", "de"), ("s", "odd", "en")], "set_name string, product_type string, language string")
    assert [(r["product_type"], r["language"]) for r in runs.within_set(products).collect()] == [("etb", "de"), ("etb", "fr"), ("upc", "en"), ("odd", "en")]
    r = spark.range(1).select(runs.product_title(F.lit("A"), F.lit("Box"), F.lit("English")).alias("t"), runs.set_slug(F.lit("A B"), F.lit(False)).alias("s")).first()
    assert tuple(r) == ("A Box (English)", "a-b-uden-match")
    quotes = spark.createDataFrame([("EUR", 746.0), ("SEK", 66.0)], "currency string, per_100 double")
    assert {r["currency"]: round(r["value"], 4) for r in runs.rebase(quotes).collect()} == {"EUR": 1.0, "DKK": 7.46, "SEK": round(746 / 66, 4)}


def test_countries_overview_and_cached_aliases(spark):
    from pyspark.sql import functions as F

    from cairn.sources import feeds

    codes = spark.createDataFrame([("DK",), ("XX",), (None,)], "code string").select(runs.country_name(F.col("code")).alias("n")).collect()
    assert [r["n"] for r in codes] == ["Danmark", "XX", None]
    log = spark.createDataFrame([(1, "ok", 5), (2, "failed", 0)], "shop_key int, status string, count long")
    shops = spark.createDataFrame([(1, "Zeta", "DK"), (2, "Alpha", "SE")], "shop_key int, shop_name string, country string")
    scores = spark.createDataFrame([(1, 3, 9)], "shop_key int, wins int, count long")
    got = runs.shop_overview(log, shops, scores).collect()
    assert [(r["shop_name"], r["status"], r["count"], r["wins"]) for r in got] == [("Alpha", "failed", 0, None), ("Zeta", "ok", 5, 3)]
    cache = spark.createDataFrame([("a", "Surging Sparks", "2024"), ("b", "surging  sparks", None), ("c", None, None), ("d", "!!", None)], "id string, name string, release_date string")
    assert [tuple(r) for r in feeds.cached_aliases(cache).collect()] == [("surging sparks", "b", "surging  sparks", None, None)]
    days = spark.createDataFrame([("p", "2024-01-01"), ("p", "2024-03-01")], "product_key string, day string")
    assert [r["day"] for r in runs.newest_first(days).collect()] == ["2024-03-01", "2024-01-01"]


def test_history_and_run_are_read_back(spark, tmp_path):
    from cairn.operators import history
    from cairn.sources import sinks

    rows = spark.sql("SELECT * FROM VALUES ('p', DATE'2023-12-31', 1.0D, 1, 1), ('p', DATE'2024-01-01', 2.0D, 1, 1), ('p', DATE'2024-01-01', 3.0D, 1, 2) AS t(product_key, day, dkk, shop_key, run)")
    schema, log = "product_key string, day date, dkk double, shop_key int, run int", str(tmp_path / "h")
    assert history.read(spark, log, schema).count() == 0 and history.vacuum(spark, log) == 0
    history.append(rows, log)
    (part,) = (tmp_path / "h").glob("data-*/year=2024")
    (part / "broken.parquet").write_bytes(b"no parquet at all")
    assert sorted((str(r["day"]), r["dkk"]) for r in history.read(spark, log, schema).collect()) == [("2023-12-31", 1.0), ("2024-01-01", 3.0)]
    assert [r["dkk"] for r in history.read(spark, log, schema, 2023).collect()] == [1.0]


def test_history_is_a_log(spark, tmp_path, monkeypatch):
    from cairn.operators import history
    from cairn.sources import commits

    schema, log = "product_key string, day date, dkk double, shop_key int, run int", str(tmp_path / "h")
    day = lambda d, price, run: spark.sql(f"SELECT 'p' AS product_key, DATE'{d}' AS day, {price}D AS dkk, 1 AS shop_key, {run} AS run")
    seen = lambda: sorted((str(r["day"]), r["dkk"]) for r in history.read(spark, log, schema).collect())
    history.append(day("2024-01-01", 1, 1).unionByName(day("2023-05-05", 7, 1)), log)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "h").rglob("*.parquet")}
    history.append(day("2024-01-02", 2, 2), log)
    history.append(day("2024-01-01", 3, 3), log)
    history.append(day("2024-01-01", 3, 3).limit(0), log)
    # a batch of a day writes that day alone, and leaves all files there were as they are
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    assert len(list((tmp_path / "h").rglob("*.parquet"))) == len(before) + 2
    assert seen() == [("2023-05-05", 7.0), ("2024-01-01", 3.0), ("2024-01-02", 2.0)]
    # a writer that dies before its commit leaves the old state
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        try:
            history.append(day("2024-01-03", 9, 4), log)
        except OSError:
            pass
        try:
            history.compact(spark, log, schema, 2024)
        except OSError:
            pass
    assert len(seen()) == 3
    state = commits.current(spark, log)
    assert history.compact(spark, log, schema, 2024) == 3 and history.compact(spark, log, schema, 2023) == 1
    assert seen() == [("2023-05-05", 7.0), ("2024-01-01", 3.0), ("2024-01-02", 2.0)]
    assert history.vacuum(spark, log) >= 4 and len(seen()) == 3
    # two writers can't follow the same state
    try:
        commits.commit(spark, log, {"live": []}, state)
        raise AssertionError
    except FileExistsError:
        pass


def test_a_run_is_there_as_a_whole_or_not(spark, tmp_path):
    from cairn.sources import sinks

    nested, path = "product_key string, offers array<struct<rank:int,total:double>>", str(tmp_path / "run")
    one = spark.createDataFrame([("EUR", 7.46)], "currency string, factor double")
    offers = lambda total: spark.createDataFrame([("p", 1, total), ("p", 2, 6.0)], "product_key string, rank int, total double")
    try:
        sinks.read_run(spark, path, "fx", one.schema.simpleString())
        raise AssertionError
    except FileNotFoundError:
        pass
    sinks.write_run(path, offers(5.0), one, one, one)
    broken = one.select(F.raise_error(F.lit("killed")).alias("x"))
    try:
        sinks.write_run(path, offers(99.0), one, broken, one)
        raise AssertionError
    except Exception as e:
        assert "killed" in str(e)
    got = sinks.unnest(sinks.read_run(spark, path, "products", nested))
    assert sorted(map(tuple, got.collect())) == [("p", 1, 5.0), ("p", 2, 6.0)]
    sinks.write_run(path, offers(4.0), one, one, one)
    assert {r["total"] for r in sinks.unnest(sinks.read_run(spark, path, "products", nested)).collect()} == {4.0, 6.0}
    assert [tuple(r) for r in sinks.read_run(spark, path, "stats", "currency string, factor double").collect()] == [("EUR", 7.46)]
