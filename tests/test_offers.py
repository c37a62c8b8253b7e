"""Market statistics, history, feeds, rates and runs on hand-built rows."""

import datetime
import json
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cairn.functions import money, text
from cairn.operators import history, offers
from cairn.sources import feeds, sinks
from cairn.streaming import snapshots

OFFER = "product_key string, shop_key string, country string, in_stock boolean, amount_dkk decimal(18,2), shipping_dkk decimal(18,2), total_dkk decimal(18,2), seq int"


def rows(spark, *products):
    out = []
    for name, *own in products:
        for i, o in enumerate(own):
            shop, total, stock = (*o, True)[:3]
            out.append((name, shop, "DK", stock, Decimal(total), Decimal(0), Decimal(total), i))
    return spark.createDataFrame(out, OFFER)


def test_market_price(spark):
    df = rows(spark, ("p", ("a", 1000), ("b", 1100), ("c", 1500), ("d", 900, False)), ("q", ("a", 1000), ("b", 1020), ("c", 3000)), ("r", ("a", 1000), ("b", 1200)), ("s", ("a", 1000), ("b", 1100), ("c", 1300), ("d", 1400)), ("t", ("a", 50, False)))
    got = {r["product_key"]: r for r in offers.statistics(df).collect()}
    assert (got["p"]["market"], got["p"]["discount_pct"]) == (1100, 9.1)
    assert (got["q"]["market"], got["q"]["discount_pct"]) == (1020, 2.0)
    assert (got["r"]["market"], got["r"]["discount_pct"], got["r"]["lo"], got["r"]["hi"]) == (None, None, 1000, 1200)
    assert got["s"]["market"] == 1200
    assert got["t"]["cheapest"]["shop_key"] == "a" and got["t"]["cheapest_item"] is None and got["t"]["spread"] is None


def test_deals_strip_and_scorecard(spark):
    df = rows(spark, ("a", ("x", 800), ("y", 1000), ("z", 1050)), ("b", ("x", 980), ("y", 1000), ("z", 1010)), ("c", ("x", 900), ("y", 1000), ("z", 1100)), ("d", ("x", 500), ("y", 1000)))
    assert [r["product_key"] for r in offers.deals(offers.statistics(df)).collect()] == ["a", "c"]
    df = rows(spark, ("a", ("x", 800), ("y", 1000), ("z", 1200)), ("b", ("x", 800), ("y", 900)))
    strip = offers.price_strip(df, offers.statistics(df)).orderBy("tick").collect()
    assert [(r["tick"], r["market_pos"]) for r in strip] == [(0.0, 50.0), (50.0, 50.0), (100.0, 50.0)]
    df = rows(spark, ("a", ("x", 800), ("y", 1000), ("z", 1200)), ("b", ("y", 500)))
    card = {r["shop_key"]: r for r in offers.scorecard(df, offers.statistics(df)).collect()}
    assert (card["x"]["wins"], card["x"]["contested"], card["x"]["price_index"]) == (1, 1, None)
    assert (card["y"]["wins"], card["y"]["contested"], card["y"]["in_stock"]) == (0, 1, 2)


def test_ties_go_to_the_earlier_offer(spark):
    df = rows(spark, ("a", ("x", 10), ("y", 10), ("x", 10), ("z", 9, False)))
    one = offers.one_per_shop(df)
    assert one.count() == 3
    assert [r["shop_key"] for r in offers.ranked(one).orderBy("rank").collect()] == ["x", "y", "z"]
    s = offers.statistics(one).first()
    assert s["cheapest"]["shop_key"] == s["dearest"]["shop_key"] == "x" and s["spread"] is None


def test_landed_cost(spark):
    shops = spark.createDataFrame([("v", "DK", "EUR", Decimal(10), Decimal(100), True), ("w", "SE", "SEK", None, None, False), ("u", "XX", "USD", Decimal(5), None, True)], "shop_key string, country string, currency string, ship decimal(18,2), free_over decimal(18,2), verified boolean")
    rates = spark.createDataFrame([("EUR", Decimal("7.46")), ("SEK", Decimal("0.66311"))], "currency string, factor decimal(12,5)")
    assumed = spark.createDataFrame([("SE", Decimal(85))], "country string, assumed decimal(18,2)")
    raw = spark.createDataFrame([(1, "v", Decimal(99)), (2, "v", Decimal(100)), (3, "w", Decimal(100)), (4, "u", Decimal(1)), (5, "none", Decimal(1))], "id int, shop_key string, amount decimal(18,2)")
    out = offers.land_cost(raw, shops, rates, assumed)
    got = {r["id"]: (r["amount_dkk"], r["shipping_dkk"], r["shipping_verified"], r["total_dkk"]) for r in out.collect()}
    d = Decimal
    assert got[1] == (d("738.54"), d("74.60"), True, d("813.14")) and got[2] == (d("746.00"), d("0.00"), True, d("746.00"))
    assert got[3] == (d("66.31"), d("85.00"), False, d("151.31")) and got[4][0] is None and got[5][3] is None
    assert offers.convertible(out).count() == 3


def day(n):
    return datetime.date(2026, 9, n)


def test_history(spark):
    schema = "product_key string, day date, dkk decimal(18,2), total_dkk decimal(18,2), shop_key string, in_stock boolean, run int"
    old = spark.createDataFrame([("p", day(i), Decimal(100 + i), Decimal(0), "a", True, 1) for i in range(1, 9)] + [("q", day(1), Decimal(5), Decimal(0), "a", True, 1)], schema)
    new = spark.createDataFrame([("p", day(8), Decimal(50), Decimal(0), "b", True, 2)], schema)
    out = history.upsert(old, new)
    assert out.count() == 9 and history.upsert(out, new).collect() == out.collect()
    drops = history.price_drops(out).collect()
    assert [(r["product_key"], r["today"], r["baseline"], r["drop_dkk"], r["drop_pct"], r["days"]) for r in drops] == [("p", 50, 104, 54, 51.9, 8)]
    s = {r["product_key"]: r for r in history.series(out).collect()}
    assert s["p"]["observations"] == 8 and s["p"]["points"][-1]["dkk"] == 50 and s["q"]["first_day"] == day(1)


def test_recent_observations_merge(spark):
    rng = random.Random(4)
    start = datetime.date(2020, 1, 1)
    rows_ = [(p, start + datetime.timedelta(days=d), None if rng.random() < 0.1 else Decimal(rng.randrange(50, 150))) for p in range(40) for d in sorted(rng.sample(range(1500), rng.randrange(1, 30)))]
    schema = "product_key long, day date, dkk decimal(18,2)"
    want = {}
    for p in range(40):
        own = [x for q, _, x in rows_ if q == p and x is not None]
        if len(own) >= 3:
            base = statistics.median(map(float, own[-8:-1]))
            if base > 0 and (base - float(own[-1])) / base >= 0.03:
                want[p] = (own[-1], round(base, 2), len(own))
    whole = history.price_drops(spark.createDataFrame(rows_, schema))
    assert {r["product_key"]: (r["today"], float(r["baseline"]), r["days"]) for r in whole.collect()} == want
    parts = [history.recent(spark.createDataFrame([r for r in rows_ if r[1].year in years] or [(0, start, None)], schema)) for years in ((2020,), (2021, 2022), (2023, 2024))]
    state = history.merge_recent(history.merge_recent(parts[0], parts[1]), parts[2])
    assert sorted(map(tuple, history.drops(state).collect())) == sorted(map(tuple, whole.collect()))
    assert "Window" not in whole._jdf.queryExecution().toString()
    assert whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_medians_of_a_hot_shop(spark):
    rng = random.Random(6)
    rows_ = [("hot", rng.choice([rng.random() * 3, 1.0, 1.0 + rng.random() * 1e-7])) for _ in range(5000)] + [("even", 1.25), ("even", 1.5), ("one", 0.333), ("same", 2.0), ("same", 2.0), ("none", None)]
    df = spark.createDataFrame(rows_, "shop_key string, v double")
    got = {r["shop_key"]: (r["n"], r["median"]) for r in offers.medians(df, "shop_key", "v").collect()}
    values = {k: [v for s, v in rows_ if s == k and v is not None] for k in ("hot", "even", "one", "same")}
    assert got == {k: (len(v), statistics.median(v)) for k, v in values.items()}


def test_feeds(spark, tmp_path):
    shops = spark.createDataFrame([("s", "DK", "DKK", "https://s.example/")], "shop_key string, country string, currency string, base_url string")
    variants = [{"title": "Default Title", "price": "10.50", "available": True}, {"title": "Blue", "price": "x", "available": True}, {"title": "Red", "price": "12", "available": False}, {"title": "Free", "price": "0", "available": True}]
    page = lambda n, ids: {"shop_key": "s", "path": "/all", "page": n, "products": [{"id": i, "handle": f"h{i}", "title": f"Box &amp; {i}", "variants": variants} for i in ids] + [{"id": 99, "handle": "", "title": "none", "variants": variants}]}
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, (page(1, [1, 2]), page(2, [3]), page(3, [1, 2]), page(4, [5])))) + "\n{broken\n")
    got = feeds.conform(feeds.read_feed(spark, "nested", str(tmp_path / "n.json"), shops), shops, F.lit("2026-09-24"))
    assert sorted((r["title"], str(r["amount"]), r["in_stock"], r["url"], r["currency"]) for r in got.collect()) == sorted(x for i in (1, 2, 3) for x in [(f"Box & {i}", "10.50", True, f"https://s.example/products/h{i}", "DKK"), (f"Box & {i} - Red", "12.00", False, f"https://s.example/products/h{i}", "DKK")])
    flat = [{"shop_key": "s", "name": "A", "permalink": "u", "prices": {"price": "12345", "currency_code": "eur"}, "is_in_stock": True}, {"shop_key": "s", "name": "B", "permalink": "u", "prices": {"price": "500", "currency_minor_unit": 0}, "stock_availability": {"text": "few"}, "is_purchasable": False}, {"shop_key": "s", "name": "C", "permalink": "u", "prices": {"price": ""}}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, flat)))
    got = feeds.conform(feeds.read_feed(spark, "flat", str(tmp_path / "f.json"), shops), shops, F.lit("2026-09-24"))
    assert sorted((r["title"], str(r["amount"]), r["currency"], r["in_stock"]) for r in got.collect()) == [("A", "123.45", "EUR", True), ("B", "500.00", "DKK", False)]
    pages = [{"shop_key": "s", "page_id": 1, "url": "https://s.example/all?page=1", "html": '<li class="product"><h3><a href="/p/1">Box &amp; Co</a></h3><span class="price">1.299,50 kr</span></li><li class="product"><a href="x">Tin</a> 20 kr udsolgt</li><li class="product">no link 5 kr</li>'}, {"shop_key": "none", "page_id": 2, "url": "u", "html": "<p>nothing</p>"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, pages)))
    got = feeds.conform(feeds.read_feed(spark, "listing", str(tmp_path / "l.json"), shops), shops, F.lit("2026-09-24"))
    assert sorted((r["title"], r["url"], str(r["amount"]), r["currency"], r["in_stock"]) for r in got.collect()) == [("Box & Co", "https://s.example/p/1", "1299.50", "DKK", True), ("Tin", "https://s.example/x", "20.00", "DKK", False)]
    with pytest.raises(ValueError, match="no reader"):
        feeds.read_feed(spark, "other", "x", shops)
    with pytest.raises(ValueError, match="unknown shops: z"):
        feeds.select_shops(shops, ["s", "z"])


def test_listing(spark):
    html = '<div class="product-listing-item"><a class="product-name" href="/p-1.html">Box &amp; One</a><span class="price">1.299,50 DKK</span></div><div class="product-listing-item"><h3><a href="p-2.html?x=1">Two</a></h3> 95 kr Udsolgt</div><div class="product-listing-item"><a href="x">no price</a></div>'
    pages = spark.createDataFrame([(1, "https://h.example/a/list?page=2", html), (2, "https://h.example/", "<p>none</p>"), (3, None, None)], "page_id long, url string, html string")
    assert [tuple(r)[1:] for r in feeds.listing(pages).orderBy("seq").collect()] == [(0, "Box & One", "https://h.example/p-1.html", 1299.5, True), (1, "Two", "https://h.example/a/p-2.html?x=1", 95.0, False)]


def test_rates(spark):
    series = spark.createDataFrame([("DKK", "2026-09-01", "7.40"), ("DKK", "2026-09-02", "7.46"), ("DKK", "2026-09-03", "NaN"), ("SEK", "2026-09-02", "11.25"), ("SEK", "2026-09-03", "")], "currency string, period string, value string")
    got = {r["currency"]: (str(r["factor"]), r["stale"]) for r in feeds.last_rates(series).collect()}
    assert got == {"DKK": ("1.00000", False), "EUR": ("7.46000", False), "SEK": ("0.66311", False)}
    cached = spark.createDataFrame([("DKK", "2026-08-01", 7.5)], "currency string, period string, value double")
    assert {r["currency"]: (str(r["factor"]), r["stale"]) for r in feeds.last_rates(series.filter("currency = 'SEK'"), cached).collect()} == {"DKK": ("1.00000", True), "EUR": ("7.50000", True)}
    assert all(not r["stale"] for r in feeds.last_rates(series, cached).collect())


def test_set_aliases(spark):
    sets = spark.createDataFrame([("en", 0, "a", "Alpha One", None), ("en", 1, "b", "Beta", "2020-01-01"), ("en", 2, "c", "Beta!", "2021-01-01"), ("de", 0, "a", "Älpha Eins", None), ("de", 1, "x", "Unknown", None), ("fr", 0, "b", "Alpha one", None)], "lang string, seq int, id string, name string, releaseDate string")
    cache = spark.createDataFrame([("a", "1999-01-01")], "id string, release_date string")
    got = {r["alias"]: (r["set_id"], r["release_date"], r["alias_lang"]) for r in feeds.set_aliases(sets, cache=cache).collect()}
    assert got == {"alpha one": ("a", "1999-01-01", "en"), "beta": ("c", "2021-01-01", "en"), "alpha eins": ("a", "1999-01-01", "de")}


def test_users_json(spark):
    df = spark.createDataFrame([(1, '["a","b","a"]'), (2, "{broken"), (3, None)], "user_id int, json string")
    assert sorted(map(tuple, feeds.parse_watchlist(df).collect())) == [(1, "a"), (1, "b")]
    df = spark.createDataFrame([(1, '[{"key":"a","qty":2,"cost":5.5},{"key":"b"}]'), (2, "nope")], "user_id int, json string")
    assert [tuple(r) for r in feeds.parse_holdings(df).orderBy("seq").collect()] == [(1, 0, "a", 2, 5.5), (1, 1, "b", 1, None)]


def test_snapshots_and_results_round_trip(spark, tmp_path):
    df = rows(spark, ("a", ("x", 800), ("y", 1000)), ("b", ("x", 5)))
    sinks.write_last_good(df, str(tmp_path / "good"))
    sinks.write_last_good(df.filter("shop_key = 'x'").withColumn("amount_dkk", F.lit(1).cast(money.MONEY)), str(tmp_path / "good"))
    back = sinks.read_last_good(spark, str(tmp_path / "good"))
    assert back.count() == 3 and back.filter("shop_key = 'y'").first()["amount_dkk"] == 1000 and all(r["stale"] for r in back.collect())
    ranked = offers.ranked(df).select("product_key", "rank", "shop_key", "total_dkk")
    sinks.write_result(ranked, str(tmp_path / "result"))
    again = sinks.read_result(spark, str(tmp_path / "result"), "product_key string, offers array<struct<rank:int,shop_key:string,total_dkk:decimal(18,2)>>")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ranked.collect()))


def test_fallback_and_log(spark):
    shops = spark.createDataFrame([("a",), ("b",), ("c",)], "shop_key string")
    fresh, last = (spark.createDataFrame(x, "shop_key string, n int, stale boolean") for x in ([("a", 1, False)], [("a", 9, False), ("b", 2, False), ("b", 3, False)]))
    assert sorted(map(tuple, offers.fallback(fresh, last).collect())) == [("a", 1, False), ("b", 2, True), ("b", 3, True)]
    assert {r["shop_key"]: (r["status"], r["count"]) for r in offers.run_log(shops, fresh, last).collect()} == {"a": ("ok", 1), "b": ("stale", 2), "c": ("failed", 0)}


def test_product_groups_and_keys(spark):
    df = spark.createDataFrame([(0, None, "Zeta Alpha", "etb", "en"), (1, None, "alpha zeta!", "etb", "en"), (2, "s1", "Name A", "etb", "en"), (3, "s1", "Nom A", "etb", "en"), (4, "s1", "Nom A", "etb", "fr")], "seq int, set_id string, set_name string, product_type string, language string")
    got = {r["seq"]: (r["product_key"], r["set_name"]) for r in offers.group_products(df).collect()}
    assert got[0] == got[1] and got[0][1] == "Zeta Alpha" and got[2] == got[3] != got[4]
    import hashlib

    assert got[2][0] == "name-a-etb-en-" + hashlib.sha1(b"s1|etb|en").hexdigest()[:8]
    assert got[0][0] == "zeta-alpha-etb-en-" + hashlib.sha1(b"raw:zeta-alpha|etb|en").hexdigest()[:8]


def test_stream_of_snapshots(spark, tmp_path):
    schema = OFFER + ", captured_at date"
    src, target = str(tmp_path / "in"), str(tmp_path / "history")
    put = lambda d, price: rows(spark, ("a", ("x", price), ("y", 1000))).withColumn("captured_at", F.lit(d)).coalesce(1).write.mode("append").parquet(src)
    for d, price in ((day(1), 800), (day(2), 700), (day(2), 650)):
        put(d, price)
        snapshots.follow(spark, src, schema, target, str(tmp_path / "cp")).awaitTermination(120)
    stored = "product_key string, day date, dkk decimal(18,2), total_dkk decimal(18,2), shop_key string, in_stock boolean, run long"
    got = sorted((r["day"], r["dkk"]) for r in history.read(spark, target, stored).collect())
    assert got == [(day(1), 800), (day(2), 650)]


def test_text_functions(spark):
    price = {"1.299,50 DKK": 1299.5, "fra 95 kr": 95.0, "0": None, "none": None, "1\xa0000,5": 1000.5, "": None}
    got = spark.createDataFrame([(k,) for k in price], "t string").withColumn("p", text.price_of(F.col("t"))).collect()
    assert {r["t"]: r["p"] for r in got} == price
    words = {"Pokémon & Ünïcode—Æ": "pokemon and unicode", "  ": "", "Straße 1": "stra e 1"}
    got = spark.createDataFrame([(k,) for k in words], "t string").select("t", text.normalise(F.col("t")).alias("n"), text.slugify(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["n"] for r in got} == words and {r["s"] for r in got} == {"pokemon-unicode", "ukendt", "stra-e-1"}
    coded = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "&#233;&#xE9;&#39;": "éé'", "&nope;": "&nope;"}
    got = spark.createDataFrame([(k,) for k in coded], "t string").withColumn("u", text.unescape(F.col("t"))).collect()
    assert {r["t"]: r["u"] for r in got} == coded


def test_formats(spark):
    r = spark.range(1).select(money.whole(F.lit(1299.5)).alias("a"), money.exact(F.lit(1299.5), F.lit("EUR")).alias("b"), money.long_date(F.lit("2026-09-24").cast("date")).alias("c"), money.countries_text(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("d"), money.shipping_rule_text(F.lit(True), F.lit(39), F.lit(500), F.lit("DKK"), F.lit(None).cast("int")).alias("e")).first()
    assert tuple(r) == ("1.300 kr", "1.299,50 EUR", "24. september 2026", "a, b og c", "39,00 DKK til Danmark, fri fragt over 500,00 DKK")


def test_entities_equal_pythons(spark):
    import html
    import html.entities

    rng, names = random.Random(1), sorted(html.entities.html5)
    made = ["&aelig;&oslash;&aring; &uuml; &euro; &#128512; &#x1F600; &amp;lt; &amp;amp; &copy2024 &notit; &unknown; &#0; &#55296; &#150; &#x110000; &#13; &#8; &; & &#; &#x; a&b &ampx &lt3 &AMP", "", "plain & simple", "&#65534; &#99999999999;"]
    kinds = (lambda: f"&{rng.choice(names)}", lambda: f"&{rng.choice(names)}x", lambda: f"&#{rng.randrange(70_000)};", lambda: f"&#x{rng.randrange(1_200_000):x}", lambda: "&", lambda: "x")
    made += [" ".join(rng.choice(kinds)() for _ in range(6)) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in made], "t string").select("t", text.unescape(F.col("t")).alias("u")).collect()
    assert [(r["t"], r["u"]) for r in got if r["u"] != html.unescape(r["t"])] == []


def test_folding_equals_full_decomposition(spark):
    import re
    import unicodedata

    rng = random.Random(2)
    codes = [c for c in (*range(0x80, 0xD800), *range(0xE000, 0x1FFFF)) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    made = ["a" + "b".join(chr(c) for c in codes[i : i + 50]) + "c" for i in range(0, len(codes), 50)]
    made += ["".join(rng.choice(["a", "É", "\u0301", "ﬁ", "½", "Ｐ", "＆", "№", " ", "ø", "ß", "𝐁", "㎏", "日"]) for _ in range(20)) for _ in range(200)]

    def by_hand(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().replace("&", " and ")
        return re.sub("[^a-z0-9]+", " ", t).strip()

    got = spark.createDataFrame([(t,) for t in made], "t string").select("t", text.normalise(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"], by_hand(r["t"])) for r in got if r["n"] != by_hand(r["t"])] == []
