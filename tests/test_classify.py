"""Golden titles, and the guards of the join with set names."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import classify

# Titles, names of sets and the results that must come out of them.
SETS = [
    ("sv08", "Surging Sparks", "en"), ("sv08", "Rivalen am Abgrund", "de"), ("sv08.5", "Prismatic Evolutions", "en"), ("sv09", "Journey Together", "en"), ("sv10", "Destined Rivals", "en"), ("sv07", "Stellar Crown", "en"),
    ("sv06.5", "Shrouded Fable", "en"), ("sv03.5", "151", "en"), ("m3", "Nihil Zero", "en"), ("cel30", "30th Celebration", "en"), ("tf", "Terastal Festival", "en"), ("sv06", "Twilight Masquerade", "en"), ("meg", "Mega Evolution", "en"),
    ("sv4a", "Shiny Treasure ex", "en"), ("m2", "Inferno X", "en"), ("m4", "Ninja Spinner", "en"), ("m6", "Storm Emeralda", "en"), ("sv9a", "Heat Wave Arena", "en"), ("sv02", "Paldea Evolved", "en"), ("sv02", "Evoluciones en Paldea", "es"), ("me2", "Delta Reign", "en"),
]
#: title, product type and language, or None where it is to be rejected
GOLDEN = [
    ("Xerneas EX - Collection X (Secret Rare) [XY1x-063]", None), ("Disney Lorcana – Hyperia City – Prerelease Event – 16. oktober", None), ("Pokémon Mega Evolution: Pitch Black - Ultra PRO 9-Pocket Portfolio", None), ("Ampharos-EX 085/081 - Bandit Ring", None),
    ("30th Celebration Japanese Booster Box", ("booster_box", "ja")), ("Sneasel 25/111 30th Celebration: Classic Collection", None), ("Topps Match Attax UCC 2026/27 Booster Box", None), ("Pokemon Terastal Gathering Coin Box Chinesisch ZUFÄLLIG", None),
    ("Pokémon TCG | Nihil Zero (M3) | Display (KOR)", ("booster_box", "ko")), ("Booster Heat Wave Arena sv9a Coreano | Caja sellada 30 sobres Pokémon TCG", ("booster_box", "ko")), ("Caja 20 Sobres Pokémon 30th Anniversary - Chino", ("booster_box", "zh")),
    ("ETB Evoluciones de Paldea | Élite Paldea Evolved Pokémon Center - Inglés (Dañada)", None), ("Pokémon Buio Pesto Box Display 36 Buste ITA", ("booster_box", "it")), ("Pokémon 30° Anniversario – Bundle 6 Buste (IT)", ("booster_bundle", "it")),
    ("Pokémon Buio Pesto Bundle Box Display 36 Buste + Set Allenatore ITA", None), ("Pokémon 30° Anniversario – Display Completo 10 Mini Tin (IT)", None), ("[S-CHN] Pokémon Display - 30th Celebration (30thC)", ("booster_box", "zh")), ("[DE] Pokémon Top Trainer Box - 30 Jahre (MBE4)", ("etb", "de")),
    ("Pre-Order | Pokemon - Storm Emeralda Display (M6) (JP)", ("booster_box", "ja")), ("Inferno x Japansk Booster Box", ("booster_box", "ja")), ("White Flare Booster Bundle Display", None), ("Pokemon - Destined Rivals Elite Trainer Box ETB (EN) (with imperfection)", None),
    ("151 - Ultra Premium Collection", ("upc", "en")), ("Pokémon TCG: Shiny Treasure ex Booster Box - Alm. moms", ("booster_box", "en")), ("ETB Evoluciones de Paldea | Élite Paldea Evolved Pokémon Center - Inglés", ("etb_pc", "en")), ("Caja de Sobres Ninja Spinner M4 - Coreano", ("booster_box", "ko")),
    ("Pokémon TCG: Surging Sparks Elite Trainer Box", ("etb", "en")), ("Pokémon KP08 Rivalen am Abgrund Top-Trainer-Box (DE)", ("etb", "de")), ("Pokemon Prismatic Evolutions Pokemon Center Elite Trainer Box", ("etb_pc", "en")), ("Pokémon Journey Together Booster Bundle", ("booster_bundle", "en")),
    ("Pokemon Destined Rivals Booster Display 36er (Deutsch)", ("booster_box", "de")), ("Pokémon Stellar Crown Elite Trainer Box - Japansk", ("etb", "ja")), ("Pokémon Twilight Masquerade Coffret Dresseur d'Elite (FR)", ("etb", "fr")), ("Pokemon Surging Sparks Elite Trainer Box - BESKADIGET ÆSKE", None),
    ("Pokémon 151 Booster Box - TOM ÆSKE uden kort", None), ("Pokemon Prismatic Evolutions Elite Trainer Box PSA 10 Graded", None), ("Pokémon Surging Sparks Booster Box - Sealed Case of 6", None), ("Acrylic Display Case for Pokemon Elite Trainer Box", None), ("Pokémon Journey Together Elite Trainer Box 6x bundle", None),
]
#: title and the set that it is to be matched with (None: no set)
MATCHED = [
    ("Pokemon KP08 Rivalen am Abgrund Display", "sv08"), ("Pokemon Zarude Legends Untold Elite Trainer Box", None), ("Pokemon Mega Evolution: Chaos Rising Booster Box", None), ("Pokemon Mega Evolution: Perfect Order Booster Box", None), ("Pokemon Mega Evolution Booster Box", "meg"),
    ("Pokemon Violet EX Display Japanisch", None), ("[JP] Pokémon Display - Storm Emerald (M6)", "m6"), ("Pre-Order | Pokemon - Storm Emeralda Display (M6) (JP)", "m6"), ("ETB Evoluciones de Paldea | Élite Paldea Evolved Pokémon Center - Inglés", "sv02"),
    ("Pokémon TCG: Mega Evolution—Delta Reign Elite Trainer Box – English - English / Normal", "me2"), ("Pokémon TCG: Mega Evolution: Pitch Black - Booster Box", None), ("Pokemon Mega Evolution Delta Reign Booster Box", "me2"), ("Pokemon Mega Evolution Enhanced Booster Box", None),
]
REASONS = [
    ("Pokemon Shrouded Fable 60X Packs Booster Bundle", "several units"), ("Pokemon Paradox Rift Case Med 6 Booster Bokse", "case"), ("Pokemon Fusion Strike Pokemon Center Elite Trainer Box Kosmetisk Skade", "damaged"), ("Pokemon TCG - Mega Evolution Halve Booster Box", "part_unit"),
    ("Pokemon Elite Trainer Box Sleeves 65 stk", "accessory"), ("Pokemon ETB PSA 10", "graded"), ("Pokemon Booster Box b-vare", "damaged"), ("Pokemon Elite Trainer Box tom aeske", "empty"), ("Charizard 004/165 151", "single"),
]


@pytest.fixture(scope="module")
def classified(spark):
    names = spark.createDataFrame(SETS, "set_id string, name string, alias_lang string").withColumn("alias", text.normalise(F.col("name"))).withColumn("release_date", F.lit(None).cast("string"))
    titles = [t for t, _ in GOLDEN + MATCHED + REASONS] + ["POKEMON  TCG   SURGING SPARKS   ELITE TRAINER BOX", "", None]
    return {r["title"]: r for r in classify.classify(spark.createDataFrame([(t,) for t in titles], "title string"), names).collect()}


def test_golden_titles(classified):
    got = {t: (classified[t]["product_type"], classified[t]["language"]) if classified[t]["accepted"] else None for t, _ in GOLDEN}
    assert got == dict(GOLDEN)


def test_sets(classified):
    assert {t: classified[t]["set_id"] for t, _ in MATCHED} == dict(MATCHED)
    assert all(classified[t]["accepted"] for t, _ in MATCHED if "Violet EX" not in t)  # a name of two letters is none
    assert classified["Pokemon Zarude Legends Untold Elite Trainer Box"]["set_name"] == "Zarude Legends Untold"


def test_reasons(classified):
    assert all(not classified[t]["accepted"] and r in classified[t]["reason"] for t, r in REASONS)
    assert classified[""]["reason"] == "empty title" and None not in classified


def test_case_and_punctuation_do_not_matter(classified):
    a, b = classified["Pokémon TCG: Surging Sparks Elite Trainer Box"], classified["POKEMON  TCG   SURGING SPARKS   ELITE TRAINER BOX"]
    assert (a["set_id"], a["product_type"], a["language"]) == (b["set_id"], b["product_type"], b["language"])


CANDIDATES = {
    "Pokemon TCG: Cyber Judge (sv5m) - Display (JP)": "cyber judge", "Pokemon TCG | Legendary Heartbeat (S3a) | Display (KOR)": "legendary heartbeat", "Pokemon TCG | Inferno X (M2) | Display (KOR)": "inferno x", "Pokemon TCG: Fearless Terastal (CSV3C) - Slim Display (CHN)": "fearless terastal slim",
    "Pokemon TCG | Gem Pack Vol. 5 (CBB5C) | Display (CHN)": "gem pack vol 5", "Pokemon Destined Rivals Booster Box 36 pakker": "destined rivals", "Pokemon TCG: Black Bolt Display (SV11B) (KOR)": "black bolt", "Pokemon 30th Celebration Booster Box": "30th celebration", "Pokemon 151 Elite Trainer Box": "151", "": "",
}


def test_candidates(spark):
    rows = spark.createDataFrame([(t,) for t in CANDIDATES], "t string").withColumn("c", classify.candidate(text.normalise(F.col("t"))))
    assert {r["t"]: r["c"] for r in rows.collect()} == CANDIDATES


def test_types_languages_and_pre_orders(spark):
    cases = [
        ("Pokemon Surging Sparks Booster Pack", None, None, False), ("Pokemon KP08 Top-Trainer-Box", "etb", None, False), ("Pokemon Display (KOR)", "booster_box", "ko", False), ("Pokemon Display Kinesisk", "booster_box", "zh", False), ("Pokemon Display (DE)", "booster_box", "de", False),
        ("Pokemon Destined Rivals Display", "booster_box", None, False), ("Vorbestellung: Pokemon Mega Evolution Display", "booster_box", None, True), ("Preventa Caja Pokémon", None, None, True), ("Précommande Coffret Dresseur d'Elite", "etb", None, True), ("Perfect Order Elite Trainer Box", "etb", None, False),
    ]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string").withColumn("n", text.normalise(F.col("t")))
    rows = rows.select("t", classify.product_type(F.col("n")).alias("k"), classify.language(F.col("n"), F.col("t")).alias("l"), classify.pre_order(F.col("t")).alias("p"))
    assert sorted(map(tuple, rows.collect())) == sorted(cases)


def test_similarity(spark):
    def indel(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return 100.0 if not a + b else 200 * row[-1] / (len(a) + len(b))

    pairs = [("emerald", "emeralda"), ("", ""), ("a", ""), ("kitten", "sitting"), ("abc", "abc"), ("evoluciones de paldea", "evoluciones en paldea")]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("r", text.indel_ratio(F.col("a"), F.col("b")))
    for r in rows.collect():
        assert abs(r["r"] - indel(r["a"], r["b"])) < 1e-9


def test_near_words_keep_exchanged_letters(spark):
    """Every near pair by brute force, words of ten and twenty letters with two neighbours exchanged among them."""
    words = ["collection", "collectoin", "colection", "collections", "masquerade", "masqeurade", "characterisationally", "characterisatoinally", "hcaracterisatoinally", "hcaracterisationally", "sparks", "spakrs"]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b, 1):
                new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
            row = new
        return row[-1]

    want = {(a, b) for a in words for b in words if 200 * lcs(a, b) >= 90 * (len(a) + len(b))}
    assert ("collection", "collectoin") in want
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {tuple(r) for r in classify.near_words(df, df).collect()} == want


def indel(a, b):
    """Similarity of two words by their longest common subsequence."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return 200 * rows[-1][-1] / (len(a) + len(b))


def test_near_words_lose_no_pair(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(5, 24))) for _ in range(120)}
    for w in list(words):
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(v))
                kind = rng.randrange(4)
                if kind == 0:
                    v.insert(at, rng.choice("aeks"))
                elif kind == 1 and len(v) > 4:
                    del v[at]
                elif kind == 2:
                    v[at] = rng.choice("aeks")
                elif at + 1 < len(v):
                    v[at], v[at + 1] = v[at + 1], v[at]
            words.add("".join(v))
    words |= {"collection", "collectoin"}
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in classify.near_words(rows, rows).collect()}
    want = {(a, b) for a in words for b in words if a == b or (len(a) >= 6 and len(b) >= 6 and indel(a, b) >= 90)}
    assert got == want and len(want) > len(words) + 100


def test_names_match_by_their_rarest_word(spark):
    aliases = spark.createDataFrame([(a,) for a in ("common storm rising", "common storm", "common crown zenith", "common", "quiet harbour lights", "common storm emeralda")], "alias string")
    names = ["storm common", "common storm risinng", "zenith crown common", "common storms emeralda", "harbour lights", "harbour", "common nothing", "emeralda"]
    got = {r["name"]: r["alias"] for r in classify.match(spark.createDataFrame([(n,) for n in names], "name string"), aliases).collect()}
    assert got["storm common"] == "common storm" and got["zenith crown common"] == "common crown zenith" and got["harbour lights"] == "quiet harbour lights"
    assert "common nothing" not in got and "harbour" not in got and "emeralda" not in got


def test_a_higher_score_without_the_conditions_leaves_a_name_without_set(spark):
    aliases = spark.createDataFrame([("mega evolution",), ("mega evolution perfect orderings",), ("quiet harbour orderings",)], "alias string")
    names = spark.createDataFrame([("mega evolution perfect ordering",), ("quiet harbour ordering",)], "name string")
    assert {r["name"]: r["alias"] for r in classify.match(names, aliases).collect()} == {"quiet harbour ordering": "quiet harbour orderings"}
