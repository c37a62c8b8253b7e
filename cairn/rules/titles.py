"""Word lists and patterns for titles of sealed card products, as data.

All lists are fixed values: results depend on each entry. ``Rules`` gathers them, so that
another catalogue can bring its own.
"""

from __future__ import annotations

from dataclasses import dataclass

# Names of other games, searched as substrings.
OTHER_GAMES = (
    "lorcana", "magic the gathering", "mtg", "yu gi oh", "yugioh", "yu gi",
    "one piece", "digimon", "dragon ball", "flesh and blood", "naruto",
    "star wars unlimited", "weiss schwarz", "vanguard", "metazoo",
    "match attax", "topps", "panini", "fifa", "uefa", "union arena",
    "gundam", "riftbound", "league of legends", "sorcery", "altered",
    "battle spirits", "duel masters", "grand archive", "shadowverse",
    "disney", "marvel", "garbage pail", "hot wheels", "wow tcg", "keyforge",
)

# A title that says one of these is of the brand.
BRAND = ("pokemon", "pokmon", "pocket monsters")

# Whole words by reason of rejection, in the order of the tests.
REJECT = (
    ("accessory", (
        "sleeve", "sleeves", "hylster", "hylstre", "hulle", "hullen", "huelle", "kartenhulle", "toploader", "top loader", "card saver", "perfect fit",
        "penny sleeve", "protector", "beskyttelse", "schutzhulle", "skyddsfickor",
        "binder", "ringordner", "sammelalbum", "portfolio", "mappe", "parm", "album", "ordner", "verzamelmap", "opbergmap", "samlemappe", "flip file",
        "storage box", "opbevaringsboks", "aufbewahrungsbox", "card box",
        "playmat", "play mat", "spillemate", "spielmatte", "speelmat", "spelmatta", "deck box", "deckbox", "dice", "wurfel", "tarning", "terning", "munt",
        "coin box", "counter", "damage counter", "sleeve pack",
        "acryl", "acrylic", "akryl", "plexiglas", "display case", "display stand", "displaycase", "stativ", "halter", "houder", "case for", "holder for",
        "magnetic holder", "magnetholder", "one touch", "screwdown",
        "plush", "bamse", "plusch", "knuffel", "figur", "figure", "funko", "keychain", "nogleringe", "schlusselanhanger", "t shirt", "tshirt",
        "mug", "krus", "tasse", "poster", "plakat", "puslespil", "puzzle", "sticker", "klistermaerker", "backpack", "rygsaek", "lunch box",
        "gift box", "giftbox", "geschenkbox", "geschenkset", "gaveaeske", "cadeaubox",
    )),
    ("graded", ("psa", "psa10", "psa 10", "bgs", "cgc", "ace 10", "graded", "gradet", "slab", "slabbed", "beckett", "sgc")),
    ("case", (
        "master case", "sealed case", "case of", "umkarton", "karton mit", "6er case", "12er case", "full case", "hel kasse", "hele kasse",
        "bundle of 6", "sampak", "multipack", "multi pack", "lot of", "booster box case", "booster case", "box case", "display case of",
        "case", "kasse", "karton", "carton", "bundle collezioni", "bundle mazzi", "display completo",
    )),
    ("empty", (
        "empty", "tom", "tomt", "tom box", "tom aeske", "leer", "leere", "leerbox", "lege doos", "no cards", "uden kort", "ohne karten", "zonder kaarten",
        "only box", "kun aesken", "box only", "nur box",
    )),
    ("damaged", (
        "damaged", "beskadiget", "beschadigt", "beschaedigt", "dented", "bulk damaged", "b vare", "b ware", "2 wahl", "zweite wahl", "skadad", "skadet", "dinge",
        "creased", "reduced box", "nedsat aeske", "beschadigde", "poor condition", "kosmetisk skade", "kosmetiske skader", "cosmetic damage", "cosmetically damaged",
        "kosmetischer schaden", "kosmetische schade", "let skade", "minor damage", "damage", "schade", "beschadiging", "met schade", "deuk", "deukje",
        "imperfect", "imperfection", "imperfections", "imperfecte", "kleine damage", "danada", "danado", "caja danada", "defectuosa", "defectuoso", "golpeada",
        "danneggiato", "danneggiata", "ammaccato", "ammaccata", "rovinata", "abime", "abimee", "endommage", "endommagee",
    )),
    ("part_unit", (
        "halve booster box", "half booster box", "halve box", "half box", "halbes display", "halbe display", "halv booster box", "halv display",
        "halve display", "half display", "18er display", "quarter display", "split display", "loose pack", "single pack", "losse booster",
    )),
    ("other_form", ("mini tin", "mini tins", "tin", "tins", "blister", "checklane", "promo pack", "sleeved booster", "blind box")),
)

# Whole words by product type; the first type is the most specific.
TYPES = (
    ("upc", (
        "ultra premium collection", "ultra premium kollektion", "ultra premium collectie", "ultra premium samling", "ultra premium collection box",
        "ultra premium", "upc", "coleccion ultra premium", "collezione ultra premium", "collection ultra premium", "coffret ultra premium",
    )),
    ("booster_bundle", (
        "booster bundle", "boosterbundle", "booster bundel", "boosterbundel", "bundle pack", "booster bundt", "bundle 6 buste", "bundle di 6 buste",
        "bundle di buste", "bundle 6 sobres", "bundle de sobres", "bundle da 6 buste",
    )),
    ("etb", (
        "elite trainer box", "elitetrainerbox", "elite trainerbox", "top trainer box", "top trainer boxen", "toptrainerbox", "trainer box", "trainerbox",
        "etb", "ttb", "elite trainer", "top trainer", "coffret dresseur d elite", "dresseur d elite", "caja de entrenador elite", "entrenador elite",
        "set allenatore fuoriclasse", "allenatore fuoriclasse", "set allenatore",
    )),
    ("booster_box", (
        "booster box", "boosterbox", "booster display", "boosterdisplay", "display box", "displaybox", "36er display", "30er display", "display",
        "boosterbrick", "booster brick", "caja sellada", "caja de sobres", "caja sobres", "box di espansione", "box espansione",
    )),
)
BOX_TYPE, ELITE_TYPE, CENTER_TYPE = "booster_box", "etb", "etb_pc"
# A box of the elite type with one of these is one of the centre.
CENTER_WORDS = ("pokemon center", "pokemoncenter", "pokemon center etb", "pc etb")
# A box word and a full count of packs, in either order.
PACK_BOX = r"(?<![a-z0-9])(?:caja|box|display)(?![a-z0-9])"
PACK_COUNT = r"(?<![0-9])(?:20|24|30|36)\s+(?:sobres|buste|bustine)(?![a-z0-9])"

# Whole words by language, in the order of the tests.
LANGUAGES = (
    ("ja", ("japansk", "japanese", "japans", "japanisch", "japanska", "japonais", "japanse", "japones", "giapponese", "jpn", "jap", "jp")),
    ("ko", ("korean", "koreansk", "koreanisch", "koreaans", "koreanska", "coreano", "coreen", "kor")),
    ("zh", ("chinese", "kinesisk", "chinesisch", "chinees", "kinesiska", "chino", "cinese", "chinois", "simplified chinese", "traditional chinese", "s chn", "t chn", "chn", "cn", "zh")),
    ("de", ("deutsch", "german", "tysk", "duits", "allemand", "tyska", "aleman", "tedesco", "ger")),
    ("fr", ("french", "francais", "franzosisch", "fransk", "frans", "frances", "francese", "fra")),
    ("es", ("spanish", "spansk", "spanisch", "spaans", "espanol", "espagnol", "spagnolo", "castellano")),
    ("it", ("italian", "italiensk", "italienisch", "italiaans", "italiano", "italien", "ita")),
    ("en", ("english", "engelsk", "englisch", "engels", "engelska", "ingles", "inglese", "anglais", "eng")),
)
# Codes that a tag or a last word may give, and languages that an alias may give.
CODES = ("de", "fr", "es", "it", "en")
ALIAS_LANGUAGES = ("de", "fr", "es", "it")

# Words that are no part of a set's name.
NOISE = (
    "pokemon", "pokmon", "tcg", "trading", "card", "game", "sammelkartenspiel", "kortspil", "kaartspel", "kortspel", "booster", "box", "boxes", "bundle", "bundles", "display", "displays", "elite", "trainer",
    "top", "toptrainer", "trainerbox", "etb", "ttb", "upc", "ultra", "premium", "collection", "kollektion", "collectie", "samling", "new", "nyhed", "neu", "nieuw", "ny", "sealed", "forseglet", "versiegelt",
    "verzegeld", "forseglad", "preorder", "forudbestilling", "vorbestellung", "reservering", "release", "udgivelse", "the", "of", "and", "a", "an",
    "en", "eng", "english", "engelsk", "englisch", "engels", "engelska", "de", "ger", "deutsch", "german", "tysk", "duits", "tyska", "jp", "jpn", "jap", "japansk", "japanese", "japans", "japanisch", "japanska",
    "kor", "korean", "koreansk", "koreanisch", "koreaans", "cn", "chn", "chinese", "kinesisk", "chinesisch", "chinees", "fr", "fra", "french", "francais", "franzosisch", "fransk", "frans",
    "scarlet", "violet", "karmesin", "purpur", "ecarlate", "base", "basis", "center", "centre", "pakker", "pakke", "stk", "stuck", "stuecke", "editie", "edition", "ausgabe", "udgave", "engelse", "boosters", "brick",
    "6er", "10er", "12er", "20er", "24er", "30er", "36er", "limit", "kunde", "kunden", "max", "maks", "pr", "alm", "moms", "brugtmoms", "normal", "sets", "sellada", "sobres", "sobre", "caja", "cajas", "buste", "bustine",
    "busta", "completo", "coffret", "dresseur", "entrenador", "allenatore", "fuoriclasse", "coleccion", "collezione", "japones", "coreano", "chino", "simplificado", "simplified", "tradicional", "traditional",
    "ingles", "inglese", "espanol", "italiano", "ita", "frances", "francese", "giapponese", "cinese", "spagnolo", "anglais", "chinois", "coreen", "del", "la", "el", "con", "da", "di", "le", "et", "d", "l", "it", "es",
    "sword", "shield", "schwert", "schild", "zwaard", "svard", "skold",
)

# Patterns of what goes from a title before its words: set codes that shops add to a name, pre-order words, tags of a script.
SET_CODES = r"c?s(?:v|wsh|m)?\d{1,2}[a-z]?c?|c?bb?\d{1,2}c?|kp\d{1,2}|m\d{1,2}[a-z]?|mbe?\d{1,2}|\d{2,3}thc|ev\d{1,2}|xy\d{1,2}|bw\d{1,2}|\d{2,3}c"
PRE_WORD = r"pre\s?order"
SCRIPT_TAG = r"[st]\s+(?:chn|chinese|chinesisch|chino)"
# Words before or after which a number belongs to the name.
ORDINAL_LEAD = ("vol", "volume", "nr", "no", "part", "serie", "series", "gen")
ORDINAL_TRAIL = ("jahre", "anniversario", "aniversario", "anniversary", "anniversaire")
# Names of series that may stand before a set's name.
SERIES = (
    "heartgold soulsilver", "diamond and pearl", "diamond pearl", "black and white", "black white", "sun and moon", "sun moon", "sword and shield", "sword shield",
    "scarlet and violet", "scarlet violet", "mega evolution", "platinum", "xy",
)

# Pre-order words in eight languages, for lower-cased titles.
PRE_ORDER = r"(?U)(?<![a-z])(?:pre[\s-]?orders?|forudbestil\w*|vorbestell\w*|vorverkauf|voorverkoop|pre[\s-]?venta|preordine|pr[eé][\s-]?commande|f[öo]rhandsbok\w*|f[öo]rbest[äa]ll\w*)(?![a-z])"


@dataclass(frozen=True)
class Rules:
    other_games: tuple[str, ...] = OTHER_GAMES
    brand: tuple[str, ...] = BRAND
    reject: tuple[tuple[str, tuple[str, ...]], ...] = REJECT
    types: tuple[tuple[str, tuple[str, ...]], ...] = TYPES
    center_words: tuple[str, ...] = CENTER_WORDS
    languages: tuple[tuple[str, tuple[str, ...]], ...] = LANGUAGES
    noise: tuple[str, ...] = NOISE
    series: tuple[str, ...] = SERIES
