"""Column functions on text: folding, slugs, whole-word matching, prices, entities and addresses."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without_marks(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _ranges(codes: Iterable[int]) -> str:
    """A character class of Java's patterns."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def _foldings() -> tuple[dict[str, str], dict[str, str], str]:
    """Characters outside ASCII that decompose into one with ASCII, those that decompose into several, and the class of all marks."""
    one, several, marks = {}, {}, []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        char = chr(code)
        kept = _without_marks(char)
        if not kept:
            marks.append(code)
        if kept != char and any(c.isascii() for c in kept):
            (one if len(kept) == 1 else several)[char] = kept
    return one, several, _ranges(marks)


ONE, SEVERAL, MARKS = _foldings()


def _replaced(text: Column, pattern: str, value) -> Column:
    """The text with ``value`` of each match of pattern in its place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = lambda kinds, rest: F.zip_with(rest, F.concat(F.transform(kinds, value), F.array(F.lit(""))), lambda gap, char: F.concat(gap, F.coalesce(char, F.lit(""))))
    joined = F.element_at(F.transform(F.array(F.struct(found.alias("e"), F.split(text, pattern, -1).alias("t"))), lambda x: F.array_join(pairs(x["e"], x["t"]), "")), 1)
    return F.when(text.rlike(pattern), joined).otherwise(text)


def fold(text: Column) -> Column:
    """Lower case without accents: compatibility decomposition of all characters that have ASCII in theirs, ligatures, fractions and full width among them.

    Letters that don't decompose (ß, æ, ø) stay as they are.
    """
    table = F.from_json(F.lit(json.dumps(SEVERAL)), "map<string,string>")
    several = _replaced(text, _ranges(map(ord, SEVERAL)), lambda c: table[c])
    folded = F.lower(F.regexp_replace(F.translate(several, "".join(ONE), "".join(ONE.values())), MARKS, ""))
    # marks and most decompositions lie beyond Latin-1: texts without such characters take the short way
    latin = {c: x for c, x in ONE.items() if c < "\u0100"}
    short = F.lower(F.translate(text, "".join(latin), "".join(latin.values())))
    fractions = "".join(c for c in SEVERAL if c < "\u0100")
    return F.when(text.rlike(rf"[\x{{100}}-\x{{10ffff}}{fractions}]"), folded).otherwise(short)


def normalise(text: Column) -> Column:
    """Folded words of a-z and 0-9 with one blank between; & reads and."""
    return F.trim(F.regexp_replace(F.replace(fold(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def slugify(text: Column, empty: str = "ukendt") -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(empty)).otherwise(slug)


def alternatives(terms: Iterable[str]) -> str:
    """Quoted terms, the longest first."""
    return "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))


def word_pattern(terms: Iterable[str]) -> str:
    """Any of the terms as whole words of a normalised text; the longest wins."""
    return rf"(?<![a-z0-9])(?:{alternatives(terms)})(?![a-z0-9])"


def has_word(norm: Column, terms: Iterable[str]) -> Column:
    return norm.rlike(word_pattern(terms))


def hit(norm: Column, terms: Iterable[str]) -> Column:
    """The first term that stands as whole words, or the empty string."""
    return F.regexp_extract(norm, word_pattern(terms), 0)


def spotted(norm: Column, terms: Iterable[str]) -> Column:
    """All of the terms that stand as whole words of a normalised text, in order of place, of those at one place the longest first.

    The text's words pass once, however many dictionaries the terms come from: runs of words are looked up as a set.
    """
    known = sorted(set(terms))
    longest, words = max(t.count(" ") for t in known) + 1, F.split(norm, " ")
    runs = lambda ws: F.flatten(F.transform(ws, lambda w, i: F.concat(F.transform(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda n: F.array_join(F.slice(ws, i + 1, n), " ")), F.array(w))))
    looked_up = words if longest == 1 else F.element_at(F.transform(F.array(words), runs), 1)
    return F.array_intersect(looked_up, F.array(*map(F.lit, known)))


def any_of(found: Column, terms: Iterable[str]) -> Column:
    """Whether one of the terms is among ``spotted``'s."""
    return F.arrays_overlap(found, F.array(*map(F.lit, terms)))


def first_of(found: Column, terms: Iterable[str]) -> Column:
    """The first of the terms among ``spotted``'s; null if there is none."""
    return F.get(F.array_intersect(found, F.array(*map(F.lit, terms))), F.lit(0))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_part(norm: Column, terms: Iterable[str]) -> Column:
    """Whether any of the terms is a substring."""
    return norm.rlike(alternatives(terms))


def price_of(text: Column) -> Column:
    """The first number of a text with dots or blanks between thousands and a decimal comma: 1.299,50 is 1299.50; null unless positive."""
    found = F.regexp_extract(F.replace(text, F.lit("\xa0"), F.lit(" ")), r"(\d[\d.\s]*(?:,\d{1,2})?)", 1)
    number = F.translate(F.regexp_replace(found, r"[\s.]", ""), ",", ".").try_cast("double")
    return F.when(number > 0, number)


#: What numeric entities 128 to 159 mean: the bytes of Windows-1252, or themselves where it has none.
WINDOWS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
#: An entity: a number, or a name; without a semicolon only the names that HTML knows so.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: The same, with a semicolon always.
CLOSED_ENTITY = ENTITY.replace(";?", ";")


def _entity_table() -> dict[str, str]:
    """What each named entity stands for, by Python's own table of HTML."""
    return {f"&{name}": char for name, char in html5.items()}


def unescape(text: Column, closed: bool = False) -> Column:
    """Decodes HTML entities, each once: all names of HTML, and numbers of any code point.

    Only a text's own distinct entities are looked up, in one constant map. A number of no character gives
    the replacement character, and 128 to 159 what they mean in Windows-1252. A name without its semicolon is decoded where HTML
    knows it so; an unknown name stays, but for the longest known beginning of it without a semicolon. ``closed`` decodes
    entities with their semicolon alone: what a cut text ends in (``&amp``) stays as it is.
    """
    table = F.from_json(F.lit(json.dumps(_entity_table())), "map<string,string>")

    def named(e: Column) -> Column:
        if closed:
            return F.coalesce(table[e], e)
        # names without a semicolon have two letters at least: the longest beginning that is one
        sizes = F.sequence(F.length(e) - 1, F.lit(3), F.lit(-1))
        known = F.filter(F.transform(sizes, lambda n: F.substring(e, F.lit(1), n)), lambda x: table[x].isNotNull())
        first = F.get(known, F.lit(0))
        shorter = F.when(F.length(e) > 3, F.when(first.isNotNull(), F.concat(table[first], F.substring(e, F.length(first) + 1, F.length(e)))))
        return F.coalesce(table[e], shorter, e)

    def numbered(e: Column) -> Column:
        digits = F.regexp_extract(e, r"&#[xX]?0*([0-9a-fA-F]*)", 1)
        code = F.when(F.length(digits) > 8, F.lit(1 << 32).cast("long")).otherwise(F.coalesce(F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0).cast("long")))
        windows = F.element_at(F.array(*(F.lit(WINDOWS[i]) for i in range(32))), (code - 127).cast("int"))
        big = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        dropped = ((code < 32) & ~code.isin(9, 10, 12, 13) & (code > 0)) | (code == 127) | ((code >= 0xFDD0) & (code <= 0xFDEF)) | (code % 65536 >= 65534) | (code == 11)
        return (
            F.when((code == 0) | (code > 0x10FFFF) | ((code >= 0xD800) & (code < 0xE000)), "\ufffd").when((code >= 128) & (code < 160), windows).when(code == 13, "\r").when(dropped, "").otherwise(big)
        )

    return _replaced(text, CLOSED_ENTITY if closed else ENTITY, lambda e: F.when(e.startswith("&#"), numbered(e)).otherwise(named(e)))


def strip_tags(html: Column) -> Column:
    """Text of an HTML fragment: tags become blanks, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def absolute(href: Column, page: Column) -> Column:
    """A link resolved against its page's address."""
    scheme, host = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    path = F.regexp_replace(F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    folder = F.when(path == "", "/").otherwise(path)
    whole = F.regexp_replace(page, "#.*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("#"), F.concat(whole, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(whole, r"\?.*$", ""), href))
        .otherwise(F.concat(host, folder, href))
    )


#: Letters that one 64-bit word of ``common_letters`` stands for; one more stays free for the carry.
BITS = 60


def common_letters(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, bit by bit of 64-bit words.

    The state has a bit for each letter of a, 60 in a word. A letter of b takes one addition and a few logical operations
    for each word: places of the letter in a, looked up in a map, are added to the state, and the sum carries
    over runs of places; bits that end up 0 are letters in common.
    """
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    zero, top = F.lit(0).cast("bigint"), F.lit(1 << BITS).cast("bigint")
    ones = F.lit((1 << BITS) - 1).cast("bigint")
    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    words = lambda t: F.sequence(F.lit(0), F.floor((F.length(t) - 1) / BITS).cast("int"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % BITS).cast("int"))
    places = lambda xs, c, w: F.aggregate(F.slice(xs, w * BITS + 1, BITS), F.struct(zero.alias("m"), F.lit(0).alias("i")), lambda s, x: F.struct(F.when(x == c, s["m"].bitwiseOR(bit(s["i"]))).otherwise(s["m"]).alias("m"), (s["i"] + 1).alias("i")), lambda s: s["m"])
    masks = lambda xs: F.map_from_entries(F.transform(F.array_distinct(xs), lambda c: F.struct(c.alias("c"), F.transform(words(a), lambda w: places(xs, c, w)).alias("m"))))

    def step(state: Column, at: Column) -> Column:
        """One letter of b: at has its places in a by word, or null."""

        def word(acc: Column, v: Column) -> Column:
            hit = F.get(at, acc["w"])
            total = v + v.bitwiseAND(hit) + acc["carry"]
            after = F.when(total >= top, total - top).otherwise(total).bitwiseOR(v.bitwiseAND(F.bitwise_not(hit)))
            return F.struct(F.concat(acc["out"], F.array(after)).alias("out"), F.when(total >= top, F.lit(1).cast("bigint")).otherwise(zero).alias("carry"), (acc["w"] + 1).alias("w"))

        begin = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("carry"), F.lit(0).alias("w"))
        return F.when(at.isNull(), state).otherwise(F.aggregate(state, begin, word, lambda s: s["out"]))

    def run(m: Column) -> Column:
        found = F.aggregate(F.transform(letters(b), lambda c: m[c]), F.transform(words(a), lambda _: ones), step)
        return F.aggregate(found, F.lit(0), lambda n, v: n + BITS - F.bit_count(v))

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(let(letters(a), lambda xs: let(masks(xs), run)))


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity 0 to 100 of two strings: twice their longest common subsequence over the sum of lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common_letters(a, b) / total)
