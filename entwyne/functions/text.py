"""Text functions as column expressions.

What Spark has no function for is expressed by tables built from Unicode's own rules: accents by ``translate`` (of long
texts by Arrow's normalisation), Brahmic scripts by a walk over code points with the offset within the script's block.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne.functions.vocabulary import NULL_WORDS, ORDINAL_SUFFIXES, ORDINAL_WORDS, TOP_LEVEL_DOMAINS, Vocabulary

_TLD = r"(?i)\.(" + "|".join(TOP_LEVEL_DOMAINS) + r")\b"

# Latin readings of a Brahmic block's offsets, nine blocks of 0x80 code points from U+0900 on.
_FIRST_BLOCK, _LAST_BLOCK = 0x0900, 0x0D7F
_READINGS = {
    0x01: "n", 0x02: "n", 0x03: "h",
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh",
    0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r",
    0x31: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au",
    0x66: "0", 0x67: "1", 0x68: "2", 0x69: "3", 0x6A: "4", 0x6B: "5", 0x6C: "6", 0x6D: "7", 0x6E: "8", 0x6F: "9",
}
_CONSONANTS, _VOWEL_SIGNS, _NUKTA = (0x15, 0x39), (0x3E, 0x4D), 0x3C


@cache
def _accents() -> tuple[str, str, str]:
    """Characters that lose marks and what is left of them; the marks themselves as a class for a pattern."""
    source, target, marks = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if unicodedata.combining(c):
            marks.append(cp)
        elif unicodedata.normalize("NFD", c) != c:
            left = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)))
            if left != c and len(left) == 1:
                source.append(c)
                target.append(left)
    ranges, start = [], None
    for a, b in zip(marks, [*marks[1:], -1], strict=True):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"\\x{{{start:X}}}-\\x{{{a:X}}}")
            start = None
    return "".join(source), "".join(target), "[" + "".join(ranges) + "]"


def strip_accents(text: Column) -> Column:
    """Without combining marks; characters composed with marks become their base."""
    source, target, marks = _accents()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, source, target), marks, "")).otherwise(text)


def strip_accents_of_texts(text: Column) -> Column:
    """The same for long texts: Arrow's normalisation of a whole batch, composed again. Not for use inside a lambda."""
    marks = _accents()[2]

    def run(col: pa.Array) -> pa.Array:
        return pc.utf8_normalize(pc.replace_substring_regex(pc.utf8_normalize(col, "NFD"), pattern=marks, replacement=""), "NFC")

    return F.arrow_udf(run, T.StringType())(text)


def decompose(text: Column) -> Column:
    """Compatibility decomposition without the marks of U+0300 to U+036F: ligatures and widths are resolved, too."""

    def run(col: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(pc.utf8_normalize(col, "NFKD"), pattern=r"[\x{300}-\x{36F}]", replacement="")

    return F.arrow_udf(run, T.StringType())(text)


def has_indic(text: Column) -> Column:
    return text.rlike(r"[\x{0900}-\x{0D7F}]")


def romanise(text: Column) -> Column:
    """Brahmic letters in Latin. A consonant carries an a unless a vowel sign, virama or nukta of its block follows."""
    readings = F.array(*[F.lit(_READINGS.get(off, "")) for off in range(0x80)])

    def read(chars: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            cp, after = F.ascii(c), F.ascii(F.coalesce(F.get(chars, i + 1), F.lit("")))
            off, next_off = cp % 0x80, after % 0x80
            killed = (F.floor(cp / 0x80) == F.floor(after / 0x80)) & (next_off.between(*_VOWEL_SIGNS) | (next_off == _NUKTA))
            vowel = F.when(off.between(*_CONSONANTS) & ~killed, F.lit("a")).otherwise(F.lit(""))
            return F.when(cp.between(_FIRST_BLOCK, _LAST_BLOCK), F.concat(F.get(readings, off), vowel)).otherwise(c)

        return F.array_join(F.transform(chars, one), "")

    chars = F.array(F.split(text, ""))
    return F.when(has_indic(text), F.get(F.transform(chars, read), F.lit(0))).otherwise(text)


def skeleton(text: Column) -> Column:
    """Consonants only."""
    return F.regexp_replace(text, "[aeiou]+", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def country(text: Column) -> Column:
    """An open set of names, folded; empty stays empty."""
    return squeeze(F.lower(strip_accents(F.coalesce(text, F.lit("")))))


def basic(text: Column) -> Column:
    """Latin letters and digits in lower case, one space between tokens."""
    latin = F.lower(strip_accents(romanise(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(F.replace(latin, F.lit("&"), F.lit(" and ")), "[^0-9a-z]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def _replaced(toks: Column, table: dict[str, str]) -> Column:
    if not table:
        return toks
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(known, t), t))


def without(toks: Column, words) -> Column:
    """Distinct tokens that are none of these words, in order; if none is left, all tokens as they were."""
    kept = F.array_except(toks, F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    return F.when(F.size(kept) > 0, kept).otherwise(toks)


def is_domain(name: Column) -> Column:
    return name.rlike(_TLD) & ~F.contains(F.trim(name), F.lit(" "))


def name_tokens(name: Column, vocabulary: Vocabulary) -> Column:
    raw = F.coalesce(name, F.lit(""))
    raw = F.when(is_domain(raw), F.regexp_replace(raw, _TLD, " ")).otherwise(raw)
    return _replaced(tokens(basic(raw)), vocabulary.name_alias)


def address_tokens(address: Column, vocabulary: Vocabulary) -> Column:
    """Null words go, 23404b becomes two tokens, 2nd and second become 2, aliases are resolved."""
    named = F.filter(tokens(basic(address)), lambda t: ~t.isin(*NULL_WORDS))
    suffixes = "|".join(ORDINAL_SUFFIXES)
    apart = F.transform(named, lambda t: F.regexp_replace(t, rf"^(\d+)(?!(?:{suffixes})$)([a-z]{{1,2}})$", "$1 $2"))
    plain = F.transform(F.flatten(F.transform(apart, lambda t: F.split(t, " "))), lambda t: F.regexp_replace(t, rf"^(\d+)(?:{suffixes})$", "$1"))
    return _replaced(_replaced(plain, ORDINAL_WORDS), vocabulary.address_alias)


def derive_views(full: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The views that depend on noise words, from nm_full, ad_full and ad_num: a projection, cheap to repeat."""
    digits = F.filter(F.transform(tokens(F.col("ad_num")), lambda t: F.regexp_replace(t, "^0+", "")), lambda t: t != "")
    return (
        full.withColumn("_nt", without(tokens(F.col("nm_full")), vocabulary.name_noise))
        .withColumn("_at", without(tokens(F.col("ad_full")), vocabulary.address_noise))
        .withColumn("nm_core", F.array_join("_nt", " "))
        .withColumn("nm_compact", F.array_join("_nt", ""))
        .withColumn("nm_skel", skeleton(F.col("nm_compact")))
        .withColumn("ad_core", F.array_join("_at", " "))
        .withColumn("ad_alpha", F.array_join(F.filter("_at", lambda t: ~t.rlike(r"\d")), " "))
        .withColumn("ad_num", F.array_join(F.array_distinct(digits), " "))
        .drop("_nt", "_at")
    )


def normalise(records: DataFrame, vocabulary: Vocabulary | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records to their comparison views; the columns ``keep`` stay beside them."""
    vocabulary = vocabulary or Vocabulary()
    address = address_tokens(F.col("business_address"), vocabulary)
    full = records.select(
        "entity_id",
        F.array_join(name_tokens(F.col("business_name"), vocabulary), " ").alias("nm_full"),
        F.array_join(address, " ").alias("ad_full"),
        F.array_join(F.filter(address, lambda t: t.rlike(r"^\d+$")), " ").alias("ad_num"),
        country(F.col("country")).alias("ctry"),
        *keep,
    )
    views = derive_views(full, vocabulary)
    return views.select("entity_id", "nm_full", "nm_core", "nm_compact", "nm_skel", "ad_full", "ad_core", "ad_num", "ad_alpha", "ctry", *keep)


def name_view(name: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Struct of a name's views: full, core, compact, sorted_key and whether it was a domain. Repeated core tokens stay."""
    vocabulary = vocabulary or Vocabulary()
    toks = name_tokens(name, vocabulary)
    noise = F.array(*[F.lit(w) for w in vocabulary.name_noise]).cast("array<string>")
    kept = F.filter(toks, lambda t: ~F.array_contains(noise, t))
    core = F.when(F.size(kept) > 0, kept).otherwise(toks)
    return F.struct(
        F.array_join(toks, " ").alias("full"), F.array_join(core, " ").alias("core"), F.array_join(core, "").alias("compact"),
        F.array_join(F.array_sort(F.array_distinct(core)), " ").alias("sorted_key"), is_domain(F.coalesce(name, F.lit(""))).alias("was_domain"),
    )


def address_view(address: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Struct of an address's views: full, core, numbers, alpha tokens, emptiness."""
    vocabulary = vocabulary or Vocabulary()
    toks = address_tokens(address, vocabulary)
    noise = F.array(*[F.lit(w) for w in vocabulary.address_noise]).cast("array<string>")
    core = F.filter(toks, lambda t: ~F.array_contains(noise, t))
    return F.struct(
        F.array_join(toks, " ").alias("full"), F.array_join(core, " ").alias("core"), F.filter(toks, lambda t: t.rlike(r"^\d+$")).alias("numbers"),
        F.filter(core, lambda t: ~t.rlike(r"\d")).alias("alpha_tokens"), (F.size(toks) == 0).alias("is_empty"),
    )


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of the text without spaces; a shorter text is one gram, an empty one has none."""
    s = F.replace(text, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def is_abbreviation(a: Column, b: Column) -> Column:
    """One is a beginning of the other or, up to five letters, a subsequence of it."""
    a_first = F.length(a) <= F.length(b)
    short, long = F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)
    letters = F.concat(F.lit("^.*"), F.array_join(F.filter(F.split(short, ""), lambda c: c != ""), ".*"), F.lit(".*$"))
    return (F.length(short) >= 2) & (short != long) & (long.startswith(short) | ((F.length(short) <= 5) & F.call_function("rlike", long, letters)))


def id_set(value: Column) -> Column:
    """Distinct, trimmed, non-blank ids of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))


def f_beta(precision: Column, recall: Column, beta2: float = 0.25) -> Column:
    below = F.lit(beta2) * precision + recall
    return F.when(below > 0, (1 + beta2) * precision * recall / below).otherwise(F.lit(0.0))
