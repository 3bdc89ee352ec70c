"""Cleaning of names, addresses and countries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expansions, characters stripped at the edges of a word, punctuation, white space.
NAME_WORDS = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company"}
ADDRESS_WORDS = {
    "rd": "road",
    "st": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "hwy": "highway",
    "ln": "lane",
    "dr": "drive",
    "apt": "apartment",
    "ste": "suite",
    "fl": "floor",
}
NAME_EDGES, ADDRESS_EDGES = ".,;:'\"-", ".,;:'\"-/#"
PUNCTUATION = r"""[.,;:!?'"/\\#$%^*()\[\]{}<>=+\-_~|`@•·°©®™\x{2000}-\x{206F}\x{2E00}-\x{2E7F}\x{FEFF}]"""
WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _clean(text: Column, words: dict[str, str], edges: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    tokens = F.filter(F.split(lowered, WHITE), lambda t: t != "")
    spelled = F.transform(tokens, lambda t: F.coalesce(F.element_at(table, F.btrim(t, F.lit(edges))), t))
    bare = F.regexp_replace(F.array_join(spelled, " "), PUNCTUATION, " ")
    return F.btrim(F.regexp_replace(bare, WHITE, " "))


def normalize_name(text: Column) -> Column:
    """Lower case, 'and' for '&', legal forms spelled out, punctuation to spaces. Null gives ''. A word is only spelled out
    if it is known once its edges are stripped; 'pvt.ltd' stays two short words, so a second pass can change more."""
    return _clean(text, NAME_WORDS, NAME_EDGES)


def normalize_address(text: Column) -> Column:
    """As for names, with street words."""
    return _clean(text, ADDRESS_WORDS, ADDRESS_EDGES)


def normalize_country(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WHITE}|{WHITE}$", ""))


def tokens(text: Column) -> Column:
    """Words of a cleaned text; [] for ''."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda t: t != "")


def number_tokens(text: Column) -> Column:
    """Runs of two or more digits that stand alone, in order, repeated ones kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\d{2,}\b"), 0)


def ngrams(text: Column, n: int) -> Column:
    """All windows of n characters in order; [] for shorter texts."""
    text = F.coalesce(text, F.lit(""))
    spans = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.transform(spans, lambda i: F.substring(text, i, F.lit(n))))


def ngram_set(text: Column, n: int) -> Column:
    return F.array_distinct(ngrams(text, n))


def entity_text(name: Column, address: Column, country: Column) -> Column:
    """One line for an embedding."""
    part = [F.btrim(F.coalesce(c, F.lit(""))) for c in (name, address, country)]
    return F.concat(F.lit("Business: "), part[0], F.lit(" | Address: "), part[1], F.lit(" | Country: "), part[2])
