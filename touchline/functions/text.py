"""Names, tokens and page text."""
from __future__ import annotations

import sys
import unicodedata

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters with combining marks -> base letter, built from Unicode decomposition."""
    src, dst = [], []
    for code in range(0xC0, 0x1F00):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            src.append(ch)
            dst.append(base[0])
    return "".join(src), "".join(dst)


_SRC, _DST = _accent_table()
_MARKS = "[\\u0300-\\u036f]"
assert sys.maxunicode > 0xFFFF


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _SRC, _DST), _MARKS, "")


def normalize_name(text: Column, keep: str = "a-z ") -> Column:
    """Lower case, no accents, only ``keep`` characters, single spaces."""
    flat = F.regexp_replace(F.lower(strip_accents(text)), f"[^{keep}]", "")
    return F.trim(F.regexp_replace(flat, " +", " "))


def tokens(name: Column) -> Column:
    """Distinct tokens of a normalised name."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))


def last_token(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def first_token(name: Column) -> Column:
    return F.element_at(F.split(name, " "), 1)


# Name particles that never identify a taker.
PARTICLES = ["al", "de", "van", "el", "bin", "abu", "le", "la", "di", "da", "du", "den", "der", "dos", "das"]


def taker_tokens(name: Column, min_length: int = 4) -> Column:
    """Tokens of at least ``min_length`` letters that are not particles."""
    flat = F.translate(F.lower(strip_accents(name)), "-.", "  ")
    kept = F.filter(F.split(flat, " +"), lambda t: F.length(t) >= min_length)
    return F.array_distinct(F.array_except(kept, F.array(*[F.lit(p) for p in PARTICLES])))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the lower-cased text contains one of the words; null text is False."""
    hits = [F.contains(F.lower(text), F.lit(w)) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def search_any(columns: list[Column], query: str) -> Column:
    """Case-insensitive substring search over several columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return hit


# Factors of the unit letters of money texts.
UNIT_FACTORS = {"m": 1_000_000, "k": 1_000, "th": 1_000}


def market_value(text: Column) -> Column:
    """'1,50M' -> 1500000, '500k' / '500 Th.' -> 500000; unit-free numbers stay as they are."""
    first = r"([0-9][0-9.,]*)\s*([A-Za-z]*)"  # the first number and the word after it; what follows says nothing
    digits = F.rtrim(F.translate(F.regexp_extract(text, first, 1), ",", "."), F.lit("."))
    letters = F.lower(F.regexp_extract(text, first, 2))
    factor = F.lit(1)
    for unit, value in UNIT_FACTORS.items():
        factor = F.when(letters == unit, value).otherwise(factor)
    return F.round(digits.try_cast("double") * factor).cast("long")


# How the providers' goal lines name own goals and penalties.
OWN_GOAL_WORDS = "propia puerta|propia meta|Eigentor|en propia"
PENALTY_WORDS = r"penal|penalty|Elfmeter|\(EP\)"


def goal_kind(text: Column) -> Column:
    """own goal / penalty / regular from the free text of a goal line."""
    own, penalty = text.rlike(f"(?i){OWN_GOAL_WORDS}"), text.rlike(f"(?i){PENALTY_WORDS}")
    return F.when(own, "owngoal").when(penalty, "penalty").otherwise("regular")


def tag_text(html: Column, tag: str) -> Column:
    """Inner text of the first ``tag`` element."""
    return F.regexp_extract(html, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)


def tag_all(html: Column, tag: str) -> Column:
    """Inner html of every ``tag`` element, in page order."""
    return F.regexp_extract_all(html, F.lit(f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), 1)
