"""Text functions as Catalyst expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ACRONYMS, PHRASE_STOPS, PLACES, SECOND_LEVELS, TITLE_NOISE, TRACKING_KEYS, VALUE, WATCHLIST


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def quoted(text: str) -> str:
    """text as a literal part of a Java, Python or RE2 pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def any_term(terms: Iterable[str]) -> str:
    """A pattern for any of the terms as whole words, in either case, longer ones first."""
    return r"(?iU)\b(?:" + "|".join(quoted(t) for t in sorted(terms, key=len, reverse=True)) + r")\b"


def has_any(text: Column | str, terms: Iterable[str]) -> Column:
    return _text(text).rlike(any_term(terms))


# ---------------------------------------------------------------- cleaning

_URL = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column | str) -> Column:
    """Lower-case scheme and host without www., path without final slashes, query without tracking keys and sorted, no fragment."""
    u = F.trim(_text(url))
    part = lambda i: F.regexp_extract(u, _URL, i)
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pair = lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.lower(p["k"]).startswith("utm_")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    front = F.concat(
        F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.regexp_replace(part(3), "/+$", ""),
    )
    return F.when(u == "", F.lit("")).otherwise(F.concat(front, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def host(url: Column | str) -> Column:
    """The lower-case host of an address with or without a scheme; empty without any."""
    return F.regexp_extract(F.lower(F.trim(_text(url))), r"^(?:[^:/?#]+://|//)?(?:[^/?#@]*@)?([^/?#:]*)", 1)


def registered_domain(url: Column | str) -> Column:
    """The name under the public suffix, for suffixes of one label and the second levels listed in the configuration;
    `suffixes.suffix_domain` takes a whole table."""
    own = host(url)
    double = "|".join(f"{k}\\.(?:{'|'.join(v.split())})" for k, v in SECOND_LEVELS.items())
    found = F.regexp_extract(own, rf"([^.]+\.(?:{double}|[^.]+))\.?$", 1)
    return F.when(own.rlike(r"^[\d.]+$"), own).when(found != "", found).otherwise(own)


def normalized_title(title: Column | str) -> Column:
    """Lower case, without a short publisher's suffix, punctuation and filler words."""
    low = F.lower(_text(title))
    cut = r"(?s)^(.*)( - | \| )(.*)$"
    body = F.when(low.rlike(cut) & (F.length(F.regexp_extract(low, cut, 3)) < 35), F.regexp_extract(low, cut, 1)).otherwise(low)
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(body, r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*TITLE_NOISE)), " ")


def without_tags(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_text(text), "<[^>]+>", " "), r"(?U)\s+", " "))


def clean_snippet(text: Column | str, most: int = 500) -> Column:
    return F.substring(without_tags(text), 1, most)


def display_title(title: Column | str) -> Column:
    """The title up to the first separator that a short tail follows."""
    return F.trim(F.regexp_replace(_text(title), r"\s+(?:-|\|)\s+.{1,45}$", ""))


#: Every character beyond ASCII whose decomposition has ASCII in it: what is left of it.
_FOLDED = {chr(c): v for c in range(0xA0, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (v := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode())}
_ONE = {k: v for k, v in _FOLDED.items() if len(v) == 1}
_MORE = {k: v for k, v in _FOLDED.items() if len(v) > 1}


def _ranges(chars: Iterable[str]) -> str:
    """A class of these characters as few ranges: a matcher asks one after the other of a class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


#: ASCII and the letters with marks that follow Latin-1's signs are told at once, before the ranges are asked.
_ANY_MORE = r"(?![\x00-\x7F\xC0-\xFF])" + _ranges(_MORE)


def accent_fold(text: Column | str) -> Column:
    """Decomposed characters without their marks, as NFKD gives them; other characters outside ASCII are dropped.

    Characters that stand for one are mapped at once; of those that stand for several (ligatures, fractions, units) each
    kind that a text has is replaced by itself.
    """
    text = _text(text)
    several = F.create_map(*(F.lit(x) for kv in _MORE.items() for x in kv))
    spelled = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(_ANY_MORE), F.lit(0))), text, lambda t, c: F.replace(t, c, F.element_at(several, c)))
    plain = F.when(F.rlike(text, F.lit(_ANY_MORE)), spelled).otherwise(text)
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.regexp_replace(F.translate(plain, "".join(_ONE), "".join(_ONE.values())), r"[^\x00-\x7F]", "")).otherwise(text)


def fold(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def company_key(name: Column) -> Column:
    return F.lower(F.trim(accent_fold(name)))


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_text(text), F.lit(r"(?U)\b[\w$€£₹.-]+\b"), F.lit(0)))


# ---------------------------------------------------------------- detection


def _first(cases: list[tuple[Column, str]], default: str) -> Column:
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for when, value in cases[1:]:
        out = out.when(when, F.lit(value))
    return out.otherwise(F.lit(default))


def deal_type(text: Column, types: tuple) -> Column:
    return _first([(has_any(text, terms), name) for name, terms in types], "unknown")


def category(text: Column, categories: tuple) -> Column:
    return _first([(has_any(text, (term,)), name) for term, name in categories], "Other")


def geography(text: Column) -> Column:
    """Acronyms in capitals first, then names, each in the order of its list."""
    short = [(_text(text).rlike(rf"\b{quoted(a)}(?![\w.])"), place) for a, place in ACRONYMS]
    return _first([*short, *((has_any(text, (name,)), place) for name, place in PLACES)], "Not specified")


def deal_value(texts: Column) -> Column:
    """The first value in the texts (an array, best first), word for word; "undisclosed" without one."""
    found = F.filter(F.transform(texts, lambda t: F.trim(F.regexp_extract(t, VALUE, 0))), lambda v: v != "")
    return F.coalesce(F.get(found, 0), F.lit("undisclosed"))


_WATCH = {fold(name).lower(): name for name in reversed(WATCHLIST)}
_PHRASE = r"\b[A-Z][a-zA-Z&'.-]+(?:\s[A-Z][a-zA-Z&'.-]+){0,2}\b"


def companies(title: Column | str, snippet: Column | str = "", stops: frozenset[str] = PHRASE_STOPS) -> Column:
    """Company names, in order, each once: known ones anywhere in the text, then capitalised phrases of the title, cut at the
    first stop word. Names are compared without accents and case."""
    snippet = F.lit("") if isinstance(snippet, str) and not snippet else snippet
    known = r"(?i)\b(?:" + "|".join(quoted(fold(n)) for n in WATCHLIST) + r")\b"
    names = F.create_map(*(F.lit(x) for kv in _WATCH.items() for x in kv))
    listed = F.transform(
        F.regexp_extract_all(accent_fold(F.concat(_text(title), F.lit(" "), _text(snippet))), F.lit(known), F.lit(0)), lambda m: F.coalesce(F.element_at(names, F.lower(m)), m)
    )
    stop = F.array(*(F.lit(w) for w in sorted(stops)))

    def cut(phrase: Column) -> Column:
        words = F.split(phrase, r"\s")
        at = F.array_position(F.transform(words, lambda w: F.array_contains(stop, F.btrim(F.lower(w), F.lit(".,'&-")))), True)
        return F.when(at == 0, words).otherwise(F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))

    phrases = F.transform(F.regexp_extract_all(display_title(title), F.lit(_PHRASE), F.lit(0)), cut)
    phrases = F.filter(phrases, lambda w: (F.size(w) > 0) & ~((F.size(w) == 1) & (F.length(F.get(w, 0)) < 3)))
    every = F.concat(listed, F.transform(phrases, lambda w: F.array_join(w, " ")))
    keyed = F.filter(F.transform(every, lambda n: F.struct(company_key(n).alias("key"), n.alias("name"))), lambda x: x["key"] != "")

    def first(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, lambda x: x["key"]))
        return F.transform(keys, lambda k: F.get(F.filter(all_, lambda x: x["key"] == k), 0)["name"])

    return F.get(F.transform(F.array(keyed), first), 0)  # in a lambda's variable, the names are worked out once, not for every key
