"""Array functions over letters, phones and aligned tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import strip_phoneset_stress
from lexiloom.symbols import EPSILON, EQUIVALENT, JOINER, PAD, SPLITS, canonical_locale, joins_for

EMPTY = "cast(array() as array<string>)"


def once(value: Column, f) -> Column:
    """``f(value)``, with the value computed once however often ``f``, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def letters_of(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def join_tokens(tokens: Column, patterns: list[tuple[str, ...]]) -> Column:
    """Neighbours that make a pattern become one token; longest pattern first, left to right.

    Two passes over the space-joined tokens: mark whole patterns (the space that
    ends one may begin the next), then turn the spaces within marks into joiners.
    """
    if not patterns:
        return tokens
    options = "|".join(" ".join(map(re.escape, p)) for p in sorted(patterns, key=lambda p: -len(" ".join(p))))
    text = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    marked = F.regexp_replace(text, f" ({options})(?= )", " ⟨$1⟩")
    joined = F.regexp_replace(marked, " (?=[^⟨⟩]*⟩)", JOINER)
    return F.filter(F.split(F.translate(joined, "⟨⟩", ""), " "), lambda t: t != "")


def uncook(tokens: Column) -> Column:
    """Joined tokens apart again, epsilons dropped."""
    return F.flatten(F.transform(F.filter(tokens, lambda t: t != EPSILON), lambda t: F.split(t, JOINER)))


def cook_phones(phones: Column, locale: str = "default", phoneset: str = "ipa", remove_stress: bool = False) -> Column:
    """Phones apart, without stress marks of the phone set if asked for, and joined by the locale's patterns."""
    apart = F.transform(phones, lambda p: F.replace(p, F.lit(JOINER), F.lit(" ")))
    if remove_stress:
        apart = F.transform(apart, lambda p: strip_phoneset_stress(p, phoneset))
    tokens = F.filter(F.split(F.array_join(apart, " "), " "), lambda t: t != "")
    return join_tokens(tokens, joins_for(locale, phoneset))


def split_tokens(phones: Column, locale: str) -> Column:
    """Phones that the locale's phone set lists apart, apart."""
    told = SPLITS.get(canonical_locale(locale), {})
    out = lambda p: F.coalesce(*(F.when(p == old, F.array(*map(F.lit, new))) for old, new in told.items()), F.array(p))
    return F.flatten(F.transform(phones, out)) if told else phones


def context_windows(letters: Column, width: int = 7) -> Column:
    """For each letter the array of the ``width`` letters around it, padded."""
    half = width // 2
    padded = F.concat(F.array_repeat(F.lit(PAD), half), letters, F.array_repeat(F.lit(PAD), half))
    return F.when(F.size(letters) == 0, F.expr("cast(array() as array<array<string>>)")).otherwise(F.transform(F.sequence(F.lit(1), F.size(letters)), lambda i: F.slice(padded, i, F.lit(width))))


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) < 2, F.expr(EMPTY)).otherwise(F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1))))


def equal_phones(a: Column, b: Column, locale: str | None = None) -> Column:
    same = a == b
    for x, y in EQUIVALENT.get(locale or "", ()):
        same = same | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return same


def matches_in_place(a: Column, b: Column, locale: str | None = None) -> Column:
    """Positions of the common prefix at which both agree."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n < 1, 0).otherwise(F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: equal_phones(F.get(a, i), F.get(b, i), locale))))


#: Locales whose equivalent phones make classes: each pair shares no phone with another pair.
_CLASSES = {k: dict((b, a) for a, b in pairs) for k, pairs in EQUIVALENT.items() if len({p for pair in pairs for p in pair}) == 2 * len(pairs)}


def _to(old: str, new: str):
    return lambda p: F.when(p == old, new).otherwise(p)


def edit_distance(a: Column, b: Column, locale: str | None = None) -> Column:
    """Levenshtein distance of two arrays; a locale's equivalent phones count as equal.

    Where every phone is one code point (and equivalence makes classes) the
    built-in distance of the joined strings is the same; else a table row by row.
    """
    if locale in _CLASSES:
        for old, new in _CLASSES[locale].items():
            a, b = F.transform(a, _to(old, new)), F.transform(b, _to(old, new))
        locale = None
    if locale in EQUIVALENT:
        return _table_distance(a, b, locale)
    plain_a, plain_b = F.array_join(a, ""), F.array_join(b, "")
    single = ~F.exists(F.concat(a, b), lambda p: F.length(p) != 1)
    return F.when(single, F.levenshtein(plain_a, plain_b)).otherwise(_table_distance(a, b, None))


def _table_distance(a: Column, b: Column, locale: str | None) -> Column:
    first = F.sequence(F.lit(0), F.size(b))

    def row(above: Column, x: Column) -> Column:
        start = F.array(F.element_at(above, 1) + 1)
        steps = F.when(F.size(b) == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(1), F.size(b)))

        def cell(line: Column, j: Column) -> Column:
            cost = F.when(equal_phones(x, F.element_at(b, j), locale), 0).otherwise(1)
            best = F.least(F.element_at(line, -1) + 1, F.element_at(above, j + 1) + 1, F.element_at(above, j) + cost)
            return F.concat(line, F.array(best))

        return F.aggregate(steps, start, cell)

    return F.element_at(F.aggregate(a, first, row), -1)


def phones_match(predicted: Column, expected: Column, gold: Column, locale: str | None = None) -> Column:
    """Equal to the expected phones or to any gold variant, or equivalent in each place."""
    exact = (predicted == expected) | F.coalesce(F.array_contains(gold, predicted), F.lit(False))
    if locale not in EQUIVALENT:
        return exact
    return exact | ((F.size(predicted) == F.size(expected)) & (matches_in_place(predicted, expected, locale) == F.size(expected)))


def _last(phones: Column, old: tuple[str, ...], new: str) -> Column:
    """``phones`` with the last one replaced if it is one of ``old``."""
    ends = F.concat(F.slice(phones, F.lit(1), F.size(phones) - 1), F.array(F.lit(new)))
    return F.when((F.size(phones) > 0) & F.get(phones, F.size(phones) - 1).isin(*old), ends).otherwise(phones)


def _mapped(phones: Column, pairs: dict[str, str]) -> Column:
    return F.transform(phones, lambda p: F.coalesce(*(F.when(p == old, new) for old, new in pairs.items()), p))


_MID = dict(zip("ɛɔ", "eo", strict=True))


def _plain_o(word: Column) -> Column:
    """Ends in o, with no nasal vowel before it and no accented o anywhere."""
    return F.endswith(word, F.lit("o")) & ~word.rlike("[ãõ]o$") & ~word.rlike("[óôõÓÔÕ]")


def _surface_final(word: Column, phones: Column) -> Column:
    return F.when(_plain_o(word), _last(phones, ("o", "ʊ"), "u")).otherwise(phones)


def _do_du(word: Column, phones: Column) -> Column:
    out = _surface_final(word, phones)
    fits = F.endswith(word, F.lit("do")) & (F.get(out, F.size(out) - 2) == "d")
    return F.when(F.coalesce(fits, F.lit(False)), _last(out, ("o", "ʊ"), "u")).otherwise(out)


#: Named policies (word, phones) -> phones that training phones may pass first.
POLICIES = {
    "identity": lambda word, phones: phones,
    "collapse_open": lambda word, phones: _mapped(phones, _MID),
    "spelling_gated": lambda word, phones: F.when(word.rlike("[èÈòÒ]"), phones).otherwise(_mapped(phones, _MID)),
    "surface_final": _surface_final,
    "do_du": _do_du,
    "citation_expand": lambda word, phones: F.when(_plain_o(word), _last(phones, ("u",), "o")).otherwise(phones),
}
#: The policies of each locale's experiments.
LOCALE_POLICIES = {"it_IT": ("identity", "spelling_gated", "collapse_open"), "pt_BR": ("identity", "surface_final", "do_du", "citation_expand")}
