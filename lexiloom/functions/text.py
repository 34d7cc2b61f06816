"""String functions as column expressions; only Unicode normal forms need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom.symbols import EPSILON, JOINER, STRESSED_VOWELS, UNIT


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """Normal form C. Code points below U+0300 are in it already, so only texts with others go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    other = text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.when(other, _composed(F.when(other, text))).otherwise(text)


@F.pandas_udf(StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Without combining marks: decomposed, marks dropped, composed."""

    def fold(t):
        if t is None or t.isascii():
            return t
        parts = unicodedata.normalize("NFD", t)
        return unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))

    return text.map(fold)


def is_comment(line: Column) -> Column:
    t = F.trim(line)
    return (t == "") | t.rlike(r"^(#|;;;)")


def strip_stress(phone: Column) -> Column:
    """Without one trailing digit 0, 1 or 2."""
    return F.regexp_replace(phone, "[012]$", "")


def strip_phoneset_stress(phone: Column, phoneset: str) -> Column:
    marks = {"cmu": "[012]", "xsampa": '["%]'}.get(phoneset)
    return F.regexp_replace(phone, marks, "") if marks else phone


def filter_stress(phones: Column, keep: str = "1", mark_unstressed: bool = False) -> Column:
    """Stress digits other than those of ``keep`` go; if asked for, a vowel gets 0 in place of a digit that goes."""

    def one(p: Column) -> Column:
        bare = F.regexp_replace(p, "[012]$", "")
        left = F.when(bare.isin(*STRESSED_VOWELS), F.concat(bare, F.lit("0"))).otherwise(bare) if mark_unstressed else bare
        return F.when(~p.rlike("[012]$") | p.rlike(f"[{keep}]$"), p).otherwise(left)

    return F.transform(phones, one)


def strip_variant(word: Column) -> Column:
    return F.regexp_replace(word, r"\(\d+\)$", "")


def variant_rank(word: Column) -> Column:
    """The number of a trailing (N), else 1."""
    n = F.regexp_extract(word, r"\((\d+)\)$", 1)
    return F.when(n == "", 1).otherwise(n.try_cast("int"))


EDGE = r"^[\p{P}\p{S}\p{C}\p{M}\p{Z}]+|[\p{P}\p{S}\p{C}\p{M}\p{Z}]+$"


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def normal_tokens(text: Column) -> Column:
    """Tokens of the composed text without punctuation, symbols, controls, marks and separators at their edges."""
    return F.filter(F.transform(F.split(nfc(text), r"\s+"), lambda t: F.regexp_replace(t, EDGE, "")), lambda t: t != "")


_QUOTES, _DASHES = "‘’❛❜‛`‚❟ʼ", r"\p{Pd}"
_SPELLED = {"🙰": "et", "Æ": "Ae", "æ": "ae", "Œ": "Oe", "œ": "oe", "ᵫ": "ue", **{c: v for k, v in {"ꜨTz": "tz", "ꜲAa": "aa", "ꜴAo": "ao", "ꜶAu": "au", "ꜸAv": "av", "ꜺAv": "av", "ꝎOo": "oo", "ꝠVy": "vy"}.items() for c, v in ((k[0], k[1:]), (chr(ord(k[0]) + 1), v))}, "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}


def plain_symbols(text: Column) -> Column:
    """Quotes as ', dashes as -, full-width forms as ASCII, ligatures spelled out, composed."""
    wide = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
    text = F.translate(text, wide + _QUOTES, "".join(chr(k) for k in range(0x21, 0x7F)) + "'" * len(_QUOTES))
    text = F.regexp_replace(text, _DASHES, "-")
    for old, new in _SPELLED.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return nfc(text)


def letters_only(text: Column) -> Column:
    """Letters, combining marks, hyphen, apostrophe and full stop."""
    return F.regexp_replace(text, r"[^\p{L}\p{Mn}\p{Mc}\-'.]", "")


def unit_id(letters: Column, phones: Column) -> Column:
    joined = F.array_join(phones, JOINER)
    return F.concat(F.array_join(letters, JOINER), F.lit(UNIT), F.when(joined == "", EPSILON).otherwise(joined))


def unit_letters(unit: Column) -> Column:
    return F.split(F.element_at(F.split(unit, UNIT), 1), JOINER)


def unit_phones(unit: Column) -> Column:
    side = F.element_at(F.split(unit, UNIT), 2)
    return F.when(side == EPSILON, F.expr("cast(array() as array<string>)")).otherwise(F.split(side, JOINER))


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))


#: Letters that a locale writes in another form before anything is dropped.
_PROTECTED = {"es_MX": ("ñÑüÜ", "\ue000\ue001\ue002\ue003")}
_MAPPED = {"it_IT": ("èÈéÉòÒóÓ", "ɛɛeeɔɔoo")}
_COMPOSED = ("fr_FR", "de_DE", "pt_BR")


def transliterate(word: Column, locale: str) -> Column:
    """The letters of a word as a locale's rules leave them; ``en_IN`` has none."""
    if locale == "en_IN":
        return word
    if locale in _COMPOSED:
        return F.regexp_replace(F.lower(nfc(word)), r"[^\-.'\p{L}]", "")
    if locale in _MAPPED:
        return F.regexp_replace(F.lower(F.translate(nfc(word), *_MAPPED[locale])), r"[^\-.\p{L}]", "")
    if locale in _PROTECTED:
        letters, private = _PROTECTED[locale]
        kept = F.translate(fold_accents(F.translate(nfc(word), letters, private)), private, letters)
        return F.lower(F.regexp_replace(kept, r"[^\-.'\p{L}]", ""))
    return F.lower(F.regexp_replace(fold_accents(word), r"[^\-.'\p{L}]", ""))


LOCALES = ("default", "en_US", "en_IN", "es_MX", "fr_FR", "de_DE", "pt_BR", "it_IT")
