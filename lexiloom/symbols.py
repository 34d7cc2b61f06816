"""Symbols, locale rules and policies: small constants that live on the driver."""

PAD = "•"
EPSILON = "∅"
JOINER = "₊"
UNIT = "\x1f"
BEGIN, END = "<s>", "</s>"
STRESSED_VOWELS = tuple("AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split())
EPS = 1e-300



def _patterns(text: str) -> list[tuple[str, ...]]:
    return [tuple(p.split(" ")) for p in text.split("|") if p]


#: Letters and phones (by phone set) that are joined, by locale.
JOINS: dict[str, dict[str, list[tuple[str, ...]]]] = {
    locale: {kind: _patterns(text) for kind, text in told.items()}
    for locale, told in {
        "default": {"letters": ""},
        "en_IN": {"letters": "", "cmu": "ax r|ax m|g z|k s|k sh|m ax k|t s|y ax|y ua|y uh|y uw", "ipa": "ə ɾ|ə m|ɡ z|k s|k ʃ|m ə k|t s|j ə|j uə|j ʊ|j u"},
        "en_US": {
            "letters": "s h|c h|t h|p h|w h|n g|c k",
            "xsampa": 'j "u|j %u|j u|j "U|j %U|j U|j "oU|j %oU|j oU|j @|k s|k S|g z|@ l|@ m|@ n|t s|I z|m @ k',
            "cmu": "Y UW|Y UH|Y OW|Y @|K SH|K S|G Z|AH L|AH M|AH N|T S|IH Z|M AH K",
            "ipa": "j u|j ʊ|j oʊ|j ə|k s|k ʃ|ɡ z|ə l|ə m|ə n|t s|ɪ z|m ə k",
        },
        "de_DE": {"letters": "s c h|t s c h|c h|c k|p f|p h|q u|e u|ä u|a u|a i|e i|i e", "ipa": "t s"},
        "es_MX": {"letters": "l l|r r|c h", "ipa": "k s"},
        "fr_FR": {"letters": "e a u|i l l|a i l|c h|g n|p h|q u|o u|a u", "ipa": "k s|ɡ z"},
        "it_IT": {"letters": "g l i|g n|s c e|s c i|s c|z z|c h|l l", "ipa": "ɲ ɲ|ʎ ʎ|ʃ ʃ|t s|ts ts|k s"},
        "pt_BR": {"letters": "n h|l h|c h|r r|s s|q u|g u", "ipa": ""},
    }.items()
}
LOCALE_SPANS_DEFAULT = (2, 2)
SPANS = {"default": LOCALE_SPANS_DEFAULT, "de_DE": (3, 2), "fr_FR": (3, 2)}
#: Phones that a locale's phone set lists apart.
SPLITS = {"es_MX": {"ɟʝ": ("ɟ", "ʝ")}}

#: Pairs of phones that count as equal where a relaxed score is asked for; pt_BR's aren't transitive.
EQUIVALENT: dict[str, list[tuple[str, ...]]] = {"it_IT": _patterns("e ɛ|o ɔ"), "pt_BR": _patterns("o u|e i|ʊ u|ʁ ɾ|tʃ t|dʒ d")}

PRESETS = {
    "defaults": {"width": 7, "criterion": "entropy", "min_samples_split": 2, "min_samples_leaf": 1, "max_combinations": 0, "iterations": 15},
    "fast": {"width": 5, "criterion": "gini", "min_samples_split": 10, "min_samples_leaf": 5, "max_combinations": 1024, "iterations": 5},
    "accurate": {"width": 9, "criterion": "entropy", "min_samples_split": 2, "min_samples_leaf": 1, "max_combinations": 10000, "iterations": 30},
    "pocketsphinx": {"locale": "en_US", "phoneset": "cmu", "remove_stress": True, "remove_accents": True, "filter_non_letters": True, "cased": False, "width": 7, "criterion": "entropy", "min_samples_split": 2, "min_samples_leaf": 1, "max_combinations": 0, "iterations": 100},
    "xsampa": {"locale": "en_US", "phoneset": "xsampa", "remove_stress": False, "remove_accents": False, "cased": False, "width": 7, "criterion": "entropy", "min_samples_split": 2, "min_samples_leaf": 1, "max_combinations": 4096, "iterations": 100},
    "narrow": {"width": 3, "criterion": "entropy", "min_samples_split": 2, "min_samples_leaf": 1, "max_combinations": 0, "iterations": 15},
}


def canonical_locale(tag: str) -> str:
    """``en-us`` as ``en_US``; tags of another form unchanged."""
    if len(tag) == 5 and tag[2] in "-_":
        return f"{tag[:2].lower()}_{tag[3:].upper()}"
    return tag


def joins_for(locale: str, kind: str, enabled: bool = True) -> list[tuple[str, ...]]:
    """Patterns of a locale (``kind``: letters, or a phone set), longest first; none where joins are switched off."""
    found = JOINS.get(canonical_locale(locale), JOINS["default"]).get(kind, []) if enabled else []
    return sorted(found, key=lambda p: -len(" ".join(p)))
