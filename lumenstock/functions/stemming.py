"""The Snowball English stemmer (Porter 2) as native columns.

One expression per word, whose steps bind what they need once. Words are lower-case ASCII letters and digits;
apostrophes don't occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: letter classes, exceptions and endings of each step.
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
REGION_STARTS = ["gener", "commun", "arsen"]
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousness": "ous", "ousli": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ative": "", "ful": "", "ness": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
SHORT_END = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def ending(suffixes) -> str:
    """The longest of the suffixes a word ends in: the search finds the leftmost start first."""
    return f"({'|'.join(suffixes)})$"


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once: an expression that names a column twice would grow with every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(word: Column, n) -> Column:
    """`word` without its last `n` letters."""
    return F.substring(word, F.lit(1), F.length(word) - n)


def _region(word: Column, pattern: str, whole: Column) -> Column:
    """Where the region after a match at the start begins; the end of `whole` where nothing matches."""
    return _let(F.regexp_extract(word, pattern, 1), lambda head: F.when(head == "", F.length(whole)).otherwise(F.length(whole) - F.length(word) + F.length(head)))


def _by_ending(word: Column, suffixes, change) -> Column:
    """`change(base, suffix)` for the longest suffix the word ends in, the word itself where that is NULL or none ends it."""
    def with_suffix(suffix):
        return F.when(suffix == "", word).otherwise(_let(_cut(word, F.length(suffix)), lambda base: F.coalesce(change(base, suffix), word)))

    return _let(F.regexp_extract(word, ending(suffixes), 1), with_suffix)


def _mapped(suffix: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[suffix]


def _plural(w: Column) -> Column:
    return (F.when(w.endswith("sses"), _cut(w, 2)).when(w.rlike("ie[sd]$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
            .when(w.rlike("(us|ss)$"), w).when(w.rlike(f"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w))


def _verb(w: Column, r1: Column) -> Column:
    def change(base, suffix):
        mended = (F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e"))).when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(base, 1))
                  .when((r1 >= F.length(base)) & base.rlike(SHORT_END), F.concat(base, F.lit("e"))).otherwise(base))
        return F.when(suffix.startswith("eed"), F.when(F.length(base) >= r1, F.concat(base, F.lit("ee")))).when(base.rlike(VOWEL), mended)

    done = _by_ending(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"], change)
    return F.regexp_replace(done, f"(.{OTHER})[yY]$", "$1i")


def _derived(w: Column, r1: Column, r2: Column) -> Column:
    def second(base, suffix):
        after = F.when(suffix == "ogi", base.endswith("l")).when(suffix == "li", base.rlike("[cdeghkmnrt]$")).otherwise(True)
        return F.when((F.length(base) >= r1) & after, F.concat(base, _mapped(suffix, STEP2)))

    def third(base, suffix):
        return F.when(F.length(base) >= F.when(suffix == "ative", r2).otherwise(r1), F.concat(base, _mapped(suffix, STEP3)))

    def fourth(base, suffix):
        return F.when((F.length(base) >= r2) & ((suffix != "ion") | base.rlike("[st]$")), base)

    def last(base, suffix):
        outer = F.length(base) >= r2
        return F.when(F.when(suffix == "e", outer | ((F.length(base) >= r1) & ~base.rlike(SHORT_END))).otherwise(outer & base.endswith("l")), base)

    steps = [(STEP2, second), (STEP3, third), (STEP4, fourth), (["e", "l"], last)]
    return reduce(lambda word, step: _let(word, lambda x: _by_ending(x, *step)), steps, w)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; NULL of NULL."""
    def marked(w):
        pattern = f"^({'|'.join(REGION_STARTS)}|.*?{VOWEL}{OTHER})"
        return _let(_region(w, pattern, w), lambda r1: _let(_region(F.substring(w, r1 + 1, F.length(w)), f"^(.*?{VOWEL}{OTHER})", w), lambda r2: regions(w, r1, r2)))

    def regions(w, r1, r2):
        return _let(_plural(w), lambda x: F.when(x.isin(INVARIANT), x).otherwise(_let(_verb(x, r1), lambda y: F.lower(_derived(y, r1, r2)))))

    started = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(_mapped(word, SPECIAL), _let(started, marked)))
