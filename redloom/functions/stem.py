"""The suffix stripper of Porter (1980), written from the paper's rules, and named stemmers as Arrow functions."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def _shape(word: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# fixed values: suffix pairs of the published algorithm, steps 2 to 4
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replace(word: str, table: tuple[tuple[str, str], ...]) -> str:
    found = _longest(word, [a for a, _ in table])
    if found and _measure(word[: -len(found)]) > 0:
        return word[: -len(found)] + dict(table)[found]
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer, or not of a to z alone, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):  # plurals
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    if word.endswith("eed"):  # past forms
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if _has_vowel(word[: -len(suffix)]):
                    word = word[: -len(suffix)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _cvc(word):
                        word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    found = _longest(word, STEP4)
    if found and _measure(word[: -len(found)]) > 1 and (found != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(found)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


STEMMERS = {"porter": porter}


def stemmer(name: str):
    """The stemmer of that name; an unknown name is an error."""
    if name not in STEMMERS:
        raise ValueError(f"no stemmer is named {name!r}; known: {sorted(STEMMERS)}")
    return STEMMERS[name]


def stem_tokens(tokens: Column, name: str = "porter") -> Column:
    """The stems of a token array; each distinct word is stemmed once a worker."""
    f = stemmer(name)

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [f(w) for w in ws])

    return run(tokens)


def register(spark) -> None:
    """Each stemmer as a SQL function ``stem_<name>`` over one word."""
    for name, f in STEMMERS.items():
        spark.udf.register(f"stem_{name}", F.pandas_udf(lambda s, f=f: s.map(lambda w: None if w is None else f(w)), "string"))
