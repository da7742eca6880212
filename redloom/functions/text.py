"""Tokens with code-point offsets, as JVM expressions.

A token is a maximal run of letters, numbers and marks.  Hyphens inside or after a token are read in two ways: joined
(they belong to the token and are deleted) or split (they separate).  Offsets always count in the raw text; in the joined
reading a token's span takes trailing hyphens in.

Folding is lower case plus the full foldings of the letters that lower case leaves apart; ``exact_fold`` is the complete
Unicode folding with composition, an Arrow function for text that is not composed.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

READINGS = ("joined", "split")
_T = r"\p{L}\p{N}\p{M}"
_H = r"\-\x{00AD}\x{2010}\x{2011}"
_PATTERN = {"joined": rf"[^{_T}]*[{_T}][{_T}{_H}]*", "split": rf"[^{_T}]*[{_T}]+"}


def fold(c: Column) -> Column:
    return F.translate(F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ŉ"), F.lit("ʼn")), "ſς", "sσ")


def exact_fold(c: Column) -> Column:
    run = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.casefold())), "string")
    return run(c)


def token_words(text: Column, reading: str = "joined") -> Column:
    """Folded tokens without offsets; null text gives null."""
    found = F.regexp_extract_all(text, F.lit(rf"[{_T}][{_T}{_H}]*" if reading == "joined" else rf"[{_T}]+"), F.lit(0))
    return F.transform(found, lambda t: fold(F.regexp_replace(t, rf"[{_H}]", "") if reading == "joined" else t))


def token_spans(text: Column, reading: str = "joined") -> Column:
    """array<struct<s,e,t>>: start, end and folded text of every token; meant for texts of paragraph size."""
    found = F.regexp_extract_all(text, F.lit(_PATTERN[reading]), F.lit(0))
    start = F.struct(F.lit(0).alias("e"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        own = F.regexp_replace(m, rf"^[^{_T}]+", "")
        end = acc["e"] + F.length(m)
        word = fold(F.regexp_replace(own, rf"[{_H}]", "") if reading == "joined" else own)
        return F.struct(end.alias("e"), F.array_append(acc["out"], F.struct((end - F.length(own)).alias("s"), end.alias("e"), word.alias("t"))).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def normalize(text: Column) -> Column:
    """Tokens joined by one blank."""
    return F.array_join(token_words(text), " ")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, folded; for comparing typed answers."""
    return fold(F.trim(F.regexp_replace(text, r"\s+", " ")))


def contains_sequence(tokens: Column, wanted: Column) -> Column:
    """Whether the token array holds ``wanted`` as consecutive tokens."""
    n = F.size(wanted)
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return (n > 0) & (F.size(tokens) >= n) & F.exists(at, lambda i: F.slice(tokens, i, n) == wanted)


def segments(text: Column) -> Column:
    """array<struct<base,line>>: the lines of a text and where each begins."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,line:string>>").alias("out"))
    return F.aggregate(lines, start, lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("base"), x.alias("line"))).alias("out")), lambda acc: acc["out"])


def letters_label(n: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa, 28 -> bb: the letter repeated."""
    return F.when(n >= 1, F.repeat(F.char(F.lit(97) + F.pmod(n - 1, F.lit(26))), (F.floor((n - 1) / 26) + 1).cast("int")))


def roman_label(n: Column) -> Column:
    """Lower-case roman numeral of 1 to 3999; null outside."""
    rank = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
    part = lambda words, unit: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.floor(n / unit), F.lit(10)) + 1).cast("int"))
    return F.when(n.between(1, 3999), F.concat(part(rank[0], 1000), part(rank[1], 100), part(rank[2], 10), part(rank[3], 1)))
