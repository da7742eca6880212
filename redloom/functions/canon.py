"""Canonical JSON and its hashes, the same from Python and from Spark expressions.

Keys sorted, separators without blanks, nothing escaped but what JSON demands, control characters as lower-case
``\\u00xx`` or their short forms.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHORT = {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r"}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sha256_json(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def json_text(c: Column) -> Column:
    """A string as a JSON string; null as null."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = out
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(_SHORT.get(code, f"\\u{code:04x}")))
    # most texts hold no control character at all
    out = F.when(c.rlike(r"[\x00-\x1f]"), rare).otherwise(out)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), out, F.lit('"')))


def json_number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_texts(c: Column) -> Column:
    """An array of strings as JSON; null as null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(c, json_text), ","), F.lit("]")))


def json_object(**fields: Column) -> Column:
    """An object of rendered fields, keys in sorted order."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), fields[name]]
    return F.concat(*parts, F.lit("}"))


def hash_of(**fields: Column) -> Column:
    return F.sha2(json_object(**fields), 256)
