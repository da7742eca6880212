"""Oversized texts cut at natural boundaries, the deepest valley of lexical cohesion in each size window.

At every sentence end the words before and after it are compared (cosine of their counts over sliding blocks); a valley
between two peaks of similarity marks a change of topic.  Within what the size limit allows, the deepest valley is the
cut; the next piece starts ``overlap`` characters before it.

Defined results
* null text: no piece.  A text within the limit, the empty one too: one piece, the whole text.
* no sentence end in the window: the last clause end, else the last blank, else a hard cut at the limit (never between a
  letter and its combining mark while another place exists).
* an overlap of the limit or more is reduced so that every piece adds at least one character.
* no limit, or one below 1: the whole text is one piece.
* offsets count code points; piece i+1 starts at the end of piece i less the overlap.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words on either side of a gap that are compared.
BLOCK_WORDS = 24
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+|\s*\n\s*")
_CLAUSE = re.compile(r"[,;:–—]\s+|\|")
_WORD = re.compile(r"[^\W_]+")


def cohesion_depths(text: str, gaps: list[int]) -> list[float]:
    """How deep a valley of similarity each gap lies in; 0 where both sides go on alike."""
    words, ends = [], []
    for m in _WORD.finditer(text):
        words.append(m.group().lower())
        ends.append(m.end())
    left: Counter = Counter()
    right: Counter = Counter()
    lo = mid = hi = 0
    alike = []
    for gap in gaps:
        at = bisect_right(ends, gap)
        while hi < min(len(words), at + BLOCK_WORDS):
            right[words[hi]] += 1
            hi += 1
        while mid < at:
            right[words[mid]] -= 1
            left[words[mid]] += 1
            mid += 1
        while lo < at - BLOCK_WORDS:
            left[words[lo]] -= 1
            lo += 1
        dot = sum(n * right[w] for w, n in left.items() if n)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        alike.append(dot / norm if norm else 0.0)
        if len(left) > 4 * BLOCK_WORDS:
            left, right = +left, +right
    # peaks: the highest similarity reached while climbing away from the gap
    n = len(alike)
    up_left, up_right = alike[:], alike[:]
    for i in range(1, n):
        up_left[i] = max(alike[i], up_left[i - 1]) if alike[i - 1] >= alike[i] else alike[i]
    for i in range(n - 2, -1, -1):
        up_right[i] = max(alike[i], up_right[i + 1]) if alike[i + 1] >= alike[i] else alike[i]
    return [a + b - 2 * s for a, b, s in zip(up_left, up_right, alike)]


def split_text(text: str, cap: int | None, least: int = 0, overlap: int = 0) -> list[tuple[int, int, str, float]]:
    """Pieces of ``text`` as (start, end, kind of cut at the end, depth of its valley)."""
    n = len(text)
    if not cap or cap < 1 or n <= cap:
        return [(0, n, "end", 0.0)]
    gaps = [m.end() for m in _SENTENCE.finditer(text) if 0 < m.end() < n]
    clauses = [m.end() for m in _CLAUSE.finditer(text) if 0 < m.end() < n]
    blanks = [m.end() for m in re.finditer(r"\s+", text) if 0 < m.end() < n]
    depths = cohesion_depths(text, gaps)
    overlap = max(0, min(overlap or 0, cap - 1))
    least = max(1, min(least or 1, cap))
    pieces, start = [], 0
    while n - start > cap:
        high = start + cap
        floor = start + overlap + 1  # a cut here or later moves on
        low = max(floor, start + least)
        i, j = bisect_left(gaps, low), bisect_right(gaps, high)
        if i < j:
            best = max(range(i, j), key=lambda k: (n - gaps[k] + overlap >= least, depths[k], gaps[k]))
            cut, kind, depth = gaps[best], "sentence", depths[best]
        else:
            depth = 0.0
            for kind, places in (("sentence", gaps), ("clause", clauses), ("blank", blanks)):
                j = bisect_right(places, high)
                if j and places[j - 1] >= floor:
                    cut = places[j - 1]
                    break
            else:
                cut, kind = high, "hard"
                while cut > floor and unicodedata.combining(text[cut]):
                    cut -= 1
                if unicodedata.combining(text[cut]):
                    cut = high
        pieces.append((start, cut, kind, depth))
        start = cut - overlap
    pieces.append((start, n, "end", 0.0))
    return pieces


_SCHEMA = "owner_key long, item_ix int, n_chars int, size_cap int, piece_ix int, n_pieces int, start_off int, end_off int, cut string, depth double, piece string"


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, ix, text, cap, least, overlap in zip(*(pdf[c] for c in ("owner_key", "item_ix", "text", "size_cap", "min_size", "overlap_cp"))):
            cap = None if pd.isna(cap) else int(cap)
            pieces = split_text(text, cap, 0 if pd.isna(least) else int(least), 0 if pd.isna(overlap) else int(overlap))
            rows += [(key, ix, len(text), cap, k, len(pieces), a, b, cut, depth, text[a:b]) for k, (a, b, cut, depth) in enumerate(pieces)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
        out["size_cap"] = out["size_cap"].astype("Int32")
        yield out


def split_items(items: DataFrame) -> DataFrame:
    """Pieces of ``items(owner_key, item_ix, text, size_cap, min_size, overlap_cp)``, one row a piece."""
    return items.where(F.col("text").isNotNull()).select(F.col("owner_key").cast("long"), F.col("item_ix").cast("int"), "text", *(F.col(c).cast("int") for c in ("size_cap", "min_size", "overlap_cp"))).mapInPandas(_batches, _SCHEMA)


def block_items(blocks: DataFrame, params: DataFrame, default_params: int = 1) -> DataFrame:
    """The blocks' texts (item_ix -1) and their row items with the limits that apply; ``params`` is a small fixed table."""
    own = blocks.select("block_key", "text", "row_items", "params_id").dropDuplicates(["block_key"])
    whole = own.select("block_key", F.lit(-1).alias("item_ix"), "text", "params_id")
    rows = own.select("block_key", F.explode("row_items").alias("r"), "params_id").select("block_key", F.col("r.row_ix").alias("item_ix"), F.col("r.text").alias("text"), "params_id")
    p = params.dropDuplicates(["params_id"]).select(F.col("params_id").alias("__p"), "size_cap", "min_size", "overlap_cp")
    both = whole.unionByName(rows).withColumn("__p", F.coalesce("params_id", F.lit(default_params)))
    return both.join(p, "__p", "left").select(F.col("block_key").alias("owner_key"), "item_ix", "text", "size_cap", "min_size", "overlap_cp")
