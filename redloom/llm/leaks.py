"""Evaluation passages inside training texts: rare word n-grams as seeds, Smith-Waterman on what they meet.

Every n-gram of an item is a seed, so a copy is met wherever ``seed`` words in a row were left unedited.  A seed met in a
text opens a window as wide as any alignment through it can be; windows of one item that overlap are one, and are aligned
in batches (match 2, mismatch -1, gap -1), which scores edited copies too.  The longest unbroken run is read off the same
matrices.  A window whose words cannot reach what is asked for is not aligned.

Where only unbroken runs are asked for, the frequency of every item n-gram is counted over the whole corpus and the rarest
of each stretch of ``run`` words is the seed: a copied stretch holds all of its n-grams.

Defined results
* a word is an unbroken run of letters and digits, lower-cased.
* null and empty texts or items, items shorter than the n-gram: no row.
* a text that holds an item in several places has one row, with the best score and the longest run.
* repeated document keys: one row, of the best of their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a seed.
SEED = 6
#: Words of items that go to the executors at a time; more items are taken in blocks.
BLOCK_WORDS = 1_000_000
#: Columns of the matrices that are filled in step.
CELLS = 25_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def gram_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive ids; 0 where one of them is 0."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(width):
            part = ids[i : i + n]
            out = (out ^ part.astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(31)
            whole &= part != 0
    return np.where(whole, out | np.uint64(1), np.uint64(0))


class Items:
    """A block of items as word ids, and where their n-grams stand."""

    def __init__(self, rows: list[tuple[int, str]], width: int = SEED) -> None:
        self.width = width
        self.vocabulary: dict[str, int] = {}
        self.item_id, self.words = [], []
        for item, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids) >= width:
                self.item_id.append(item)
                self.words.append(ids)
        grams = [gram_hashes(w, width) for w in self.words]
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        self.distinct = np.unique(self.gram)

    def keep_rarest(self, frequency: dict[int, int], run: int) -> None:
        """Drop all n-grams but the rarest of each stretch of ``run`` words; for unbroken runs only, as an edit may fall on the rarest."""
        keep = np.zeros(len(self.gram), bool)
        span = max(1, run - self.width + 1)
        for item in range(len(self.words)):
            at = np.flatnonzero(self.item == item)
            often = [frequency.get(int(g), 0) for g in self.gram[at]]
            for i in range(max(1, len(at) - span + 1)):
                keep[at[min(range(i, min(i + span, len(at))), key=lambda j: (often[j], j))]] = True
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]
        self.sort()

    def sort(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.distinct = np.unique(self.gram)


def _ids(texts: list[str | None], vocabulary: dict[str, int], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word ids one after the other, ``gap`` zeros between them, and where each begins."""
    get, zeros = vocabulary.get, [0] * gap
    flat: list[int] = []
    begin = []
    for t in texts:
        begin.append(len(flat))
        if t:
            flat += [get(w, 0) for w in _WORD.findall(t.lower())]
        flat += zeros
    return np.array(flat, np.int32), np.array(begin, np.int64)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the values that are in the sorted array ``of``."""
    some = np.flatnonzero(values)
    if not len(some) or not len(of):
        return some[:0]
    at = np.minimum(np.searchsorted(of, values[some]), len(of) - 1)
    return some[of[at] == values[some]]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score and longest unbroken common run of each item with its window, all in step."""
    b, m, w = len(items), max(map(len, items)), max(map(len, windows))
    a = np.full((m, b), -1, np.int32)
    d = np.zeros((w, b), np.int32)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[: len(x), i], d[: len(y), i] = x, y
    # no value exceeds a whole match and the ramp together
    kind = np.int16 if 2 * m + w < 32_000 else np.int32
    # a column a pair; every array is made once
    score, new, run, after = (np.zeros((w + 1, b), kind) for _ in range(4))
    best, longest = np.zeros((w + 1, b), kind), np.zeros((w + 1, b), kind)
    same, gain, drop = np.empty((w, b), bool), np.empty((w, b), kind), np.empty((w, b), kind)
    ramp = np.arange(w + 1, dtype=kind)[:, None]
    for i in range(m):
        np.equal(d, a[i], out=same)
        np.multiply(same, kind(3), out=gain)
        gain -= kind(1)
        gain += score[:-1]
        np.subtract(score[1:], kind(1), out=drop)
        np.maximum(gain, drop, out=gain)
        np.maximum(gain, 0, out=new[1:])
        new[0] = 0
        new += ramp
        step = 1
        while step <= w:  # gaps in the item's row: the greatest so far, by doubling
            np.maximum(new[step:], new[:-step], out=score[step:])
            score[:step] = new[:step]
            new, score = score, new
            step *= 2
        np.subtract(new, ramp, out=score)
        np.add(run[:-1], kind(1), out=after[1:])
        after[1:] *= same
        run, after = after, run
        np.maximum(best, score, out=best)
        np.maximum(longest, run, out=longest)
    return best.max(axis=0), longest.max(axis=0)


def _count_grams(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.distinct), np.int64)
        for batch in batches:
            ids, _ = _ids(batch.column(0).to_pylist(), items.vocabulary, items.width)
            grams = gram_hashes(ids, items.width)
            total += np.bincount(np.searchsorted(items.distinct, grams[_member(grams, items.distinct)]), minlength=len(total)).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.distinct[met].view(np.int64), pa.int64()), pa.array(total[met], pa.int64())], ["gram", "n"])

    return run


def _windows(jobs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping ranges of equal ``jobs`` as one."""
    order = np.lexsort((lo, jobs))
    jobs, lo, hi = jobs[order], lo[order], hi[order]
    # the furthest end so far within a job
    far = np.maximum.accumulate(hi + jobs * (int(hi.max()) + 1)) - jobs * (int(hi.max()) + 1)
    first = np.flatnonzero(np.r_[True, (jobs[1:] != jobs[:-1]) | (lo[1:] > far[:-1])])
    return jobs[first], lo[first], np.maximum.reduceat(hi, first)


def _bounds(ids: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, held: np.ndarray, size: int) -> np.ndarray:
    """What no alignment of the item with its window can exceed: the best sum of 2 a word of the item and -1 any other."""
    out = np.zeros(len(item), np.int64)
    for i in range(0, len(item), 1024):
        n = hi[i : i + 1024] - lo[i : i + 1024]
        begin = np.r_[0, np.cumsum(n)[:-1]]
        words = ids[np.repeat(lo[i : i + 1024] - begin, n) + np.arange(n.sum())].astype(np.int64)
        key = np.repeat(item[i : i + 1024], n) * size + words
        own = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
        sums = np.zeros((len(n), int(n.max()) + 1), np.int32)
        sums[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(begin, n) + 1] = np.where(own, 2, -1)
        sums = np.cumsum(sums, axis=1, dtype=np.int32)
        out[i : i + 1024] = (sums - np.minimum.accumulate(sums, axis=1)).max(axis=1)
    return out


def _find(items: Items, asked: int = 0, least: float = 0.0):
    """Best alignments of what the seeds meet; windows that can reach neither a run of ``asked`` words nor the similarity ``least`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(items.item_id, np.int64)
        lengths = np.array([len(w) for w in items.words], np.int64)
        size = len(items.vocabulary) + 1
        held = np.unique(np.concatenate([np.int64(i) * size + w.astype(np.int64) for i, w in enumerate(items.words)]))
        enough = np.minimum(2 * asked, np.ceil(2 * least * lengths - 1e-9))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            ids, begin = _ids(texts, items.vocabulary, items.width)
            end = np.r_[begin[1:], len(ids)] - items.width
            grams = gram_hashes(ids, items.width)
            at = _member(grams, items.distinct)
            first, last = np.searchsorted(items.gram, grams[at], "left"), np.searchsorted(items.gram, grams[at], "right")
            count = last - first
            if not len(at):
                continue
            which = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            at = np.repeat(at, count)
            item, doc = items.item[which], np.searchsorted(begin, at, "right") - 1
            # an aligned word makes up for two gaps at most, so a side of n item words takes 3 n words of the text at most
            place = items.place[which]
            lo = np.maximum(begin[doc], at - 3 * place)
            hi = np.minimum(end[doc], at + items.width + 3 * (lengths[item] - place - items.width))
            job, lo, hi = _windows(doc * len(lengths) + item, lo, hi)
            doc, item = job // len(lengths), job % len(lengths)
            can = np.flatnonzero(_bounds(ids, item, lo, hi, held, size) >= enough[item])
            can = can[np.lexsort((hi[can] - lo[can], lengths[item[can]] // 16))]
            out = []
            i = 0
            while i < len(can):
                # as many windows in step as keep the matrices small
                some = can[i : i + 256]
                many = np.arange(1, len(some) + 1)
                wide = np.maximum.accumulate(hi[some] - lo[some])
                # nor is an item filled up to one more than twice its size
                alike = np.maximum.accumulate(lengths[item[some]]) <= 2 * lengths[item[some[0]]] + 16
                some = some[: max(1, int(np.searchsorted(wide * many, CELLS, "right")))]
                some = some[: max(1, int(np.argmin(np.r_[alike[: len(some)], False])))]
                i += len(some)
                own = [items.words[x] for x in item[some]]
                best, longest = align(own, [ids[a:b] for a, b in zip(lo[some], hi[some])])
                good = np.flatnonzero((longest >= asked) | (best >= 2 * least * lengths[item[some]] - 1e-9))
                out.append((some[good], best[good], longest[good]))
            if out:
                some, best, longest = (np.concatenate(x) for x in zip(*out))
                own = lengths[item[some]]
                columns = [names[item[some]], keys.take(pa.array(doc[some])), best.astype(np.int32), longest.astype(np.int32), own.astype(np.int32), best / (2.0 * own)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["item_id", "key", "score", "run", "item_words", "similarity"])

    return run


def blocks_of(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, a block of at most ``BLOCK_WORDS`` words at a time; at most one block is in the driver."""
    rows: list[tuple[int, str]] = []
    size = 0
    for r in items.where(F.col(text).isNotNull()).select(F.col(item).cast("long"), text).distinct().toLocalIterator():
        n = len(words_of(r[1]))
        if rows and size + n > BLOCK_WORDS:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield rows


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str = "item_id", item_text: str = "text", *, run: int = 12, seed: int = SEED, least: float = 0.0, edited: bool = True) -> DataFrame:
    """(item_id, key, score, run, item_words, similarity): every text that a seed of an item meets, with its best alignment.

    Every text that holds ``run`` consecutive words of an item has a row with that run.  Other rows are edited or partial
    copies: with ``edited`` all that keep ``seed`` words in a row and reach the similarity ``least``, without it only some.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "item_id long, key long, score int, run int, item_words int, similarity double"
    found = spark.createDataFrame([], schema)
    for rows in blocks_of(items, item, item_text):
        block = Items(rows, seed)
        if not len(block.gram):
            continue
        if edited:
            block.sort()
        else:
            # as many rows as the block has n-grams
            counted = docs.select("text").mapInArrow(_count_grams(block), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            counts = counted.toPandas()
            block.keep_rarest(dict(zip(counts["gram"].to_numpy(np.int64).view(np.uint64).tolist(), counts["n"].tolist())), run)
        found = found.unionByName(docs.mapInArrow(_find(block, run, least), schema))
    return found.groupBy("item_id", "key").agg(F.max("score").alias("score"), F.max("run").alias("run"), F.first("item_words").alias("item_words"), F.max("similarity").alias("similarity"))
