"""Near-duplicate texts by a grouped prefix join on word shingles.

Equal shingle sets are one class.  Shingles are ordered by how many texts hold them, the rarest first; two sets of sizes m
and n can only reach similarity t if their first ``m - ceil(t m) + 1`` and ``n - ceil(t n) + 1`` shingles in that order
meet, and if behind some place where they meet both still have the ``t / (1 + t) (m + n)`` shingles they must share.
Classes with the same prefix and size form one group; group pairs are filtered by these bounds; what passes is expanded to
its classes, whose bitmaps bound what two sets can share, and the rest is verified on whole sets.

Defined results
* a word is an unbroken run of letters and digits, lower-cased; texts of fewer than ``least_words`` words, null and empty
  texts among them, are in no pair.
* similarity is |both| / |either| of the distinct shingles; at the threshold counts.
* equal texts are pairs too; repeated keys count once.
* shingles are 64-bit hashes; the chance that two of a pair's shingles are confused is below 1e-14.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redloom.operators.skew import skew_join
from redloom.session import discard, staged

#: How often shingles are held is counted in so many buckets of their hashes (a power of two).  The counts give the order
#: of the prefixes, and any order that all texts share gives the same pairs; what goes to the executors is one byte a
#: bucket, 16 MB, whatever the size of the input.
BUCKET_BITS = 24
#: Entries a partition holds back to combine counts before they are shuffled.
COMBINE = 3_000_000
#: Rows that are paired with each other at a time: the rows of a more frequent key are split in blocks, and each pair of
#: blocks is a unit of its own.
BLOCK = 4096
#: Rows, and found pairs, a partition holds back.
HELD = 500_000
_WORD = re.compile(r"[^\W_]+")
#: Of ASCII texts: letters as lower case, digits as they are, a blank for the rest.
_ASCII = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


def shingle_batch(texts: list[str | None], width: int, seed: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have enough words, where the shingle hashes of each begin (and the last end), and the hashes: sorted and distinct within a text."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    which = np.flatnonzero(sizes >= max(least_words, width))
    if not len(which):
        return which, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    sizes = sizes[which]
    flat = [w for i in which.tolist() for w in lists[i]]
    code, distinct = pd.factorize(np.array(flat, dtype=object))
    h = pd.util.hash_array(np.array(distinct, dtype=object), categorize=False)[code]
    n = len(h)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            mixed = (mixed ^ (h[i : n - width + 1 + i] >> np.uint64(i))) * _MIX + np.uint64(i + 1)
            mixed ^= mixed >> np.uint64(29)
    # without the runs that cross from one text into the next
    ends = np.cumsum(sizes)
    inside = np.ones(n, bool)
    for i in range(width - 1):
        inside[ends - 1 - i] = False
    mixed = mixed[inside[: len(mixed)]]
    counts = sizes - width + 1
    mixed ^= np.repeat(seed[which], counts)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        mixed[a:b].sort()
    first = np.ones(len(mixed), bool)
    first[1:] = mixed[1:] != mixed[:-1]
    first[ends[:-1]] = True
    return which, np.r_[0, np.cumsum(first)[ends - 1]], mixed[first]


def _sum_of(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each of the sets that begin at ``begin``, whatever the order of its values."""
    with np.errstate(over="ignore"):
        m = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        total = np.add.reduceat(m ^ (m >> np.uint64(32)), begin)
        return (total ^ (total >> np.uint64(30))) * _MIX


def prefix_length(n, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _seed(src: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(src, dtype=object), categorize=False)


def _buckets(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int32)


def _count_buckets(width: int, least_words: int, bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            src, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values = shingle_batch(text, width, _seed(src), least_words)[2]
            held.append(_buckets(values, bits))
            size += len(values)
            if size > COMBINE:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], schema=schema)

    return run


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Counts as a byte that grows with them, 8 steps to an octave; 0 for a count of one."""
    return np.minimum(255, np.round(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _pack_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at, n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32), batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([levels_of(n).tobytes()])], ["at", "level"])


def bucket_levels(texts: DataFrame, width: int, least_words: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often the shingles of each bucket are held, over all ``texts(src, text)``: a level a bucket, 0 where one text at most holds any."""
    counts = texts.mapInArrow(_count_buckets(width, least_words, bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    level = np.zeros(1 << bits, np.uint8)
    packed = counts.mapInArrow(_pack_levels, "at binary, level binary").toArrow()
    for at, held in zip(packed.column(0), packed.column(1)):
        level[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(held.as_buffer(), np.uint8)
    return level


_ROWS = pa.schema([("src", pa.string()), ("key", pa.int64()), ("n", pa.int32()), ("class", pa.int64()), ("gid", pa.int64()), ("rid", pa.int64()), ("pos", pa.list_(pa.int32())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int16())), *[(f"b{i}", pa.int64()) for i in range(4)]])
_ROWS_DDL = "src string, key long, n int, class long, gid long, rid long, pos array<int>, low array<int>, high array<short>, b0 long, b1 long, b2 long, b3 long"
_BITS = ["b0", "b1", "b2", "b3"]


def _bits(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Each set's bitmap: one bit a shingle, so two sets differ in at least as many shingles as their bitmaps in bits."""
    with np.errstate(over="ignore"):
        at = (values * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 8)
    out = np.zeros((n_docs, 256), np.uint8)
    out[doc, at.astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.int64)


def _split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 40 bits of hashes as 32 and 8, which a table holds in five bytes."""
    upper = (values >> np.uint64(24)).astype(np.int64)
    return ((upper & 0xFFFFFFFF) - (1 << 31)).astype(np.int32), (upper >> 32).astype(np.int16)


#: Added to the upper eight bits of a shingle whose bucket is held often enough that the shingle may need blocks.
_OFTEN = 256


def _prefixes(width: int, threshold: float, least_words: int, shared, bits: int, block: int):
    """Per text its class, group and prefix; shingles of a single text keep their place but are left out, and so are prefixes the partition has told before."""
    often_from = int(levels_of(np.array([block]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        told: set[int] = set()
        # small numbers, partition first: they pack better on disk than hashes
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            src, text = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            which, at, values = shingle_batch(text, width, _seed(src), least_words)
            if not len(which):
                continue
            n = np.diff(at)
            often = level[_buckets(values, bits)]
            length = prefix_length(n, threshold)
            # the rarest first, of equals the smaller hash
            order = np.concatenate([np.argsort(often[a:b], kind="stable")[:p] + a for a, b, p in zip(at[:-1].tolist(), at[1:].tolist(), length.tolist())])
            begin = np.cumsum(length) - length
            with np.errstate(over="ignore"):
                gid = (_sum_of(values[order], begin) ^ n.astype(np.uint64)) * _MIX
            gid = gid.view(np.int64)
            new = np.zeros(len(which), bool)
            for i, g in enumerate(gid.tolist()):
                if g not in told:
                    told.add(g)
                    new[i] = True
            if len(told) > 1_000_000:
                told.clear()
            told_here = np.repeat(new, length) & (often[order] > 0)
            place = (np.arange(len(order)) - np.repeat(begin, length))[told_here].astype(np.int32)
            low, high = _split(values[order[told_here]])
            high = high + np.where(often[order[told_here]] >= often_from, _OFTEN, 0).astype(np.int16)
            doc = np.repeat(np.arange(len(which)), length)[told_here]
            ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(which)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x), mask=pa.array(~new)) for x in (place, low, high)]
            rids = rid + 1 + np.arange(len(which))
            rid += len(which)
            bitmaps = _bits(values, np.repeat(np.arange(len(which)), n), len(which))
            taken = pa.array(which)
            columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(n.astype(np.int32)), pa.array(_sum_of(values, at[:-1]).view(np.int64)), pa.array(gid), pa.array(rids), *lists, *[pa.array(np.ascontiguousarray(bitmaps[:, i])) for i in range(4)]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

    return run


def in_units(rows: DataFrame, key: str, spread: str, counts: DataFrame, block: int = BLOCK, how: str = "left") -> DataFrame:
    """``rows`` with ``unit`` and ``side``: rows of one key and unit are to be paired, those of sides 0 and 1 across, those of side 2 with each other.

    ``counts(key, n)`` has how many rows a key has; keys of more than ``block`` are split in blocks, and every two blocks,
    and each block with itself, are a unit.  With ``how`` "inner" only the counted keys stay.
    """
    r = skew_join(rows, counts.select(key, F.ceil(F.col("n") / block).cast("int").alias("__nb")), [key], how, spread=F.col(spread), counted=rows).withColumn("__nb", F.coalesce("__nb", F.lit(1)))
    r = r.withColumn("__i", F.pmod(F.xxhash64(spread), F.col("__nb")).cast("int"))
    with_others = F.expr("transform(sequence(0, __nb - 1), j -> struct(least(j, __i) * __nb + greatest(j, __i) as unit, case when j = __i then 2 when j > __i then 0 else 1 end as side))")
    return r.withColumn("__u", F.explode(with_others)).select("*", "__u.unit", "__u.side").drop("__nb", "__i", "__u")


def _as_postings(u: DataFrame) -> DataFrame:
    """Rows of :func:`in_units` as (key, id, np): the unit goes into the key, the side into the upper two bits of ``np``."""
    key = F.when((F.col("unit") == 0) & (F.col("side") == 2), F.col("key")).otherwise(F.xxhash64("key", "unit"))
    return u.select(key.alias("key"), "id", F.col("np").bitwiseOR(F.shiftleft(F.col("side").cast("long"), 62)).alias("np"))


#: Side 2, as :func:`_as_postings` has it.
_WHOLE = -(1 << 63)


def _pair_arrays(threshold: float, key: np.ndarray, rid: np.ndarray, packed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one key that sides, size and place allow."""
    packed = packed.view(np.uint64)
    side, n = (packed >> np.uint64(62)).astype(np.int8), ((packed >> np.uint64(32)) & np.uint64(0x3FFFFFFF)).astype(np.int64)
    order = np.lexsort((n, key))
    key, rid, side, n = key[order], rid[order], side[order], n[order]
    ahead = n - (packed[order] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    left = np.arange(len(key) - 1)
    share = threshold / (1 + threshold)
    d = 0
    while len(left):
        d += 1
        left = left[: np.searchsorted(left, len(key) - d)]
        # sizes only grow on the way: who is too small for one is too small for the rest
        left = left[(key[left] == key[left + d]) & (n[left] >= threshold * n[left + d] - 1e-9)]
        right = left + d
        needed = share * (n[left] + n[right]) - 1e-9
        good = (ahead[left] >= needed) & (ahead[right] >= needed) & (rid[left] != rid[right]) & ((side[left] == 2) | (side[left] != side[right]))
        if good.any():
            a, b = rid[left[good]], rid[right[good]]
            yield np.minimum(a, b), np.maximum(a, b)


def _pair_batches(threshold: float, most: int):
    """Pairs of the postings of each key, which come together; a key has 2 * BLOCK postings or so at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["ra", "rb"])

        def take(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, pairs, size
            columns = [np.concatenate(c) for c in zip(*held)]
            # the last key's rows may go on
            cut = len(columns[0]) if last else int(np.searchsorted(columns[0], columns[0][-1], "left"))
            for found in _pair_arrays(threshold, *(c[:cut] for c in columns)):
                pairs.append(found)
                size += len(found[0])
                if size > most:
                    yield out()
                    pairs, size = [], 0
            held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows > most:
                yield from take(False)
        if held:
            yield from take(True)
        if pairs:
            yield out()

    return run


def _met(postings: DataFrame, threshold: float, held: int) -> DataFrame:
    """(ra, rb), smaller first, of ``postings(key, id, np)``, ``np`` having the side (2 bits), the size (30) and the place (32): each pair once."""
    spread = postings.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(_pair_batches(threshold, held), "ra long, rb long").distinct()


def _sets(width: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, at, values = shingle_batch(batch.column(1).to_pylist(), width, _seed(batch.column(0).to_pylist()), least_words)
            if len(which):
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(which)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], ["class", "shingles"])

    return run


def near_duplicates(texts: DataFrame, *, width: int = 5, threshold: float = 0.8, least_words: int = 1, bucket_bits: int = BUCKET_BITS, block: int = BLOCK, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Members (src, key, class) and class pairs (class_a, class_b, similarity) of ``texts(src, key, text)``; sources stay apart."""
    spark = texts.sparkSession
    t = texts.where("text is not null").select("src", F.col("key").cast("long").alias("key"), "text")
    # repeated rows of a key count again, which only moves the order
    level = bucket_levels(t.select("src", "text"), width, least_words, bucket_bits)
    shared = spark.sparkContext.broadcast(zlib.compress(level.tobytes(), 1))
    rows = staged(t.mapInArrow(_prefixes(width, threshold, least_words, shared, bucket_bits, block), _ROWS_DDL), "prefixes")
    members = staged(rows.select("src", "key", "class").distinct(), "members")
    classes = staged(rows.groupBy("class").agg(F.min(F.struct("src", "key")).alias("one"), F.min("gid").alias("gid"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in _BITS]), "classes")
    tellers = staged(rows.where("pos is not null").select("rid", "gid"), "tellers")
    # Postings of the groups, each told by at least one row: 40 bits of the shingle, as a meeting by chance only costs a
    # check; place and size in one number.
    upper = F.shiftleft(F.col("x.high").bitwiseAND(F.lit(_OFTEN - 1)).cast("long"), 32) + (F.col("x.low").cast("long") + F.lit(1 << 31))
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("x.pos")
    postings = rows.where("pos is not null").select("rid", "n", F.explode(F.arrays_zip("pos", "low", "high")).alias("x"))
    some = postings.where(F.col("x.high") >= _OFTEN).select(upper.alias("key"), F.col("rid").alias("id"), packed.alias("np"))
    rare = postings.where(F.col("x.high") < _OFTEN).select(upper.alias("key"), F.col("rid").alias("id"), packed.bitwiseOR(F.lit(_WHOLE)).alias("np"))
    units = rare.unionByName(_as_postings(in_units(some, "key", "id", some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), block)))
    pairs = staged(_met(units, threshold, held), "group-pairs")
    discard(rows)
    # groups to classes, with a safe bound on what two sets share from their sizes and bitmaps
    own = classes.select("gid", "class", "n", *_BITS)
    told = tellers.join(own, "gid")
    facts = lambda df, i: df.withColumnsRenamed({"gid": f"g{i}", "class": f"c{i}", "n": f"n{i}", **{c: f"{c}_{i}" for c in _BITS}})
    kept = [f"{c}{i}" for i in (1, 2) for c in ("c", "n")] + [f"{c}_{i}" for i in (1, 2) for c in _BITS]
    across = pairs.join(facts(told, 1).withColumnRenamed("rid", "ra"), "ra").join(facts(told, 2).withColumnRenamed("rid", "rb"), "rb").where("g1 <> g2").select(*kept)
    # classes of one group
    several = own.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("gid", "key")
    fellows = own.select(F.col("gid").alias("key"), F.col("class").alias("id"), F.shiftleft(F.col("n").cast("long"), 32).alias("np"))
    inside = _met(_as_postings(in_units(fellows, "key", "id", several, block, "inner")), threshold, held)
    within = inside.toDF("c1", "c2").join(facts(own, 1).drop("g1"), "c1").join(facts(own, 2).drop("g2"), "c2").select(*kept)
    apart = sum((F.bit_count(F.col(f"{c}_1").bitwiseXOR(F.col(f"{c}_2"))) for c in _BITS[1:]), F.bit_count(F.col("b0_1").bitwiseXOR(F.col("b0_2"))))
    shared_least = 2 * threshold / (1 + threshold) * (F.col("n1") + F.col("n2")) - 1e-9
    near = across.unionByName(within).where(F.col("n1") + F.col("n2") - apart >= shared_least)
    candidates = staged(near.select(F.least("c1", "c2").alias("class_a"), F.greatest("c1", "c2").alias("class_b")).distinct(), "class-pairs")
    discard(pairs)
    # whole sets of the classes that are in a pair, from one text of each
    involved = candidates.select(F.col("class_a").alias("class")).union(candidates.select("class_b")).distinct()
    one = classes.join(involved, "class", "left_semi").select("one.src", "one.key", "class")
    sets = staged(t.join(one, ["src", "key"]).select("src", "text", "class").mapInArrow(_sets(width, least_words), "class long, shingles array<long>"), "class-sets")
    left, right = sets.toDF("class_a", "set_a"), sets.toDF("class_b", "set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    # no class is near a large share of all others unless these are near each other, so no class has a large share of the pairs
    checked = candidates.join(left, "class_a").join(right, "class_b").withColumn("__both", both).withColumn("similarity", F.col("__both") / (F.size("set_a") + F.size("set_b") - F.col("__both")))
    # a text sent again gave its set twice
    found = checked.where(F.col("similarity") >= threshold - 1e-12).select("class_a", "class_b", "similarity").distinct()
    return members, found


def key_pairs(members: DataFrame, class_pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, key_a, key_b): pairs of different keys, smaller first, of equal and of paired classes."""
    m = members.select("class", "src", "key")
    several = m.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    u = in_units(m, "class", "key", several, block, "inner")
    other = u.select("class", "unit", F.col("key").alias("b"), F.col("side").alias("sb"))
    same = u.where("side <> 1").toDF("class", "src", "a", "unit", "sa").join(other, ["class", "unit"]).where("(sa = 2 and sb = 2 and a < b) or (sa = 0 and sb = 1)").select("src", "a", "b")
    near = class_pairs.select("class_a", "class_b").join(m.toDF("class_a", "src", "a"), "class_a").join(m.select(F.col("class").alias("class_b"), F.col("key").alias("b")), "class_b").select("src", "a", "b")
    both = same.unionByName(near)
    return both.select("src", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
