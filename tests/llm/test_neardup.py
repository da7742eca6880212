import random

import pytest

from redloom.llm import neardup as N


def brute(rows, width, threshold, least):
    sets = {}
    for s, k, t in rows:
        w = N.words_of(t)
        if len(w) >= max(least, width):
            sets[s, k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, base = [], []
    for k in range(150):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 6)):
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = [rng.choice(vocab)]
        else:
            words = [rng.choice(vocab) for _ in range(rng.randrange(5, 50))]
            base.append(words)
        rows.append((rng.choice("ab"), k, rng.choice([" ", ", "]).join(words).upper() if k % 3 else " ".join(words)))
    return [*rows, ("a", 900, None), ("a", 901, ""), ("a", 902, "one two"), *rows[:3]]


@pytest.mark.parametrize(("width", "threshold", "least", "small"), [(3, 0.6, 10, False), (3, 0.6, 10, True), (5, 0.8, 1, True), (1, 0.5, 1, False)])
def test_against_brute_force(spark, width, threshold, least, small):
    # small: as large input does, with full buckets, frequent shingles in blocks, batches that end within a key
    sizes = {"bucket_bits": 4, "block": 3, "held": 5} if small else {}
    rows = corpus(width)
    df = spark.createDataFrame([(*r, 1) for r in rows], "src string, key long, text string, shingle int")
    got = [tuple(r) for r in N.key_pairs(*N.near_duplicates(df, width=width, threshold=threshold, least_words=least, **sizes), block=sizes.get("block", N.BLOCK)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, width, threshold, least)


def test_empty_and_copies(spark):
    df = spark.createDataFrame([], "src string, key long, text string")
    assert N.key_pairs(*N.near_duplicates(df)).count() == 0
    copies = spark.createDataFrame([("a", k, "the very same words in every row here " * 3) for k in range(40)], "src string, key long, text string")
    members, pairs = N.near_duplicates(copies)
    assert members.select("class").distinct().count() == 1 and pairs.count() == 0
    assert N.key_pairs(members, pairs).count() == 40 * 39 // 2
