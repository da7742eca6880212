import random

import numpy as np
import pytest

from redloom.llm import leaks as L


def sw(a, b):
    """Score and longest unbroken run, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    r = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = run = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if same else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            r[i][j] = r[i - 1][j - 1] + 1 if same else 0
            best, run = max(best, h[i][j]), max(run, r[i][j])
    return best, run


def test_align():
    rng = np.random.RandomState(4)
    items = [rng.randint(1, 5, rng.randint(1, 15)) for _ in range(40)]
    windows = [rng.randint(0, 5, rng.randint(1, 25)) for _ in range(40)]
    best, run = L.align(items, windows)
    for a, b, p, r in zip(items, windows, best, run):
        assert (p, r) == sw(a.tolist(), b.tolist())


def make(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(200)]
    items = [(i, None if i == 9 else " ".join(rng.choice(vocab[:80]) for _ in range(rng.randrange(3, 60)))) for i in range(12)]
    docs = [(100, None), (101, ""), (102, "short")]
    for k in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            src = L.words_of(rng.choice(items)[1])
            n = rng.randrange(0, len(src) + 1)
            i = rng.randrange(0, len(src) - n + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = src[i : i + n]
        docs.append((k, ", ".join(words).title() if k % 2 else "\n".join(words)))
    return items, docs


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_every_run_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_WORDS", block)
    items, docs = make(6)
    d = spark.createDataFrame([(*x, 0) for x in docs], "id long, text string, score int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.key): r.run for r in L.find_leaks(d, "id", "text", i, run=12).collect()}
    for item, a in items:
        for key, b in docs:
            x, y = L.words_of(a), L.words_of(b)
            grams = {tuple(x[p : p + 12]) for p in range(len(x) - 11)}
            held = any(tuple(y[p : p + 12]) in grams for p in range(len(y) - 11))
            assert (got.get((item, key), 0) >= 12) == held, (item, key)


def test_edited_copy_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(40))
    words = text.split()
    words[10] = "changed"
    words[25:26] = ["more", "words"]
    d = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, "nothing alike at all")], "id long, text string")
    i = spark.createDataFrame([(7, text)], "item_id long, text string")
    (r,) = L.find_leaks(d, "id", "text", i).collect()
    assert (r.item_id, r.key, r.run) == (7, 1, 14) and r.similarity > 0.85
    assert L.find_leaks(d.where("false"), "id", "text", i).count() == 0
    assert L.find_leaks(d, "id", "text", i.where("false")).count() == 0


def test_copies_edited_every_eight_words(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(60)}" for _ in range(72)]
    docs = []
    for k in range(12):
        copy, n = [], 0
        for i, w in enumerate(item[: 72 - 3 * k]):
            if i % 8 == 7:
                # a word changed, left out, or words put in
                copy += [[f"x{i}"], [], [w, f"y{i}", f"z{i}"]][(k + n) % 3]
                n += 1
            else:
                copy.append(w)
        docs.append((k, " ".join([f"a{j}" for j in range(5 * k)] + copy + ["after"] * k)))
    # elsewhere every other word of the item is common, so its rarest n-grams are those across edits
    docs += [(100 + k, " ".join(item[6 * k : 6 * k + 7])) for k in range(11)]
    d = spark.createDataFrame(docs, "id long, text string")
    i = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.key: (r.score, r.run) for r in L.find_leaks(d, "id", "text", i).where("run >= 12 or similarity >= 0.4").collect()}
    want = {}
    for k, text in docs:
        score, run = sw(item, L.words_of(text))
        if run >= 12 or score / (2 * len(item)) >= 0.4:
            want[k] = (score, run)
    assert len(want) >= 11 and max(run for _, run in want.values()) < 12 and got == want


def test_scores_of_very_long_items():
    words = np.arange(1, 11_001, dtype=np.int32)
    score, run = L.align([words, words[:5]], [words, words[2:9]])
    assert score.tolist() == [22_000, 6] and run.tolist() == [11_000, 3]
