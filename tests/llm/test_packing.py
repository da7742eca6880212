import numpy as np
import pytest

from redloom.llm import packing as P


def test_difference_is_a_near_equal_partition():
    rng = np.random.RandomState(2)
    for k in (1, 2, 5, 16):
        sizes = rng.randint(1, 100, 120)
        windows = P.difference(sizes, k)
        assert sorted(x for w in windows for x in w) == list(range(120)) and len(windows) <= k
        sums = [sizes[w].sum() for w in windows]
        assert max(sums) - min(sums) <= 3 or k == 1
    assert P.difference(np.array([], np.int64), 3) == []


def test_textbook_case():
    # two-way differencing of 4 5 6 7 8 leaves a difference of 2
    sums = sorted(sum([4, 5, 6, 7, 8][i] for i in w) for w in P.difference(np.array([4, 5, 6, 7, 8]), 2))
    assert sums == [14, 16]


@pytest.mark.parametrize("capacity", [50, 100, 1000])
def test_windows_hold(capacity):
    rng = np.random.RandomState(capacity)
    for n in (0, 1, 7, 300):
        sizes = rng.randint(0, capacity + 1, n)
        windows = P.fill_windows(sizes, capacity)
        assert sorted(x for w in windows for x in w) == list(range(n))
        assert all(sizes[w].sum() <= capacity for w in windows)
        half = int((2 * sizes > capacity).sum())
        if n == 300:
            assert len(windows) <= 1.05 * max(half, -(-sizes.sum() // capacity)) + 2


def test_operator(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 5, 10, 23, 10, 7, 3, 3, 3, 30])]
    sizes = spark.createDataFrame(rows, "key long, n_tokens long")
    caps = spark.createDataFrame([(1, 10), (2, 40), (3, 0)], "capacity_id int, max_tokens int")
    got = P.pack(sizes, caps).collect()
    assert {r.capacity_id for r in got} == {1, 2}
    for cap, limit in ((1, 10), (2, 40)):
        own = [r for r in got if r.capacity_id == cap]
        fill = {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= limit and {k: sum(r.n_tokens for r in own if r.key == k) for k, _ in rows} == dict(rows)
        assert all(n <= limit or sum(r.key == k for r in own) == -(-n // limit) for k, n in rows)
        assert all(sum(r.key == k for r in own) == 1 for k, n in rows if n <= limit)
    assert P.pack(sizes.where("false"), caps).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 200_000), (5, "<|endoftext|>")], "key long, text string")
    got = {r.key: r.n_tokens for r in P.token_sizes(df, "key", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 1000 and got[5] > 1
