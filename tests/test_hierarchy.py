import random
from functools import partial

import pytest

from redloom.operators import hierarchy as H

SCHEMA = "scope string, node_key long, parent_key long"


def brute(links):
    up = {(s, k): p for s, k, p in links}
    out = {}
    for s, k in up:
        seen, at = [], k
        while at is not None and (s, at) in up and at not in seen:
            seen.append(at)
            at = up[s, at]
        if at in seen:
            out[s, k] = (min(seen[seen.index(at) :]), -1)
        else:
            out[s, k] = (seen[-1], len(seen) - 1)
    return out


def forest(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        keys = rng.sample(range(1000), n)
        for i, k in enumerate(keys):
            parent = None if rng.random() < 0.1 else rng.choice(keys if rng.random() < 0.05 else keys[: i + 1])
            rows.append((s, k, parent))
    rows += [("c", 1, 1), ("c", 2, 3), ("c", 3, 2), ("c", 4, 2), ("c", 5, 99), ("d", 1, None)]
    return rows


def chains():
    """Deep lines, loops of several lengths with what hangs below them, and a star."""
    rows = [("l", k, k - 1 if k else None) for k in range(70)]
    for n, base in ((2, 1000), (3, 1100), (4, 1200), (6, 1300), (9, 1400)):
        rows += [("o", base + k, base + (k + 1) % n) for k in range(n)]
        rows += [("o", base - 20 + k, base + n - 1 if k == 0 else base - 21 + k) for k in range(5)]
    return rows + [("s", k, 5) for k in range(6, 300)] + [("s", 5, None)] + [("s", 1000 + k, 6 + k) for k in range(100)]


@pytest.mark.parametrize("links", [forest(1), forest(5), chains()], ids=["forest", "another", "chains"])
def test_against_brute_force(spark, monkeypatch, links):
    # hot keys and ranges that end within a parent's children
    monkeypatch.setattr(H, "skew_join", partial(H.skew_join, hot_rows=20))
    got = H.build_hierarchy(spark.createDataFrame(links + links[:5], SCHEMA).repartition(4)).collect()
    assert len(got) == len(links)
    assert {(r.scope, r.node_key): (r.root_key, r.depth) for r in got} == brute(links)
    # ranges: inside a tree a descendant's lies in its ancestor's, and they are as long as the subtree
    sound = [r for r in got if r.depth >= 0]
    up = {(s, k): p for s, k, p in links}
    for r in sound:
        inside = {x.node_key for x in sound if (x.scope, x.root_key) == (r.scope, r.root_key) and r.pre <= x.pre < r.pre_end}
        below = set()
        for x in sound:
            at = x.node_key
            while at is not None and at != r.node_key:
                at = up.get((x.scope, at))
            if at == r.node_key and x.scope == r.scope:
                below.add(x.node_key)
        assert inside == below and r.pre_end - r.pre == len(below)
    # siblings by key
    for r in sound:
        if r.depth:
            smaller = [x.pre for x in sound if (x.scope, up[x.scope, x.node_key]) == (r.scope, up[r.scope, r.node_key]) and x.node_key < r.node_key]
            assert all(p < r.pre for p in smaller)


def test_empty_and_paths(spark):
    empty = H.build_hierarchy(spark.createDataFrame([], SCHEMA))
    assert empty.columns == H.COLUMNS and empty.count() == 0
    f = H.build_hierarchy(spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("a", 4, 1), ("a", 9, 9)], SCHEMA))
    assert {r.node_key: r.path for r in H.paths(f).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 4]}
    want = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9)], "scope string, node_key long")
    assert {(r.node_key, r.descendant_key) for r in H.descendants(f, want).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3)}


def test_links(spark):
    nodes = spark.createDataFrame([("d", 1, "a", ["b", "zz", "b"]), ("d", 2, "b", []), ("d", 3, None, None), ("e", 4, "b", ["b"])], "doc string, k long, id string, kids array<string>")
    assert {(r.scope, r.node_key, r.parent_key) for r in H.child_links(nodes, "doc", "k", "id", "kids").collect()} == {("d", 1, None), ("d", 2, 1), ("d", 3, None), ("e", 4, 4)}
    rows = spark.createDataFrame([("d", 1, "p", None), ("d", 2, "q", "p"), ("d", 3, "q", "nope"), ("e", 4, "x", "p")], "doc string, k long, id string, up string")
    assert {(r.node_key, r.parent_key) for r in H.named_parent_links(rows, "doc", "k", "id", "up").collect()} == {(1, None), (2, 1), (3, None), (4, None)}


def test_ranges_against_brute_force(spark):
    import __spark_entry__

    rng = random.Random(2)
    links = forest(7) + [("t", k, rng.randrange(max(0, k - 40), k) if k else None) for k in range(400)]
    f = H.build_hierarchy(spark.createDataFrame(links, SCHEMA)).cache()
    up, known = {(s, k): p for s, k, p in links}, brute(links)
    want = {}
    for (s, k), (_, depth) in known.items():
        if depth >= 0:
            path = [k]
            while (s, up[s, path[0]]) in up:
                path.insert(0, up[s, path[0]])
            want[s, k] = path
    assert {(r.scope, r.node_key): r.path for r in H.paths(f).collect()} == want
    got = [(r.scope, r.node_key, r.descendant_key) for r in H.descendants(f).collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, a, k) for (s, k), path in want.items() for a in path[:-1]}
    # the join finds a pair by its block, it does not form the pairs of a tree
    assert "__block" in H.descendants(f)._jdf.queryExecution().optimizedPlan().toString()
    assert {"p2_paths", "p2_descendants"} <= set(__spark_entry__.queries())
