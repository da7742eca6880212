import json
import random

from redloom.operators import nested as N


def brute(text):
    """(ix, parent) of every object with a tag, by a plain recursion over the decoded value."""
    out = []

    def walk(v, parent):
        if isinstance(v, dict):
            if "tag" in v:
                out.append(parent)
                parent = len(out) - 1
            for x in v.values():
                walk(x, parent)
        elif isinstance(v, list):
            for x in v:
                walk(x, parent)

    try:
        v = json.loads(text)
        while isinstance(v, str):
            v = json.loads(v)
    except ValueError:
        return []
    walk(v, None)
    return list(enumerate(out))


def random_tree(rng, depth=0):
    kind = rng.random()
    if depth > 5 or kind < 0.2:
        return rng.choice([None, 1, "x", True, "{not json", ""])
    if kind < 0.5:
        return [random_tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    d = {rng.choice("abcdef"): random_tree(rng, depth + 1) for _ in range(rng.randrange(4))}
    if rng.random() < 0.6:
        d = {"tag": "t", **d} if rng.random() < 0.5 else {**d, "tag": None}
    return d


def links(text):
    e = N.label_elements(v) if (v := N.parse_tree(text)) is not None else []
    N.link_by_containment(e)
    return [(x["ix"], x["parent_ix"]) for x in e]


def test_random_trees():
    rng = random.Random(5)
    for i in range(400):
        text = json.dumps(random_tree(rng), indent=rng.choice([None, 1]))
        if i % 5 == 0:
            text = json.dumps(text)
        if i % 7 == 0:
            text = text[: len(text) // 2]
        assert links(text) == brute(text), text


def test_edges():
    assert links(None) == [] and links("") == [] and links('{"tag": NaN}') == [] and links('{"tag":1} x') == []
    assert links('{"a": {"tag": 1}, "a": {"tag": 2}}') == [(0, None), (1, None)]
    assert links('{"b": {"tag": 2}, "tag": 1}') == [(0, None), (1, 0)]


def test_deeper_than_any_stack():
    n = 120_000
    text = '{"tag":"a","c":[' * n + "1" + "]}" * n
    found = links(text)
    assert len(found) == n and found[-1] == (n - 1, n - 2)
    assert links(text[:-1]) == []


def test_deep_decoder_agrees():
    rng = random.Random(9)
    for _ in range(200):
        text = json.dumps(random_tree(rng), indent=rng.choice([None, 2]))
        assert N._decode_deep(text) == N._decode(text)
        for cut in (text[:-1], text + "]", text.replace(":", "", 1), text.replace(",", ",,", 1)):
            try:
                want = N._decode(cut)
            except ValueError:
                want = "bad"
            try:
                got = N._decode_deep(cut)
            except ValueError:
                got = "bad"
            assert got == want, cut


def test_tables(spark):
    df = spark.createDataFrame([(1, '{"tag":"p","c":[{"tag":"r","text":"x"},{"x":{"tag":"r","attrs":{"id":"5"}}}]}', "z"), (2, None, "z"), (3, "[]", "z")], "key long, tree string, ix string")
    e = N.flatten_trees(df, "key", "tree")
    assert [(r.owner_key, r.ix, r.parent_ix, r.tag, r.text, r.attrs) for r in e.orderBy("ix").collect()] == [(1, 0, None, "p", None, None), (1, 1, 0, "r", "x", None), (1, 2, 0, "r", None, '{"id": "5"}')]
    w = N.within(N.table_of(e, "r"), N.table_of(e, "p"))
    assert {(r.ix, r.outer_ix) for r in w.collect()} == {(1, 0), (2, 0)}
    assert N.flatten_trees(df.where("false"), "key", "tree").count() == 0


def test_children_and_spans(spark):
    kind = "doc string, k long, id string, kids array<string>, spans array<struct<part_id:string,start_off:int,end_off:int>>"
    nodes = spark.createDataFrame([("d", 1, "a", ["b", None, "b", "x"], [("p", 0, 1), (None, 1, 2)]), ("d", 2, "b", [], None), ("d", 2, "b", [], None)], kind)
    got = {(r.owner_key, r.item_ix, r.child_key) for r in N.explode_children(nodes, "doc", "k", "id", "kids").collect()}
    assert got == {(1, 0, 2), (1, 1, None), (1, 2, 2), (1, 3, None)}
    streams = spark.createDataFrame([("d", "p", 7), ("d", "p", 7), ("e", "p", 8)], "doc string, part string, sk long")
    got = {(r.owner_key, r.item_ix, r.stream_key) for r in N.explode_spans(nodes, "doc", "k", "spans", streams, "doc", "part", "sk").collect()}
    assert got == {(1, 0, 7), (1, 1, None)}
