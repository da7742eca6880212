import random

from redloom.llm import splitting as S


def check(text, cap, least, overlap):
    pieces = S.split_text(text, cap, least, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= cap for a, b, _, _ in pieces) and all(b > a for a, b, _, _ in pieces)
    assert all(y[0] == x[1] - min(overlap, cap - 1) for x, y in zip(pieces, pieces[1:]))
    # overlaps taken off, the text comes back whole
    assert "".join(text[max(a, end) : b] for (a, b, _, _), end in zip(pieces, [0, *(p[1] for p in pieces)])) == text
    return pieces


def test_random_texts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "a", ". ", "\n", "é", "́", "longer text, ", "Sentence ends. "]) for _ in range(rng.randrange(1, 400)))
        cap = rng.randrange(1, 120)
        if len(text) > cap:
            check(text, cap, rng.randrange(0, cap + 1), rng.randrange(0, cap * 2))


def test_edges():
    assert S.split_text("", 10) == [(0, 0, "end", 0.0)]
    assert S.split_text("x" * 10, 10) == [(0, 10, "end", 0.0)]
    assert S.split_text("x" * 11, None) == [(0, 11, "end", 0.0)]
    assert [p[2] for p in check("x" * 25, 10, 0, 3)] == ["hard", "hard", "hard", "end"]
    check("a" + "́" * 50, 10, 0, 0)
    assert check("one two three four", 10, 0, 0)[0][2] == "blank"
    assert check("one, two three four", 6, 0, 0)[0][2] == "clause"


def test_deepest_valley_is_the_topic_change():
    a = ["The boiler heats water in the boiler house. ", "Water pressure in the boiler rises. ", "The boiler valve lets water out. "]
    b = ["A violin has four strings of gut. ", "The violin bow pulls on strings. ", "Strings on a violin need tuning. "]
    text = "".join(a * 2 + b * 2)
    pieces = check(text, len(text) - 40, 60, 0)
    assert pieces[0][1] == len("".join(a * 2)) and pieces[0][2] == "sentence"


def test_operator(spark):
    blocks = spark.createDataFrame([(1, "x " * 30, None, None), (1, "x " * 30, None, None), (2, "ab\ncd", [(0, "ab"), (1, "c" * 50), (2, None)], 2), (3, None, None, 9), (4, "y" * 45, None, 9)], "block_key long, text string, row_items array<struct<row_ix:int,text:string>>, params_id int")
    params = spark.createDataFrame([(1, 20, 5, 4), (2, 10, 2, 3)], "params_id int, size_cap int, min_size int, overlap_cp int")
    p = S.split_items(S.block_items(blocks, params)).collect()
    assert {(r.owner_key, r.item_ix) for r in p if r.n_pieces > 1} == {(1, -1), (2, 1)}
    assert all(len(r.piece) == r.end_off - r.start_off for r in p) and {(r.owner_key, r.item_ix) for r in p} == {(1, -1), (2, -1), (2, 0), (2, 1), (4, -1)}
    assert all(r.size_cap is None or len(r.piece) <= r.size_cap for r in p)
    assert S.split_items(S.block_items(blocks.where("false"), params)).count() == 0
