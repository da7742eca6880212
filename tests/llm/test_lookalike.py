import unicodedata

from redloom.llm import lookalike as L

SAME = [
    ("profit-share escrow", "ｐｒｏｆｉｔ－ｓｈａｒｅ escrow"),
    ("profit-share escrow", "profit‐share escrow"),
    ("fa\xe7ade", "fac\u0327ade"),
    ("reflex escrow", "rе\xad​flех еѕсrоw"),
    ("final K9", "ﬁnal K9"),
    ("a b", "a\xa0b"),
    ("a b", "a　b"),
    ("TAKE", "ТАКЕ"),
    ("", "​﻿"),
    ("\u043e\u0301", "\xf3"),
    ("x\ny", "x\r\ny"),
]
DIFFERENT = [("façade", "facade"), ("a b", "ab"), ("a-b", "a—b"), ("A", "a"), ("a b", "a  b"), ("a, b", "a b"), ("a\nb", "a b"), ("½", "1/2"), ("x²", "x2")]


def plain(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r.k: r.plain for r in L.normalise_text(df, "text").collect()}


def test_pairs(spark):
    flat = [x for p in SAME + DIFFERENT for x in p]
    got = plain(spark, flat)
    for i, (a, b) in enumerate(SAME + DIFFERENT):
        assert (got[2 * i] == got[2 * i + 1]) == (i < len(SAME)), (a, b, got[2 * i], got[2 * i + 1])
    assert all(got[k] == unicodedata.normalize("NFC", got[k]) for k in got)


def test_idempotent_null_long_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "c"), ("Ѕо it’s" * 20_000, "c")], "c1 string, c0 string")
    rows = L.normalise_text(df, "c1").collect()
    assert rows[0].plain is None and rows[1].plain == "So it’s" * 20_000 and rows[0].c0 == "c"
    again = L.normalise_text(spark.createDataFrame([(rows[1].plain,)], "t string"), "t").first()
    assert again.plain == rows[1].plain
    assert L.normalise_text(df.where("false"), "c1").count() == 0


def test_found(spark):
    streams = spark.createDataFrame([(1, "the first escrow holds"), (2, "the ﬁrst escrow holds"), (3, "the first escrow holds"), (4, "first escrow, held"), (5, None), (6, ""), (7, "First escrow"), (8, "the ﬁrst\nescrow"), (2, "the ﬁrst escrow holds")], "stream_key long, text string")
    groups = spark.createDataFrame([(10, "first escrow", ["lapse"]), (11, "ﬁrst escrow", []), (12, "first escrow", None), (13, None, ["holds"])], "group_key int, canonical string, synonyms array<string>")
    got = {tuple(r) for r in L.find_lookalikes(streams, groups).collect()}
    want = {("stream", 1, 2), ("stream", 2, 3), ("group", 10, 11), ("group", 11, 12)}
    want |= {("hit", g, s) for g in (10, 11, 12) for s in (1, 2, 3, 8)} | {("hit", 13, s) for s in (1, 2, 3)}
    assert got == want
