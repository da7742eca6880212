import hashlib
import random

import pytest
from pyspark.sql import functions as F

from redloom.functions import canon
from redloom.functions import text as T
from redloom.functions.stem import porter, stem_tokens, stemmer
from redloom.operators import chunks as C
from redloom.operators import evals, retrieval, revisions, structure, terms, views
from redloom.operators.skew import skew_join

STEMS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


def test_porter(spark):
    assert [(w, porter(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2]))
    assert [porter(w) for w in ("is", "naïve", "x2")] == ["is", "naïve", "x2"]
    df = spark.createDataFrame([(["relational", "is"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(stem_tokens(F.col("w"))).collect()] == [["relat", "is"], None]
    with pytest.raises(ValueError, match="stemmer"):
        stemmer("none")


def test_tokens(spark):
    df = spark.createDataFrame([("right- of No\xadn-Smoking ½ e\u0301 ß -x",), ("",), (None,)], "t string")
    rows = df.select(T.token_spans(F.col("t")).alias("j"), T.token_spans(F.col("t"), "split").alias("s")).collect()
    assert [(x.s, x.e, x.t) for x in rows[0].j] == [(0, 6, "right"), (7, 9, "of"), (10, 22, "nonsmoking"), (23, 24, "½"), (25, 27, "e\u0301"), (28, 29, "ss"), (31, 32, "x")]
    assert [x.t for x in rows[0].s] == ["right", "of", "no", "n", "smoking", "½", "e\u0301", "ss", "x"]
    assert rows[1].j == [] and rows[2].j is None
    n = spark.range(1, 60).select(T.letters_label(F.col("id")).alias("a"), T.roman_label(F.col("id")).alias("r")).collect()
    assert (n[0].a, n[25].a, n[26].a, n[53].a) == ("a", "z", "aa", "bbb") and (n[3].r, n[8].r, n[48].r) == ("iv", "ix", "xlix")
    assert spark.createDataFrame([("E\u0301ß",)], "t string").select(T.exact_fold(F.col("t"))).first()[0] == "\xe9ss"


def test_canonical_json(spark):
    text = 'a"\\\n\t\x0b\x1f/é'
    df = spark.createDataFrame([(text, 3, ["x", '"'], None)], "t string, n int, l array<string>, z string")
    got = df.select(canon.json_object(t=canon.json_text(F.col("t")), n=canon.json_number(F.col("n")), l=canon.json_texts(F.col("l")), z=canon.json_text(F.col("z"))).alias("j"), canon.hash_of(t=canon.json_text(F.col("t"))).alias("h")).first()
    assert got.j == canon.canonical({"t": text, "n": 3, "l": ["x", '"'], "z": None}) and got.h == canon.sha256_json({"t": text})


def pieces(spark, rows):
    return spark.createDataFrame([("d", "p", i, t, s) for i, (t, s) in enumerate(rows)], "document_id string, part_id string, piece_ord int, text string, stack array<string>")


def test_views(spark):
    s = views.build_spans(pieces(spark, [("Coverage ", ["ins:2"]), ("is ", ["ins:2", "del:3"]), ("excluded", ["ins:2", "del:3"]), ("", []), ("applies", []), ("\n", []), ("\n", []), ("gone", ["del:4"]), ("\n", [])]))
    assert [(r.start_off, r.end_off, r.text) for r in s.orderBy("span_ord").collect()] == [(0, 9, "Coverage "), (9, 20, "is excluded"), (20, 27, "applies"), (27, 28, "\n"), (28, 29, "\n"), (29, 33, "gone"), (33, 34, "\n")]
    text = {v: views.view_text(views.project(s, v)).first().text for v in views.VIEWS}
    assert text == {"accepted": "Coverage applies\n\n\n", "original": "applies\n\ngone\n", "superseded": "is excluded\n\n\n"}
    with pytest.raises(ValueError, match="view"):
        views.project(s, "other")
    m = spark.createDataFrame([("d", "p", "accepted", "m", 4, 12)], "document_id string, part_id string, view string, match_id string, start int, end int")
    a = views.project(s, "accepted")
    assert [(r.union_start, r.union_end) for r in views.union_spans(m, a).orderBy("union_start").collect()] == [(4, 9), (20, 23)]
    assert views.union_range(m, a).first().union_end == 23
    pts = spark.createDataFrame([("d", "p", "accepted", str(o), o) for o in (0, 9, 15, 20, 29, 33)], "document_id string, part_id string, view string, point_id string, offset int")
    assert {int(r.point_id): r.view_offset for r in views.view_offsets(pts, a).collect()} == {0: 0, 9: 9, 15: 9, 20: 9, 29: 18, 33: 18}


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(0)
    a = [("k", i, (s := rng.randrange(3000)), s + rng.randrange(0, 700)) for i in range(60)]
    b = [("k", i, (s := rng.randrange(3000)), s + rng.randrange(0, 700)) for i in range(60)]
    x = spark.createDataFrame(a, "k string, i int, s int, e int")
    y = spark.createDataFrame(b, "k string, j int, t int, u int")
    got = [(r.i, r.j) for r in views.overlap_join(x, y, ["k"], "s", "e", "t", "u").collect()]
    want = {(i, j) for _, i, s, e in a for _, j, t, u in b if s < u and t < e}
    assert len(got) == len(set(got)) and set(got) == want


def groups(spark, rows):
    return spark.createDataFrame(rows, "group_key int, canonical string, synonyms array<string>, stemming string")


def test_terms(spark):
    g = groups(spark, [(1, "non-compliance", ["breach of duty"], None), (2, "termination", ["end"], "porter"), (3, "aggregate limit", ["limit"], None)])
    terms.check_registry(g)
    forms = terms.compile_forms(g)
    texts = spark.createDataFrame([("d", "p", "Non compliance, noncompliance and NON-COMPLIANCE.\nTerminations end. The aggregate limit\nlimit; breach of\nduty")], "document_id string, part_id string, text string")
    got = {(r.group_key, r.start, r.end, r.match_type) for r in terms.match_texts(texts, forms).collect()}
    assert got == {(1, 0, 14, "exact"), (1, 16, 29, "exact"), (1, 34, 48, "exact"), (2, 50, 62, "stem"), (2, 63, 66, "synonym"), (3, 72, 87, "exact"), (3, 88, 93, "synonym")}
    assert {(r.group_key, r.match_type) for r in terms.cross_line_misses(texts, forms).collect()} == {(1, "synonym")}
    assert terms.resolve_group(forms, "Aggregate-Limit") is None or terms.resolve_group(forms, "aggregate  LIMIT") == 3
    assert terms.resolve_group(forms, "nothing") is None
    for bad in ([(1, "a", None, None), (2, "a", None, None)], [(1, "a\nb", None, None)], [(1, "!", None, None)], [(1, "a", None, "unknown")]):
        with pytest.raises(ValueError):
            terms.check_registry(groups(spark, bad))
    two = terms.compile_forms(groups(spark, [(1, "cap", None, None), (2, "Cap", None, None)]))
    with pytest.raises(ValueError, match="several"):
        terms.resolve_group(two, "CAP")
    assert terms.registry_hash([{"canonical": "b"}, {"canonical": "a", "synonyms": ["y", "x"]}]) == terms.registry_hash([{"canonical": "a", "synonyms": ["x", "y"]}, {"canonical": "b"}])


def test_resolution_against_brute_force(spark):
    rng = random.Random(8)
    rows = [("d", "p", seg, 1, (s := rng.randrange(20)), s + rng.randrange(1, 6), rng.randrange(1, 4)) for seg in range(60) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "document_id string, part_id string, seg_ix int, group_key int, start int, end int, rank int")
    got = {(r.seg_ix, r.start, r.end, r["rank"]) for r in terms.resolve(df).collect()}
    want = set()
    for seg in range(60):
        best = {}
        for r in rows:
            if r[2] == seg:
                best[r[4], r[5]] = min(best.get((r[4], r[5]), 9), r[6])
        kept = []
        for (s, e), k in sorted(best.items(), key=lambda x: (x[0][0] - x[0][1], x[0][0], x[1])):
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, k))
        want |= {(seg, *x) for x in kept}
    assert got == want


def test_hit_folding(spark):
    kind = "document_id string, group_key int, move_group_id string, norm_text string, present_in array<string>, hit_ord int"
    h = spark.createDataFrame([("d", 1, "m", "x", ["original"], 1), ("d", 1, "m", "x", ["original"], 2), ("d", 1, "m", "x", ["accepted"], 3), ("d", 1, None, "x", ["accepted"], 4)], kind)
    assert {(r.hit_ord, r.n_ends) for r in terms.fold_moves(h).collect()} == {(1, 2), (2, 1), (4, 1)}
    v = "array<struct<view:string,s:int,e:int>>"
    k = spark.createDataFrame([("d", 1, 1, [("a", 0, 3)]), ("d", 1, 2, [("a", 0, 3), ("o", 5, 8)]), ("d", 1, 3, [("o", 5, 8)]), ("d", 1, 4, [])], f"document_id string, group_key int, hit_ord int, view_spans {v}")
    assert {r.hit_ord for r in terms.dedupe_hits(k).collect()} == {1, 3, 4}
    m = spark.createDataFrame([("d", "n", 1, [(0, 3)], "original", 0, 3, 2, 5), ("d", "n", 1, [(0, 3)], "accepted", 1, 4, 1, 6)], "document_id string, node_id string, group_key int, spans array<struct<a:int,b:int>>, view string, view_start int, view_end int, rank int, ord int")
    r = terms.merge_views(m).first()
    assert r.present_in == ["accepted", "original"] and r.match_type == "exact" and r.hit_ord == 5


def test_sections_and_assignment(spark):
    rng = random.Random(2)
    rows = [("d", i, f"t{i}", rng.choice([0, 1, 2, 3, None])) for i in range(40)]
    got = structure.build_sections(spark.createDataFrame(rows, "document_id string, node_ord int, title string, stated_level int")).orderBy("pre_order").collect()
    stack = []
    for r, (_, _, title, stated) in zip(got, rows):
        level = stated if stated is not None else next((x[1] + 1 for x in reversed(stack) if x[2]), 1)
        while stack and stack[-1][1] >= level:
            stack.pop()
        assert (r.title, r.level, r.parent_ix, r.path) == (title, level, stack[-1][3] if stack else None, [*(x[0] for x in stack), title])
        stack.append((title, level, stated is not None, r.pre_order))


def test_packing_and_tables(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(0, 60) for _ in range(80)]
    b = spark.createDataFrame([("d", i, n, False, False) for i, n in enumerate(sizes)], "doc string, o int, n int, h boolean, i boolean")
    got = [r.chunk_no for r in C.pack_blocks(b, ["doc"], "o", "n", 100).orderBy("o").collect()]
    want, fill, no = [], None, 0
    for n in sizes:
        if fill is not None and fill + 1 + n > 100:
            no, fill = no + 1, n
        else:
            fill = n if fill is None else fill + 1 + n
        want.append(no)
    assert got == want
    h = spark.createDataFrame([("d", 0, 50, False, False), ("d", 1, 10, True, False), ("d", 2, 80, False, False), ("d", 3, 5, False, True), ("d", 4, 5, False, True), ("d", 5, 5, False, False), ("d", 6, 5, False, True)], "doc string, o int, n int, h boolean, i boolean")
    assert [r.chunk_no for r in C.pack_blocks(h, ["doc"], "o", "n", 100, "h", "i").orderBy("o").collect()] == [0, 1, 1, 2, 2, 3, 3]
    t = spark.createDataFrame([("t", i, n) for i, n in enumerate([10, 40, 40, 95, 5])] + [("u", 0, 500)], "t string, ix int, n int")
    assert [(r.t, r.group_no) for r in C.split_table_rows(t, ["t"], "ix", "n", 100).orderBy("t", "ix").collect()] == [("t", 0), ("t", 0), ("t", 0), ("t", 1), ("t", 2), ("u", 0)]


def test_small_sections_dissolve(spark):
    kind = "document_id string, section_ix int, parent_ix int, own_size int, has_list_run boolean, n_blocks int"
    s = spark.createDataFrame([("d", 0, None, 10, False, 1), ("d", 1, 0, 50, False, 1), ("d", 2, 1, 50, False, 1), ("d", 3, 0, 50, True, 1), ("d", 4, 0, 500, False, 0), ("d", 5, 4, 5, False, 1)], kind)
    assert {r.section_ix: r.merged_into for r in C.merge_small(s, 100).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_identity_and_churn(spark):
    c = spark.createDataFrame([("d", "accepted", i, t) for i, t in enumerate(["x", "y", "x"])], "document_id string, view_id string, chunk_ord int, text string")
    rows = C.identify(c).orderBy("chunk_ord").collect()
    assert rows[0].content_hash == rows[2].content_hash == canon.sha256_json({"text": "x", "view_id": "accepted", "textmodel_version": "1"})
    assert [r.occurrence_index for r in rows] == [0, 0, 1] and len({r.chunk_id for r in rows}) == 3
    assert C.ChunkParams().hash() != C.ChunkParams(size_cap=1).hash()
    old, new = (spark.createDataFrame([(x,) for x in s], "content_hash string") for s in ("aab", "abc"))
    assert sorted((r.content_hash, r.change) for r in C.churn(old, new).collect()) == [("a", "gone"), ("c", "new")]


def test_comments_and_pending(spark):
    bodies = spark.createDataFrame([("d", "1", "A1"), ("d", "2", "A2"), ("e", "1", "B1")], "document_id string, comment_id string, para_id string")
    ranges = spark.createDataFrame([("d", "1", "p", 5, 9, 1), ("d", "1", "p", 0, 2, 0), ("d", "9", "p", 0, 1, 2)], "document_id string, comment_id string, part_id string, start_off int, end_off int, ord int")
    ext = spark.createDataFrame([("d", "A1", None, "1", 0), ("d", "A1", "x", "0", 1)], "document_id string, para_id string, parent_para_id string, done string, ord int")
    got = {(r.document_id, r.comment_id): r for r in revisions.assemble_comments(bodies, ranges, ext).collect()}
    assert got["d", "1"].anchor.start_off == 0 and got["d", "1"].resolved is True and got["d", "1"].threading_status == "verified"
    assert got["d", "2"].threading_status == "unknown" and got["e", "1"].threading_status == "absent"
    assert revisions.comment_gaps(revisions.assemble_comments(bodies, ranges, None), ranges).count() == 3
    spans = views.build_spans(pieces(spark, [("abc", ["ins:1"]), ("d" * 300, ["ins:1", "del:2"]), ("\n", [])]))
    chunk = spark.createDataFrame([("d", "p", "c", 1, 304)], "document_id string, part_id string, chunk_key string, start_off int, end_off int")
    rec = spark.createDataFrame([("d", "ins:1", 'A "x"]', None, None), ("d", "del:9", "B", "2026", "g")], "document_id string, revision_id string, author string, date string, move_group_id string")
    on = revisions.stacked(chunk, spans)
    pend = {r.revision_id: r for r in revisions.pending_changes(on, rec).collect()}
    assert pend["ins:1"].first_start == 1 and pend["ins:1"].excerpt.endswith(revisions.CUT_MARK) and pend["del:2"].author is None
    assert revisions.document_pending(rec, on).first().n_unattributed == 1
    assert revisions.render_markup(spans.where("span_ord = 1"), ["document_id"], rec).first().markup == '[[ins author="A \\"x\\"\\]"]]abc[[/ins]]'
    flags = spark.createDataFrame([("t", True), ("t", None), ("n", None), ("n", False), ("f", False)], "k string, f boolean")
    assert {r.k: r.x for r in flags.groupBy("k").agg(revisions.three_state_any(F.col("f")).alias("x")).collect()} == {"t": True, "n": None, "f": False}


def test_search_and_compare(spark):
    leaves = spark.createDataFrame([("d", "n1", "accepted", "a b a b a"), ("d", "n2", "accepted", "a-b"), ("e", "n3", "accepted", "b a")], "document_id string, node_id string, view string, text string")
    owner = spark.createDataFrame([("d", "n1", "c1"), ("d", "n2", "c2"), ("e", "n3", "c3")], "document_id string, node_id string, chunk_id string")
    text = retrieval.text_tier(leaves, owner, "A b")
    assert {(r.chunk_id, r.start, r.end) for r in text.collect()} == {("c1", 0, 3), ("c1", 4, 7)}
    assert retrieval.text_tier(leaves, owner, "!").count() == 0
    sums = spark.createDataFrame([("e", "c3", "nothing", ["about a b"]), ("d", "c1", "x", None)], "document_id string, chunk_id string, text string, topics array<string>")
    hits = spark.createDataFrame([("d", 1, "n2", None, [], "body", 0, 3), ("e", 1, "cm", "n3", ["original"], "comment", 0, 1)], "document_id string, group_key int, node_id string, context_node_id string, present_in array<string>, location string, start int, end int")
    places = spark.createDataFrame([("d", "c1", 0), ("d", "c2", 1), ("e", "c3", 0)], "document_id string, chunk_id string, chunk_ord int")
    tiers = [retrieval.term_tier(hits, owner, 1, ("accepted",)), text, retrieval.summary_tier(sums, "A b")]
    assert [(r.chunk_id, r.tier) for r in retrieval.search(tiers, places).collect()] == [("c2", 1), ("c1", 2), ("c3", 3)]
    assert [r.chunk_id for r in retrieval.search(tiers, places, ("summary",)).collect()] == ["c3"]
    with pytest.raises(ValueError, match="sources"):
        retrieval.search(tiers, places, ("other",))
    c = spark.createDataFrame([("a", "v", "1", "h"), ("a", "v", "2", "h"), ("a", "w", "9", "h"), ("b", "v", "2", "x"), ("b", "v", "3", "h")], "document_id string, view_id string, chunk_id string, context_hash string")
    assert {(r.view_id, r.chunk_id, r.change) for r in retrieval.compare(c, "a", "b").collect()} == {("v", "1", "only_a"), ("v", "2", "context_changed"), ("v", "3", "only_b")}
    docs = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "U")], "document_id string, title string")
    assert retrieval.resolve_document(docs, "U") == "c" and retrieval.resolve_document(docs, "a") == "a"
    with pytest.raises(ValueError, match="2 documents"):
        retrieval.resolve_document(docs, "T")
    with pytest.raises(ValueError, match="places"):
        retrieval.get_chunk(c, "2")
    assert retrieval.get_chunk(c, "2", document_id="a").count() == 1


def test_evals(spark):
    facts = spark.createDataFrame([("f", "d", "a", "1", "1", True), ("f", "d", "b", "1", None, True), ("f", "d", "c", None, "x", False), ("g", "d", "c", None, "x", False)], "family string, document string, what string, want string, got string, stated boolean")
    assert {r.family: (r.n_compared, r.n_failed, r.n_skipped, r.accuracy) for r in evals.score_facts(facts).collect()} == {"f": (2, 1, 1, 0.5), "g": (0, 0, 1, 0.0)}
    assert [r.what for r in evals.examples(facts).collect()] == ["b"]
    want = spark.createDataFrame([("d", "Two  Words"), ("d", "x"), ("e", None)], "doc string, term string")
    got = spark.createDataFrame([("d", "two words"), ("d", "more")], "doc string, term string")
    rows = evals.recall(want, got, ["doc"])
    assert {r.doc: r.recall for r in rows.collect()} == {"d": 0.5, "e": None} and evals.total_recall(rows).first().recall == 0.5
    assert [r.t for r in evals.unclassified(got, want, ["doc"]).collect()] == ["more"]
    many = spark.range(100).select(F.col("id").alias("k"))
    assert [r.k for r in evals.even_sample(many, ["k"], 4).orderBy("k").collect()] == [0, 33, 66, 99]
    calls = spark.createDataFrame([("miss", 5, None), ("miss", 7, 1), ("hit", None, None)], "cache string, prompt_tokens int, answer_tokens int")
    assert tuple(evals.cost(calls).first()) == (2, 1, 12, None)
    s = spark.createDataFrame([("d", "c1", "h"), ("d", "c2", "h"), ("d", "c3", "h"), ("d", "c4", "h")], "document_id string, chunk_id string, prompt_hash string")
    g = spark.createDataFrame([("d", "c1", "h", {"a": "1", "b": "2"}), ("d", "c2", "h", {"a": "1"}), ("d", "c3", "old", {"a": "1", "b": "2"})], "document_id string, chunk_id string, prompt_hash string, criteria map<string,string>")
    assert {r.chunk_id: r.state for r in evals.grade_states(s, g, ["a", "b"]).collect()} == {"c1": "graded", "c2": "partial", "c3": "stale", "c4": "ungraded"}
    f = evals.fingerprint(got, ["doc"], F.col("term")).first()
    hs = sorted(hashlib.sha256(x.encode()).hexdigest() for x in ("two words", "more"))
    assert f.fingerprint == hashlib.sha256("".join(hs).encode()).hexdigest()
    assert evals.gate_failures({"a": 0.5, "b": None}, {"a": 1.0, "b": 1.0}) == ["a: 0.5 < 1.0"]
    cells = spark.createDataFrame([("d", "t", r_, c_) for r_, n in enumerate([3, 2]) for c_ in range(n)], "document_id string, table_id string, row_ix int, col_ix int")
    t = evals.table_shape(cells).first()
    assert (t.n_rows, t.n_columns, [tuple(m) for m in t.merges]) == (2, 3, [(1, 1, 2)])


def test_skew_join(spark):
    left = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("hot"), F.col("id")).select(F.when(F.col("hot") == 1, 0).otherwise(F.col("id") % 500).alias("k"), "id")
    right = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a = skew_join(left, right, ["k"], "left", spread=F.col("id"), hot_rows=100)
    b = left.join(right, ["k"], "left")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_scratch(spark):
    from redloom import session

    df = session.staged(spark.range(3), "x")
    name = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and session.path_exists(spark, name)
    session.discard(df)
    assert not session.path_exists(spark, name)
    kept = session.staged(spark.range(3), "y").inputFiles()[0].rsplit("/", 1)[0]
    session.drop_scratch(spark)
    assert not session.path_exists(spark, kept)


def test_search_many_queries(spark, data):
    leaves = spark.createDataFrame([("d", "n1", "accepted", "a b a b a"), ("d", "n2", "accepted", "a-b"), ("e", "n3", "accepted", "b a")], "document_id string, node_id string, view string, text string")
    owner = spark.createDataFrame([("d", "n1", "c1"), ("d", "n2", "c2"), ("e", "n3", "c3")], "document_id string, node_id string, chunk_id string")
    sums = spark.createDataFrame([("e", "c3", "nothing", ["about a b"]), ("d", "c1", "b", None)], "document_id string, chunk_id string, text string, topics array<string>")
    hits = spark.createDataFrame([("d", 1, "n2", None, [], "body", 0, 3), ("e", 2, "cm", "n3", ["accepted"], "comment", 0, 1)], "document_id string, group_key int, node_id string, context_node_id string, present_in array<string>, location string, start int, end int")
    places = spark.createDataFrame([("d", "c1", 0), ("d", "c2", 1), ("e", "c3", 0)], "document_id string, chunk_id string, chunk_ord int")
    asked = retrieval.text_queries(spark.createDataFrame([(7, "A b"), (8, "b"), (9, "!"), (10, None)], "id int, q string"), "id", "q")
    groups = spark.createDataFrame([(7, 1), (8, 2)], "query_id int, group_key int")
    tiers = [retrieval.term_tier(hits, owner, groups, ("accepted",)), retrieval.text_tier(leaves, owner, asked), retrieval.summary_tier(sums, asked)]
    got = [(r.query_id, r.chunk_id, r.tier, r.sources) for r in retrieval.search(tiers, places).collect()]
    assert got == [(7, "c2", 1, ["term"]), (7, "c1", 2, ["text"]), (7, "c3", 3, ["summary"]), (8, "c3", 1, ["summary", "term", "text"]), (8, "c1", 2, ["summary", "text"])]
    import __spark_entry__

    wanted = {r[0] for r in spark.read.parquet(f"{data}/term_groups.parquet").where("group_key % 20 = 0").select("group_key").collect()}
    found = {r.query_id for r in __spark_entry__.queries()["search_tiered"](spark, data).select("query_id").distinct().collect()}
    assert len(wanted) > 1 and found <= wanted


def test_tile_defects_at_ends(spark, tmp_path):
    import __spark_entry__

    span = "array<struct<part_id:string,start_off:int,end_off:int,fragment_id:string>>"
    whole = [("p", 0, 3, None), ("p", 3, 6, None)]
    nodes = [("1", "d", whole), ("2", "short", whole[:1]), ("3", "long", whole)]
    kind = f"node_key string, document_id string, spans {span}"
    n = spark.createDataFrame(nodes, kind).selectExpr("*", "0 as node_ord", "'para' as kind", "array('x') as section_path", "current_timestamp() as received_at")
    n.write.parquet(str(tmp_path / "nodes.parquet"))
    s = spark.createDataFrame([("1", "d", "p", "abcdef"), ("2", "short", "p", "abcdef"), ("3", "long", "p", "abc"), ("4", "none", "p", "ab"), ("5", "empty", "p", "")], "stream_key string, document_id string, part_id string, text string")
    s.write.parquet(str(tmp_path / "streams.parquet"))
    got = __spark_entry__.queries()["tile_defects"](spark, str(tmp_path)).collect()
    assert {(r.document_id, r.at_off, r.expected) for r in got} == {("short", 3, 6), ("long", 6, 3), ("none", 0, 2)}


def test_moved_terms_union_places_and_coverage(spark):
    kind = "document_id string, group_key int, node_id string, context_node_id string, present_in array<string>, location string, start int, end int, hit_ord int, view_spans array<struct<view:string,s:int,e:int>>, move_group_id string, norm_text string"
    rows = [("d", 1, "n1", None, ["original"], "body", 0, 3, 1, [("original", 0, 3)], "m", "x"), ("d", 1, "n2", None, ["accepted"], "body", 9, 12, 2, [("accepted", 9, 12)], "m", "x")]
    rows += [("d", 1, "n2", None, ["accepted"], "body", 8, 12, 3, [("accepted", 9, 12)], None, None), ("d", 1, "n3", None, ["accepted"], "body", 9, 12, 4, [("accepted", 9, 12)], None, None)]
    hits = spark.createDataFrame(rows, kind)
    owner = spark.createDataFrame([("d", "n1", "c1"), ("d", "n2", "c2"), ("d", "n3", "c3")], "document_id string, node_id string, chunk_id string")
    got = {(r.chunk_id, r.node_id, r.start, r.end) for r in retrieval.term_tier(hits, owner, 1, ("accepted", "original")).collect()}
    assert got == {("c1", "n1", 0, 3), ("c1", "n2", 9, 12), ("c3", "n3", 9, 12)}
    # "a DEL b" reads "a b" in the accepted view
    spans = spark.createDataFrame([("d", "p", 0, "x\n", []), ("d", "p", 1, "a ", []), ("d", "p", 2, "DEL ", ["del:1"]), ("d", "p", 3, "b", [])], "document_id string, part_id string, piece_ord int, text string, stack array<string>")
    p = views.project(views.build_spans(spans), "accepted")
    leaves = spark.createDataFrame([("d", "n1", "p", "accepted", 2, "a b")], "document_id string, node_id string, part_id string, view string, view_base int, text string")
    assert {(r.start, r.end) for r in retrieval.text_tier(leaves, owner, "a b", p).collect()} == {(2, 4), (8, 9)}
    s = spark.createDataFrame([("d", "p", "ab\ncd\nef"), ("d", "q", "\n"), ("d", "r", "xy")], "document_id string, part_id string, text string")
    n = spark.createDataFrame([("d", "p", 0, 2), ("d", "p", 0, 1), ("d", "p", 6, 7)], "document_id string, part_id string, start_off int, end_off int")
    assert {(r.part_id, r.start_off, r.end_off) for r in evals.uncovered(n, s).collect()} == {("p", 2, 6), ("p", 7, 8), ("r", 0, 2)}
