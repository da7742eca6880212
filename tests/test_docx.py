import io
import zipfile

import pytest

from redloom.sources import docx
from redloom.sources.docx import PackageError, parse_package
from redloom.sources.writer import package_bytes
from tests.packages import deleted, p, package, r, rev


def rows(data, kind):
    return [x for k, x in parse_package(data) if k == kind]


def spans(data, part="officeDocument:0"):
    return [(s["text"], s["stack"]) for s in rows(data, "span") if s["part_id"] == part]


def gaps(data):
    return [g["gap"] for g in rows(data, "gap")]


def test_nested_revisions():
    body = p(rev("ins", r("Coverage ") + rev("del", deleted("is excluded"), "3") + r("applies."), "2"))
    d = package(body)
    assert spans(d) == [("Coverage ", ["ins:2"]), ("is excluded", ["ins:2", "del:3"]), ("applies.", ["ins:2"]), ("\n", [])]
    assert [(x["revision_id"], x["kind"], x["ancestors"]) for x in rows(d, "revision")] == [("ins:2", "ins", []), ("del:3", "del", ["ins:2"])]
    assert gaps(d) == []


def test_special_characters_and_fields():
    fld = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    body = p("<w:r><w:t>a</w:t><w:tab/><w:t>b\nc</w:t><w:br/><w:softHyphen/><w:noBreakHyphen/><w:sym w:char=\"F0B7\"/><w:sym w:char=\"zz\"/></w:r>")
    body += p("<w:r><w:t>x</w:t></w:r>" + fld("begin") + "<w:r><w:instrText>PAGE</w:instrText><w:t>hidden</w:t></w:r>" + fld("separate") + r("7") + fld("end") + r("!"))
    assert [t for t, _ in spans(package(body))] == ["a\tb\x0bc\x0b\xad‑\uf0b7", "\n", "x7!", "\n"]


def test_ids_collisions_and_missing():
    body = p(rev("ins", r("a"), "1") + rev("ins", r("b"), "1", author="Other") + rev("del", deleted("c"), None) + rev("ins", r("d"), "1"))
    d = package(body)
    assert [s for _, s in spans(d)] == [["ins:1"], ["ins:1~1"], ["del:noid1"], ["ins:1"], []]
    assert set(gaps(d)) == {"revision_id_collision", "revision_missing_id"}


def test_moves_and_paragraph_marks():
    body = p('<w:moveFromRangeStart w:id="9" w:name="mg1"/>' + rev("moveFrom", r("moved"), "4") + '<w:moveFromRangeEnd w:id="9"/>')
    body += p(r("kept"), "<w:rPr>" + rev("del", "", "6") + "</w:rPr>")
    d = package(body)
    assert [(x["revision_id"], x["move_group_id"]) for x in rows(d, "revision")] == [("moveFrom:4", "mg1"), ("del:6", None)]
    assert gaps(d) == ["paragraph_mark_revision"]


def test_node_identity_and_containers():
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("same", para="10000001") + p("same") + p("same") + p("") + f"<w:tbl><w:tr>{cell('one')}{cell('two')}</w:tr></w:tbl>" + f"<w:sdt><w:sdtContent>{p('in')}</w:sdtContent></w:sdt>"
    d = package(body)
    n = rows(d, "node")
    assert [x["kind"] for x in n] == ["para"] * 4 + ["table", "row", "cell", "para", "cell", "para", "sdt", "para"]
    assert [x["id_stability"] for x in n[:4]] == ["paraid", "content_hash", "content_hash", "path"] and n[1]["node_id"] != n[2]["node_id"]
    assert n[4]["child_ids"] == [n[5]["node_id"]] and n[7]["parent_id"] == n[6]["node_id"] and n[4]["start_off"] is None
    stream = rows(d, "stream")[0]["text"]
    assert stream[n[6]["start_off"] : n[6]["end_off"]] == "one" and "duplicate_content_id_churn" in gaps(d)


def test_headings_lists_styles():
    styles = '<w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="K"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:pPr><w:outlineLvl w:val="3"/></w:pPr></w:style><w:style w:styleId="X"><w:basedOn w:val="Y"/></w:style><w:style w:styleId="Y"><w:basedOn w:val="X"/></w:style>'
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num>'
    item = lambda t, lvl=0: p(t, f'<w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="5"/></w:numPr>')
    body = p("Two", '<w:pStyle w:val="H"/>') + p("Four", '<w:pStyle w:val="K"/>') + p(r("Bold", "<w:b/>")) + p(r("Not", '<w:b w:val="0"/>')) + item("a") + item("b", 1) + item("c", 1) + item("d") + item("e", 1) + p("loop", '<w:pStyle w:val="X"/>')
    d = package(body, styles=styles, numbering=numbering)
    n = rows(d, "node")
    assert [(x["kind"], x["level"]) for x in n[:4]] == [("heading", 2), ("heading", 4), ("heading", None), ("para", None)]
    assert [x["numbering_label"] for x in n[4:9]] == ["1.", "1.i", "1.ii", "2.", "2.i"]
    assert n[0]["fired_rules"] == ["style"] and n[1]["fired_rules"] == ["outline_inherited"] and n[2]["fired_rules"] == ["bold_short"]
    assert gaps(d) == ["style_chain_cycle"]


def test_comments():
    c = lambda i, t, para: f'<w:comment w:id="{i}" w:author="T" w:initials="T">{p(t, para=para)}</w:comment>'
    mark = lambda k, i: f'<w:commentRange{k} w:id="{i}"/>'
    body = p(mark("Start", 1) + r("anchored") + mark("End", 1) + r(" rest")) + p(mark("Start", 2) + r("never closed"))
    ext = '<w15:commentEx w15:paraId="A1" w15:done="1"/><w15:commentEx w15:paraId="A2" w15:paraIdParent="A1" w15:done="maybe"/><w15:commentEx w15:paraId="A3" w15:paraIdParent="DEAD"/>'
    d = package(body, comments=c(1, "root", "A1") + c(2, "reply", "A2") + c(3, "lost", "A3") + c(4, "late", "A4"), commentsExtended=ext)
    got = {x["comment_id"]: x for x in rows(d, "comment")}
    assert got["1"]["anchor_text"] == "anchored" and got["1"]["resolved"] is True and got["1"]["threading_status"] == "verified"
    assert got["2"]["anchor_start"] is None and got["2"]["parent_id"] == "A1" and got["2"]["resolved"] is None
    assert got["4"]["threading_status"] == "unknown" and set(gaps(d)) == {"unanchored_comment", "dangling_comment_parent"}
    alone = rows(package(body, comments=c(1, "root", "A1")), "comment")
    assert alone[0]["threading_status"] == "absent" and alone[0]["text"] == "root"


def test_skipped_text():
    box = "<w:r><w:pict><wps:txbx><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></wps:txbx></w:pict></w:r>"
    d = package(p(r("a") + box) + "<w:altChunkX><w:p><w:r><w:t>lost</w:t></w:r></w:p></w:altChunkX>" + p('<w:sdt><w:sdtContent><w:r><w:t>in</w:t></w:r></w:sdtContent></w:sdt>') + p(r("f", "<w:rPrChange/>")))
    assert [t for t, _ in spans(d)] == ["a", "\n", "in", "\n", "f", "\n"]
    assert gaps(d) == ["inline_sdt_transparent", "textbox", "unrecognized_container", "unrecorded_revision_kind"]


def test_strict_parts_and_order():
    d = package(p("body"), strict=True, header=p("top"), footnotes=f'<w:footnote w:id="1">{p("note")}</w:footnote>')
    assert [(s["part_id"], s["text"]) for s in rows(d, "stream")] == [("officeDocument:0", "body\n"), ("header:0", "top\n"), ("footnotes:0", "note\n")]
    assert [x["content_type"].rsplit(".", 1)[-1] for x in rows(d, "part")][0] == "main+xml"
    assert any(x["part_name"] is None for x in rows(d, "rel"))


def test_refusals():
    for data in (b"", b"no zip", package("<w:p>"), package(p("x"), extra={"word/document.xml": "<!DOCTYPE a><a/>"})):
        with pytest.raises(PackageError):
            parse_package(data)
    assert docx.resolve_target("word/document.xml", "../x/a.xml") == "x/a.xml" and docx.resolve_target("word/d.xml", "/w/a.xml") == "w/a.xml"
    assert [docx.format_number(n, k) for n, k in ((27, "lowerLetter"), (28, "upperLetter"), (1994, "upperRoman"), (3, "decimalZero"), (3, "none"))] == ["aa", "BB", "MCMXCIV", "03", ""]


def test_read_packages_tables(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(p("one") + p("two")))
    (tmp_path / "bad.docx").write_bytes(b"broken")
    parsed = docx.read_packages(spark, str(tmp_path)).cache()
    t = docx.tables_of(parsed)
    assert [r_.text for r_ in t["stream"].collect()] == ["one\ntwo\n"] and t["error"].count() == 1 and t["node"].count() == 2
    from redloom.operators.evals import tile_defects

    assert tile_defects(t["span"], t["stream"]).count() == 0


def test_too_large_a_file_gives_an_error_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(docx, "MAX_TOTAL", 10)
    (tmp_path / "large.docx").write_bytes(b"x" * 11)
    (tmp_path / "small.docx").write_bytes(b"x" * 10)
    rows = docx.read_packages(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.row_type) for r in rows) == [("large.docx", "error"), ("small.docx", "error")]
    t = docx.tables_of(docx.read_packages(spark, str(tmp_path)))
    assert "the file has 11 bytes, more than 10" in {r.error for r in t["error"].collect()}


def test_one_bad_package_never_fails_the_job(spark, tmp_path):
    good = package(p("fine"))
    with zipfile.ZipFile(io.BytesIO(good)) as z:
        at = z.getinfo("word/document.xml").header_offset
    packed = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(good)) as z, zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for i in z.infolist():
            out.writestr(i.filename, z.read(i))
    damaged = bytearray(packed.getvalue())
    with zipfile.ZipFile(io.BytesIO(packed.getvalue())) as z:
        at = z.getinfo("word/document.xml").header_offset + 30 + len("word/document.xml")
    damaged[at : at + 12] = b"\xff" * 12
    deep = package("<w:tbl><w:tr><w:tc>" * 2000 + p("x") + "</w:tc></w:tr></w:tbl>" * 2000)
    odd = package(p("odd", '<w:outlineLvl w:val="x"/><w:numPr><w:ilvl w:val="?"/><w:numId w:val="5"/></w:numPr>'), numbering='<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="y"><w:start w:val="z"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num>')
    for name, data in (("good", good), ("damaged", bytes(damaged)), ("deep", deep), ("odd", odd)):
        (tmp_path / f"{name}.docx").write_bytes(data)
    t = docx.tables_of(docx.read_packages(spark, str(tmp_path)).cache())
    assert t["error"].count() == 2 and sorted(r_.text for r_ in t["stream"].collect()) == ["fine\n", "odd\n"]


def test_hidden_runs_say_nothing():
    short = r("Bold", "<w:b/>")
    kinds = lambda body: [n["kind"] for n in rows(package(p(body)), "node")]
    assert kinds(short + rev("del", deleted("plain"))) == ["heading"] and kinds(rev("moveFrom", r("plain")) + short) == ["heading"]
    assert kinds(short + rev("ins", r("plain"))) == ["para"] and kinds(rev("del", deleted("all"))) == ["para"]
    assert kinds(short + "<w:r><w:tab/></w:r>") == ["heading"]


def test_revision_around_whole_paragraphs_is_a_gap():
    d = package(p("kept") + rev("ins", p("around")))
    assert [t for t, _ in spans(d)] == ["kept", "\n"] and gaps(d) == ["unrecognized_container"]


def test_written_packages_are_read_back():
    pieces = [("a<b", []), ("&", ["ins:1"]), ("gone", ["ins:1", "del:2"]), ("\n", []), ("\n", []), ("there", ["moveTo:3"]), ("\n", [])]
    c = {"comment_id": "1", "para_id": "0A", "author": 'A "B"', "initials": None, "date": "x", "text": "said", "parent_id": None, "resolved": False}
    d = package_bytes(pieces, [c, {**c, "comment_id": "2", "para_id": None, "resolved": None}])
    assert [(t, s) for t, s in spans(d)] == pieces
    got = rows(d, "comment")
    assert [(x["comment_id"], x["author"], x["initials"], x["text"], x["resolved"], x["threading_status"]) for x in got] == [("1", 'A "B"', None, "said", False, "verified"), ("2", 'A "B"', None, "said", None, "unknown")]


def test_documents_to_hits_and_chunks(spark, tmp_path):
    from redloom.operators import terms
    from redloom.operators.chunks import ChunkParams
    from redloom.plans import documents

    styles = '<w:style w:styleId="H"><w:name w:val="heading 1"/></w:style>'
    head = lambda t: p(t, '<w:pStyle w:val="H"/>')
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    note = f'<w:comment w:id="1" w:author="T">{p("the notice period", para="C1")}</w:comment>'
    body = p("Preamble") + head("One") + p(r("right of ") + rev("del", deleted("refusal"), "3") + rev("ins", r("renewal"), "4")) + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>" + head("Two") + p("notice period here")
    (tmp_path / "a.docx").write_bytes(package(body, styles=styles, comments=note))
    t = docx.tables_of(docx.read_packages(spark, str(tmp_path)).cache())
    groups = spark.createDataFrame([(1, "right of renewal", None, None), (2, "right of refusal", None, None), (3, "notice period", ["refusalrenewal"], None)], "group_key int, canonical string, synonyms array<string>, stemming string")
    hits = {(h.group_key, h.part_id.split(":")[0], tuple(h.present_in), len(h.spans)) for h in documents.hits_of(t, terms.compile_forms(groups)).collect()}
    assert hits == {(1, "officeDocument", ("accepted",), 2), (2, "officeDocument", ("original",), 1), (3, "officeDocument", ("accepted", "original"), 1), (3, "comments", (), 1)}
    c = documents.chunks_of(t, "accepted", ChunkParams(min_size=0)).orderBy("chunk_ord").collect()
    assert [(x.section_path, x.text) for x in c] == [([], "Preamble"), (["One"], "right of renewal\na\nb"), (["Two"], "notice period here")]
