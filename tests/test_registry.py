import json

import pytest

from redloom.__main__ import main
from redloom.sources import registry as R
from tests.packages import p, package

GOOD = {"groups": [{"canonical": "boiler", "synonyms": ["heater"], "stemming": "porter", "tags": {"k": "v"}}]}


def test_round_trip_and_refusals(spark, tmp_path):
    df = R.load_registry(spark, R.encode(GOOD))
    assert df.first().canonical == "boiler" and df.first().tags == {"k": "v"}
    for bad in ("", "{}", json.dumps({"schema_version": "9", "record": GOOD}), R.encode({"groups": [{"synonyms": []}]}), R.encode({"groups": [{"canonical": "a", "x": 1}]}), R.encode({"groups": [], "x": 1})):
        with pytest.raises(R.FormatError):
            R.load_registry(spark, bad)
    R.write_json(tmp_path / "x.json", {"b": 1, "a": "é"})
    assert (tmp_path / "x.json").read_text("utf-8").startswith('{\n  "a": "é"') and R.read_json(tmp_path / "x.json") == {"a": "é", "b": 1}


def test_labels(tmp_path):
    good = {"labels_provenance": "human", "entries": [{"document": "d", "term": "t"}]}
    R.write_json(tmp_path / "l.json", good)
    assert R.load_labels("must_find", tmp_path / "l.json") == good["entries"]
    R.write_json(tmp_path / "l.example.json", {"any": 1})
    assert R.load_labels("must_find", tmp_path / "l.example.json") == []
    for bad in ({**good, "labels_provenance": "generator"}, {**good, "entries": [{"document": "d"}]}, {**good, "entries": [{"document": "d", "term": "t", "x": 1}]}):
        R.write_json(tmp_path / "b.json", bad)
        with pytest.raises(R.FormatError):
            R.load_labels("must_find", tmp_path / "b.json")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(package(p("The boiler and the heaters")))
    (tmp_path / "t.json").write_text(R.encode(GOOD), "utf-8")
    store = str(tmp_path / "store")
    run = lambda *a: (main(list(a)), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert run("documents", store)[0] == 2
    assert run("ingest", str(tmp_path / "in"), store)[1][0]["nodes"] == 1
    assert run("documents", store)[1][0]["nodes"] == 1
    assert run("text", store, "accepted")[1][0]["text"] == "The boiler and the heaters\n"
    hits = run("hits", store, str(tmp_path / "t.json"))[1]
    assert [(h["spans"], h["present_in"], h["match_type"]) for h in hits] == [([{"union_start": 4, "union_end": 10}], ["accepted", "original"], "exact")]
    assert [c["text"] for c in run("chunks", store, "accepted")[1]] == ["The boiler and the heaters"]
    assert [(c["status"], c["cache"]) for c in run("summarize", store, "Say it.", "m", "canned")[1]] == [("ok", "miss")]
    assert [c["cache"] for c in run("summarize", store, "Say it.", "m", "canned")[1]] == ["hit"]
    assert run("search", store, "the BOILER")[1][0]["start"] == 0
    assert run("text", store, "nothing")[0] == 2
