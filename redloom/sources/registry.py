"""Term registries and label files as JSON: read strictly, written canonically.

A file is ``{"schema_version": "1", "record": ...}``; unknown keys and other versions are errors.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from redloom.functions.canon import canonical
from redloom.operators.terms import check_registry, registry_hash

VERSION = "1"
GROUP = {"canonical": str, "synonyms": list, "stemming": (str, type(None)), "rules": dict, "tags": dict}
GROUP_SCHEMA = "term_list_hash string, group_key int, canonical string, synonyms array<string>, stemming string, rules map<string,string>, tags map<string,string>"
#: Label files by kind: the keys of one entry and which of them must be there.
LABELS = {
    "must_find": ({"document", "term", "note"}, {"document", "term"}),
    "queries": ({"query", "document", "chunk", "note"}, {"query", "document"}),
    "grades": ({"document", "chunk_id", "prompt_hash", "model", "criteria", "note"}, {"document", "chunk_id", "prompt_hash", "criteria"}),
    "facts": ({"family", "document", "what", "want"}, {"family", "document", "what"}),
}


class FormatError(ValueError):
    pass


def decode(text: str):
    """The record of an envelope of this version."""
    try:
        body = json.loads(text)
    except ValueError as x:
        raise FormatError(f"no JSON: {x}") from x
    if not isinstance(body, dict) or set(body) != {"schema_version", "record"}:
        raise FormatError("no envelope")
    if body["schema_version"] != VERSION:
        raise FormatError(f"version {body['schema_version']!r}, expected {VERSION!r}")
    return body["record"]


def encode(record) -> str:
    return canonical({"schema_version": VERSION, "record": record})


def read_json(path: str | Path):
    return json.loads(Path(path).read_text("utf-8"))


def write_json(path: str | Path, value) -> None:
    Path(path).write_text(json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n", "utf-8")


def read_groups(text: str) -> list[dict]:
    record = decode(text)
    if not isinstance(record, dict) or set(record) != {"groups"} or not isinstance(record["groups"], list):
        raise FormatError("a registry holds groups and nothing else")
    out = []
    for g in record["groups"]:
        unknown = set(g) - set(GROUP)
        full = {"synonyms": [], "stemming": None, "rules": {}, "tags": {}, **g}
        if unknown or "canonical" not in g or any(not isinstance(full[k], t) for k, t in GROUP.items()):
            raise FormatError(f"group {g.get('canonical')!r}: unknown keys {sorted(unknown)} or a value of the wrong type")
        out.append(full)
    return out


def load_registry(spark: SparkSession, text: str) -> DataFrame:
    """The groups of a registry as a table, checked, with the registry's hash."""
    groups = read_groups(text)
    key = registry_hash(groups)
    rows = [(key, i, g["canonical"], g["synonyms"], g["stemming"], {k: str(v) for k, v in g["rules"].items()}, {k: str(v) for k, v in g["tags"].items()}) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, GROUP_SCHEMA)
    check_registry(df)
    return df


def load_labels(kind: str, path: str | Path) -> list[dict]:
    """The entries of a label file made by people; example files carry no labels."""
    known, needed = LABELS[kind]
    if Path(path).name.endswith(".example.json"):
        return []
    body = read_json(path)
    if set(body) != {"labels_provenance", "entries"} or body["labels_provenance"] != "human":
        raise FormatError(f"{path}: labels have to be human and in entries")
    for e in body["entries"]:
        if not needed <= set(e) <= known:
            raise FormatError(f"{path}: entry with keys {sorted(e)}")
    return body["entries"]
