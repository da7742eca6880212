"""Deeply nested JSON records to flat, related tables.

Each tree is walked depth-first without recursion; every element gets an interval (pre-order and post-order number),
and children are tied to parents by interval containment.

Defined results
* null text, text that is no complete JSON value (cut, trailing text, NaN): no rows.
* a JSON string holding JSON text is opened, as often as it is wrapped.
* a member stated twice in one object: both values are walked.
* an element is an object with the member ``tag``, whatever its value; other objects and arrays only nest.
* elements are numbered in the order of their opening braces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redloom.operators.hierarchy import inside
from redloom.operators.skew import skew_join


class _Pairs(list):
    """The members of an object in the order written, repeats included."""


def _no_constant(x: str):
    raise ValueError(x)


_decode = json.JSONDecoder(object_pairs_hook=_Pairs, parse_constant=_no_constant).decode
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _decode_deep(text: str):
    """Like ``_decode`` for text nested deeper than the decoder's stack, by one pass with a stack of its own."""
    top: list = []
    stack: list[tuple[str, list]] = [("top", top)]
    want, at, name = "value", 0, None
    text = text.rstrip(" \t\n\r")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(at)
        at = m.end()
        mark, string, other = m.groups()
        kind, into = stack[-1]
        if mark in ("}", "]"):
            if kind != {"}": "object", "]": "array"}[mark] or want not in ("first", "after"):
                raise ValueError(at)
            stack.pop()
            want = "after"
        elif mark == ",":
            if want != "after" or kind == "top":
                raise ValueError(at)
            want = "name" if kind == "object" else "value"
        elif mark == ":":
            if want != "colon":
                raise ValueError(at)
            want = "value"
        elif kind == "object" and want in ("first", "name"):
            if string is None:
                raise ValueError(at)
            name, want = json.loads(string), "colon"
        elif want == "value" or (kind == "array" and want == "first"):
            new = _Pairs() if mark == "{" else [] if mark == "[" else json.loads(string or other)
            into.append((name, new) if kind == "object" else new)
            want = "after"
            if mark:
                stack.append(("object" if mark == "{" else "array", new))
                want = "first"
        else:
            raise ValueError(at)
    if len(stack) != 1 or len(top) != 1:
        raise ValueError(at)
    return top[0]


def parse_tree(text: str | None):
    """The value of a JSON text, or None if it has none."""
    value = text
    if value is None:
        return None
    while isinstance(value, str):
        value = value.lstrip("﻿")
        try:
            value = _decode(value)
        except RecursionError:
            try:
                value = _decode_deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def label_elements(value) -> list[dict]:
    """Elements of a tree with ``pre``, ``post``, ``depth``, ``tag``, ``role`` (the member that holds them), ``attrs`` and ``text``."""
    out: list[dict] = []
    clock = 0
    stack: list = [(value, None, 0)]
    while stack:
        here, role, depth = stack.pop()
        if here is None and isinstance(role, dict):  # leaving an element
            role["post"] = clock
            clock += 1
            continue
        if isinstance(here, _Pairs):
            members = dict(here)
            if "tag" in members:
                attrs, text = members.get("attrs"), members.get("text")
                if isinstance(attrs, _Pairs):
                    attrs = {k: v for k, v in attrs if not isinstance(v, list)}
                elif isinstance(attrs, list):
                    attrs = {x.get("name"): x.get("val") for x in map(dict, (a for a in attrs if isinstance(a, _Pairs)))}
                tag = members["tag"]
                own = {"pre": clock, "post": -1, "depth": depth, "tag": tag if isinstance(tag, str) else json.dumps(tag), "role": role, "attrs": json.dumps(attrs, sort_keys=True, default=str) if isinstance(attrs, dict) and attrs else None, "text": text if isinstance(text, str) else None}
                clock += 1
                out.append(own)
                depth += 1
                stack.append((None, own, depth))
            stack.extend((v, k, depth) for k, v in reversed(here) if isinstance(v, list))
        elif isinstance(here, list):
            stack.extend((v, role, depth) for v in reversed(here) if isinstance(v, list))
    return out


def link_by_containment(elements: list[dict]) -> None:
    """Give each element its number ``ix`` and the number of its nearest enclosing element, ``parent_ix``, from the intervals alone."""
    open_: list[dict] = []
    for ix, e in enumerate(sorted(elements, key=lambda e: e["pre"])):
        while open_ and open_[-1]["post"] < e["post"]:
            open_.pop()
        e["ix"], e["parent_ix"] = ix, open_[-1]["ix"] if open_ else None
        open_.append(e)


_ELEMENTS = pa.schema([("owner_key", pa.int64()), ("ix", pa.int32()), ("parent_ix", pa.int32()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("role", pa.string()), ("attrs", pa.string()), ("text", pa.string())])
_ELEMENTS_DDL = "owner_key long, ix int, parent_ix int, pre int, post int, depth int, tag string, role string, attrs string, text string"


def _element_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            value = parse_tree(text)
            if value is None:
                continue
            found = label_elements(value)
            link_by_containment(found)
            for e in found:
                e["owner_key"] = key
            rows += found
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_pylist(rows, _ELEMENTS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ELEMENTS)


def flatten_trees(df: DataFrame, key: str, tree: str) -> DataFrame:
    """One row an element of the JSON tree in ``tree``: owner, number, parent's number, interval, depth, tag, role, attributes, text."""
    return df.where(F.col(tree).isNotNull()).select(F.col(key).cast("long").alias("owner_key"), F.col(tree)).mapInArrow(_element_batches, _ELEMENTS_DDL)


def table_of(elements: DataFrame, *tags: str) -> DataFrame:
    """The table of one type of element; its rows keep the interval that ties them to other types' tables."""
    return elements.where(F.col("tag").isin(*tags))


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``inner`` rows with the number ``outer_ix`` of the nearest ``outer`` row around them, by interval containment; ranges meet in aligned blocks, pairs of a tree are not formed."""
    o = outer.select(F.col("owner_key").alias("scope"), F.lit(0).alias("root_key"), (F.col("pre") + 1).alias("lo"), F.col("post").alias("hi"), F.col("pre").alias("__pre"), F.col("ix").alias("__ix"))
    i = inner.select(F.col("owner_key").alias("scope"), F.lit(0).alias("root_key"), "pre", F.col("ix").alias("__own"))
    met = inside(i, o, outer.agg(F.max("post")).first()[0] or 1)
    nearest = met.groupBy(F.col("scope").alias("owner_key"), F.col("__own").alias("ix")).agg(F.max_by("__ix", "__pre").alias("outer_ix"))
    return inner.join(nearest, ["owner_key", "ix"], "left")


def _link_key(scope: Column, name: Column) -> Column:
    """Scope and name as 16 bytes, which is all that travels to the join; null for a null name."""
    return F.when(name.isNotNull(), F.unhex(F.md5(F.concat(scope.cast("string"), F.lit("\x00"), name))))


def _linked(entries: DataFrame, keys: DataFrame) -> DataFrame:
    # repeated rows of an owner give the same entries: one of each stays
    own = entries.dropDuplicates(["owner_key", "item_ix"])
    return skew_join(own, keys, ["__key"], "left", spread=F.struct("owner_key", "item_ix")).drop("__key")


def explode_children(nodes: DataFrame, scope: str, key: str, name: str, children: str) -> DataFrame:
    """One row an entry of the list of child names: scope, owner, place, name, and the child's key or null.

    ``key`` has to be unique beyond its scope.
    """
    entries = nodes.select(F.col(scope).alias("scope"), F.col(key).alias("owner_key"), F.posexplode(children).alias("item_ix", "child_name"))
    keys = nodes.where(F.col(name).isNotNull()).select(_link_key(F.col(scope), F.col(name)).alias("__key"), F.col(key).alias("k")).groupBy("__key").agg(F.min("k").alias("child_key"))
    return _linked(entries.withColumn("__key", _link_key(F.col("scope"), F.col("child_name"))), keys)


def explode_spans(nodes: DataFrame, scope: str, key: str, spans: str, streams: DataFrame, stream_scope: str, stream_part: str, stream_key: str) -> DataFrame:
    """One row a span: scope, owner, place, part, offsets, and the key of the stream it points into or null."""
    entries = nodes.select(F.col(scope).alias("scope"), F.col(key).alias("owner_key"), F.posexplode(spans).alias("item_ix", "__s")).select("scope", "owner_key", "item_ix", F.col("__s.part_id").alias("part_id"), F.col("__s.start_off").alias("start_off"), F.col("__s.end_off").alias("end_off"))
    keys = streams.where(F.col(stream_part).isNotNull()).select(_link_key(F.col(stream_scope), F.col(stream_part)).alias("__key"), F.col(stream_key).alias("k")).groupBy("__key").agg(F.min("k").alias("stream_key"))
    return _linked(entries.withColumn("__key", _link_key(F.col("scope"), F.col("part_id"))), keys)
