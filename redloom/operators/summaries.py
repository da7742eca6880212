"""Summaries of chunks and roll-ups of sections, each made once for its inputs.

A client is a callable from prompt to answer.  Answers come only for keys that are not stored, each distinct key once; a
rejected answer is stored under its key too and counts as found.  Run with ``spark.speculation`` off: a call costs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redloom.functions import canon
from redloom.functions.canon import canonical
from redloom.operators.revisions import three_state_any
from redloom.session import staged
from redloom.sources.store import Store

FAN_IN = 8
FIELDS = {"text": str, "topics": list, "pending": str}
OUTCOME = "key string, status string, text string, topics array<string>, pending string, reason string, prompt_tokens int, answer_tokens int"


def canned(prompt: str) -> str:
    """An answer that depends on the prompt alone, for tests and dry runs."""
    mark = hashlib.sha256(prompt.encode()).hexdigest()[:8]
    return json.dumps({"schema_version": "1", "record": {"text": f"summary {mark}", "topics": [mark], "pending": ""}})


CLIENTS: dict[str, Callable[[str], str]] = {"canned": canned}


def client(name: str) -> Callable[[str], str]:
    """A client by name, or ``module:attribute``."""
    if name in CLIENTS:
        return CLIENTS[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"no client {name!r}; known: {sorted(CLIENTS)} or module:attribute")
    import importlib

    return getattr(importlib.import_module(module), attribute)


def read_answer(answer: str) -> tuple[dict | None, str | None]:
    """The record of an answer, or why it is rejected: exactly the known fields, in an envelope."""
    try:
        body = json.loads(answer)
    except ValueError as x:
        return None, f"no JSON: {x}"
    if not isinstance(body, dict) or set(body) != {"schema_version", "record"} or not isinstance(body["record"], dict):
        return None, "no envelope"
    record = body["record"]
    if set(record) != set(FIELDS):
        return None, f"fields {sorted(record)}"
    if any(not isinstance(record[k], t) for k, t in FIELDS.items()) or any(not isinstance(x, str) for x in record["topics"]):
        return None, "a field of the wrong type"
    return record, None


def summary_keys(chunks: DataFrame, prompt: str, model: str) -> DataFrame:
    """``chunks(document_id, chunk_id, markup)`` with the key of each: its rendered bytes, prompt and model."""
    return chunks.withColumn("key", canon.hash_of(markup=canon.json_text(F.sha2("markup", 256)), model=canon.json_text(F.lit(model)), prompt=canon.json_text(F.lit(canon.sha256_text(prompt)))))


def call(prompts: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """Outcomes of ``prompts(key, prompt)``, one call a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["key"], pdf["prompt"]):
                record, why = read_answer(answer(prompt))
                rows.append((key, "rejected" if why else "ok", record and record["text"], record and record["topics"], record and record["pending"], why, None, None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOME.split(", ")])
            yield out.astype({"prompt_tokens": "Int32", "answer_tokens": "Int32"})

    return prompts.mapInPandas(run, OUTCOME)


def summarize(store: Store, chunks: DataFrame, prompt: str, model: str, answer: Callable[[str], str]) -> DataFrame:
    """Summaries of chunks: missing keys are asked for and stored; (document_id, chunk_id, key, cache) and the outcome."""
    keyed = staged(summary_keys(chunks, prompt, model), "summary-keys")
    missing = staged(store.misses("summaries", keyed), "summary-misses")
    asked = keyed.join(missing, "key", "left_semi").groupBy("key").agg(F.min("markup").alias("markup"))
    made = staged(call(asked.select("key", F.concat(F.lit(prompt + "\n"), "markup").alias("prompt")), answer), "summary-answers")
    store.save("summaries", made)
    fresh = missing.withColumn("cache", F.lit("miss"))
    return keyed.join(store.load("summaries"), "key").join(fresh, "key", "left").withColumn("cache", F.coalesce("cache", F.lit("hit")))


def rollup_leaves(chunks: DataFrame, node_sections: DataFrame) -> DataFrame:
    """The section of each chunk, that of its first node; without one the document (null)."""
    first = chunks.withColumn("node_id", F.try_element_at("node_ids", F.lit(1)))
    return first.join(node_sections.select("document_id", "node_id", "section_ix"), ["document_id", "node_id"], "left")


def fan_in(children: DataFrame, keys: list[str], order: str, width: int = FAN_IN) -> DataFrame:
    """Children in batches of ``width`` in order: (keys, batch_no, child_keys, child_chunk_ids, has_pending).

    ``has_pending`` is true if any child's is, null if some child does not state it, else false.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    placed = children.withColumn("__pos", F.row_number().over(w) - 1).withColumn("batch_no", F.floor(F.col("__pos") / width).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("__pos", "child_key", "chunk_ids")))
    return placed.groupBy(*keys, "batch_no").agg(ordered.alias("c"), three_state_any(F.col("has_pending")).alias("has_pending")).select(*keys, "batch_no", F.transform("c", lambda x: x["child_key"]).alias("child_keys"), F.flatten(F.transform("c", lambda x: x["chunk_ids"])).alias("child_chunk_ids"), "has_pending")


def rollup_key(prompt: str, model: str, width: int = FAN_IN):
    """The key of a batch: its ordered child keys, prompt, model and width; the target is no part of it."""
    return canon.hash_of(children=canon.json_texts(F.col("child_keys")), fan_in=F.lit(str(width)), model=canon.json_text(F.lit(model)), prompt=canon.json_text(F.lit(canon.sha256_text(prompt))))


def roll_up(store: Store, leaves: DataFrame, texts: DataFrame, target: list[str], prompt: str, model: str, answer: Callable[[str], str], width: int = FAN_IN) -> DataFrame:
    """Roll the children of each target up until one batch is left.

    ``leaves(target..., pos, child_key, chunk_ids, has_pending)``, ``texts(key, text)``.  Rounds are as many as the
    logarithm of the largest number of children to the base ``width``.
    """
    level = leaves.select(*target, "pos", "child_key", "chunk_ids", "has_pending")
    while True:
        batches = staged(fan_in(level, target, "pos", width).withColumn("key", rollup_key(prompt, model, width)), "rollup-batches")
        missing = store.misses("rollups", batches)
        body = batches.join(missing, "key", "left_semi").select("key", F.posexplode("child_keys").alias("pos", "child")).distinct().join(texts.select(F.col("key").alias("child"), "text").dropDuplicates(["child"]), "child", "left")
        prompts = body.groupBy("key").agg(F.concat_ws("\n", F.lit(prompt), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")).alias("prompt"))
        store.save("rollups", staged(call(prompts, answer), "rollup-answers"))
        done = batches.join(store.load("rollups"), "key").select(*target, F.col("batch_no").alias("pos"), F.col("key").alias("child_key"), F.col("child_chunk_ids").alias("chunk_ids"), "has_pending", "status", "text")
        done = staged(done, "rollup-level")
        texts = done.select(F.col("child_key").alias("key"), "text")
        if done.where("pos > 0").isEmpty():
            return done.drop("pos")
        level = done.select(*target, "pos", "child_key", "chunk_ids", "has_pending")


def prompt_hash(prompt: str, **settings) -> str:
    return canon.sha256_text(canonical({"prompt": prompt, **settings}))
