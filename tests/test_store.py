import json

import pytest
from pyspark.sql import functions as F

from redloom.operators import summaries as S
from redloom.sources import docx
from redloom.sources.store import ReadOnlyError, Store, artifact_keys, ingest
from redloom.streaming.ingest import ingest_stream, latest_by_key, windowed_counts
from tests.packages import p, package


def files(spark, path):
    return spark.read.format("binaryFile").load(str(path) + "/*.docx")


def test_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.docx").write_bytes(package(p("one")))
    (src / "copy.docx").write_bytes((src / "a.docx").read_bytes())
    store = Store(spark, str(tmp_path / "store"))
    calls = spark.sparkContext.accumulator(0)

    def parse(df):
        calls.add(df.count())
        return docx.parse_files(df)

    first = ingest(store, files(spark, src), parse).count()
    assert calls.value == 1 and store.load("raw").count() == 1
    assert ingest(store, files(spark, src), parse).count() == first and calls.value == 1
    (src / "b.docx").write_bytes(package(p("two")))
    assert ingest(store, files(spark, src), parse).count() == 2 * first and calls.value == 2


def test_read_only_and_evict(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"), read_only=True)
    store = Store(spark, str(tmp_path / "s"))
    store.save("terms", spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"))
    store.save("terms", spark.createDataFrame([("a", 9), ("c", 3)], "key string, v int"))
    assert {r.key: r.v for r in store.load("terms").collect()} == {"a": 1, "b": 2, "c": 3}
    with pytest.raises(ReadOnlyError):
        Store(spark, str(tmp_path / "s"), read_only=True).save("terms", spark.createDataFrame([("z", 1)], "key string, v int"))
    store.replace("terms", spark.createDataFrame([("a", 5)], "key string, v int"))
    assert {r.key: r.v for r in store.load("terms").collect()} == {"a": 5, "b": 2, "c": 3}
    assert [r.key for r in store.keys("terms").collect()] == ["a", "b", "c"] and store.find("terms", "b").first().v == 2
    store.replace("terms", spark.createDataFrame([("a", 6), ("a", 7)], "key string, v int"))
    store.evict("terms", spark.createDataFrame([("b",)], "key string"))
    store.save("terms", spark.createDataFrame([("b", 8)], "key string, v int"))
    want = [("a", 6), ("a", 7), ("b", 8), ("c", 3)]
    assert sorted((r.key, r.v) for r in store.load("terms").collect()) == want
    # a part that no manifest lists is not there, a write between reading and adding is not lost
    store._write("terms", spark.createDataFrame([("ghost", 1)], "key string, v int"))
    parts = store._parts("terms")
    assert not store._commit("terms", [*parts[:-1], {"name": "x", "rows": True, "masks": False}])
    store.compact("terms")
    assert len(store._parts("terms")) == 1 and sorted((r.key, r.v) for r in store.load("terms").collect()) == want
    with pytest.raises(KeyError):
        store.get("terms", "nothing")
    store.evict("terms", spark.createDataFrame([("c",)], "key string"))
    assert {r.key for r in store.load("terms").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="collection"):
        store.load("nothing")


def test_keys_follow_only_what_they_read():
    base = dict(parse_version="1", model_version="1", heading_version="1", chunk_params="p", view="accepted", term_list="t", matcher_version="1")
    moved = {k: {n for n, v in artifact_keys("d", **{**base, k: "other"}).items() if v != artifact_keys("d", **base)[n]} for k in base}
    assert moved == {"parse_version": {"parse", "chunks", "hits"}, "model_version": {"parse", "chunks", "hits"}, "heading_version": {"parse", "chunks", "hits"}, "chunk_params": {"chunks"}, "view": {"chunks"}, "term_list": {"hits"}, "matcher_version": {"hits"}}


def test_summaries_once_per_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    asked = spark.sparkContext.accumulator(0)

    def answer(prompt):
        asked.add(1)
        return "not json" if "bad" in prompt else S.canned(prompt)

    chunks = spark.createDataFrame([("d", "c1", "same"), ("d", "c2", "same"), ("d", "c3", "bad")], "document_id string, chunk_id string, markup string")
    one = S.summarize(store, chunks, "Summarise.", "m", answer).collect()
    assert asked.value == 2 and {(r.chunk_id, r.status, r.cache) for r in one} == {("c1", "ok", "miss"), ("c2", "ok", "miss"), ("c3", "rejected", "miss")}
    two = S.summarize(store, chunks, "Summarise.", "m", answer).collect()
    assert asked.value == 2 and {r.cache for r in two} == {"hit"}
    assert {r.key for r in S.summarize(store, chunks, "Other.", "m", answer).collect()}.isdisjoint({r.key for r in one})


def test_roll_up_by_eights(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    leaves = spark.createDataFrame([("d", i, f"k{i:02d}", [f"c{i}"], None if i == 3 else False) for i in range(20)], "document_id string, pos int, child_key string, chunk_ids array<string>, has_pending boolean")
    texts = spark.createDataFrame([(f"k{i:02d}", f"text {i}") for i in range(20)], "key string, text string")
    (top,) = S.roll_up(store, leaves, texts, ["document_id"], "Roll up.", "m", S.canned).collect()
    assert top.chunk_ids == [f"c{i}" for i in range(20)] and top.has_pending is None and top.status == "ok"
    assert store.load("rollups").count() == 4


def test_answers():
    good = {"schema_version": "1", "record": {"text": "t", "topics": ["a"], "pending": ""}}
    assert S.read_answer(json.dumps(good))[0] == good["record"]
    for bad in ("", "[]", json.dumps(good["record"]), json.dumps({**good, "x": 1}), json.dumps({"schema_version": "1", "record": {**good["record"], "topics": [1]}})):
        assert S.read_answer(bad)[1]
    assert S.client("canned") is S.canned and S.client("json:dumps") is json.dumps
    with pytest.raises(ValueError, match="client"):
        S.client("nobody")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.docx").write_bytes(package(p("one")))
    run = lambda: ingest_stream(spark, str(src), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination(120)
    run()
    store = Store(spark, str(tmp_path / "store"))
    n = store.load("parse").count()
    (src / "b.docx").write_bytes(package(p("two")))
    run()
    assert n > 0 and store.load("parse").count() == 2 * n


def test_stream_operators(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    events = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(data).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df, mode in (("counts", windowed_counts(events, "ts", "event_type"), "complete"), ("dedup", latest_by_key(events, "event_id", "ts"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    total = spark.read.parquet(f"{data}/events.parquet").count()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == total and spark.table("dedup").count() == total
