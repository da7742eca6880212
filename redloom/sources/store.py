"""Content-addressed tables: what was computed from which inputs is kept under a hash of those inputs.

A kind is a folder of Parquet parts and of manifests that list them.  A write adds a part, then the next manifest; readers
take the newest manifest, so they see a write whole or not at all, and a writer that dies leaves a part nobody lists.  Two
writers cannot add the same manifest: the later one looks again and adds the next.  Evicting and replacing add a part that
masks the keys in older parts; ``compact`` writes what is visible as one part.  Rows that two writers added under one key
at the same time are kept once: the older part counts.

A read-only store refuses to write before it starts any job; rows of another version count as missing.
"""

from __future__ import annotations

import json
import os
import platform
import subprocess
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.functions.canon import sha256_json
from redloom.session import path_exists, staged, write_table

KINDS = ("raw", "parse", "chunks", "hits", "summaries", "rollups", "terms", "runs", "llm_archive")
SCHEMA_VERSION = "1"


class ReadOnlyError(RuntimeError):
    pass


class Store:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        if read_only and not path_exists(spark, self.root):
            raise FileNotFoundError(root)

    def path(self, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"no collection {kind!r}; known: {KINDS}")
        return f"{self.root}/{kind}"

    def exists(self, kind: str) -> bool:
        return bool(self._parts(kind))

    def load(self, kind: str, schema: str | None = None) -> DataFrame:
        """All rows of this version; a missing table is empty if its schema is given."""
        parts = self._parts(kind)
        if not any(p["rows"] for p in parts):
            if schema is None:
                raise FileNotFoundError(self.path(kind))
            return self.spark.createDataFrame([], schema)
        rows = [self._part(kind, p["name"]).where(F.col("schema_version") == SCHEMA_VERSION).withColumn("__part", F.lit(i)) for i, p in enumerate(parts) if p["rows"]]
        out = rows[0]
        for x in rows[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        masks = self.spark.createDataFrame([], "key string, __at int")
        for i, p in enumerate(parts):
            if p["masks"]:
                masks = masks.unionByName(self._part(kind, p["name"]).select("key", F.lit(i).alias("__at")))
        if len(parts) > 1:
            # of the parts that hold a key and that no later one masks, the first counts
            last = masks.groupBy("key").agg(F.max("__at").alias("__at"))
            stand = out.select("key", "__part").distinct().join(last, "key", "left").where("__at is null or __part >= __at").groupBy("key").agg(F.min("__part").alias("__part"))
            out = out.join(stand, ["key", "__part"], "left_semi")
        return out.drop("schema_version", "__part")

    def find(self, kind: str, key: str) -> DataFrame:
        return self.load(kind).where(F.col("key") == key)

    def get(self, kind: str, key: str) -> DataFrame:
        """The rows of a key; an error where it is not stored."""
        rows = self.find(kind, key)
        if rows.isEmpty():
            raise KeyError(f"{kind} has nothing under {key}")
        return rows

    def keys(self, kind: str) -> DataFrame:
        return self.load(kind, "key string").select("key").distinct().orderBy("key")

    def save(self, kind: str, rows: DataFrame, key: str = "key") -> None:
        """Add the rows whose key is new; of equal keys in ``rows`` all rows are kept together."""
        self._writable()
        new = rows.withColumnRenamed(key, "key") if key != "key" else rows
        if self.exists(kind):
            new = new.join(self.load(kind, "key string").select("key").distinct(), "key", "left_anti")
        self._add(kind, new, rows=True, masks=False)

    def evict(self, kind: str, keys: DataFrame) -> None:
        """Hide some keys; their rows go with the next :meth:`compact`."""
        self._writable()
        if self.exists(kind):
            self._add(kind, keys.select("key").distinct(), rows=False, masks=True)

    def replace(self, kind: str, rows: DataFrame) -> None:
        """Give the keys of ``rows`` these rows and no others, in one step."""
        self._writable()
        self._add(kind, rows, rows=True, masks=True)

    def compact(self, kind: str) -> None:
        """Write the visible rows as one part; files of older parts are deleted once the new manifest stands."""
        self._writable()
        parts = self._parts(kind)
        if not parts:
            return
        name = self._write(kind, self.load(kind, "key string"))
        if self._commit(kind, [{"name": name, "rows": True, "masks": False}], parts):
            for p in parts:
                self._fs().delete(self._at(f"{self.path(kind)}/{p['name']}"), True)

    # parts and manifests

    def _fs(self):
        return self._at(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _part(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(kind)}/{name}")

    def _newest(self, kind: str) -> int:
        folder = self._at(f"{self.path(kind)}/_manifests")
        if not self._fs().exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=0)

    def _parts(self, kind: str) -> list[dict]:
        n = self._newest(kind)
        if not n:
            return []
        stream = self._fs().open(self._at(f"{self.path(kind)}/_manifests/{n}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, kind: str, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        write_table(rows.withColumn("schema_version", F.lit(SCHEMA_VERSION)), f"{self.path(kind)}/{name}")
        return name

    def _add(self, kind: str, df: DataFrame, **flags: bool) -> None:
        name = self._write(kind, df)
        while not self._commit(kind, [*self._parts(kind), {"name": name, **flags}]):
            pass

    def _commit(self, kind: str, parts: list[dict], seen: list[dict] | None = None) -> bool:
        """Add the next manifest; False if another writer did so first (or if ``seen`` is no longer what is listed)."""
        before = self._newest(kind)
        listed = self._parts(kind)
        if (seen if seen is not None else parts[:-1]) != listed:
            return False
        fs, folder = self._fs(), f"{self.path(kind)}/_manifests"
        side = self._at(f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(side, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        target = self._at(f"{folder}/{before + 1}.json")
        if fs.exists(target) or not fs.rename(side, target):
            fs.delete(side, False)
            return False
        return True

    def misses(self, kind: str, wanted: DataFrame) -> DataFrame:
        """The wanted keys that are not stored, each once."""
        asked = wanted.select("key").distinct()
        return asked.join(self.load(kind, "key string").select("key").distinct(), "key", "left_anti")

    def archive_raw(self, files: DataFrame, source_system: str = "files") -> DataFrame:
        """Keep a ``binaryFile`` table's bytes by their hash, the same bytes once; gives the rows of these files, old or new."""
        rows = files.select(F.sha2("content", 256).alias("key"), F.col("length").alias("size"), F.element_at(F.split("path", "/"), -1).alias("original_filename"), F.col("path").alias("storage_ref"), F.lit(source_system).alias("source_system"), F.current_timestamp().alias("ingested_at"), "content").dropDuplicates(["key"])
        keys = staged(rows.select("key"), "raw-keys")
        self.save("raw", rows)
        return self.load("raw").join(keys, "key", "left_semi")

    def archive_call(self, calls: DataFrame) -> None:
        """Prompts and answers ``(kind, text)`` by hash."""
        self.save("llm_archive", calls.select(F.sha2("text", 256).alias("key"), "kind", "text").dropDuplicates(["key"]))

    def record_run(self, document_id: str, hashed: dict, artifacts: list[dict], run_id: str | None = None) -> str:
        """A run row: what went in (hashed), what was around (recorded, never hashed) and which artifacts were found or made."""
        self._writable()
        run_id = run_id or uuid.uuid4().hex
        row = {"key": run_id, "run_id": run_id, "document_id": document_id, "written_at": datetime.now(timezone.utc).isoformat(), "hashed_inputs": json.dumps(hashed, sort_keys=True), "recorded_inputs": json.dumps({"python": platform.python_version(), "spark": self.spark.version, "revision": code_revision()}), "artifacts": json.dumps(artifacts)}
        self.save("runs", self.spark.createDataFrame([row]))
        return run_id

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError(self.root)


def code_revision() -> str | None:
    """The git revision of this code, with ``+`` where files differ from it; None outside a repository."""
    git = lambda *args: subprocess.run(["git", "-C", os.path.dirname(os.path.abspath(__file__)), *args], capture_output=True, text=True, timeout=20)
    try:
        head = git("rev-parse", "HEAD")
        return head.stdout.strip() + ("+" if git("status", "--porcelain").stdout.strip() else "") if head.returncode == 0 else None
    except (OSError, subprocess.TimeoutExpired):
        return None


def artifact_key(kind: str, **inputs) -> str:
    """The key of an artifact: a hash of exactly what it is computed from."""
    return sha256_json({"kind": kind, **inputs})


def artifact_keys(document_id: str, *, parse_version: str, model_version: str, heading_version: str, chunk_params: str, view: str, term_list: str | None, matcher_version: str) -> dict[str, str]:
    """Keys of a document's parse, chunks and hits; each follows only what it reads."""
    parse = artifact_key("parse", source=document_id, parser=parse_version, textmodel=model_version, headings=heading_version)
    out = {"parse": parse, "chunks": artifact_key("chunks", parse=parse, params=chunk_params, view=view)}
    if term_list is not None:
        out["hits"] = artifact_key("hits", parse=parse, terms=term_list, matcher=matcher_version)
    return out


def ingest(store: Store, files: DataFrame, parse: Callable[[DataFrame], DataFrame], version: str = "1") -> DataFrame:
    """Archive files and parse those not parsed yet; the tagged rows of these files' documents.

    The work follows the files given: of what is stored only keys are read, and the parsed rows of these documents.
    """
    prefix = F.lit('{"kind":"parse","source":"')
    key = F.sha2("content", 256)
    keyed = files.select(key.alias("document_id"), F.sha2(F.concat(prefix, key, F.lit(f'","version":"{version}"}}')), 256).alias("parse_key"), "path", "length", "content").dropDuplicates(["document_id"])
    keys = staged(keyed.select("document_id", "parse_key"), "ingest-keys")
    store.archive_raw(files)
    fresh = staged(store.misses("parse", keys.select(F.col("parse_key").alias("key"))).withColumnRenamed("key", "parse_key"), "ingest-misses")
    rows = parse(keyed.join(fresh, "parse_key", "left_semi").select("path", "length", "content"))
    store.save("parse", rows.join(keys, "document_id").withColumnRenamed("parse_key", "key"))
    return store.load("parse").join(keys.select(F.col("parse_key").alias("key")), "key", "left_semi")
