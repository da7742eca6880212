"""The test tables as model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.functions import text as T
from redloom.session import table

PART = ["document_id", "part_id"]


def streams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "streams").where("text is not null").select("document_id", "part_id", "stream_key", "text").dropDuplicates(["stream_key"])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").drop("received_at").dropDuplicates(["node_key"])


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comment_labels").drop("received_at").dropDuplicates(["comment_key"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").drop("received_at").dropDuplicates(["chunk_key"])


def groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_groups")


def node_spans(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("document_id", "node_key", "node_ord", "kind", F.size("section_path").alias("depth"), F.explode("spans").alias("s"))
    return n.select("document_id", F.col("s.part_id").alias("part_id"), "node_key", "node_ord", "kind", "depth", F.col("s.start_off").alias("start_off"), F.col("s.end_off").alias("end_off"))


def comment_streams(spark: SparkSession, d: str) -> DataFrame:
    """The text of each comment as a part of its own."""
    c = comments(spark, d).where("text is not null")
    return c.select("document_id", F.concat(F.lit("comment:"), F.col("comment_key").cast("string")).alias("part_id"), F.col("comment_key").alias("stream_key"), "text")


def pieces(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Every line of every stream cut in three, with stacks made from the stream's key: inserted, deleted, moved and plain text."""
    s = (streams(spark, d) if of is None else of).select("document_id", "part_id", "stream_key", F.posexplode(T.segments(F.col("text"))).alias("seg_ix", "x")).select("document_id", "part_id", "stream_key", "seg_ix", F.col("x.line").alias("line"))
    k = s.withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    n, m = F.length("line"), F.pmod(F.col("stream_key") + F.col("seg_ix") + F.col("k"), F.lit(7))
    lo, hi = F.floor(n * F.col("k") / 3).cast("int"), F.floor(n * (F.col("k") + 1) / 3).cast("int")
    tag = lambda kind: F.concat(F.lit(kind + ":"), F.col("seg_ix").cast("string"))
    stack = F.when(m == 0, F.array(tag("del"))).when(m == 1, F.array(tag("ins"))).when(m == 2, F.array(tag("ins"), tag("del"))).when(m == 3, F.array(tag("moveFrom"))).when(m == 4, F.array(tag("moveTo"))).otherwise(F.array().cast("array<string>"))
    plain = F.array().cast("array<string>")
    end = F.col("k") == 3
    return k.select("document_id", "part_id", (F.col("seg_ix") * 4 + F.col("k")).alias("piece_ord"), F.when(end, F.lit("\n")).otherwise(F.substring("line", lo + 1, hi - lo)).alias("text"), F.when(end, plain).otherwise(stack).alias("stack"))


#: The same rules as SQL.
STREAMS_SQL = "st AS (SELECT DISTINCT document_id, part_id, stream_key, text FROM streams WHERE text IS NOT NULL),"
PIECES_SQL = STREAMS_SQL + r"""
ln AS (SELECT document_id, part_id, stream_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_ix FROM st),
pc0 AS (SELECT *, (stream_key + seg_ix + k) % 7 AS m, length(line) * k // 3 AS lo, length(line) * (k + 1) // 3 AS hi FROM ln, (SELECT unnest([0, 1, 2, 3]) AS k)),
pc AS (SELECT document_id, part_id, seg_ix * 4 + k AS piece_ord, CASE WHEN k = 3 THEN chr(10) ELSE substr(line, lo + 1, hi - lo) END AS text,
  CASE WHEN k = 3 THEN []::VARCHAR[] WHEN m = 0 THEN ['del:' || seg_ix] WHEN m = 1 THEN ['ins:' || seg_ix] WHEN m = 2 THEN ['ins:' || seg_ix, 'del:' || seg_ix] WHEN m = 3 THEN ['moveFrom:' || seg_ix] WHEN m = 4 THEN ['moveTo:' || seg_ix] ELSE []::VARCHAR[] END AS stack FROM pc0),
pn AS (SELECT *, CASE WHEN (text = chr(10) AND len(stack) = 0) OR lag(text = chr(10) AND len(stack) = 0) OVER w IS NOT FALSE OR stack <> lag(stack) OVER w THEN 1 ELSE 0 END AS cut FROM pc WHERE text <> '' WINDOW w AS (PARTITION BY document_id, part_id ORDER BY piece_ord)),
pr AS (SELECT *, sum(cut) OVER (PARTITION BY document_id, part_id ORDER BY piece_ord) AS span_ord FROM pn),
sp0 AS (SELECT document_id, part_id, span_ord, string_agg(text, '' ORDER BY piece_ord) AS text, arg_min(stack, piece_ord) AS stack FROM pr GROUP BY ALL),
sp AS (SELECT *, sum(length(text)) OVER (PARTITION BY document_id, part_id ORDER BY span_ord) AS end_off FROM sp0),
spans AS (SELECT *, end_off - length(text) AS start_off FROM sp),
kinds AS (SELECT *, list_transform(stack, lambda r: split_part(r, ':', 1)) AS ks, len(stack) = 0 AND text = chr(10) AS line_end FROM spans),
vw AS (SELECT v.view, k.* FROM kinds k, (SELECT unnest(['accepted', 'original', 'superseded']) AS view) v WHERE k.line_end
  OR (v.view = 'accepted' AND NOT list_has_any(k.ks, ['del', 'moveFrom'])) OR (v.view = 'original' AND NOT list_has_any(k.ks, ['ins', 'moveTo'])) OR (v.view = 'superseded' AND list_has_any(k.ks, ['del', 'moveFrom']) AND list_has_any(k.ks, ['ins', 'moveTo']))),
proj AS (SELECT *, sum(length(text)) OVER (PARTITION BY document_id, part_id, view ORDER BY span_ord) AS view_end FROM vw),
pj AS (SELECT *, view_end - length(text) AS view_start FROM proj)"""
