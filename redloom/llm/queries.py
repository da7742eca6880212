"""Queries p3, p4, p6 to p10 and the SQL that some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.llm import leaks, lookalike, names, neardup, packing, reading, splitting
from redloom.session import table


def _authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comment_labels").select("author").unionByName(table(spark, d, "revision_labels").select("author"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.link_names(_authors(spark, d), "author"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(_authors(spark, d), "author")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.find_lookalikes(table(spark, d, "streams").select("stream_key", "text"), table(spark, d, "term_groups").select("group_key", "canonical", "synonyms"))


def p4_normal(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalise_text(table(spark, d, "streams").select("stream_key", "text").dropDuplicates(["stream_key"]), "text").select("stream_key", "plain")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(splitting.block_items(table(spark, d, "blocks"), table(spark, d, "chunk_params")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # the first piece of every item that was cut
    return _pieces(spark, d).where("n_pieces > 1 and piece_ix = 0").select(F.col("owner_key").alias("block_key"), F.col("item_ix").alias("row_ix"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select(F.col("owner_key").alias("block_key"), F.col("item_ix").alias("row_ix"), "piece_ix", "n_pieces", "start_off", "end_off", "cut", "depth", "piece")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("src"), F.col("chunk_key").alias("key"), "text")
    streams = table(spark, d, "streams").select(F.lit("stream").alias("src"), F.col("stream_key").alias("key"), "text")
    return neardup.near_duplicates(chunks.unionByName(streams), width=3, threshold=0.6, least_words=40)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.key_pairs(*_near(spark, d))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a text: its class of equal shingle sets, named by its smallest key, and how many other classes that class is linked to."""
    members, pairs = _near(spark, d)
    both = pairs.select(F.col("class_a").alias("class")).unionByName(pairs.select(F.col("class_b").alias("class")))
    links = both.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    named = members.groupBy("class").agg(F.min("key").alias("class_key"))
    return members.join(named, "class").join(links, "class", "left").select("src", "key", "class_key", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_texts(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "capacities"))
    return packed.withColumnRenamed("key", "doc_id")


def _leaks(spark: SparkSession, d: str, **how) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), run=12, **how)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, edited=False).where("run >= 12").select("item_id", F.col("key").alias("doc_id"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Edited and partial copies too, with their alignment."""
    return _leaks(spark, d, least=0.4).where("run >= 12 or similarity >= 0.4").withColumnRenamed("key", "doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    model = reading.train(documents, table(spark, d, "reading_labels"))
    return reading.reading_levels(documents, model).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_entities, p4_found, p4_normal, p6_found, p6_pieces, p7_found, p7_classes, p8_containers, p9_found, p9_leaks, p10_levels)}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_RUNS = f"""
WITH t AS (SELECT DISTINCT 'chunk' AS src, chunk_key AS k, text FROM chunks UNION ALL SELECT DISTINCT 'stream', stream_key, text FROM streams),
w AS (SELECT src, k, {_WORDS} AS w FROM t WHERE text IS NOT NULL),
r AS (SELECT DISTINCT src, k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w WHERE len(w) >= 40)"""

SQL = {
    "p4_found": f"""
WITH s AS (SELECT DISTINCT stream_key AS k, text AS raw, {lookalike.normal_sql('text')} AS plain FROM streams WHERE text IS NOT NULL),
g AS (SELECT group_key AS k, canonical AS raw, {lookalike.normal_sql('canonical')} AS plain FROM term_groups WHERE canonical IS NOT NULL),
f0 AS (SELECT group_key AS k, unnest(list_append(coalesce(synonyms, []), canonical)) AS form FROM term_groups),
f AS (SELECT DISTINCT k, ' ' || trim(regexp_replace({lookalike.normal_sql('form')}, '[ \\n]+', ' ', 'g')) || ' ' AS form FROM f0 WHERE form IS NOT NULL),
t AS (SELECT k, ' ' || trim(regexp_replace(plain, '[ \\n]+', ' ', 'g')) || ' ' AS line FROM s)
SELECT 'stream' AS src, a.k AS key_a, b.k AS key_b FROM s a JOIN s b ON a.plain = b.plain AND a.k < b.k AND a.raw <> b.raw
UNION ALL SELECT 'group', CAST(a.k AS BIGINT), CAST(b.k AS BIGINT) FROM g a JOIN g b ON a.plain = b.plain AND a.k < b.k AND a.raw <> b.raw
UNION ALL SELECT DISTINCT 'hit', CAST(f.k AS BIGINT), t.k FROM t JOIN f ON contains(t.line, f.form) AND trim(f.form) <> ''""",
    "p6_found": """
WITH b AS (SELECT DISTINCT ON (block_key) * FROM blocks),
i AS (SELECT block_key, -1 AS row_ix, text, params_id FROM b UNION ALL SELECT block_key, r.row_ix, r.text, params_id FROM (SELECT block_key, params_id, unnest(row_items) AS r FROM b))
SELECT i.block_key, CAST(i.row_ix AS INTEGER) AS row_ix FROM i JOIN chunk_params p ON p.params_id = coalesce(i.params_id, 1) WHERE length(i.text) > p.size_cap""",
    "p7_found": f"""
{_RUNS},
n AS (SELECT src, k, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT a.src, a.k AS ka, b.k AS kb, count(*) AS c FROM r a JOIN r b ON a.src = b.src AND a.run = b.run AND a.k < b.k GROUP BY ALL)
SELECT c.src, c.ka AS key_a, c.kb AS key_b FROM c JOIN n x ON x.src = c.src AND x.k = c.ka JOIN n y ON y.src = c.src AND y.k = c.kb WHERE c.c >= 0.6 * (x.n + y.n - c.c)""",
    "p7_classes": f"""
{_RUNS},
g AS (SELECT src, k, md5(string_agg(run, chr(1) ORDER BY run)) AS sig, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT *, min(k) OVER (PARTITION BY src, sig) AS ck FROM g),
o AS (SELECT r.src, r.k, r.run, m.n FROM r JOIN m ON m.src = r.src AND m.k = r.k WHERE m.k = m.ck),
c AS (SELECT a.src, a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, count(*) AS c FROM o a JOIN o b ON a.src = b.src AND a.run = b.run AND a.k < b.k GROUP BY ALL),
l AS (SELECT src, ka, kb FROM c WHERE c >= 0.6 * (na + nb - c)),
e AS (SELECT src, k, count(*) AS n_links FROM (SELECT src, ka AS k FROM l UNION ALL SELECT src, kb FROM l) GROUP BY ALL)
SELECT m.src, m.k AS key, m.ck AS class_key, coalesce(e.n_links, 0) AS n_links FROM m LEFT JOIN e ON e.src = m.src AND e.k = m.ck""",
    "p9_found": f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
gi AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda p: list_aggregate(w[p:p + 11], 'string_agg', ' '))) AS g FROM i WHERE len(w) >= 12),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
gd AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda p: list_aggregate(w[p:p + 11], 'string_agg', ' '))) AS g FROM d WHERE len(w) >= 12)
SELECT DISTINCT gi.item_id, gd.doc_id FROM gi JOIN gd ON gi.g = gd.g""",
}
