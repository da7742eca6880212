"""Queries p1, p2 and p5, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.operators import hierarchy, nested, timestamps
from redloom.session import staged, table


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, src, key: table(spark, d, name).select(F.lit(src).alias("src"), F.col(key).alias("item_key"), "date_raw", "tz_name")
    both = part("comment_labels", "comment", "comment_key").unionByName(part("revision_labels", "revision", "revision_key"))
    return both.dropDuplicates(["src", "item_key"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    done = timestamps.normalise_timestamps(_stamps(spark, d), "date_raw", "tz_name", F.col("src"), spread="item_key")
    return done.where("utc_us is not null").select("src", "item_key", "utc_us")


def p1_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each source's notations stand for, and how many could be placed in time."""
    done = timestamps.normalise_timestamps(_stamps(spark, d), "date_raw", "tz_name", F.col("src"), spread="item_key")
    return done.groupBy("src", (F.col("tz_name").isNull()).alias("no_zone_column")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("utc_us").alias("n_placed"), F.countDistinct("date_raw").alias("n_notations"))


def _compact(c: str) -> Column:
    """An id of hexadecimal digits as half as many bytes, any other as its text; a first byte tells which."""
    return F.when(F.col(c).rlike("^([0-9a-f]{2})+$"), F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(F.col(c), "utf-8")))


def _links(spark: SparkSession, d: str) -> DataFrame:
    # keys are unique in their table, so links only need a hash of the document; its last bit tells the table
    scope = lambda bit: F.shiftleft(F.xxhash64("document_id"), 1) + F.lit(bit)
    comments = table(spark, d, "comment_labels").select("document_id", _compact("document_id").alias("doc"), "comment_key", F.lower("para_id").alias("para"), F.lower("parent_id").alias("up"))
    nodes = table(spark, d, "nodes").select("document_id", _compact("document_id").alias("doc"), "node_key", "node_id", "child_ids")
    return hierarchy.named_parent_links(comments, "doc", "comment_key", "para", "up", scope(0)).unionByName(hierarchy.child_links(nodes, "doc", "node_key", "node_id", "child_ids", scope(1)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    forest = hierarchy.build_hierarchy(_links(spark, d))
    src = F.when(F.col("scope").bitwiseAND(F.lit(1)) == 0, "comment").otherwise("node")
    return forest.where("depth <> 0").select(src.alias("src"), F.col("node_key").alias("item_key"), "root_key", F.col("depth").alias("tree_depth"))


def _forest(spark: SparkSession, d: str) -> DataFrame:
    return staged(hierarchy.build_hierarchy(_links(spark, d)), "forest")


def _source() -> Column:
    return F.when(F.col("scope").bitwiseAND(F.lit(1)) == 0, "comment").otherwise("node").alias("src")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_forest(spark, d)).select(_source(), F.col("node_key").alias("item_key"), "root_key", F.col("depth").alias("tree_depth"), F.array_join(F.transform("path", lambda k: k.cast("string")), "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_forest(spark, d)).select(_source(), F.col("node_key").alias("item_key"), "descendant_key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    nodes, streams = table(spark, d, "nodes"), table(spark, d, "streams")
    parts = table(spark, d, "parts").select("part_key", "tree").dropDuplicates(["part_key"])
    tree = nested.flatten_trees(parts, "part_key", "tree").select(F.lit("tree").alias("src"), "owner_key", F.col("ix").alias("item_ix"), text("parent_ix").alias("link_key"))
    child = nested.explode_children(nodes, "document_id", "node_key", "node_id", "child_ids").select(F.lit("child").alias("src"), "owner_key", "item_ix", text("child_key").alias("link_key"))
    span = nested.explode_spans(nodes, "document_id", "node_key", "spans", streams, "document_id", "part_id", "stream_key").select(F.lit("span").alias("src"), "owner_key", "item_ix", text("stream_key").alias("link_key"))
    return tree.unionByName(child).unionByName(span)


def p5_children(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.explode_children(table(spark, d, "nodes"), "document_id", "node_key", "node_id", "child_ids")
    return rows.select("owner_key", "item_ix", "child_name", "child_key")


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.explode_spans(table(spark, d, "nodes"), "document_id", "node_key", "spans", table(spark, d, "streams"), "document_id", "part_id", "stream_key")
    return rows.select("owner_key", "item_ix", "part_id", "start_off", "end_off", "stream_key")


def p5_elements_by_tag(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "parts").select("part_key", "tree").dropDuplicates(["part_key"])
    e = nested.flatten_trees(parts, "part_key", "tree")
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("n_elements"), F.max("depth").alias("deepest"), F.sum((F.col("post") - F.col("pre") - 1).cast("long")).alias("interval_sum"))


def p5_element_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of paragraphs and of runs, each run with the nearest paragraph around it, by interval containment."""
    parts = table(spark, d, "parts").select("part_key", "tree").dropDuplicates(["part_key"])
    e = staged(nested.flatten_trees(parts, "part_key", "tree").select("owner_key", "ix", "pre", "post", "tag"), "elements")
    inner = nested.within(nested.table_of(e, "w:r"), nested.table_of(e, "w:p"))
    return inner.select("owner_key", F.col("ix").alias("run_ix"), F.col("outer_ix").alias("paragraph_ix"))


QUERIES = {"p1_found": p1_found, "p1_dictionary": p1_dictionary, "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p5_found": p5_found, "p5_children": p5_children, "p5_spans": p5_spans, "p5_elements_by_tag": p5_elements_by_tag, "p5_element_tables": p5_element_tables}

_PARENTS = """WITH RECURSIVE c AS (SELECT DISTINCT 'comment' AS src, document_id AS doc, comment_key AS k, lower(para_id) AS nm, lower(parent_id) AS up FROM comment_labels),
n AS (SELECT DISTINCT ON (node_key) document_id AS doc, node_key AS k, node_id, child_ids FROM nodes),
kids AS (SELECT doc, k AS pk, unnest(child_ids) AS nm FROM n),
par AS (
  SELECT c.src, c.k, min(p.k) AS pk FROM c JOIN c p ON p.doc = c.doc AND p.nm = c.up GROUP BY ALL
  UNION ALL
  SELECT 'node', n.k, min(kids.pk) FROM kids JOIN n ON n.doc = kids.doc AND n.node_id = kids.nm GROUP BY ALL),"""
_DOWN = """
alone AS (SELECT 'comment' AS src, k FROM c UNION SELECT 'node', k FROM n),
down AS (
  SELECT a.src, a.k, a.k AS root, 0 AS d, [a.k] AS path FROM alone a WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.src = a.src AND par.k = a.k)
  UNION ALL SELECT p.src, p.k, w.root, w.d + 1, list_append(w.path, p.k) FROM down w JOIN par p ON p.src = w.src AND p.pk = w.k)"""
_ELEMENTS = """
t0 AS (SELECT DISTINCT ON (part_key) part_key, tree FROM parts WHERE tree IS NOT NULL),
t1 AS (SELECT part_key, CASE WHEN json_valid(tree) AND json_type(tree) = 'VARCHAR' THEN json_extract_string(tree, '$') ELSE tree END AS tree FROM t0),
t2 AS (SELECT part_key, CASE WHEN json_valid(tree) AND json_type(tree) = 'VARCHAR' THEN json_extract_string(tree, '$') ELSE tree END AS tree FROM t1),
jt AS (SELECT t2.part_key, j.id, j.parent, j.type, j.value FROM t2, json_tree(t2.tree) j WHERE json_valid(t2.tree)),
el AS (SELECT part_key, id, parent, json_extract(value, '$.tag') AS tag, row_number() OVER (PARTITION BY part_key ORDER BY id) - 1 AS ix FROM jt WHERE type = 'OBJECT' AND json_exists(value, '$.tag')),
up AS (SELECT part_key, id, parent AS cur FROM el UNION ALL SELECT u.part_key, u.id, jt.parent FROM up u JOIN jt ON jt.part_key = u.part_key AND jt.id = u.cur WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.part_key = u.part_key AND el.id = u.cur)),
pa AS (SELECT u.part_key, u.id, e.ix AS parent_ix FROM up u JOIN el e ON e.part_key = u.part_key AND e.id = u.cur)"""

_AROUND = """,
elp AS (SELECT el.part_key, el.ix, CASE WHEN json_type(el.tag) = 'VARCHAR' THEN json_extract_string(el.tag, '$') ELSE CAST(el.tag AS VARCHAR) END AS tag, pa.parent_ix FROM el LEFT JOIN pa ON pa.part_key = el.part_key AND pa.id = el.id),
an AS (SELECT part_key, ix, parent_ix AS a FROM elp WHERE parent_ix IS NOT NULL UNION ALL SELECT an.part_key, an.ix, e.parent_ix FROM an JOIN elp e ON e.part_key = an.part_key AND e.ix = an.a WHERE e.parent_ix IS NOT NULL)"""

SQL = {
    "p2_found": f"""
{_PARENTS}
walk AS (
  SELECT src, k, pk AS cur, 1 AS steps, [k, pk] AS seen, pk = k AS lp FROM par
  UNION ALL
  SELECT w.src, w.k, p.pk, w.steps + 1, list_append(w.seen, p.pk), list_contains(w.seen, p.pk) FROM walk w JOIN par p ON p.src = w.src AND p.k = w.cur WHERE NOT w.lp)
SELECT src, k AS item_key, CASE WHEN bool_or(lp) THEN min(list_min(list_slice(seen, list_position(seen, cur), len(seen)))) FILTER (WHERE lp) ELSE arg_max(cur, steps) END AS root_key,
  CAST(CASE WHEN bool_or(lp) THEN -1 ELSE max(steps) END AS INTEGER) AS tree_depth
FROM walk GROUP BY src, k""",
    "p2_paths": f"""
{_PARENTS}{_DOWN}
SELECT src, k AS item_key, root AS root_key, CAST(d AS INTEGER) AS tree_depth, array_to_string(path, '/') AS path FROM down""",
    "p2_descendants": f"""
{_PARENTS}{_DOWN}
SELECT src, unnest(list_slice(path, 1, len(path) - 1)) AS item_key, k AS descendant_key FROM down""",
    "p5_found": f"""
WITH RECURSIVE {_ELEMENTS},
n AS (SELECT DISTINCT ON (node_key) * FROM nodes),
ce AS (SELECT document_id, node_key, unnest(child_ids) AS nm, unnest(range(len(child_ids))) AS ix FROM n),
ck AS (SELECT document_id, node_id, min(node_key) AS k FROM nodes GROUP BY ALL),
se AS (SELECT document_id, node_key, unnest(spans) AS s, unnest(range(len(spans))) AS ix FROM n),
sk AS (SELECT document_id, part_id, min(stream_key) AS k FROM streams GROUP BY ALL)
SELECT 'tree' AS src, el.part_key AS owner_key, CAST(el.ix AS INTEGER) AS item_ix, coalesce(CAST(pa.parent_ix AS VARCHAR), '') AS link_key FROM el LEFT JOIN pa ON pa.part_key = el.part_key AND pa.id = el.id
UNION ALL SELECT 'child', ce.node_key, CAST(ce.ix AS INTEGER), coalesce(CAST(ck.k AS VARCHAR), '') FROM ce LEFT JOIN ck ON ck.document_id = ce.document_id AND ck.node_id = ce.nm
UNION ALL SELECT 'span', se.node_key, CAST(se.ix AS INTEGER), coalesce(CAST(sk.k AS VARCHAR), '') FROM se LEFT JOIN sk ON sk.document_id = se.document_id AND sk.part_id = se.s.part_id""",
    "p5_children": """
WITH n AS (SELECT DISTINCT ON (node_key) * FROM nodes),
e AS (SELECT document_id, node_key, unnest(child_ids) AS nm, unnest(range(len(child_ids))) AS ix FROM n),
k AS (SELECT document_id, node_id, min(node_key) AS child_key FROM nodes GROUP BY ALL)
SELECT e.node_key AS owner_key, CAST(e.ix AS INTEGER) AS item_ix, e.nm AS child_name, k.child_key FROM e LEFT JOIN k ON k.document_id = e.document_id AND k.node_id = e.nm""",
    "p5_spans": """
WITH n AS (SELECT DISTINCT ON (node_key) * FROM nodes),
e AS (SELECT document_id, node_key, unnest(spans) AS s, unnest(range(len(spans))) AS ix FROM n),
k AS (SELECT document_id, part_id, min(stream_key) AS stream_key FROM streams GROUP BY ALL)
SELECT e.node_key AS owner_key, CAST(e.ix AS INTEGER) AS item_ix, e.s.part_id AS part_id, e.s.start_off AS start_off, e.s.end_off AS end_off, k.stream_key FROM e LEFT JOIN k ON k.document_id = e.document_id AND k.part_id = e.s.part_id""",
    "p5_elements_by_tag": f"""
WITH RECURSIVE {_ELEMENTS}{_AROUND},
dp AS (SELECT part_key, ix, count(*) AS n FROM an GROUP BY ALL), ds AS (SELECT part_key, a AS ix, count(*) AS n FROM an GROUP BY ALL)
SELECT elp.tag, count(*) AS n_elements, CAST(max(coalesce(dp.n, 0)) AS INTEGER) AS deepest, CAST(sum(2 * coalesce(ds.n, 0)) AS BIGINT) AS interval_sum FROM elp LEFT JOIN dp USING (part_key, ix) LEFT JOIN ds USING (part_key, ix) GROUP BY elp.tag""",
    "p5_element_tables": f"""
WITH RECURSIVE {_ELEMENTS}{_AROUND}
SELECT r.part_key AS owner_key, CAST(r.ix AS INTEGER) AS run_ix, CAST(max(p.ix) AS INTEGER) AS paragraph_ix FROM elp r LEFT JOIN an ON an.part_key = r.part_key AND an.ix = r.ix LEFT JOIN elp p ON p.part_key = an.part_key AND p.ix = an.a AND p.tag = 'w:p' WHERE r.tag = 'w:r' GROUP BY r.part_key, r.ix""",
}
