"""Queries over the reference's own operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.functions import text as T
from redloom.functions.stem import stem_tokens
from redloom.operators import chunks as C
from redloom.operators import evals, hierarchy, matching, retrieval, revisions, structure, summaries, terms, views
from redloom.plans import adapters as A
from redloom.session import staged, table
from redloom.sources import docx, writer

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_T = r"\p{L}\p{N}\p{M}"
_H = r"\-\x{00AD}\x{2010}\x{2011}"


def _fold(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')"


def _joined(x: str) -> str:
    word = _fold(f"regexp_replace(t, '[{_H}]', '', 'g')")
    return f"list_transform(regexp_extract_all({x}, '[{_T}][{_T}{_H}]*'), lambda t: {word})"


def _split(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[{_T}]+'), lambda t: {_fold('t')})"


# --- tokens, forms, matching


@query(f"""
WITH s AS (SELECT DISTINCT stream_key, text FROM streams WHERE text IS NOT NULL), w AS (SELECT stream_key, {_joined('text')} AS j, {_split('text')} AS p FROM s)
SELECT stream_key, CAST(len(j) AS BIGINT) AS n_joined, CAST(len(p) AS BIGINT) AS n_split, CAST(len(list_distinct(j)) AS BIGINT) AS n_distinct, CAST(coalesce(list_sum(list_transform(j, lambda t: length(t))), 0) AS BIGINT) AS n_chars FROM w""")
def tokens_per_stream(spark: SparkSession, d: str) -> DataFrame:
    s = A.streams(spark, d).select("stream_key", T.token_words(F.col("text")).alias("j"), T.token_words(F.col("text"), "split").alias("p"))
    total = F.aggregate("j", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    return s.select("stream_key", F.size("j").cast("long").alias("n_joined"), F.size("p").cast("long").alias("n_split"), F.size(F.array_distinct("j")).cast("long").alias("n_distinct"), total.alias("n_chars"))


@query(f"SELECT group_key, array_to_string({_joined('canonical')}, ' ') AS normal FROM term_groups WHERE canonical IS NOT NULL")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return A.groups(spark, d).where("canonical is not null").select("group_key", T.normalize(F.col("canonical")).alias("normal"))


_FORMS = f"""
fm0 AS (SELECT group_key, canonical AS form, 1 AS rank FROM term_groups UNION ALL SELECT group_key, unnest(synonyms), 2 FROM term_groups),
fm AS (SELECT DISTINCT group_key, rank, 'joined' AS reading, {_joined('form')} AS tokens FROM fm0 WHERE form IS NOT NULL UNION SELECT DISTINCT group_key, rank, 'split', {_split('form')} FROM fm0 WHERE form IS NOT NULL)"""
_LN = """
st AS (SELECT DISTINCT document_id, part_id, stream_key, text FROM streams WHERE text IS NOT NULL),
ln AS (SELECT document_id, part_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_ix FROM st)"""
_MATCH = f"""
ms AS (SELECT document_id, part_id, seg_ix, 'joined' AS reading, unnest(l) AS m, generate_subscripts(l, 1) AS ix FROM (SELECT *, regexp_extract_all(line, '[^{_T}]*[{_T}][{_T}{_H}]*') AS l FROM ln)
  UNION ALL SELECT document_id, part_id, seg_ix, 'split', unnest(l), generate_subscripts(l, 1) FROM (SELECT *, regexp_extract_all(line, '[^{_T}]*[{_T}]+') AS l FROM ln)),
tk0 AS (SELECT *, regexp_replace(m, '^[^{_T}]+', '') AS own, sum(length(m)) OVER (PARTITION BY document_id, part_id, seg_ix, reading ORDER BY ix) AS e FROM ms),
tk AS (SELECT document_id, part_id, seg_ix, reading, list({_fold(f"regexp_replace(own, '[{_H}]', '', 'g')")} ORDER BY ix) AS t, list(e - length(own) ORDER BY ix) AS s, list(e ORDER BY ix) AS e FROM tk0 GROUP BY ALL),
place AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk),
cand AS (SELECT a.document_id, a.part_id, a.seg_ix, f.group_key, a.s[a.i] AS s, a.e[a.i + len(f.tokens) - 1] AS e, min(f.rank) AS rank FROM place a JOIN fm f ON f.reading = a.reading AND f.tokens[1] = a.t[a.i] AND a.t[a.i:a.i + len(f.tokens) - 1] = f.tokens GROUP BY ALL),
ranked AS (SELECT document_id, part_id, seg_ix, group_key, list(struct_pack(s := s, e := e, rank := rank) ORDER BY s - e, s, rank) AS l FROM cand GROUP BY ALL),
kept AS (SELECT document_id, part_id, seg_ix, group_key, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.s < x.e AND t.e > x.s)) = 0 THEN list_append(acc, x) ELSE acc END, CAST([] AS STRUCT(s HUGEINT, e HUGEINT, rank INTEGER)[]))) AS h FROM ranked),
hits AS (SELECT document_id, part_id, seg_ix, group_key, CAST(h.s AS INTEGER) AS start, CAST(h.e AS INTEGER) AS stop, CASE h.rank WHEN 1 THEN 'exact' ELSE 'synonym' END AS match_type FROM kept)"""
_TOKENS = f"{_LN}, {_MATCH}"


def _plain_forms(spark: SparkSession, d: str) -> DataFrame:
    return terms.compile_forms(A.groups(spark, d).withColumn("stemming", F.lit(None).cast("string")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return terms.match_lines(terms.lines_of(A.streams(spark, d).drop("stream_key")), _plain_forms(spark, d))


@query(f"WITH {_FORMS}, {_TOKENS} SELECT document_id, part_id, CAST(seg_ix AS INTEGER) AS seg_ix, group_key, start AS start_off, stop AS end_off, match_type FROM hits")
def term_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("document_id", "part_id", "seg_ix", "group_key", F.col("start").alias("start_off"), F.col("end").alias("end_off"), "match_type")


@query(f"WITH {_FORMS}, {_TOKENS} SELECT document_id, group_key, match_type, count(*) AS n_hits, min(start) AS first_start FROM hits GROUP BY ALL")
def term_hits_by_document(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).groupBy("document_id", "group_key", "match_type").agg(F.count(F.lit(1)).alias("n_hits"), F.min("start").alias("first_start"))


@query()
def term_hits_stem(spark: SparkSession, d: str) -> DataFrame:
    forms = terms.compile_forms(A.groups(spark, d))
    h = terms.match_lines(terms.lines_of(A.streams(spark, d).drop("stream_key")), forms)
    return h.select("document_id", "part_id", "seg_ix", "group_key", F.col("start").alias("start_off"), F.col("end").alias("end_off"), "match_type")


@query()
def cross_line_misses(spark: SparkSession, d: str) -> DataFrame:
    return terms.cross_line_misses(A.streams(spark, d).drop("stream_key"), _plain_forms(spark, d)).withColumnsRenamed({"start": "start_off", "end": "end_off"})


@query()
def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = A.streams(spark, d).select(F.explode(T.token_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem_tokens(F.array("word"))[0].alias("stem"))


@query(f"""
WITH f AS (SELECT group_key, canonical, unnest(list_append(coalesce(synonyms, []), canonical)) AS form FROM term_groups)
SELECT array_to_string({_joined('form')}, ' ') AS reading, count(DISTINCT group_key) AS n_groups FROM f WHERE form IS NOT NULL GROUP BY 1 HAVING count(DISTINCT group_key) > 1""")
def ambiguous_forms(spark: SparkSession, d: str) -> DataFrame:
    f = terms.compile_forms(A.groups(spark, d)).where("reading = 'joined' and algorithm = ''")
    return f.groupBy(F.array_join("tokens", " ").alias("reading")).agg(F.count_distinct("group_key").alias("n_groups")).where("n_groups > 1")


# --- views


@query(f"WITH {A.PIECES_SQL} SELECT document_id, part_id, CAST(span_ord AS BIGINT) AS span_ord, CAST(start_off AS INTEGER) AS start_off, CAST(end_off AS INTEGER) AS end_off, array_to_string(stack, '|') AS stack, text FROM spans")
def stream_spans(spark: SparkSession, d: str) -> DataFrame:
    return views.build_spans(A.pieces(spark, d)).select("document_id", "part_id", "span_ord", "start_off", "end_off", F.array_join("stack", "|").alias("stack"), "text")


def _view_texts(spark: SparkSession, d: str, view: str) -> DataFrame:
    return views.view_text(views.project(views.build_spans(A.pieces(spark, d)), view))


for _view in views.VIEWS:

    def _make(view: str):
        def f(spark: SparkSession, d: str) -> DataFrame:
            return _view_texts(spark, d, view)

        f.__name__ = f"view_text_{view}"
        return f

    query(f"WITH {A.PIECES_SQL} SELECT document_id, part_id, view, string_agg(text, '' ORDER BY span_ord) AS text FROM pj WHERE view = '{_view}' GROUP BY ALL")(_make(_view))


def _probes(spark: SparkSession, d: str, projection: DataFrame) -> DataFrame:
    """Ranges every 60 characters, 90 long, over each view: they cross many span ends."""
    ends = projection.groupBy("document_id", "part_id", "view").agg(F.max("view_end").alias("n"))
    at = ends.select("document_id", "part_id", "view", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(60))).alias("start"))
    return at.select("document_id", "part_id", "view", F.col("start").cast("string").alias("match_id"), F.col("start").cast("int").alias("start"), F.least(F.col("start") + 90, "n").cast("int").alias("end"))


@query(f"""
WITH {A.PIECES_SQL}, ends AS (SELECT document_id, part_id, view, max(view_end) AS n FROM pj WHERE view = 'accepted' GROUP BY ALL),
pb AS (SELECT document_id, part_id, view, unnest(range(0, CAST(n AS BIGINT), 60)) AS s, n FROM ends), pb2 AS (SELECT *, least(s + 90, n) AS e FROM pb),
cl AS (SELECT b.document_id, b.part_id, b.s, p.start_off + greatest(b.s, p.view_start) - p.view_start AS u0, p.start_off + least(b.e, p.view_end) - p.view_start AS u1 FROM pb2 b JOIN pj p ON p.document_id = b.document_id AND p.part_id = b.part_id AND p.view = b.view AND b.s < p.view_end AND p.view_start < b.e),
rn AS (SELECT *, CASE WHEN u0 = lag(u1) OVER (PARTITION BY document_id, part_id, s ORDER BY u0) THEN 0 ELSE 1 END AS new FROM cl),
gr AS (SELECT *, sum(new) OVER (PARTITION BY document_id, part_id, s ORDER BY u0) AS g FROM rn)
SELECT document_id, part_id, CAST(s AS VARCHAR) AS match_id, CAST(min(u0) AS INTEGER) AS union_start, CAST(max(u1) AS INTEGER) AS union_end FROM gr GROUP BY document_id, part_id, s, g""")
def union_spans(spark: SparkSession, d: str) -> DataFrame:
    p = views.project(views.build_spans(A.pieces(spark, d)), "accepted")
    return views.union_spans(_probes(spark, d, p), p).select("document_id", "part_id", "match_id", "union_start", "union_end")


@query(f"""
WITH {A.PIECES_SQL}, q AS (SELECT document_id, part_id, start_off AS o FROM spans)
SELECT q.document_id, q.part_id, CAST(q.o AS INTEGER) AS union_offset, CAST(coalesce((SELECT max_by(p.view_start + least(q.o - p.start_off, p.end_off - p.start_off), p.span_ord) FROM pj p WHERE p.view = 'original' AND p.document_id = q.document_id AND p.part_id = q.part_id AND p.start_off <= q.o), 0) AS INTEGER) AS view_offset FROM q""")
def view_offsets(spark: SparkSession, d: str) -> DataFrame:
    s = views.build_spans(A.pieces(spark, d))
    points = s.select("document_id", "part_id", F.lit("original").alias("view"), F.col("span_ord").cast("string").alias("point_id"), F.col("start_off").alias("offset"))
    return views.view_offsets(points, views.project(s, "original")).select("document_id", "part_id", F.col("offset").alias("union_offset"), "view_offset")


# --- documents


_LINES = "WITH st AS (SELECT DISTINCT document_id, part_id, stream_key, text FROM streams WHERE text IS NOT NULL UNION ALL SELECT DISTINCT document_id, 'comment:' || comment_key, comment_key, text FROM comment_labels WHERE text IS NOT NULL)," + A.PIECES_SQL.removeprefix(A.STREAMS_SQL)


@query(f"""
{_LINES},
lf AS (SELECT document_id, s.part_id AS part_id, 'node:' || node_key AS owner, CAST(leaf_ix AS BIGINT) AS leaf_ix, s.start_off AS a, s.end_off AS b FROM (SELECT document_id, node_key, unnest(spans) AS s, generate_subscripts(spans, 1) - 1 AS leaf_ix FROM (SELECT DISTINCT ON (node_key) * FROM nodes) WHERE kind IN ('para', 'heading', 'list_item'))
  UNION ALL SELECT document_id, part_id, part_id, 0, 0, length(text) + 1 FROM st WHERE starts_with(part_id, 'comment:')),
lt AS (SELECT l.document_id, l.part_id, l.owner, l.leaf_ix, p.view, min(p.view_start + greatest(l.a - p.start_off, 0)) AS vb, string_agg(substr(p.text, CAST(greatest(l.a, p.start_off) - p.start_off + 1 AS BIGINT), CAST(least(l.b, p.end_off) - greatest(l.a, p.start_off) AS BIGINT)), '' ORDER BY p.span_ord) AS text
  FROM lf l JOIN pj p ON p.document_id = l.document_id AND p.part_id = l.part_id AND p.view <> 'superseded' AND p.start_off < l.b AND l.a < p.end_off AND l.a < l.b GROUP BY ALL),
ls AS (SELECT * EXCLUDE (text), owner || '|' || leaf_ix || '|' || part_id || '|' || view AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_ix FROM lt),
lb AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY seg_ix) - length(line) - 1 AS base FROM ls),
tl AS (SELECT id AS document_id, '-' AS part_id, seg_ix, line FROM lb), {_FORMS}, {_MATCH.replace("FROM ln)", "FROM tl)")},
hv AS (SELECT lb.document_id, lb.part_id, lb.owner, lb.leaf_ix, lb.view, h.group_key, h.match_type, vb + base + h.start AS vs, vb + base + h.stop AS ve FROM hits h JOIN lb ON lb.id = h.document_id AND lb.seg_ix = h.seg_ix),
cl AS (SELECT h.*, p.start_off + greatest(h.vs, p.view_start) - p.view_start AS u0, p.start_off + least(h.ve, p.view_end) - p.view_start AS u1 FROM hv h JOIN pj p ON p.document_id = h.document_id AND p.part_id = h.part_id AND p.view = h.view AND h.vs < p.view_end AND p.view_start < h.ve),
rn AS (SELECT *, CASE WHEN u0 = lag(u1) OVER w THEN 0 ELSE 1 END AS new FROM cl WINDOW w AS (PARTITION BY document_id, part_id, owner, leaf_ix, view, group_key, match_type, vs, ve ORDER BY u0)),
gr AS (SELECT *, sum(new) OVER (PARTITION BY document_id, part_id, owner, leaf_ix, view, group_key, match_type, vs, ve ORDER BY u0) AS g FROM rn),
pc1 AS (SELECT document_id, part_id, owner, leaf_ix, view, group_key, match_type, vs, ve, g, min(u0) AS u0, max(u1) AS u1 FROM gr GROUP BY ALL),
us AS (SELECT document_id, part_id, owner, leaf_ix, view, group_key, match_type, vs, ve, string_agg(CAST(u0 AS BIGINT) || '-' || CAST(u1 AS BIGINT), ',' ORDER BY u0) AS spans FROM pc1 GROUP BY ALL)
SELECT document_id, part_id, owner, group_key, spans, CASE WHEN starts_with(owner, 'comment:') THEN '' ELSE string_agg(DISTINCT view, ',' ORDER BY view) END AS present_in, min(match_type) AS match_type FROM us GROUP BY document_id, part_id, owner, group_key, spans""")
def document_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every group in every paragraph-like node in both views, and in every comment."""
    forms = _plain_forms(spark, d)
    n = A.nodes(spark, d).where(F.col("kind").isin(*matching.UNITS)).select("document_id", F.concat(F.lit("node:"), F.col("node_key").cast("string")).alias("owner"), "node_ord", F.posexplode("spans").alias("leaf_ix", "s"))
    leaves = n.select("document_id", F.col("s.part_id").alias("part_id"), "owner", "node_ord", "leaf_ix", F.col("s.start_off").alias("start_off"), F.col("s.end_off").alias("end_off"))
    bodies = A.comment_streams(spark, d)
    of = bodies.select("document_id", "part_id", F.col("part_id").alias("owner"), F.lit(0).alias("leaf_ix"), F.lit(0).alias("start_off"), (F.length("text") + 1).alias("end_off"))
    show = lambda h: h.select("document_id", "part_id", "owner", "group_key", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["union_start"].cast("string"), s["union_end"].cast("string"))), ",").alias("spans"), F.array_join("present_in", ",").alias("present_in"), "match_type")
    body = matching.document_hits(leaves, views.build_spans(A.pieces(spark, d)), forms)
    said = matching.comment_hits(of, views.build_spans(A.pieces(spark, d, bodies)), forms)
    return show(body).unionByName(show(said))


# --- packages: written from the tables, read back by the package reader


def _packages(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    files = writer.write_packages(A.pieces(spark, d).where("text <> ''"), ["document_id", "part_id"])
    return _package_tables(files)


def _package_tables(files: DataFrame) -> dict[str, DataFrame]:
    rows = staged(docx.parse_files(files), "packages")
    names = rows.select(F.col("document_id").alias("__hash"), "path").distinct()
    # equal packages have one id and several paths
    return {k: t.withColumnRenamed("document_id", "__hash").join(names, "__hash").withColumns({"document_id": F.substring_index("path", "/", 1), "stream_part": F.expr("substring(path, instr(path, '/') + 1)")}).drop("__hash") for k, t in docx.tables_of(rows).items()}


@query(f"WITH {A.PIECES_SQL} SELECT document_id, part_id, CAST(row_number() OVER (PARTITION BY document_id, part_id ORDER BY span_ord) - 1 AS INTEGER) AS span_ord, CAST(start_off AS INTEGER) AS start_off, CAST(end_off AS INTEGER) AS end_off, array_to_string(stack, '|') AS stack, text FROM spans")
def package_spans(spark: SparkSession, d: str) -> DataFrame:
    t = _packages(spark, d)["span"].distinct()
    return t.select("document_id", F.col("stream_part").alias("part_id"), "span_ord", "start_off", "end_off", F.array_join("stack", "|").alias("stack"), "text")


@query(f"""
WITH {A.PIECES_SQL}, x AS (SELECT document_id, part_id, span_ord, unnest(stack) AS rid, stack FROM spans)
SELECT document_id, part_id, rid AS revision_id, split_part(rid, ':', 1) AS kind, array_to_string(list_filter(arg_min(stack, span_ord), lambda r: r <> rid AND starts_with(rid, 'del:')), '|') AS ancestors FROM x GROUP BY document_id, part_id, rid""")
def package_revisions(spark: SparkSession, d: str) -> DataFrame:
    t = _packages(spark, d)["revision"]
    return t.select("document_id", F.col("stream_part").alias("part_id"), "revision_id", "kind", F.array_join("ancestors", "|").alias("ancestors")).distinct()


@query("""
WITH c AS (SELECT DISTINCT ON (comment_key) * FROM comment_labels)
SELECT document_id, CAST(comment_key AS VARCHAR) AS comment_id, para_id, author, initials, date_raw AS date, coalesce(replace(text, chr(10), ' '), '') AS text, CASE WHEN para_id IS NULL THEN NULL ELSE parent_id END AS parent_id, CASE WHEN para_id IS NULL THEN NULL ELSE resolved END AS resolved,
  CASE WHEN count(para_id) OVER (PARTITION BY document_id) = 0 THEN 'unknown' WHEN para_id IS NULL THEN 'unknown' ELSE 'verified' END AS threading_status FROM c
WHERE document_id NOT IN (SELECT document_id FROM c WHERE para_id IS NOT NULL GROUP BY document_id, para_id HAVING count(*) > 1)""")
def package_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments through a package; of documents that use a paragraph id twice the threads are not one comment's."""
    c = A.comments(spark, d)
    twice = c.where("para_id is not null").groupBy("document_id", "para_id").count().where("count > 1").select("document_id").distinct()
    c = c.join(twice, "document_id", "left_anti")
    own = c.select("document_id", F.lit("c").alias("part_id"), F.col("comment_key").alias("comment_ord"), F.col("comment_key").cast("string").alias("comment_id"), "para_id", "author", "initials", F.col("date_raw").alias("date"), F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("text"), "parent_id", "resolved")
    body = own.select("document_id", "part_id").distinct().select("*", F.lit(0).alias("piece_ord"), F.lit("body").alias("text"), F.array().cast("array<string>").alias("stack"))
    t = _package_tables(writer.write_packages(body, ["document_id", "part_id"], own))["comment"]
    stated = F.when(F.col("id_stability") == "paraid", F.col("para_id"))
    return t.select("document_id", "comment_id", stated.alias("para_id"), "author", "initials", "date", "text", "parent_id", "resolved", "threading_status")


# --- revisions and comments


@query(f"""
WITH {A.PIECES_SQL}, x AS (SELECT document_id, part_id, span_ord, start_off, end_off, text, unnest(stack) AS rid FROM spans),
r AS (SELECT document_id, rid, part_id, min(start_off) AS s, count(*) AS n, sum(length(text)) AS c FROM x GROUP BY ALL)
SELECT document_id, rid AS revision_id, sum(n)::BIGINT AS n_pieces, sum(c)::BIGINT AS n_chars FROM r GROUP BY ALL""")
def revision_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = views.build_spans(A.pieces(spark, d))
    x = s.select("document_id", F.explode("stack").alias("revision_id"), F.length("text").alias("n"))
    return x.groupBy("document_id", "revision_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n").cast("long").alias("n_chars"))


@query(f"""
WITH {A.PIECES_SQL}, x AS (SELECT document_id, part_id, start_off, end_off, text, unnest(stack) AS rid FROM spans),
y AS (SELECT *, CASE WHEN start_off = lag(end_off) OVER w THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY document_id, part_id, rid ORDER BY start_off)),
z AS (SELECT *, sum(new) OVER (PARTITION BY document_id, part_id, rid ORDER BY start_off) AS g FROM y),
o AS (SELECT document_id, part_id, rid, g, min(start_off) AS s, max(end_off) AS e, string_agg(text, '' ORDER BY start_off) AS text FROM z GROUP BY ALL)
SELECT document_id, rid AS revision_id, string_agg(text, '' ORDER BY part_id, s) AS text, string_agg(part_id || '@' || s || '-' || e, ' ' ORDER BY part_id, s) AS ranges FROM o GROUP BY ALL""")
def revision_places(spark: SparkSession, d: str) -> DataFrame:
    p = revisions.revision_places(views.build_spans(A.pieces(spark, d)))
    line = F.array_join(F.transform("ranges", lambda r: F.concat(r["part_id"], F.lit("@"), r["start_off"], F.lit("-"), r["end_off"])), " ")
    return p.select("document_id", "revision_id", "text", line.alias("ranges"))


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    """Records of the revisions whose id has an even length; of the others nothing is known."""
    r = views.build_spans(A.pieces(spark, d)).select("document_id", F.explode("stack").alias("revision_id")).distinct().where("length(revision_id) % 2 = 0")
    return r.select("document_id", "revision_id", F.concat(F.lit("by "), "revision_id").alias("author"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("move_group_id"))


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two lines of a stream as a chunk's range."""
    lines = A.streams(spark, d).select("document_id", "part_id", F.posexplode(T.segments(F.col("text"))).alias("seg_ix", "x"))
    return lines.groupBy("document_id", "part_id", F.concat("part_id", F.lit("/"), F.floor(F.col("seg_ix") / 2)).alias("chunk_key")).agg(F.min("x.base").alias("start_off"), F.max(F.col("x.base") + F.length("x.line") + 1).alias("end_off"))


_PAIRS = """lines AS (SELECT document_id, part_id, seg_ix, sum(length(line) + 1) OVER (PARTITION BY document_id, part_id ORDER BY seg_ix) AS e, length(line) + 1 AS n FROM ln),
ck AS (SELECT document_id, part_id, document_id || '/' || part_id || '/' || (seg_ix // 2) AS ck, min(e - n) AS s, max(e) AS e FROM lines GROUP BY ALL)"""


@query(f"""
WITH {A.PIECES_SQL}, {_PAIRS},
cs AS (SELECT c.document_id, c.ck, p.span_ord, p.stack, p.line_end OR NOT list_has_any(p.ks, ['del', 'moveFrom']) AS kept, substr(p.text, CAST(greatest(c.s, p.start_off) - p.start_off + 1 AS BIGINT), CAST(least(c.e, p.end_off) - greatest(c.s, p.start_off) AS BIGINT)) AS t FROM ck c JOIN kinds p ON p.document_id = c.document_id AND p.part_id = c.part_id AND p.start_off < c.e AND c.s < p.end_off),
tx AS (SELECT document_id, ck, coalesce(string_agg(t, '' ORDER BY span_ord) FILTER (WHERE kept), '') AS text,
  string_agg(array_to_string(list_transform(stack, lambda r: '[[' || split_part(r, ':', 1) || CASE WHEN length(r) % 2 = 0 THEN ' author="by ' || r || '"' ELSE '' END || ']]'), '') || t || array_to_string(list_transform(list_reverse(stack), lambda r: '[[/' || split_part(r, ':', 1) || ']]'), ''), '' ORDER BY span_ord) AS markup FROM cs GROUP BY ALL),
pd AS (SELECT document_id, ck, string_agg(DISTINCT rid, ',' ORDER BY rid) AS pending FROM (SELECT document_id, ck, unnest(stack) AS rid FROM cs) GROUP BY ALL),
an AS (SELECT DISTINCT ON (comment_key) document_id, comment_key, anchor.part_id AS part_id, anchor.start_off AS s FROM comment_labels WHERE anchor IS NOT NULL),
cm AS (SELECT c.ck, string_agg(CAST(comment_key AS VARCHAR), ',' ORDER BY comment_key) AS comments FROM ck c JOIN an ON an.document_id = c.document_id AND an.part_id = c.part_id AND c.s <= an.s AND an.s < c.e GROUP BY ALL)
SELECT tx.document_id, tx.ck AS chunk_key, text, markup, coalesce(comments, '') AS comments, coalesce(pending, '') AS pending, c.part_id || '@' || CAST(c.s AS BIGINT) || '-' || CAST(c.e AS BIGINT) AS citation FROM tx JOIN ck c ON c.ck = tx.ck LEFT JOIN cm ON cm.ck = tx.ck LEFT JOIN pd ON pd.ck = tx.ck""")
def chunk_answers(spark: SparkSession, d: str) -> DataFrame:
    """Text, markup, comments, pending changes and citation of every chunk."""
    ranges = _line_pairs(spark, d).withColumn("chunk_key", F.concat_ws("/", "document_id", "chunk_key"))
    anchors = A.comments(spark, d).where("anchor is not null").select("document_id", F.col("anchor.part_id").alias("part_id"), "comment_key", F.col("anchor.start_off").alias("start"))
    a = retrieval.chunk_answers(ranges, views.build_spans(A.pieces(spark, d)), _revisions(spark, d), anchors, "accepted")
    keys = F.array_join(F.transform("comments", lambda k: k.cast("string")), ",")
    pending = F.array_join(F.array_sort(F.transform("pending", lambda x: x["revision_id"])), ",")
    place = F.array_join(F.transform("citation", lambda c: F.concat(c["part_id"], F.lit("@"), c["start_off"], F.lit("-"), c["end_off"])), " ")
    return a.select("document_id", "chunk_key", "text", "markup", F.coalesce(keys, F.lit("")).alias("comments"), F.coalesce(pending, F.lit("")).alias("pending"), place.alias("citation"))


@query(f"""
WITH {A.PIECES_SQL}, lines AS (SELECT document_id, part_id, seg_ix, sum(length(line) + 1) OVER (PARTITION BY document_id, part_id ORDER BY seg_ix) AS e, length(line) + 1 AS n FROM ln),
ck AS (SELECT document_id, part_id, part_id || '/' || (seg_ix // 2) AS ck, min(e - n) AS s, max(e) AS e FROM lines GROUP BY ALL),
x AS (SELECT c.document_id, c.ck, p.part_id, unnest(p.stack) AS rid, greatest(c.s, p.start_off) AS s, least(c.e, p.end_off) AS e, substr(p.text, CAST(greatest(c.s, p.start_off) - p.start_off + 1 AS BIGINT), CAST(least(c.e, p.end_off) - greatest(c.s, p.start_off) AS BIGINT)) AS t FROM ck c JOIN spans p ON p.document_id = c.document_id AND p.part_id = c.part_id AND p.start_off < c.e AND c.s < p.end_off),
g AS (SELECT document_id, ck, rid, string_agg(t, '' ORDER BY part_id, s, e) AS t, min(s) AS s, count(*) AS n FROM x GROUP BY ALL)
SELECT document_id, ck AS chunk_key, rid AS revision_id, split_part(rid, ':', 1) AS kind, CASE WHEN length(rid) % 2 = 0 THEN 'by ' || rid END AS author, CAST(s AS INTEGER) AS first_start, CAST(n AS INTEGER) AS n_spans, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…[truncated]' ELSE t END AS excerpt FROM g""")
def pending_manifest(spark: SparkSession, d: str) -> DataFrame:
    ranges = _line_pairs(spark, d)
    on = revisions.stacked(ranges, views.build_spans(A.pieces(spark, d)))
    p = revisions.pending_changes(on, _revisions(spark, d))
    return p.select("document_id", "chunk_key", "revision_id", "kind", "author", "first_start", F.size("spans").alias("n_spans"), "excerpt")


@query("""
WITH c AS (SELECT DISTINCT ON (comment_key) * FROM comment_labels),
e AS (SELECT document_id, para_id, arg_min(comment_key, comment_key) AS first_key FROM c WHERE para_id IS NOT NULL AND threading_status = 'verified' GROUP BY ALL), x AS (SELECT e.document_id, e.para_id, c.parent_id, c.resolved FROM e JOIN c ON c.comment_key = e.first_key),
there AS (SELECT DISTINCT document_id FROM e),
q AS (SELECT c.comment_key, c.document_id, c.anchor IS NULL AS unanchored, CASE WHEN there.document_id IS NULL THEN 'absent' WHEN x.para_id IS NOT NULL THEN 'verified' ELSE 'unknown' END AS threading_status, x.parent_id, x.resolved FROM c LEFT JOIN there ON there.document_id = c.document_id LEFT JOIN x ON x.document_id = c.document_id AND x.para_id = c.para_id)
SELECT comment_key, threading_status, parent_id, resolved, unanchored, parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = q.document_id AND lower(c.para_id) = lower(q.parent_id)) AS dangling FROM q""")
def comment_threads(spark: SparkSession, d: str) -> DataFrame:
    """Comments put together again from bodies, ranges and extended rows."""
    c = A.comments(spark, d)
    bodies = c.select("document_id", F.col("comment_key").alias("comment_id"), "para_id", "text")
    ranges = c.where("anchor is not null").select("document_id", F.col("comment_key").alias("comment_id"), "anchor.part_id", "anchor.start_off", "anchor.end_off", F.lit(0).alias("ord"))
    extended = c.where("para_id is not null and threading_status = 'verified'").select("document_id", "para_id", F.col("parent_id").alias("parent_para_id"), F.col("resolved").cast("string").alias("done"), F.col("comment_key").alias("ord"))
    made = revisions.assemble_comments(bodies, ranges, extended)
    lost = revisions.comment_gaps(made, ranges).where("gap = 'dangling_comment_parent'").select(F.col("detail").alias("comment_id"), F.lit(True).alias("dangling"))
    return made.join(lost, "comment_id", "left").select(F.col("comment_id").alias("comment_key"), "threading_status", "parent_id", "resolved", F.col("anchor").isNull().alias("unanchored"), F.coalesce("dangling", F.lit(False)).alias("dangling"))


@query("""
WITH c AS (SELECT DISTINCT ON (comment_key) document_id, comment_key, anchor.part_id AS part_id, anchor.start_off AS s FROM comment_labels WHERE anchor IS NOT NULL),
n AS (SELECT DISTINCT ON (node_key) document_id, node_key, node_ord, len(section_path) AS depth, spans FROM nodes), x AS (SELECT document_id, node_key, node_ord, depth, unnest(spans) AS sp FROM n),
j AS (SELECT c.comment_key, x.node_key, row_number() OVER (PARTITION BY c.comment_key ORDER BY x.depth DESC, x.node_ord, x.node_key DESC) AS r FROM c JOIN x ON x.document_id = c.document_id AND x.sp.part_id = c.part_id AND x.sp.start_off <= c.s AND c.s < x.sp.end_off)
SELECT c.comment_key, j.node_key FROM c LEFT JOIN j ON j.comment_key = c.comment_key AND j.r = 1""")
def comment_anchor_nodes(spark: SparkSession, d: str) -> DataFrame:
    a = A.comments(spark, d).where("anchor is not null").select("document_id", F.col("anchor.part_id").alias("part_id"), "comment_key", F.col("anchor.start_off").alias("start"))
    s = A.node_spans(spark, d).where("start_off < end_off")
    return revisions.anchor_nodes(a, s).select("comment_key", "node_key")


@query("""
WITH c AS (SELECT DISTINCT ON (comment_key) document_id, resolved FROM comment_labels)
SELECT document_id, count(*) AS n_comments, CASE WHEN bool_or(resolved) THEN true WHEN count(*) <> count(resolved) THEN NULL ELSE false END AS any_resolved FROM c GROUP BY ALL""")
def resolved_three_state(spark: SparkSession, d: str) -> DataFrame:
    return A.comments(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_comments"), revisions.three_state_any(F.col("resolved")).alias("any_resolved"))


# --- structure


_NODES = "n AS (SELECT DISTINCT ON (node_key) * FROM nodes)"


_RULES = """list_filter([CASE WHEN regexp_full_match(style, '(?i)(heading\\s*[1-9]|title)') THEN 'style' END, CASE WHEN outline_level BETWEEN 0 AND 8 THEN 'outline_level' END, CASE WHEN node_key % 12 BETWEEN 0 AND 8 AND node_key % 5 = 0 THEN 'outline_inherited' END,
  CASE WHEN node_key % 3 = 0 AND size_ BETWEEN 1 AND 120 AND kind <> 'cell' AND kind <> 'list_item' THEN 'bold_short' END], lambda x: x IS NOT NULL)"""
_SIZED = "(SELECT *, coalesce(spans[1].end_off - spans[1].start_off, 0) AS size_ FROM n)"


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every node's rules; inherited levels and bold type, which the table has not, are made from its key."""
    n = A.nodes(spark, d)
    key, size = F.col("node_key"), F.coalesce(F.try_element_at("spans", F.lit(1))["end_off"] - F.try_element_at("spans", F.lit(1))["start_off"], F.lit(0))
    inherited = F.when(key % 5 == 0, (key % 12).cast("int"))
    dec = structure.heading_decision(F.col("style"), F.col("outline_level"), inherited, key % 3 == 0, size, F.col("kind") == "cell", F.col("kind") == "list_item")
    return n.withColumn("x", dec).select("*", "x.fired_rules", "x.winner", "x.disputed_rules")


@query(f"""
WITH {_NODES}, f AS (SELECT node_key, {_RULES} AS r, outline_level, style FROM {_SIZED})
SELECT node_key, array_to_string(r, ',') AS fired_rules, r[1] AS winner, CAST(coalesce(CASE WHEN outline_level BETWEEN 0 AND 8 THEN outline_level + 1 END, TRY_CAST(regexp_extract(style, '(?i)^heading\\s*([1-9])$', 1) AS INTEGER), CASE WHEN lower(style) = 'title' THEN 0 END) AS INTEGER) AS level FROM f""")
def heading_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d).select("node_key", F.array_join("fired_rules", ",").alias("fired_rules"), "winner", structure.section_level(F.col("outline_level"), F.col("style")).alias("level"))


@query(f"""
WITH {_NODES}, f AS (SELECT document_id, {_RULES} AS r FROM {_SIZED})
SELECT document_id, count(r[1]) AS n_headings, count(*) FILTER (WHERE len(r) > 1) AS n_disputed, CASE WHEN count(r[1]) = 0 THEN 'degraded' ELSE 'normal' END AS heading_detection FROM f GROUP BY ALL""")
def heading_summary(spark: SparkSession, d: str) -> DataFrame:
    return structure.heading_summary(_decisions(spark, d)).select("document_id", "n_headings", "n_disputed", "heading_detection")


@query(f"""
WITH RECURSIVE {_NODES}, h0 AS (SELECT document_id, node_ord, node_id AS title, CASE WHEN outline_level BETWEEN 0 AND 8 THEN outline_level + 1 ELSE TRY_CAST(regexp_extract(style, '(?i)^heading\\s*([1-9])$', 1) AS INTEGER) END AS lvl FROM n WHERE kind IN ('heading', 'table')),
h AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY node_ord, title, lvl) - 1 AS ix FROM h0),
w AS (
  SELECT document_id, CAST(-1 AS BIGINT) AS ix, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS INTEGER) AS level, CAST(NULL AS BIGINT) AS parent_ix, CAST([] AS STRUCT(ix BIGINT, lv INTEGER, stated BOOLEAN, title VARCHAR)[]) AS st FROM (SELECT DISTINCT document_id FROM h)
  UNION ALL
  SELECT document_id, ix, title, level, rest[-1].ix, list_append(rest, struct_pack(ix := ix, lv := level, stated := stated, title := title)) FROM (
    SELECT w.document_id, h.ix, h.title, lv.level, h.lvl IS NOT NULL AS stated, list_filter(w.st, lambda x: x.lv < lv.level) AS rest FROM w JOIN h ON h.document_id = w.document_id AND h.ix = w.ix + 1, LATERAL (SELECT CAST(coalesce(h.lvl, list_filter(w.st, lambda x: x.stated)[-1].lv + 1, 1) AS INTEGER) AS level) lv))
SELECT document_id, CAST(ix AS INTEGER) AS pre_order, title, level, CAST(parent_ix AS INTEGER) AS parent_ix, array_to_string(list_transform(st, lambda x: x.title), '/') AS path FROM w WHERE ix >= 0""")
def section_outline(spark: SparkSession, d: str) -> DataFrame:
    # tables stand for headings that state no level
    h = A.nodes(spark, d).where("kind in ('heading', 'table')").select("document_id", "node_ord", F.col("node_id").alias("title"), structure.section_level(F.col("outline_level"), F.col("style")).alias("stated_level"))
    return structure.build_sections(h).select("document_id", "pre_order", "title", "level", "parent_ix", F.array_join("path", "/").alias("path"))


@query(f"""
WITH {_NODES}, h AS (SELECT document_id, node_ord, node_id FROM n WHERE kind = 'heading')
SELECT n.node_key, (SELECT max_by(h.node_id, h.node_ord) FROM h WHERE h.document_id = n.document_id AND h.node_ord <= n.node_ord) AS section_title FROM n""")
def node_sections(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d).select("document_id", "node_key", "node_ord", "node_id", "kind")
    s = n.where("kind = 'heading'").select("document_id", "node_ord", F.col("node_ord").alias("pre_order"), F.array("node_id").alias("path"))
    return structure.assign_sections(n.select("document_id", "node_key", "node_ord"), s).select("node_key", F.try_element_at("section_titles", F.lit(1)).alias("section_title"))


@query(f"""
WITH {_NODES}, g AS (SELECT document_id, part_id, node_ord, kind = 'list_item' AS it, row_number() OVER (PARTITION BY document_id, part_id ORDER BY node_ord) - row_number() OVER (PARTITION BY document_id, part_id, kind = 'list_item' ORDER BY node_ord) AS i FROM n)
SELECT document_id, part_id AS parent, min(node_ord) AS first_ord, max(node_ord) AS last_ord, count(*) AS n_items FROM g WHERE it GROUP BY document_id, part_id, i HAVING count(*) >= 2""")
def list_run_segments(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d).select("document_id", F.col("part_id").alias("parent"), "node_ord", (F.col("kind") == "list_item").alias("is_item"))
    return structure.list_runs(n).select("document_id", "parent", "first_ord", "last_ord", "n_items")


# --- blocks and chunks of documents


BODY = "officeDocument:0"
_TREE = f"""
n AS (SELECT DISTINCT ON (node_key) * FROM nodes),
kd AS (SELECT document_id, node_key AS pk, unnest(child_ids) AS nm FROM n),
par AS (SELECT n.node_key AS k, min(kd.pk) AS pk FROM kd JOIN n ON n.document_id = kd.document_id AND n.node_id = kd.nm GROUP BY ALL),
walk AS (
  SELECT n.document_id, n.node_key AS k, CASE WHEN kind IN ('para', 'list_item', 'table') THEN n.node_key END AS blk FROM n LEFT JOIN par ON par.k = n.node_key WHERE par.pk IS NULL
  UNION ALL SELECT w.document_id, n.node_key, coalesce(w.blk, CASE WHEN n.kind IN ('para', 'list_item', 'table') THEN n.node_key END) FROM walk w JOIN par ON par.pk = w.k JOIN n ON n.node_key = par.k),
lfs AS (SELECT document_id, node_key AS k, s.part_id AS part_id, s.start_off AS a, s.end_off AS b FROM (SELECT document_id, node_key, spans[1] AS s FROM n WHERE kind IN ('para', 'heading', 'list_item') AND len(spans) > 0)),
lts AS (SELECT l.k, string_agg(substr(p.text, CAST(greatest(l.a, p.start_off) - p.start_off + 1 AS BIGINT), CAST(least(l.b, p.end_off) - greatest(l.a, p.start_off) AS BIGINT)), '' ORDER BY p.span_ord) AS text FROM lfs l JOIN pj p ON p.document_id = l.document_id AND p.part_id = l.part_id AND p.view = 'accepted' AND p.start_off < l.b AND l.a < p.end_off AND l.a < l.b GROUP BY ALL),
bl AS (SELECT w.blk, string_agg(coalesce(lts.text, ''), chr(10) ORDER BY n.node_ord, n.node_key) AS text, string_agg(CAST(w.k AS VARCHAR), ',' ORDER BY n.node_ord, n.node_key) AS leaf_keys FROM walk w JOIN n ON n.node_key = w.k AND n.kind IN ('para', 'heading', 'list_item') LEFT JOIN lts ON lts.k = w.k WHERE w.blk IS NOT NULL GROUP BY ALL),
blocks_ AS (SELECT n.document_id, n.node_key, n.node_ord, n.kind, coalesce(bl.text, '') AS text, coalesce(bl.leaf_keys, '') AS leaf_keys FROM walk w JOIN n ON n.node_key = w.k LEFT JOIN bl ON bl.blk = w.k WHERE w.blk = w.k)"""


def _leaf_texts(spark: SparkSession, d: str, view: str) -> DataFrame:
    """What a view keeps of the first span of each leaf: (document_id, node_key, text)."""
    n = A.nodes(spark, d).where(F.col("kind").isin(*C.LEAVES)).where("size(spans) > 0").select("document_id", F.col("node_key").alias("owner"), F.col("spans")[0].alias("s"))
    leaves = n.select("document_id", F.col("s.part_id").alias("part_id"), "owner", F.lit(0).alias("leaf_ix"), F.col("s.start_off").alias("start_off"), F.col("s.end_off").alias("end_off"))
    return matching.leaf_texts(leaves, matching.projections(views.build_spans(A.pieces(spark, d)), (view,))).select("document_id", F.col("owner").alias("node_key"), "text")


def _node_forest(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return staged(hierarchy.build_hierarchy(hierarchy.child_links(n, "document_id", "node_key", "node_id", "child_ids")), "node-forest")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return staged(C.blocks_of(A.nodes(spark, d), _node_forest(spark, d), _leaf_texts(spark, d, "accepted")), "blocks")


@query(f"WITH RECURSIVE {A.PIECES_SQL}, {_TREE} SELECT document_id, node_key, kind, text, leaf_keys FROM blocks_")
def blocks_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("document_id", "node_key", "kind", "text", F.array_join(F.transform("leaf_keys", lambda k: k.cast("string")), ",").alias("leaf_keys"))


@query(f"""
WITH RECURSIVE {A.PIECES_SQL}, {_TREE},
kinds_ AS (SELECT k, pk FROM par), up AS (SELECT k, pk AS a, 1 AS steps, [k, pk] AS seen FROM kinds_ WHERE k <> pk UNION ALL SELECT u.k, p.pk, u.steps + 1, list_append(u.seen, p.pk) FROM up u JOIN kinds_ p ON p.k = u.a WHERE NOT list_contains(u.seen, p.pk)),
ok AS (SELECT DISTINCT k FROM walk)
SELECT u.k AS node_key, arg_min(u.a, u.steps) AS table_key FROM up u JOIN ok ON ok.k = u.k JOIN n ON n.node_key = u.a AND n.kind = 'table' GROUP BY u.k""")
def nearest_tables(spark: SparkSession, d: str) -> DataFrame:
    """The nearest table around each node."""
    kinds = A.nodes(spark, d).select(F.col("document_id").alias("scope"), "node_key", "kind")
    return hierarchy.ancestor_of_kind(_node_forest(spark, d), kinds, "table").select("node_key", F.col("ancestor_key").alias("table_key"))


def _chunks_of_nodes(spark: SparkSession, d: str, params: C.ChunkParams) -> DataFrame:
    n = A.nodes(spark, d).where(F.col("part_id") == BODY)
    b = _blocks(spark, d).join(n.select("node_key"), "node_key", "left_semi")
    texts = _leaf_texts(spark, d, "accepted")
    h = n.where("kind = 'heading'").join(texts, ["document_id", "node_key"], "left").select("document_id", "node_key", "node_ord", F.coalesce("text", F.lit("")).alias("title"), structure.section_level(F.col("outline_level"), F.col("style")).alias("stated_level"))
    return C.chunk_blocks(b, h, "accepted", params)


@query(f"""
WITH RECURSIVE {A.PIECES_SQL}, {_TREE},
h0 AS (SELECT n.document_id, n.node_ord, coalesce(lts.text, '') AS title, CASE WHEN outline_level BETWEEN 0 AND 8 THEN outline_level + 1 WHEN lower(style) = 'title' THEN 0 ELSE TRY_CAST(regexp_extract(style, '(?i)^heading\\s*([1-9])$', 1) AS INTEGER) END AS lvl FROM n LEFT JOIN lts ON lts.k = n.node_key WHERE kind = 'heading' AND part_id = '{BODY}'),
h AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY node_ord, title, lvl) - 1 AS ix FROM h0),
w AS (
  SELECT document_id, CAST(-1 AS BIGINT) AS ix, CAST([] AS STRUCT(lv INTEGER, stated BOOLEAN, title VARCHAR)[]) AS st FROM (SELECT DISTINCT document_id FROM h)
  UNION ALL
  SELECT document_id, ix, list_append(rest, struct_pack(lv := level, stated := stated, title := title)) FROM (
    SELECT w.document_id, h.ix, h.title, lv.level, h.lvl IS NOT NULL AS stated, list_filter(w.st, lambda x: x.lv < lv.level) AS rest FROM w JOIN h ON h.document_id = w.document_id AND h.ix = w.ix + 1, LATERAL (SELECT CAST(coalesce(h.lvl, list_filter(w.st, lambda x: x.stated)[-1].lv + 1, 1) AS INTEGER) AS level) lv)),
sec AS (SELECT w.document_id, w.ix, h.node_ord, array_to_string(list_transform(st, lambda x: x.title), '/') AS path FROM w JOIN h ON h.document_id = w.document_id AND h.ix = w.ix),
bs AS (SELECT b.*, coalesce((SELECT max(s.ix) FROM sec s WHERE s.document_id = b.document_id AND s.node_ord <= b.node_ord), -1) AS g FROM blocks_ b JOIN n USING (node_key) WHERE n.part_id = '{BODY}'),
isl AS (SELECT *, row_number() OVER (PARTITION BY document_id, g ORDER BY node_ord) - row_number() OVER (PARTITION BY document_id, g, kind = 'list_item' ORDER BY node_ord) AS i FROM bs),
isn AS (SELECT *, kind = 'list_item' AND count(*) OVER (PARTITION BY document_id, g, kind = 'list_item', i) >= 2 AS inrun, i AS run FROM isl),
sg AS (SELECT *, CASE WHEN inrun THEN run ELSE -1 END AS tag FROM isn),
sg2 AS (SELECT *, CASE WHEN lag(tag) OVER q IS DISTINCT FROM tag OR lag(inrun) OVER q IS DISTINCT FROM inrun THEN 1 ELSE 0 END AS new, row_number() OVER q AS r FROM sg WINDOW q AS (PARTITION BY document_id, g ORDER BY node_ord)),
f AS (SELECT document_id, g, r, 0 AS no, length(text) AS fill FROM sg2 WHERE r = 1
  UNION ALL SELECT s.document_id, s.g, s.r, CASE WHEN s.new = 1 OR f.fill + 1 + length(s.text) > 300 THEN f.no + 1 ELSE f.no END, CASE WHEN s.new = 1 OR f.fill + 1 + length(s.text) > 300 THEN length(s.text) ELSE f.fill + 1 + length(s.text) END FROM f JOIN sg2 s ON s.document_id = f.document_id AND s.g = f.g AND s.r = f.r + 1)
SELECT s.document_id, coalesce(any_value(sec.path), '') AS section_path, string_agg(s.text, chr(10) ORDER BY s.node_ord) AS text, min(s.node_ord) AS first_ord, string_agg(s.leaf_keys, ',' ORDER BY s.node_ord) AS node_keys FROM sg2 s JOIN f ON f.document_id = s.document_id AND f.g = s.g AND f.r = s.r LEFT JOIN sec ON sec.document_id = s.document_id AND sec.ix = s.g GROUP BY s.document_id, s.g, f.no""")
def chunks_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    """From nodes and streams to chunks of at most 300 code points along the outline, list runs apart."""
    c = _chunks_of_nodes(spark, d, C.ChunkParams(size_cap=300, min_size=0))
    keys = F.array_join(F.transform("node_keys", lambda k: k.cast("string")), ",")
    return c.select("document_id", F.array_join("section_path", "/").alias("section_path"), "text", F.col("chunk_ord.first").alias("first_ord"), keys.alias("node_keys"))


@query()
def chunks_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same with small sections dissolved into their parents and the default sizes."""
    c = _chunks_of_nodes(spark, d, C.ChunkParams())
    return c.select("document_id", F.array_join("section_path", "/").alias("section_path"), "text", F.col("chunk_ord.first").alias("first_ord"), "content_hash", "occurrence_index", "chunk_id", "size_cp")


# --- chunks


@query("""
WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ix, 0 AS no, length(t) AS fill FROM p WHERE ix = 0
  UNION ALL SELECT p.doc_id, p.ix, CASE WHEN w.fill + 1 + length(p.t) > 1000 THEN w.no + 1 ELSE w.no END, CASE WHEN w.fill + 1 + length(p.t) > 1000 THEN length(p.t) ELSE w.fill + 1 + length(p.t) END FROM w JOIN p ON p.doc_id = w.doc_id AND p.ix = w.ix + 1)
SELECT doc_id, CAST(ix AS INTEGER) AS para_ix, CAST(no AS INTEGER) AS chunk_no FROM w""")
def chunks_greedy(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_ix", "t")).select("doc_id", "para_ix", F.length("t").alias("n"))
    return C.pack_blocks(p, ["doc_id"], "para_ix", "n", 1000).select("doc_id", "para_ix", F.col("chunk_no").cast("int").alias("chunk_no"))


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) chunk_key, document_id, view_id, chunk_ord, text FROM chunks WHERE text IS NOT NULL),
h AS (SELECT *, sha256('{"text":"' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '","textmodel_version":"1","view_id":"' || view_id || '"}') AS content_hash FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id, view_id, content_hash ORDER BY chunk_ord, chunk_key) - 1 AS nth FROM h)
SELECT chunk_key, content_hash, CAST(nth AS INTEGER) AS occurrence_index, sha256('{"content_hash":"' || content_hash || '","occurrence_index":' || nth || '}') AS chunk_id FROM o""".replace("\\\\", "\\\\"))
def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    c = A.chunks(spark, d).where("text is not null").select("chunk_key", "document_id", "view_id", F.struct("chunk_ord", "chunk_key").alias("chunk_ord"), "text")
    return C.identify(c).select("chunk_key", "content_hash", "occurrence_index", "chunk_id")


@query("""
WITH c AS (SELECT DISTINCT document_id, view_id, chunk_id, md5(heading_detection) AS h FROM chunks WHERE view_id IS NOT NULL AND chunk_id IS NOT NULL),
d AS (SELECT document_id, lead(document_id) OVER (ORDER BY document_id) AS next FROM (SELECT DISTINCT document_id FROM c)),
p AS (SELECT document_id AS a, next AS b FROM d WHERE next IS NOT NULL),
v AS (SELECT DISTINCT p.a, p.b, x.view_id FROM p JOIN c x ON x.document_id = p.a JOIN c y ON y.document_id = p.b AND y.view_id = x.view_id),
x AS (SELECT v.a, v.b, v.view_id, c.chunk_id, min(c.h) AS ha FROM v JOIN c ON c.document_id = v.a AND c.view_id = v.view_id GROUP BY ALL), y AS (SELECT v.a, v.b, v.view_id, c.chunk_id, min(c.h) AS hb FROM v JOIN c ON c.document_id = v.b AND c.view_id = v.view_id GROUP BY ALL)
SELECT a, b, view_id, chunk_id, CASE WHEN y.chunk_id IS NULL THEN 'only_a' WHEN x.chunk_id IS NULL THEN 'only_b' WHEN ha IS DISTINCT FROM hb THEN 'context_changed' ELSE 'same' END AS change
FROM x FULL JOIN y USING (a, b, view_id, chunk_id)""".replace("x.chunk_id IS NULL", "x.view_id IS NULL").replace("y.chunk_id IS NULL", "y.view_id IS NULL"))
def compare_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the next by id; how headings were found stands for the context."""
    c = A.chunks(spark, d).where("view_id is not null and chunk_id is not null").select("document_id", "view_id", "chunk_id", F.md5("heading_detection").alias("context_hash"))
    ids = c.select("document_id").distinct()
    # the next document: ranges of ids, so that one task never holds all of them
    return retrieval.compare_pairs(c, retrieval.next_pairs(ids, "document_id"))


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) * FROM chunks), a AS (SELECT content_hash FROM c WHERE view_id = 'accepted'), o AS (SELECT content_hash FROM c WHERE view_id = 'original')
SELECT content_hash, 'gone' AS change FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM a) UNION ALL SELECT content_hash, 'new' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM o)""")
def chunk_churn(spark: SparkSession, d: str) -> DataFrame:
    c = A.chunks(spark, d)
    return C.churn(c.where("view_id = 'original'"), c.where("view_id = 'accepted'"))


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) * FROM chunks), x AS (SELECT document_id, unnest(fired_rules) AS r FROM c)
SELECT document_id, string_agg(DISTINCT r, ',' ORDER BY r) AS fired_rules FROM x GROUP BY ALL""")
def rules_by_document(spark: SparkSession, d: str) -> DataFrame:
    c = A.chunks(spark, d).where("size(fired_rules) > 0")
    return C.rule_union(c, ["document_id"]).select("document_id", F.array_join("fired_rules", ",").alias("fired_rules"))


@query("""
WITH b AS (SELECT DISTINCT ON (block_key) * FROM blocks), r AS (SELECT block_key, unnest(row_items) AS r FROM b), t AS (SELECT block_key, count(*) AS n_rows, sum(length(r.text)) + count(*) - 1 AS n_chars FROM r GROUP BY ALL)
SELECT block_key, n_rows, CAST(n_chars AS BIGINT) AS n_chars FROM t""")
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "blocks").dropDuplicates(["block_key"]).select("block_key", F.explode("row_items").alias("r"))
    return r.groupBy("block_key").agg(F.count(F.lit(1)).alias("n_rows"), (F.sum(F.length("r.text")) + F.count(F.lit(1)) - 1).cast("long").alias("n_chars"))


@query("""
WITH RECURSIVE b AS (SELECT DISTINCT ON (block_key) * FROM blocks), r AS (SELECT block_key, unnest(row_items) AS r FROM b),
g AS (SELECT block_key, r.row_ix AS row_ix, length(r.text) AS n, row_number() OVER (PARTITION BY block_key ORDER BY r.row_ix) - 1 AS ix, first_value(length(r.text)) OVER (PARTITION BY block_key ORDER BY r.row_ix) AS head FROM r),
f AS (SELECT block_key, ix, 0 AS no, head + 1 + n AS fill FROM g WHERE ix = 1
  UNION ALL SELECT g.block_key, g.ix, CASE WHEN f.fill + 1 + g.n > 1000 THEN f.no + 1 ELSE f.no END, CASE WHEN f.fill + 1 + g.n > 1000 THEN g.head + 1 + g.n ELSE f.fill + 1 + g.n END FROM f JOIN g ON g.block_key = f.block_key AND g.ix = f.ix + 1)
SELECT g.block_key, g.row_ix, CAST(coalesce(f.no, 0) AS INTEGER) AS group_no, g.ix = 0 AS is_header FROM g LEFT JOIN f ON f.block_key = g.block_key AND f.ix = g.ix""")
def table_row_groups(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "blocks").dropDuplicates(["block_key"]).select("block_key", F.explode("row_items").alias("r")).select("block_key", F.col("r.row_ix").alias("row_ix"), F.length("r.text").alias("n"))
    return C.split_table_rows(r, ["block_key"], "row_ix", "n", 1000).select("block_key", "row_ix", "group_no", "is_header")


# --- summaries, catalogue, evaluation


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) * FROM chunks), p AS (SELECT *, (row_number() OVER (PARTITION BY document_id, view_id ORDER BY chunk_ord, chunk_key) - 1) // 8 AS b, CASE chunk_key % 3 WHEN 0 THEN true WHEN 1 THEN false END AS f FROM c)
SELECT document_id, view_id, CAST(b AS INTEGER) AS batch_no, count(*) AS n_children, CASE WHEN bool_or(f) THEN true WHEN count(*) <> count(f) THEN NULL ELSE false END AS has_pending, string_agg(CAST(chunk_key AS VARCHAR), ',' ORDER BY chunk_ord, chunk_key) AS children FROM p GROUP BY document_id, view_id, b""")
def fan_in_batches(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("chunk_key") % 3 == 0, True).when(F.col("chunk_key") % 3 == 1, False)
    c = A.chunks(spark, d).select("document_id", "view_id", F.struct("chunk_ord", "chunk_key").alias("pos"), F.col("chunk_key").cast("string").alias("child_key"), F.array("chunk_id").alias("chunk_ids"), flag.alias("has_pending"))
    b = summaries.fan_in(c, ["document_id", "view_id"], "pos")
    return b.select("document_id", "view_id", "batch_no", F.size("child_keys").cast("long").alias("n_children"), "has_pending", F.array_join("child_keys", ",").alias("children"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS document_id, arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) AS run_id, count(*) AS n_runs, count(DISTINCT event_type) AS n_views FROM events GROUP BY user_id""")
def latest_run_catalog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), "ts", "event_id", "event_type")
    last = retrieval.latest(e, ["document_id"], ["ts", "event_id"]).select("document_id", F.col("event_id").cast("string").alias("run_id"))
    n = e.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("event_type").alias("n_views"))
    return last.join(n, "document_id")


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) chunk_key, document_id, view_id, text FROM chunks WHERE text IS NOT NULL), w AS (SELECT chunk_key, ' ' || array_to_string(""" + _joined("text") + """, ' ') || ' ' AS t FROM c)
SELECT chunk_key FROM w WHERE contains(t, ' depends on the ')""")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    c = A.chunks(spark, d).where("text is not null").select("document_id", F.col("chunk_key").cast("string").alias("node_id"), "text")
    owner = c.select("document_id", "node_id", F.col("node_id").alias("chunk_id"))
    return retrieval.text_tier(c, owner, "depends on THE").select(F.col("chunk_id").cast("long").alias("chunk_key")).distinct()


def _group_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every group whose key is divisible by 20."""
    return A.groups(spark, d).where("group_key % 20 = 0")


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) chunk_key, document_id, view_id, text FROM chunks WHERE text IS NOT NULL), w AS (SELECT chunk_key, ' ' || array_to_string(""" + _joined("text") + """, ' ') || ' ' AS t FROM c),
q AS (SELECT DISTINCT group_key AS query_id, array_to_string(""" + _joined("canonical") + """, ' ') AS p FROM term_groups WHERE group_key % 20 = 0 AND canonical IS NOT NULL)
SELECT DISTINCT query_id, chunk_key FROM q JOIN w ON p <> '' AND contains(t, ' ' || p || ' ')""")
def search_text_groups(spark: SparkSession, d: str) -> DataFrame:
    c = A.chunks(spark, d).where("text is not null").select("document_id", F.col("chunk_key").cast("string").alias("node_id"), "text")
    owner = c.select("document_id", "node_id", F.col("node_id").alias("chunk_id"))
    asked = retrieval.text_queries(_group_queries(spark, d), "group_key", "canonical")
    return retrieval.text_tier(c, owner, asked).select("query_id", F.col("chunk_id").cast("long").alias("chunk_key")).distinct()


@query()
def search_tiered(spark: SparkSession, d: str) -> DataFrame:
    s = A.streams(spark, d)
    groups = _group_queries(spark, d)
    forms = terms.compile_forms(groups.withColumn("stemming", F.lit(None).cast("string")))
    hits = terms.match_texts(s.drop("stream_key"), forms).select("document_id", "group_key", F.col("part_id").alias("node_id"), F.lit(None).cast("string").alias("context_node_id"), F.array(F.lit("accepted")).alias("present_in"), F.lit("body").alias("location"), "start", "end")
    owner = s.select("document_id", F.col("part_id").alias("node_id"), F.col("stream_key").cast("string").alias("chunk_id"))
    leaves = s.select("document_id", F.col("part_id").alias("node_id"), F.lit("accepted").alias("view"), "text")
    places = s.select("document_id", F.col("stream_key").cast("string").alias("chunk_id"), F.lit(0).alias("chunk_ord"))
    asked = groups.select(F.col("group_key").alias("query_id"), "group_key")
    tiers = [retrieval.term_tier(hits, owner, asked, ("accepted",)), retrieval.text_tier(leaves, owner, retrieval.text_queries(groups, "group_key", "canonical"))]
    ranked = retrieval.search(tiers, places)
    return ranked.select("query_id", "document_id", "chunk_id", "tier", F.array_join("sources", ",").alias("sources"), F.size("locations").alias("n_locations"))


@query("""
WITH n AS (SELECT DISTINCT ON (node_key) * FROM nodes), x AS (SELECT DISTINCT document_id, s.part_id AS part_id, s.start_off AS a, s.end_off AS b FROM (SELECT document_id, unnest(spans) AS s FROM n)),
y AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY document_id, part_id ORDER BY a, b), 0) AS want FROM x),
st AS (SELECT DISTINCT ON (stream_key) document_id, part_id, length(text) AS n FROM streams WHERE text IS NOT NULL), e AS (SELECT document_id, part_id, max(b) AS b FROM x GROUP BY ALL)
SELECT document_id, part_id, CAST(a AS INTEGER) AS at_off, CAST(want AS INTEGER) AS expected FROM y WHERE a <> want
UNION ALL SELECT st.document_id, st.part_id, CAST(coalesce(b, 0) AS INTEGER), CAST(n AS INTEGER) FROM st LEFT JOIN e ON e.document_id = st.document_id AND e.part_id = st.part_id WHERE coalesce(b, 0) <> n""")
def tile_defects(spark: SparkSession, d: str) -> DataFrame:
    """With the parts whose spans stop before or after the end of the text, and streams without any span."""
    s = A.node_spans(spark, d).select("document_id", "part_id", "start_off", "end_off").distinct()
    return evals.tile_defects(s, A.streams(spark, d)).select("document_id", "part_id", F.col("at").alias("at_off"), "expected")


@query("""
WITH n AS (SELECT DISTINCT ON (node_key) kind, sha256(document_id || '|' || node_id || '|' || coalesce(style, '')) AS h FROM nodes)
SELECT kind, sha256(string_agg(h, '' ORDER BY h)) AS fingerprint, count(*) AS n FROM n GROUP BY ALL""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("|", "document_id", "node_id", F.coalesce("style", F.lit("")))
    return evals.fingerprint(A.nodes(spark, d), ["kind"], line)


@query(f"""
WITH {_FORMS}, {_TOKENS}, want AS (SELECT DISTINCT group_key FROM term_groups WHERE canonical IS NOT NULL), got AS (SELECT DISTINCT group_key FROM hits)
SELECT w.group_key % 10 AS bucket, count(*) AS n_expected, count(g.group_key) AS n_found, count(g.group_key) / count(*) AS recall FROM want w LEFT JOIN got g ON g.group_key = w.group_key GROUP BY ALL""")
def must_find_recall(spark: SparkSession, d: str) -> DataFrame:
    g = A.groups(spark, d).where("canonical is not null")
    tag = lambda df: df.select((F.col("group_key") % 10).alias("bucket"), F.concat(F.lit("g"), F.col("group_key").cast("string")).alias("term"))
    return evals.recall(tag(g), tag(_hits(spark, d)), ["bucket"])


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) chunk_key, size_cp, length(text) AS n FROM chunks)
SELECT CASE WHEN size_cp IS NULL THEN 'unstated' ELSE 'stated' END AS family, count(*) FILTER (WHERE size_cp IS NOT NULL) AS n_compared, count(*) FILTER (WHERE size_cp IS NOT NULL AND size_cp IS DISTINCT FROM n) AS n_failed, count(*) FILTER (WHERE size_cp IS NULL) AS n_skipped,
  CASE WHEN count(size_cp) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (WHERE size_cp IS NOT NULL AND size_cp IS NOT DISTINCT FROM n) AS DOUBLE) / count(size_cp) END AS accuracy FROM c GROUP BY ALL""")
def chunk_size_facts(spark: SparkSession, d: str) -> DataFrame:
    c = A.chunks(spark, d)
    facts = c.select(F.when(F.col("size_cp").isNull(), "unstated").otherwise("stated").alias("family"), F.col("size_cp").cast("string").alias("want"), F.length("text").cast("string").alias("got"), F.col("size_cp").isNotNull().alias("stated"))
    return evals.score_facts(facts)


@query("""
WITH c AS (SELECT DISTINCT ON (chunk_key) chunk_key, document_id FROM chunks), r AS (SELECT *, row_number() OVER (ORDER BY chunk_key) - 1 AS p, count(*) OVER () AS n FROM c),
w AS (SELECT DISTINCT CAST(round_even(i.range * (n - 1) / 11.0, 0) AS BIGINT) AS p FROM range(12) i, (SELECT any_value(n) AS n FROM r))
SELECT chunk_key, document_id FROM r WHERE n <= 12 OR p IN (SELECT p FROM w)""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return evals.even_sample(A.chunks(spark, d).select("chunk_key", "document_id"), ["chunk_key"])


@query(f"""
WITH r AS (SELECT DISTINCT ON (revision_key) * FROM revision_labels WHERE text IS NOT NULL),
h AS (SELECT document_id, move_group_id, array_to_string({_joined('text')}, ' ') AS t, CASE kind WHEN 'moveFrom' THEN 'original' ELSE 'accepted' END AS v, revision_key AS hit_ord FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY document_id, move_group_id, t, v ORDER BY hit_ord) AS nth FROM h WHERE move_group_id IS NOT NULL)
SELECT document_id, move_group_id, min(hit_ord) AS hit_ord, count(*) AS n_ends FROM m GROUP BY document_id, move_group_id, t, nth
UNION ALL SELECT document_id, NULL, hit_ord, 1 FROM h WHERE move_group_id IS NULL""")
def moves_folded(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "revision_labels").dropDuplicates(["revision_key"]).where("text is not null")
    end = F.when(F.col("kind") == "moveFrom", F.array(F.lit("original"))).otherwise(F.array(F.lit("accepted")))
    h = r.select("document_id", F.lit(0).alias("group_key"), "move_group_id", T.normalize(F.col("text")).alias("norm_text"), end.alias("present_in"), F.col("revision_key").alias("hit_ord"))
    return terms.fold_moves(h).select("document_id", "move_group_id", "hit_ord", "n_ends")


