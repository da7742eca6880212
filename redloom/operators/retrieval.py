"""Read-only questions over stored tables: search, terms, comments, revisions, outline, comparison.

Nothing here writes.  Every match is returned; ties are ordered by document id, then place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redloom.functions import text as T
from redloom.operators import revisions, structure, terms, views
from redloom.session import staged

#: Sources in the order of their say.
SOURCES = ("term", "text", "summary")


def resolve_document(documents: DataFrame, wanted: str) -> str:
    """A document by id, else by a title only it has; otherwise an error that names the candidates."""
    if not documents.where(F.col("document_id") == wanted).isEmpty():
        return wanted
    ids = [r[0] for r in documents.where(F.col("title") == wanted).select("document_id").distinct().orderBy("document_id").limit(20).collect()]
    if len(ids) != 1:
        raise ValueError(f"{wanted!r} is the title of {len(ids)} documents: {ids}" if ids else f"no document {wanted!r}")
    return ids[0]


def text_queries(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """Queries as the tiers take them, many at a time: (query_id, tokens); those without a token ask nothing."""
    return queries.select(F.col(query_id).alias("query_id"), T.token_words(F.col(text)).alias("tokens")).where("size(tokens) > 0").distinct()


def _asked(spark, query: str | DataFrame) -> tuple[DataFrame, list[str]]:
    """The table of queries, and the columns that tell results apart: none where one query was given as text."""
    if isinstance(query, DataFrame):
        return query.select("query_id", "tokens"), ["query_id"]
    return text_queries(spark.createDataFrame([(0, query)], "i int, q string"), "i", "q"), []


def _meet(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """``texts(..., text)`` with each of ``queries(query_id, tokens)`` whose first token they hold."""
    words = texts.select("*", F.explode(F.array_distinct(T.token_words(F.col("text")))).alias("first"))
    return words.join(queries.withColumn("first", F.col("tokens")[0]), "first").drop("first")


def term_tier(hits: DataFrame, owner: DataFrame, group_key, within: tuple[str, ...]) -> DataFrame:
    """Chunks of a group's hits: ``hits(document_id, group_key, node_id, context_node_id, present_in, location, start, end)``; a comment's hit stands at its anchor's node.

    ``group_key`` is one group, or a table ``(query_id, group_key)`` of many, answered together with their ``query_id``.
    Hits that also have ``hit_ord``, ``view_spans``, ``move_group_id`` and ``norm_text`` are folded: of hits sharing a view
    span the first stays, and the two ends of a move are one result at the first end's chunk with both locations.
    """
    node = F.when(F.col("location") == "comment", F.col("context_node_id")).otherwise(F.col("node_id"))
    seen = (F.size("present_in") == 0) | F.arrays_overlap("present_in", F.array(*map(F.lit, within)))
    if isinstance(group_key, DataFrame):
        asked = group_key.select("query_id", "group_key").distinct()
        h = hits.join(asked.select("group_key").distinct(), "group_key", "left_semi")
    else:
        asked, h = None, hits.where(F.col("group_key") == group_key)
    h = h.where(seen)
    key = ["document_id", "group_key"]
    if {"hit_ord", "view_spans", "move_group_id", "norm_text"} <= set(hits.columns):
        # a view span is one place only together with its node
        own = F.transform("view_spans", lambda v: F.to_json(F.struct(F.col("node_id"), v)))
        whole = F.array(F.to_json(F.struct("node_id", "start", "end")))
        strict = terms.dedupe_hits(h.withColumn("view_spans", F.when(F.size("view_spans") > 0, own).otherwise(whole)))
        strict = strict.withColumn("move_group_id", F.when(F.col("norm_text").isNotNull(), F.col("move_group_id"))).withColumn("present_in", F.array_sort("present_in"))
        shape = lambda x: x.withColumn("node_id", node).select(*key, "move_group_id", "node_id", "start", "end")
        ends = shape(strict).join(owner, ["document_id", "node_id"], "left")
        kept = shape(terms.fold_moves(strict)).join(owner, ["document_id", "node_id"]).select(*key, "chunk_id", "move_group_id").distinct()
        here = ends.join(kept.select(*key, "chunk_id").distinct(), [*key, "chunk_id"], "left_semi").select(*key, "chunk_id", "node_id", "start", "end")
        both = ends.where("move_group_id is not null").drop("chunk_id").join(kept, [*key, "move_group_id"]).select(*key, "chunk_id", "node_id", "start", "end")
        placed = here.unionByName(both).distinct()
    else:
        placed = h.withColumn("node_id", node).select(*key, "node_id", "start", "end").join(owner, ["document_id", "node_id"])
    q = [] if asked is None else ["query_id"]
    placed = placed if asked is None else placed.join(asked, "group_key")
    return placed.select(*q, "document_id", "chunk_id", F.lit("term").alias("source"), "node_id", "start", "end")


def text_tier(leaves: DataFrame, owner: DataFrame, query: str | DataFrame, projection: DataFrame | None = None) -> DataFrame:
    """Chunks whose leaves hold the query's tokens in a row: ``leaves(document_id, node_id, view, text)``; every occurrence counts, overlapping ones too.

    ``query`` is one text, or a table of :func:`text_queries`, answered together with their ``query_id``.  Locations are
    offsets of the leaf, or, with the ``projection`` of the views and leaves that also have ``part_id`` and ``view_base``
    (where the leaf begins in its view), of the stream, as the term tier's are: a row a contiguous piece.
    """
    queries, q = _asked(leaves.sparkSession, query)
    place = [] if projection is None else ["part_id", "view", "view_base"]
    # most leaves fall to the plain test for the first word
    likely = _meet(leaves.select("document_id", "node_id", *place, "text"), queries).withColumn("spans", T.token_spans(F.col("text")))
    n = F.size("tokens")
    toks = F.transform("spans", lambda x: x["t"])
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("spans") - n + 1, F.lit(1))), lambda i: F.slice(toks, i, n) == F.col("tokens"))
    found = likely.select(*q, "document_id", "node_id", *place, "spans", n.alias("n"), F.explode(at).alias("i"))
    placed = found.select(*q, "document_id", "node_id", *place, F.expr("spans[i - 1].s").alias("start"), F.expr("spans[i + n - 2].e").alias("end"))
    if projection is not None:
        # what tells a match apart goes through as its id
        ends = ["node_id", *q]
        named = placed.select("document_id", "part_id", "view", F.struct(*ends, F.col("start").alias("s")).alias("match_id"), (F.col("view_base") + F.col("start")).alias("start"), (F.col("view_base") + F.col("end")).alias("end"))
        placed = views.union_spans(named, projection).select("document_id", *[F.col(f"match_id.{c}").alias(c) for c in ends], F.col("union_start").alias("start"), F.col("union_end").alias("end"))
    return placed.distinct().join(owner, ["document_id", "node_id"]).select(*q, "document_id", "chunk_id", F.lit("text").alias("source"), "node_id", "start", "end")


def summary_tier(summaries: DataFrame, query: str | DataFrame) -> DataFrame:
    """Chunks whose summary, or one of its topics, holds the query: ``summaries(document_id, chunk_id, text, topics)``; ``query`` as in :func:`text_tier`."""
    queries, q = _asked(summaries.sparkSession, query)
    fields = summaries.select("document_id", "chunk_id", F.explode(F.concat(F.array("text"), F.coalesce("topics", F.array().cast("array<string>")))).alias("text"))
    hit = _meet(fields, queries).where(T.contains_sequence(T.token_words(F.col("text")), F.col("tokens"))).select(*q, "document_id", "chunk_id").distinct()
    none = F.lit(None)
    return hit.select(*q, "document_id", "chunk_id", F.lit("summary").alias("source"), none.cast("string").alias("node_id"), none.cast("int").alias("start"), none.cast("int").alias("end"))


def search(tiers: list[DataFrame], chunks: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Ranked chunks: best source, then document, place and id; a row a chunk with all its sources and locations; with tiers of many queries, that for each ``query_id``."""
    unknown = set(sources) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    rows = tiers[0]
    for x in tiers[1:]:
        rows = rows.unionByName(x)
    tier = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")).cast("int")
    one = rows.where(F.col("source").isin(*sources)).withColumn("tier", tier)
    q = [c for c in rows.columns if c == "query_id"]
    merged = one.groupBy(*q, "document_id", "chunk_id").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.when(F.col("node_id").isNotNull(), F.struct("node_id", "start", "end")))).alias("locations"))
    place = chunks.groupBy("document_id", "chunk_id").agg(F.min("chunk_ord").alias("chunk_ord"))
    return merged.join(place, ["document_id", "chunk_id"], "left").orderBy(*q, "tier", "document_id", "chunk_ord", "chunk_id")


def find_terms(hits: DataFrame, group_key, document_id: str | None = None, section: list[str] | None = None) -> DataFrame:
    """A group's hits by document and section, in the order they first appear."""
    h = hits.where(F.col("group_key") == group_key).where(structure.in_section(F.col("section_path"), section))
    if document_id is not None:
        h = h.where(F.col("document_id") == document_id)
    return h.groupBy("document_id", "section_path").agg(F.count(F.lit(1)).alias("n_hits"), F.min("hit_ord").alias("first_hit"), F.array_sort(F.collect_list(F.struct("hit_ord", "node_id", "match_type"))).alias("hits")).orderBy("document_id", "first_hit")


def get_comments(comments: DataFrame, document_id: str | None = None, section: list[str] | None = None, author: str | None = None) -> DataFrame:
    out = comments.where(structure.in_section(F.col("section_path"), section))
    if document_id is not None:
        out = out.where(F.col("document_id") == document_id)
    if author is not None:
        out = out.where(F.col("author") == author)
    return out


def get_revisions(documents: DataFrame, revisions: DataFrame, section: list[str] | None = None, author: str | None = None) -> DataFrame:
    """Revisions of each document, documents without any kept; a section is met if any of a revision's paths begins with it."""
    r = revisions
    if section:
        r = r.where(F.exists("section_paths", lambda p: F.slice(p, 1, len(section)) == F.array(*map(F.lit, section))))
    if author is not None:
        r = r.where(F.col("author") == author)
    return documents.select("document_id").join(r, "document_id", "left")


def outline(sections: DataFrame, rollups: DataFrame, document_id: str) -> DataFrame:
    """The section tree of a document in pre-order with each section's roll-up, if there is one."""
    r = rollups.where("status = 'ok' and target_kind = 'section'").select(F.col("document_id"), F.col("target_id").cast("int").alias("pre_order"), F.col("text").alias("summary"))
    return sections.where(F.col("document_id") == document_id).join(r, ["document_id", "pre_order"], "left").orderBy("pre_order")


def get_chunk(chunks: DataFrame, chunk_id: str, view: str | None = None, document_id: str | None = None) -> DataFrame:
    """The one chunk of that id; an error if it is in no or in several documents or views."""
    c = chunks.where(F.col("chunk_id") == chunk_id)
    if view is not None:
        c = c.where(F.col("view_id") == view)
    if document_id is not None:
        c = c.where(F.col("document_id") == document_id)
    places = [tuple(r) for r in c.select("document_id", "view_id").distinct().limit(5).collect()]
    if len(places) != 1:
        raise ValueError(f"chunk {chunk_id!r} is in {len(places)} places: {sorted(places)}")
    return c


def chunk_answers(ranges: DataFrame, spans: DataFrame, revs: DataFrame, anchors: DataFrame, view: str) -> DataFrame:
    """What is said of chunks: (document_id, chunk_key, text, markup, comments, pending, citation).

    ``ranges(document_id, part_id, chunk_key, start_off, end_off)`` are the chunks' places, ``revs(document_id, revision_id,
    author, date, move_group_id)`` the revisions, ``anchors(document_id, part_id, comment_key, start)`` where comments begin.
    ``text`` is what the view keeps, ``markup`` all text inside its revisions, ``citation`` the ranges.
    """
    key = ["document_id", "chunk_key"]
    asked = ranges.select("document_id", "part_id", "chunk_key", F.col("start_off").alias("__from"), F.col("end_off").alias("__to"))
    met = views.overlap_join(asked, spans, views.PART, "__from", "__to", "start_off", "end_off")
    cut = F.expr("substring(text, greatest(__from, start_off) - start_off + 1, least(__to, end_off) - greatest(__from, start_off))")
    own = met.select(*key, "part_id", F.struct("part_id", "span_ord").alias("span_ord"), "stack", views.retained(F.col("stack"), F.col("text"), view).alias("kept"), cut.alias("text"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("span_ord", "text")))), lambda x: x["text"]), "")
    text = own.groupBy(*key).agg(said.alias("text"))
    markup = revisions.render_markup(own, key, revs)
    held = revisions.comments_in_chunks(anchors, ranges).groupBy("chunk_key").agg(F.array_sort(F.collect_set("comment_key")).alias("comments"))
    open_ = revisions.pending_changes(revisions.stacked(ranges, spans), revs)
    pending = open_.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first_start", "revision_id", "kind", "author", "date", "excerpt"))).alias("pending"))
    cited = ranges.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part_id", "start_off", "end_off"))).alias("citation"))
    return cited.join(text, key, "left").join(markup, key, "left").join(held, "chunk_key", "left").join(pending, key, "left").select(*key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("markup", F.lit("")).alias("markup"), "comments", "pending", "citation")


def compare_pairs(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`compare` for ``pairs(a, b)`` of documents: (a, b, view_id, chunk_id, change); pairs without a common view have no row."""
    c = chunks.groupBy("document_id", "view_id", "chunk_id").agg(F.min("context_hash").alias("h"))
    p = pairs.select("a", "b").distinct()
    key = ["a", "b", "view_id"]
    x = p.join(c.withColumnRenamed("document_id", "a"), "a").select(*key, "chunk_id", F.col("h").alias("ha"), F.lit(True).alias("in_a"))
    y = p.join(c.withColumnRenamed("document_id", "b"), "b").select(*key, "chunk_id", F.col("h").alias("hb"), F.lit(True).alias("in_b"))
    shared = x.select(*key).distinct().join(y.select(*key).distinct(), key)
    both = x.join(y, [*key, "chunk_id"], "full").join(shared, key, "left_semi")
    change = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(~F.col("ha").eqNullSafe(F.col("hb")), "context_changed").otherwise("same")
    return both.select(*key, "chunk_id", change.alias("change"))


def next_pairs(ids: DataFrame, column: str) -> DataFrame:
    """Each distinct value with the next greater one, as (a, b); no task holds more than a range of them."""
    ranged = staged(ids.select(F.col(column).alias("a")).distinct().repartitionByRange("a").withColumn("__p", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("__p").orderBy("a")
    # one row a range: the first value of the next range that has any
    first = ranged.groupBy("__p").agg(F.min("a").alias("f"))
    following = first.select("__p", F.lead("f").over(Window.orderBy("__p")).alias("__next"))
    return ranged.withColumn("b", F.lead("a").over(w)).join(F.broadcast(following), "__p").select("a", F.coalesce("b", "__next").alias("b")).where("b is not null")


def compare(chunks: DataFrame, a: str, b: str) -> DataFrame:
    """Chunks of two documents in the views both have: (view_id, chunk_id, change) with only_a, only_b, context_changed or same."""
    c = chunks.where(F.col("document_id").isin(a, b))
    pair = chunks.sparkSession.createDataFrame([(a, b)], "a string, b string")
    views = c.groupBy("view_id").agg(F.count_distinct("document_id").alias("n")).where("n = 2")
    if a != b and views.isEmpty():
        raise ValueError("the two documents share no stored view")
    return compare_pairs(c, pair).select("view_id", "chunk_id", "change")


def chunk_groups_on_one_side(hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """(chunk_id, group_key, side): groups a chunk carries in one document only."""
    k = ["chunk_id", "group_key"]
    return hits_a.select(*k).distinct().join(hits_b, k, "left_anti").withColumn("side", F.lit("a")).unionByName(hits_b.select(*k).distinct().join(hits_a, k, "left_anti").withColumn("side", F.lit("b")))


def list_documents(archived: DataFrame, runs: DataFrame, rollups: DataFrame | None = None, comments: DataFrame | None = None) -> DataFrame:
    """Archived and processed documents in one list: latest run, latest keys by view and term list.

    With ``rollups(document_id, target_kind, status, text, has_pending)`` the document's own roll-up and whether something is
    pending, with ``comments(document_id)`` how many there are.
    """
    order = F.struct("written_at", "run_id")
    last = runs.groupBy("document_id").agg(F.max_by("run_id", order).alias("run_id"), F.max("written_at").alias("written_at"))
    views = runs.groupBy("document_id", "view_id").agg(F.max_by("chunks_key", order).alias("key")).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("view_id", "key")))).alias("chunk_keys"))
    terms = runs.where("term_list_hash is not null").groupBy("document_id", "term_list_hash").agg(F.max_by("hits_key", order).alias("key")).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term_list_hash", "key")))).alias("hit_keys"))
    known = archived.select("document_id", "title").join(last, "document_id", "full")
    out = known.join(views, "document_id", "left").join(terms, "document_id", "left")
    if rollups is not None:
        top = rollups.where("status = 'ok' and target_kind = 'document'").groupBy("document_id").agg(F.min(F.struct("text", "has_pending")).alias("r"))
        out = out.join(top, "document_id", "left").withColumns({"summary": F.col("r.text"), "has_pending": F.col("r.has_pending")}).drop("r")
    if comments is not None:
        out = out.join(comments.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_comments")), "document_id", "left").fillna({"n_comments": 0})
    return out.orderBy("title", "document_id")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
