"""Comments, tracked changes and what is pending in a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redloom.operators.views import PART, overlap_join

EXCERPT = 200
CUT_MARK = "…[truncated]"


def on_off(value: Column) -> Column:
    """The three-state reading of a switch attribute: true, false or not stated."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("1", "true", "on"), True).when(v.isin("0", "false", "off"), False)


def assemble_comments(bodies: DataFrame, ranges: DataFrame, extended: DataFrame | None) -> DataFrame:
    """Bodies with their anchor and thread: ``bodies(document_id, comment_id, para_id, ...)``, ``ranges(document_id, comment_id, part_id, start_off, end_off, ord)``, ``extended(document_id, para_id, parent_para_id, done, ord)``.

    The first range of an id and the first extended row of a paragraph count.  Threading is ``absent`` without an
    extended part, ``verified`` with a row in it, else ``unknown``.
    """
    first = ranges.groupBy("document_id", "comment_id").agg(F.min_by(F.struct("part_id", "start_off", "end_off"), "ord").alias("anchor"))
    out = bodies.join(first, ["document_id", "comment_id"], "left")
    if extended is None:
        return out.withColumns({"parent_id": F.lit(None).cast("string"), "resolved": F.lit(None).cast("boolean"), "threading_status": F.lit("absent")})
    there = extended.select("document_id").distinct().withColumn("__part", F.lit(True))
    row = extended.groupBy("document_id", "para_id").agg(F.min_by(F.struct("parent_para_id", "done"), "ord").alias("x"))
    out = out.join(row, ["document_id", "para_id"], "left").join(there, "document_id", "left")
    status = F.when(F.col("__part").isNull(), "absent").when(F.col("x").isNotNull(), "verified").otherwise("unknown")
    return out.withColumn("threading_status", status).withColumn("parent_id", F.col("x.parent_para_id")).withColumn("resolved", on_off(F.col("x.done"))).drop("x", "__part")


def comment_gaps(comments: DataFrame, ranges: DataFrame) -> DataFrame:
    """(document_id, gap, detail): comments without an anchor, ranges without a body, parents that are not there."""
    loose = comments.where("anchor is null").select("document_id", F.lit("unanchored_comment").alias("gap"), F.col("comment_id").alias("detail"))
    bodiless = ranges.join(comments, ["document_id", "comment_id"], "left_anti").select("document_id", F.lit("unanchored_comment").alias("gap"), F.col("comment_id").alias("detail")).distinct()
    known = comments.select("document_id", F.lower("para_id").alias("__p"))
    lost = comments.where("parent_id is not null").withColumn("__p", F.lower("parent_id")).join(known, ["document_id", "__p"], "left_anti").select("document_id", F.lit("dangling_comment_parent").alias("gap"), F.col("comment_id").alias("detail"))
    return loose.unionByName(bodiless).unionByName(lost)


def anchor_nodes(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost node that holds each anchor's start: ``anchors(document_id, part_id, comment_key, start)``, ``spans(document_id, part_id, node_key, node_ord, depth, start_off, end_off)``.

    Ties go to the first node in document order; comments no node holds are kept with null.
    """
    points = anchors.withColumn("__end", F.col("start") + 1)
    met = overlap_join(points, spans, PART, "start", "__end", "start_off", "end_off")
    best = met.groupBy("comment_key").agg(F.max_by(F.struct("node_key", "node_ord"), F.struct("depth", (-F.col("node_ord")).alias("o"))).alias("b"))
    return anchors.join(best, "comment_key", "left").select(*anchors.columns, F.col("b.node_key").alias("node_key"))


def chunk_ranges(chunks: DataFrame, node_spans: DataFrame) -> DataFrame:
    """The stream ranges of each chunk: ``chunks(document_id, chunk_key, node_ids)``, ``node_spans(document_id, node_id, part_id, start_off, end_off)``."""
    return chunks.select("document_id", "chunk_key", F.explode("node_ids").alias("node_id")).join(node_spans, ["document_id", "node_id"])


def comments_in_chunks(anchors: DataFrame, ranges: DataFrame) -> DataFrame:
    """(chunk_key, comment_key) where a chunk's ranges hold a comment's start; each pair once."""
    points = anchors.withColumn("__end", F.col("start") + 1)
    return overlap_join(points, ranges, PART, "start", "__end", "start_off", "end_off").select("chunk_key", "comment_key").distinct()


def node_owner(chunks: DataFrame) -> DataFrame:
    """The chunk of each node, the first that lists it: ``chunks(document_id, view_id, chunk_ord, chunk_id, node_ids)``."""
    return chunks.select("document_id", "view_id", "chunk_ord", "chunk_id", F.explode("node_ids").alias("node_id")).groupBy("document_id", "view_id", "node_id").agg(F.min_by("chunk_id", "chunk_ord").alias("chunk_id"))


def stacked(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Every revision on the stacks under a chunk's ranges, a row a span: (document_id, part_id, chunk_key, revision_id, start_off, end_off, text)."""
    runs = spans.where("size(stack) > 0").select(*PART, F.col("start_off").alias("s"), F.col("end_off").alias("e"), "stack", "text")
    met = overlap_join(ranges, runs, PART, "start_off", "end_off", "s", "e")
    lo, hi = F.greatest("start_off", "s"), F.least("end_off", "e")
    clipped = met.select(*PART, "chunk_key", lo.alias("a"), hi.alias("b"), F.substring("text", lo - F.col("s") + 1, hi - lo).alias("t"), F.explode("stack").alias("revision_id"))
    return clipped.select(*PART, "chunk_key", "revision_id", F.col("a").alias("start_off"), F.col("b").alias("end_off"), F.col("t").alias("text"))


def excerpt(text: Column) -> Column:
    return F.when(F.length(text) > EXCERPT, F.concat(F.substring(text, 1, EXCERPT), F.lit(CUT_MARK))).otherwise(text)


def pending_changes(pieces: DataFrame, revisions: DataFrame) -> DataFrame:
    """A row a chunk and revision: kind, author, date, clipped spans, excerpt, first start; revisions without a record keep nulls."""
    one = pieces.groupBy("document_id", "chunk_key", "revision_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "start_off", "end_off", "text"))).alias("p"), F.min("start_off").alias("first_start"))
    spans = F.transform("p", lambda x: F.struct(x["part_id"].alias("part_id"), x["start_off"].alias("start_off"), x["end_off"].alias("end_off")))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    rows = one.select("document_id", "chunk_key", "revision_id", "first_start", spans.alias("spans"), excerpt(text).alias("excerpt"), F.split_part("revision_id", F.lit(":"), F.lit(1)).alias("kind"))
    return rows.join(revisions.select("document_id", "revision_id", "author", "date"), ["document_id", "revision_id"], "left")


def document_pending(revisions: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per document: revisions that stand in some chunk and those that stand in none."""
    on = pieces.select("document_id", "revision_id").distinct().withColumn("__on", F.lit(True))
    return revisions.select("document_id", "revision_id").distinct().join(on, ["document_id", "revision_id"], "left").groupBy("document_id").agg(F.count("__on").alias("n_attributed"), F.count_if(F.col("__on").isNull()).alias("n_unattributed"))


def revision_places(spans: DataFrame) -> DataFrame:
    """A revision's whole text and its stream ranges, touching ones joined: (document_id, revision_id, text, ranges)."""
    pieces = spans.where("size(stack) > 0").select(*PART, "span_ord", "start_off", "end_off", "text", F.explode("stack").alias("revision_id"))
    w = Window.partitionBy(*PART, "revision_id").orderBy("start_off")
    runs = pieces.withColumn("__run", F.sum((~F.col("start_off").eqNullSafe(F.lag("end_off").over(w))).cast("int")).over(w))
    own = runs.groupBy(*PART, "revision_id", "__run").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_off", "text"))), lambda x: x["text"]), "").alias("text"))
    parts = own.groupBy("document_id", "revision_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "start_off", "end_off", "text"))).alias("p"))
    return parts.select("document_id", "revision_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.transform("p", lambda x: F.struct(x["part_id"].alias("part_id"), x["start_off"].alias("start_off"), x["end_off"].alias("end_off"))).alias("ranges"))


def _attribute(name: str, value: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("]"), F.lit("\\]"))
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escaped, F.lit('"'))).otherwise(F.lit(""))


def render_markup(spans: DataFrame, keys: list[str], revisions: DataFrame) -> DataFrame:
    """The inserted and deleted text of each key in one string, every span wrapped by its revisions: ``spans(keys, document_id, span_ord, text, stack)``."""
    head = revisions.select("document_id", "revision_id", F.concat(F.split_part("revision_id", F.lit(":"), F.lit(1)), _attribute("author", F.col("author")), _attribute("date", F.col("date")), _attribute("group", F.col("move_group_id"))).alias("head"))
    heads = head.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("revision_id", "head"))).alias("heads"))
    rows = spans.join(heads, "document_id", "left")
    name = lambda r: F.coalesce(F.try_element_at(F.col("heads"), r), F.split_part(r, F.lit(":"), F.lit(1)))
    opened = F.array_join(F.transform("stack", lambda r: F.concat(F.lit("[["), name(r), F.lit("]]"))), "")
    closed = F.array_join(F.transform(F.reverse("stack"), lambda r: F.concat(F.lit("[[/"), F.split_part(r, F.lit(":"), F.lit(1)), F.lit("]]"))), "")
    own = rows.select(*keys, "span_ord", F.concat(opened, F.col("text"), closed).alias("m"))
    return own.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "m"))), lambda x: x["m"]), "").alias("markup"))


def chunk_text(chunks: DataFrame, node_texts: DataFrame) -> DataFrame:
    """The text of each chunk in a view: its nodes' texts joined by line ends, a node without text an empty line."""
    leaves = chunks.select("document_id", "chunk_key", F.posexplode("node_ids").alias("pos", "node_id")).join(node_texts.select("document_id", "node_id", "text"), ["document_id", "node_id"], "left")
    return leaves.groupBy("document_id", "chunk_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))


def three_state_any(flag: Column) -> Column:
    """True if any is, else null if any is not stated, else false."""
    return F.when(F.max(flag), True).when(F.count(F.lit(1)) != F.count(flag), None).otherwise(False)
