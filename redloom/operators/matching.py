"""Term matching of whole documents: every paragraph-like node in the accepted and the original view, then comments.

A node is matched on what a view keeps of it, so words that only stand next to each other in text a view drops are never
read together; a hit's place is given in the view and, piece by piece, in the stream.  A hit that both views have at the
same place is one.  A comment's words are in no view of the document: its hits name none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redloom.operators import terms, views
from redloom.operators.views import PART

#: Kinds of nodes that are matched.
UNITS = ("para", "heading", "list_item")
#: Views a hit can be in; the superseded one is never matched.
MATCH_VIEWS = ("accepted", "original")
OWNER = [*PART, "owner", "leaf_ix"]


def projections(spans: DataFrame, of: tuple[str, ...] = MATCH_VIEWS) -> DataFrame:
    out = views.project(spans, of[0])
    for view in of[1:]:
        out = out.unionByName(views.project(spans, view))
    return out


def leaf_texts(leaves: DataFrame, projection: DataFrame) -> DataFrame:
    """What the views keep of each range: ``leaves(document_id, part_id, owner, leaf_ix, start_off, end_off)`` to (..., view, view_base, text).

    A range of which a view keeps nothing has no row there.
    """
    asked = leaves.select(*OWNER, F.col("start_off").alias("__from"), F.col("end_off").alias("__to"))
    met = views.overlap_join(asked.where("__from < __to"), projection, PART, "__from", "__to", "start_off", "end_off")
    begin = F.greatest("__from", "start_off")
    cut = F.expr("substring(text, greatest(__from, start_off) - start_off + 1, least(__to, end_off) - greatest(__from, start_off))")
    own = met.select(*OWNER, "view", "span_ord", (F.col("view_start") + begin - F.col("start_off")).alias("at"), cut.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "t"))), lambda x: x["t"]), "")
    return own.groupBy(*OWNER, "view").agg(F.min("at").alias("view_base"), joined.alias("text"))


def leaf_hits(leaves: DataFrame, spans: DataFrame, forms: DataFrame) -> DataFrame:
    """Hits of ranges in each view: (document_id, part_id, owner, leaf_ix, group_key, view, view_start, view_end, rank, spans)."""
    projection = projections(spans)
    lines = terms.lines_of(leaf_texts(leaves, projection))
    hits = terms.match_lines(lines, forms, [*OWNER, "view", "view_base", "base", "seg_ix"])
    begin = F.col("view_base") + F.col("base")
    placed = hits.select(*OWNER, "view", "group_key", "rank", (begin + F.col("start")).alias("start"), (begin + F.col("end")).alias("end"))
    named = placed.select(*PART, "view", F.struct("owner", "leaf_ix", "group_key", "rank", F.col("start").alias("s"), F.col("end").alias("e")).alias("match_id"), "start", "end")
    places = views.union_spans(named, projection).groupBy(*PART, "view", "match_id").agg(F.array_sort(F.collect_list(F.struct("union_start", "union_end"))).alias("spans"))
    return places.select(*PART, "match_id.owner", "match_id.leaf_ix", "match_id.group_key", "view", F.col("match_id.s").alias("view_start"), F.col("match_id.e").alias("view_end"), "match_id.rank", "spans")


def document_hits(leaves: DataFrame, spans: DataFrame, forms: DataFrame) -> DataFrame:
    """One hit a group, node and place, with the views that have it: (document_id, part_id, owner, group_key, spans, present_in, view_spans, match_type, hit_ord).

    ``leaves`` as in :func:`leaf_texts` plus ``node_ord``.
    """
    found = leaf_hits(leaves, spans, forms)
    order = leaves.select(*OWNER, "node_ord").distinct()
    ranked = found.join(order, OWNER)
    first = F.struct("part_id", F.array_position(F.array(*map(F.lit, MATCH_VIEWS)), F.col("view")).alias("v"), "node_ord", "leaf_ix", "view_start", "view_end", "group_key")
    shaped = ranked.select("document_id", F.struct("part_id", "owner").alias("node_id"), "group_key", "spans", "view", "view_start", "view_end", "rank", first.alias("ord"))
    return terms.merge_views(shaped).select("document_id", "node_id.part_id", "node_id.owner", "group_key", "spans", "present_in", "view_spans", "match_type", "hit_ord")


def comment_hits(bodies: DataFrame, spans: DataFrame, forms: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Hits of comments' own words: ``bodies`` as in :func:`leaf_texts`, ``owner`` being the comment; columns as in :func:`document_hits`.

    Both readings of a comment with tracked changes are matched; a place that both have is one hit, of the strongest type.
    ``context(document_id, owner, node_key)`` names the node each comment is anchored at.
    """
    found = leaf_hits(bodies, spans, forms)
    one = found.groupBy(*PART, "owner", "group_key", "spans").agg(F.min("rank").alias("rank"))
    kind = F.element_at(F.array(*map(F.lit, terms.MATCH_TYPES)), F.col("rank"))
    out = one.select(*PART, "owner", "group_key", "spans", F.array().cast("array<string>").alias("present_in"), kind.alias("match_type"))
    return out if context is None else out.join(context.select("document_id", "owner", F.col("node_key").alias("context_node")), ["document_id", "owner"], "left")
