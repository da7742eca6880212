"""Views over streams that keep inserted and deleted text side by side.

A stream is tiled by spans ``(document_id, part_id, span_ord, start_off, end_off, stack)``; a span's stack names the
revisions around it, ``kind:id``.  A view is a mask over the spans and is never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEWS = ("accepted", "original", "superseded")
ADDED = ("ins", "moveTo")
REMOVED = ("del", "moveFrom")
PART = ["document_id", "part_id"]


def _any_of(stack: Column, kinds: tuple[str, ...]) -> Column:
    return F.exists(stack, lambda r: F.split_part(r, F.lit(":"), F.lit(1)).isin(*kinds))


def keeps(stack: Column, view: str) -> Column:
    """Whether a span with that stack is in the view."""
    if view == "accepted":
        return ~_any_of(stack, REMOVED)
    if view == "original":
        return ~_any_of(stack, ADDED)
    if view == "superseded":
        return _any_of(stack, ADDED) & _any_of(stack, REMOVED)
    raise ValueError(f"no view is named {view!r}; known: {VIEWS}")


def retained(stack: Column, text: Column, view: str) -> Column:
    """Like ``keeps``, but the line end of a paragraph is in every view."""
    return keeps(stack, view) | ((F.size(stack) == 0) & (text == "\n"))


def build_spans(pieces: DataFrame) -> DataFrame:
    """Coalesce neighbours of one stack: ``pieces(document_id, part_id, piece_ord, text, stack)`` to tiled spans with text.

    A paragraph's line end (text ``\\n``, empty stack) stays a span of its own.
    """
    w = Window.partitionBy(*PART).orderBy("piece_ord")
    end = (F.col("text") == "\n") & (F.size("stack") == 0)
    cut = end | F.lag(end, 1, True).over(w) | ~F.col("stack").eqNullSafe(F.lag("stack").over(w))
    runs = pieces.where("text <> ''").withColumn("__cut", cut.cast("int")).withColumn("span_ord", F.sum("__cut").over(w))
    spans = runs.groupBy(*PART, "span_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_ord", "text"))), lambda x: x["text"]), "").alias("text"), F.first("stack").alias("stack"))
    before = Window.partitionBy(*PART).orderBy("span_ord")
    n = F.length("text")
    return spans.withColumn("end_off", F.sum(n).over(before).cast("int")).withColumn("start_off", F.col("end_off") - n)


def project(spans: DataFrame, view: str) -> DataFrame:
    """The spans a view keeps, with where each stands in the view: ``view_start``, ``view_end``."""
    w = Window.partitionBy(*PART).orderBy("span_ord")
    kept = spans.where(retained(F.col("stack"), F.col("text"), view)).withColumn("view", F.lit(view))
    n = F.length("text")
    return kept.withColumn("view_end", F.sum(n).over(w).cast("int")).withColumn("view_start", F.col("view_end") - n)


def view_text(projection: DataFrame) -> DataFrame:
    """(document_id, part_id, view, text): gaps closed by concatenation."""
    return projection.groupBy(*PART, "view").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "text"))), lambda x: x["text"]), "").alias("text"))


#: Width of the offset buckets that overlap joins meet in.
BUCKET = 256


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re_: str, width: int = BUCKET) -> DataFrame:
    """Pairs whose ranges [ls, le) and [rs, re_) share a character.

    Ranges meet in offset buckets, so the join is an equi-join whose groups stay small in long parts; a pair is kept in
    the bucket where the later of the two begins.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / width)))
    a = left.withColumn("__b", bucket(ls, le))
    b = right.withColumn("__b", bucket(rs, re_))
    return a.join(b, [*keys, "__b"]).where((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("__b"))).drop("__b")


def union_spans(matches: DataFrame, projection: DataFrame) -> DataFrame:
    """Where matches found in a view stand in the stream: one row a contiguous piece.

    ``matches(document_id, part_id, view, match_id, start, end)`` in view offsets; pieces that touch are one.
    """
    runs = projection.select(*PART, "view", "span_ord", "start_off", "view_start", "view_end")
    met = overlap_join(matches, runs, [*PART, "view"], "start", "end", "view_start", "view_end")
    u0 = F.col("start_off") + F.greatest(F.col("start"), F.col("view_start")) - F.col("view_start")
    u1 = F.col("start_off") + F.least(F.col("end"), F.col("view_end")) - F.col("view_start")
    clipped = met.select(*PART, "view", "match_id", u0.alias("u0"), u1.alias("u1"))
    key = [*PART, "view", "match_id"]
    w = Window.partitionBy(*key).orderBy("u0")
    run = clipped.withColumn("__new", (~F.col("u0").eqNullSafe(F.lag("u1").over(w))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return run.groupBy(*key, "__run").agg(F.min("u0").alias("union_start"), F.max("u1").alias("union_end")).drop("__run")


def union_range(matches: DataFrame, projection: DataFrame) -> DataFrame:
    """The one stream range that covers each match."""
    return union_spans(matches, projection).groupBy(*PART, "view", "match_id").agg(F.min("union_start").alias("union_start"), F.max("union_end").alias("union_end"))


def view_offsets(points: DataFrame, projection: DataFrame) -> DataFrame:
    """Stream offsets as view offsets: ``points(document_id, part_id, view, point_id, offset)``.

    An as-of lookup by one sort: an offset in text the view drops maps to where the view goes on, so both ends of a
    dropped range are equal.
    """
    runs = projection.select(*PART, "view", F.col("start_off").alias("at"), F.lit(0).alias("kind"), F.col("view_start").alias("v"), (F.col("end_off") - F.col("start_off")).alias("n"), F.lit(None).cast("string").alias("point_id"))
    asked = points.select(*PART, "view", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("v"), F.lit(None).cast("int").alias("n"), F.col("point_id").cast("string"))
    w = Window.partitionBy(*PART, "view").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("at", "v", "n")), ignorenulls=True).over(w)
    both = runs.unionByName(asked).withColumn("__r", last).where("kind = 1")
    return both.select(*PART, "view", "point_id", F.col("at").alias("offset"), F.coalesce(F.col("__r.v") + F.least(F.col("at") - F.col("__r.at"), F.col("__r.n")), F.lit(0)).alias("view_offset"))
