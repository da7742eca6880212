"""Headings, outlines and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOLD_CHARS = 120
#: Heading rules in the order of their say.
RULES = ("style", "outline_level", "outline_inherited", "bold_short")
_STYLE = r"(?i)^(heading\s*[1-9]|title)$"


def is_heading_style(style: Column) -> Column:
    return F.coalesce(style.rlike(_STYLE), F.lit(False))


def heading_style_level(style: Column) -> Column:
    digit = F.regexp_extract(style, r"(?i)^heading\s*([1-9])$", 1)
    return F.when(digit != "", digit.cast("int"))


def heading_decision(style: Column, outline: Column, inherited: Column, bold: Column, n_chars: Column, in_cell: Column, list_continues: Column) -> Column:
    """struct<fired, winner, disputed>: every rule that fires, the first of them, the others."""
    tests = (
        is_heading_style(style),
        outline.between(0, 8),
        inherited.between(0, 8),
        bold & n_chars.between(1, BOLD_CHARS) & ~F.coalesce(in_cell, F.lit(False)) & ~F.coalesce(list_continues, F.lit(False)),
    )
    fired = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, RULES)]))
    return F.struct(fired.alias("fired_rules"), F.try_element_at(fired, F.lit(1)).alias("winner"), F.when(F.size(fired) > 1, F.slice(fired, 2, len(RULES))).otherwise(F.array().cast("array<string>")).alias("disputed_rules"))


def section_level(outline: Column, style: Column) -> Column:
    """Outline level + 1, else the style's number, else 0 for a title, else null."""
    return F.coalesce(F.when(outline.between(0, 8), outline + 1), heading_style_level(style), F.when(F.lower(style) == "title", 0)).cast("int")


def build_sections(headings: DataFrame) -> DataFrame:
    """A document's headings ``(document_id, node_ord, title, stated_level)`` as a forest of sections.

    A heading closes the open sections of its level or deeper.  One without a level goes one below the innermost open
    section that states its level, or to the top.  One ordered fold a document: its state is the open sections only.
    """
    one = F.struct("node_ord", "title", F.col("stated_level").alias("lvl"))
    rows = headings.groupBy("document_id").agg(F.array_sort(F.collect_list(one)).alias("hs"))
    open_type = "array<struct<ix:int,lv:int,stated:boolean,title:string>>"
    out_type = "array<struct<pre_order:int,node_ord:int,title:string,level:int,parent_ix:int,path:array<string>>>"
    start = F.struct(F.array().cast(open_type).alias("st"), F.array().cast(out_type).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        inner = F.try_element_at(F.filter(acc["st"], lambda x: x["stated"]), F.lit(-1))
        level = F.coalesce(h["lvl"], inner["lv"] + 1, F.lit(1))
        rest = F.filter(acc["st"], lambda x: x["lv"] < level)
        ix = F.size(acc["out"])
        own = F.struct(ix.alias("ix"), level.alias("lv"), h["lvl"].isNotNull().alias("stated"), h["title"].alias("title"))
        path = F.array_append(F.transform(rest, lambda x: x["title"]), h["title"])
        row = F.struct(ix.alias("pre_order"), h["node_ord"].alias("node_ord"), h["title"].alias("title"), level.alias("level"), F.try_element_at(rest, F.lit(-1))["ix"].alias("parent_ix"), path.alias("path"))
        return F.struct(F.array_append(rest, own).cast(open_type).alias("st"), F.array_append(acc["out"], row).cast(out_type).alias("out"))

    return rows.select("document_id", F.explode(F.aggregate("hs", start, step, lambda acc: acc["out"])).alias("s")).select("document_id", "s.*")


def assign_sections(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """``nodes(document_id, node_ord)`` with the section they stand in: the last heading at or before them.

    An as-of lookup by one sort of both tables; nodes before the first heading have null.
    """
    s = sections.select("document_id", "node_ord", F.lit(0).alias("__kind"), F.struct("pre_order", "path").alias("__s"))
    n = nodes.withColumn("__kind", F.lit(1))
    both = n.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("document_id").orderBy("node_ord", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("__last", F.last("__s", ignorenulls=True).over(w)).where("__kind = 1")
    return last.select(*[F.col(c) for c in nodes.columns], F.col("__last.pre_order").alias("section_ix"), F.coalesce("__last.path", F.array().cast("array<string>")).alias("section_titles"))


def heading_summary(decisions: DataFrame) -> DataFrame:
    """Per document: headings, disagreements, and whether detection is degraded (no heading at all)."""
    return decisions.groupBy("document_id").agg(F.count("winner").alias("n_headings"), F.count_if((F.col("winner").isNotNull()) & (F.size("disputed_rules") > 0)).alias("n_disputed"), F.when(F.count("winner") == 0, "degraded").otherwise("normal").alias("heading_detection"))


def in_section(path: Column, wanted: list[str] | None) -> Column:
    """Whether a path begins with ``wanted``; nothing wanted passes everything."""
    if not wanted:
        return F.lit(True)
    return F.slice(path, 1, len(wanted)) == F.array(*map(F.lit, wanted))


def list_runs(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Maximal runs of ``least`` or more list items among siblings: ``nodes(document_id, parent, node_ord, is_item)``."""
    w = Window.partitionBy("document_id", "parent").orderBy("node_ord")
    islands = nodes.withColumn("__new", (~F.col("is_item").eqNullSafe(F.lag("is_item").over(w))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    runs = islands.where("is_item").groupBy("document_id", "parent", "__run").agg(F.min("node_ord").alias("first_ord"), F.max("node_ord").alias("last_ord"), F.count(F.lit(1)).alias("n_items"))
    return runs.where(F.col("n_items") >= least).drop("__run")
