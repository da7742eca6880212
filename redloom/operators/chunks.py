"""Chunks under a size limit along the outline, and their content hashes."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redloom.functions import canon
from redloom.operators import hierarchy, structure
from redloom.session import staged


@dataclass(frozen=True)
class ChunkParams:
    """Sizes in code points; ``list_run`` items in a row are a chunk of their own."""

    size_cap: int = 1000
    min_size: int = 250
    list_run: int = 2

    def hash(self) -> str:
        return canon.sha256_json(asdict(self))


def pack_blocks(blocks: DataFrame, keys: list[str], order: str, size: str, cap: int, heading: str | None = None, item: str | None = None, list_run: int = 2) -> DataFrame:
    """``blocks`` with ``chunk_no``: filled in order up to ``cap``, a joining line end counting one.

    A block over the limit stands alone; a heading that would end a full chunk goes on to the next; a run of ``list_run``
    or more list items is packed apart from what is around it.
    """
    own = blocks.select(*keys, F.col(order).alias("__o"), F.col(size).cast("int").alias("__n"), (F.col(heading) if heading else F.lit(False)).alias("__h"), (F.col(item) if item else F.lit(False)).alias("__i"))
    w = Window.partitionBy(*keys).orderBy("__o")
    island = own.withColumn("__run", F.sum((~F.col("__i").eqNullSafe(F.lag("__i").over(w))).cast("int")).over(w))
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__run"))
    segment = island.withColumn("__list", F.when(F.col("__i") & (length >= list_run), F.col("__run")).otherwise(F.lit(-1)))
    segment = segment.withColumn("__seg", F.sum((~F.col("__list").eqNullSafe(F.lag("__list").over(w))).cast("int")).over(w))
    packed = segment.groupBy(*keys, "__seg").agg(F.array_sort(F.collect_list(F.struct("__o", "__n", "__h"))).alias("bs"))
    start = F.struct(F.lit(0).alias("no"), F.lit(0).alias("fill"), F.lit(0).alias("held"), F.array().cast("array<struct<o:bigint,no:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        n, fill = b["__n"], acc["fill"]
        opens = (F.size(acc["out"]) > 0) & (fill + 1 + n > cap)
        # headings at the end of the full chunk move along, unless they are all it has
        tail = F.when(opens & (acc["held"] > 0) & (acc["held"] < fill), acc["held"]).otherwise(F.lit(0))
        no = acc["no"] + opens.cast("int")
        filled = F.when(opens, F.when(tail > 0, tail + 1 + n).otherwise(n)).otherwise(F.when(F.size(acc["out"]) == 0, n).otherwise(fill + 1 + n))
        held = F.when(b["__h"], F.when((acc["held"] > 0) & (~opens | (tail > 0)), acc["held"] + 1 + n).otherwise(n)).otherwise(F.lit(0))
        return F.struct(no.alias("no"), filled.cast("int").alias("fill"), held.cast("int").alias("held"), F.array_append(acc["out"], F.struct(b["__o"].cast("bigint").alias("o"), no.alias("no"))).alias("out"))

    rows = packed.select(*keys, "__seg", F.posexplode(F.aggregate("bs", start, step, lambda acc: acc["out"])).alias("__p", "x")).select(*keys, "__seg", F.col("x.o").alias("__o"), F.col("x.no").alias("__no"))
    if heading:
        # the headings at the end of a chunk belong to the next one when there is something else before them
        flag = rows.join(own.select(*keys, F.col("__o").cast("long").alias("__o"), "__h"), [*keys, "__o"])
        back = Window.partitionBy(*keys, "__seg", "__no").orderBy(F.desc("__o")).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys, "__seg", "__no")
        last = F.max("__no").over(Window.partitionBy(*keys, "__seg"))
        moves = F.min(F.col("__h").cast("int")).over(back) == 1
        rows = flag.withColumn("__moves", moves & (F.min(F.col("__h").cast("int")).over(whole) == 0) & (F.col("__no") < last)).withColumn("__no", F.col("__no") + F.col("__moves").cast("int")).drop("__h", "__moves")
    numbered = rows.withColumn("chunk_no", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__seg", "__no")) - 1)
    return blocks.withColumn("__o", F.col(order).cast("long")).join(numbered.select(*keys, "__o", "chunk_no"), [*keys, "__o"]).drop("__o")


def split_table_rows(rows: DataFrame, keys: list[str], order: str, size: str, cap: int) -> DataFrame:
    """Row groups of tables over the limit: ``group_no`` of each row after the first, which every group repeats.

    A group holds the first row and at least one more; a table of one row stays one group (0).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("__ix", F.row_number().over(w) - 1).withColumn("__head", F.first(size).over(w))
    bs = numbered.where("__ix > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__ix", F.col(size).cast("int").alias("n")))).alias("bs"), F.first("__head").cast("int").alias("head"))
    start = F.struct(F.lit(0).alias("no"), F.lit(-1).alias("fill"), F.array().cast("array<struct<ix:int,no:int>>").alias("out"))

    def step(acc: Column, b: Column, head: Column) -> Column:
        opens = (acc["fill"] >= 0) & (acc["fill"] + 1 + b["n"] > cap)
        no = acc["no"] + opens.cast("int")
        fill = F.when(opens | (acc["fill"] < 0), head + 1 + b["n"]).otherwise(acc["fill"] + 1 + b["n"])
        return F.struct(no.alias("no"), fill.cast("int").alias("fill"), F.array_append(acc["out"], F.struct(b["__ix"].alias("ix"), no.alias("no"))).alias("out"))

    cut = bs.select(*keys, F.explode(F.aggregate("bs", start, lambda acc, b: step(acc, b, F.col("head")), lambda acc: acc["out"])).alias("x")).select(*keys, F.col("x.ix").alias("__ix"), F.col("x.no").alias("group_no"))
    return numbered.join(cut, [*keys, "__ix"], "left").withColumn("group_no", F.coalesce("group_no", F.lit(0))).withColumn("is_header", F.col("__ix") == 0).drop("__ix", "__head")


def identify(chunks: DataFrame, version: str = "1") -> DataFrame:
    """``chunks(document_id, view_id, chunk_ord, text, comment_facts)`` with their hashes, occurrence and id.

    The id follows the text and which of its equals the chunk is, never its place or section.
    """
    content = canon.hash_of(text=canon.json_text(F.col("text")), view_id=canon.json_text(F.col("view_id")), textmodel_version=F.lit(f'"{version}"'))
    nth = F.row_number().over(Window.partitionBy("document_id", "view_id", "content_hash").orderBy("chunk_ord")) - 1
    out = chunks.withColumn("content_hash", content).withColumn("occurrence_index", nth.cast("int"))
    out = out.withColumn("chunk_id", canon.hash_of(content_hash=canon.json_text(F.col("content_hash")), occurrence_index=canon.json_number(F.col("occurrence_index"))))
    if "comment_facts" in chunks.columns:
        out = out.withColumn("context_hash", canon.hash_of(comments=F.concat(F.lit("["), F.array_join("comment_facts", ","), F.lit("]")), content_hash=canon.json_text(F.col("content_hash"))))
    return out


def comment_facts(comments: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk the sorted facts of the comments anchored in it, rendered as JSON."""
    fact = canon.json_object(author=canon.json_text(F.col("author")), date=canon.json_text(F.col("date")), para_id=canon.json_text(F.col("para_id")), resolved=F.coalesce(F.col("resolved").cast("string"), F.lit("null")), text=canon.json_text(F.col("text")))
    return comments.groupBy(*keys).agg(F.array_sort(F.collect_list(fact)).alias("comment_facts"))


def rule_union(decisions: DataFrame, keys: list[str], rules: str = "fired_rules") -> DataFrame:
    """Distinct sorted rules over the headings above a chunk."""
    return decisions.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(rules)))).alias(rules))


def merge_small(sections: DataFrame, min_size: int) -> DataFrame:
    """Which sections dissolve into their parent, deepest first: ``sections(document_id, section_ix, parent_ix, own_size, has_list_run, n_blocks)``,
    with ``heading_size`` where the heading of a dissolved section leads what it held.

    A section dissolves when it and what dissolved into it is below ``min_size``, it has no list run, and its parent has
    blocks of its own; sections at the top never do.  One ordered fold over a document's sections; a document's sections
    fit a task, its text is not in them.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("section_ix")
        own = {s: [p, n, bool(run_), b] for s, p, n, run_, b in zip(pdf.section_ix, pdf.parent_ix, pdf.own_size, pdf.has_list_run, pdf.n_blocks)}
        into = {}
        lead = dict(zip(pdf.section_ix, pdf.heading_size)) if "heading_size" in pdf else {}
        for s in sorted(own, reverse=True):  # children come after their parents in pre-order
            parent, size, has_run, _ = own[s]
            if pd.isna(parent) or has_run or size >= min_size or own[int(parent)][3] == 0:
                continue
            into[s] = int(parent)
            own[int(parent)][1] += 1 + size + (lead[s] + (size > 0) if s in lead else 0)
        target = []
        for s in pdf.section_ix:
            while s in into:
                s = into[s]
            target.append(s)
        return pd.DataFrame({"document_id": pdf.document_id, "section_ix": pdf.section_ix, "merged_into": target})

    kinds = dict(sections.dtypes)
    return sections.groupBy("document_id").applyInPandas(run, f"document_id {kinds['document_id']}, section_ix int, merged_into int")


def churn(old: DataFrame, new: DataFrame, column: str = "content_hash") -> DataFrame:
    """Chunks gone and come, as multisets."""
    counted = old.select(column, F.lit(-1).alias("n")).unionByName(new.select(column, F.lit(1).alias("n"))).groupBy(column).agg(F.sum("n").alias("n")).where("n <> 0")
    change = F.when(F.col("n") < 0, "gone").otherwise("new")
    return counted.select(column, change.alias("change"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))).alias("__i")).drop("__i")


#: Kinds of nodes that are packed, and kinds that hold text themselves.
BLOCKS = ("para", "list_item", "table")
LEAVES = ("para", "heading", "list_item")


def blocks_of(nodes: DataFrame, forest: DataFrame, texts: DataFrame) -> DataFrame:
    """The blocks of a document in one view: (document_id, node_key, node_ord, kind, text, leaf_keys).

    ``nodes(document_id, node_key, node_ord, kind)``, ``forest`` their hierarchy by document, ``texts(document_id, node_key,
    text)`` what the view keeps of each leaf.  Containers are walked through; a paragraph inside a table is the table's.  A
    block's text is its leaves' texts joined by a line end, a leaf without text being an empty line; what hangs on a loop
    is reached from no top and is no block.
    """
    n = nodes.select(F.col("document_id").alias("scope"), "node_key", "node_ord", "kind")
    kinds = n.where(F.col("kind").isin(*BLOCKS))
    sound = forest.where("depth >= 0").select("scope", "node_key")
    within = staged(hierarchy.ancestors_among(forest, kinds).groupBy("scope", "node_key").agg(F.min_by("ancestor_key", "ancestor_depth").alias("block_key")), "in-blocks")
    own = kinds.join(sound, ["scope", "node_key"], "left_semi").join(within, ["scope", "node_key"], "left_anti")
    leaves = n.where(F.col("kind").isin(*LEAVES)).join(sound, ["scope", "node_key"], "left_semi").join(within, ["scope", "node_key"], "left")
    said = texts.select(F.col("document_id").alias("scope"), "node_key", "text")
    held = leaves.withColumn("block_key", F.coalesce("block_key", F.when(F.col("kind") != "heading", F.col("node_key")))).where("block_key is not null").join(said, ["scope", "node_key"], "left")
    parts = F.array_sort(F.collect_list(F.struct("node_ord", "node_key", F.coalesce("text", F.lit("")).alias("text"))))
    joined = held.groupBy("scope", F.col("block_key").alias("node_key")).agg(parts.alias("p"))
    shaped = joined.select("scope", "node_key", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.transform("p", lambda x: x["node_key"]).alias("leaf_keys"))
    # a table without any leaf has no text
    out = own.join(shaped, ["scope", "node_key"], "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("leaf_keys", F.coalesce("leaf_keys", F.array().cast("array<bigint>")))
    return out.withColumnRenamed("scope", "document_id").select("document_id", "node_key", "node_ord", "kind", "text", "leaf_keys")


def chunk_blocks(blocks: DataFrame, headings: DataFrame, view: str, params: ChunkParams = ChunkParams(), rows: DataFrame | None = None) -> DataFrame:
    """Chunks along the outline: (document_id, view_id, chunk_ord, section_ix, section_path, node_keys, text, content_hash, occurrence_index, chunk_id, size_cp).

    ``blocks`` of :func:`blocks_of`, ``headings(document_id, node_key, node_ord, title, stated_level)``.  A block belongs to
    the section of the last heading before it; a small section dissolves into its parent (:func:`merge_small`), its heading
    leading what it held; a section's blocks are packed under the limit.  ``rows(document_id, node_key, row_ix, text)`` are
    the rows of tables: a table over the limit is cut in groups of rows that repeat the first.
    """
    doc = "document_id"
    sections = staged(structure.build_sections(headings), "sections")
    titled = headings.join(sections.select(doc, "node_ord", "pre_order"), [doc, "node_ord"]).select(doc, "node_key", "node_ord", F.lit("heading").alias("kind"), F.col("title").alias("text"), F.array("node_key").alias("leaf_keys"), F.col("pre_order").alias("section_ix"))
    placed = staged(structure.assign_sections(blocks, sections).select(doc, "node_key", "node_ord", "kind", "text", "leaf_keys", "section_ix"), "placed-blocks")
    # sizes and list runs of each section's own blocks
    w = Window.partitionBy(doc, "section_ix").orderBy("node_ord")
    item = F.col("kind") == "list_item"
    runs = placed.where("section_ix is not null").withColumn("__run", F.sum((~item).cast("int")).over(w))
    run = runs.where(item).groupBy(doc, "section_ix", "__run").count().groupBy(doc, "section_ix").agg((F.max("count") >= params.list_run).alias("has_list_run"))
    size = placed.groupBy(doc, "section_ix").agg((F.sum(F.length("text") + 1) - 1).cast("long").alias("own_size"), F.count(F.lit(1)).alias("n_blocks"))
    own = sections.select(doc, F.col("pre_order").alias("section_ix"), "parent_ix", F.length("title").alias("heading_size")).join(size, [doc, "section_ix"], "left").join(run, [doc, "section_ix"], "left")
    own = own.fillna({"own_size": 0, "n_blocks": 0, "has_list_run": False, "heading_size": 0})
    into = staged(merge_small(own, params.min_size), "merged-sections")
    target = F.coalesce("merged_into", F.lit(-1))
    stream = placed.join(into, [doc, "section_ix"], "left").withColumn("group", target)
    led = titled.join(into.where("merged_into <> section_ix"), [doc, "section_ix"]).withColumn("group", target)
    stream = staged(stream.unionByName(led).select(doc, "group", "node_ord", "node_key", "kind", "text", "leaf_keys", F.length("text").alias("n"), (F.col("kind") == "heading").alias("is_heading"), (F.col("kind") == "list_item").alias("is_item")), "chunk-stream")
    sizes = stream.select(doc, "group", "node_ord", "n", "is_heading", "is_item")
    numbered = pack_blocks(sizes, [doc, "group"], "node_ord", "n", params.size_cap, "is_heading", "is_item", params.list_run).select(doc, "group", "node_ord", F.col("chunk_no").cast("int").alias("chunk_no"), F.lit(0).alias("part_no"))
    packed = stream.join(numbered, [doc, "group", "node_ord"])
    if rows is not None:
        large = stream.where((F.col("kind") == "table") & (F.col("n") > params.size_cap)).select(doc, "node_key")
        cut = split_table_rows(rows.join(large, [doc, "node_key"], "left_semi").withColumn("n", F.length("text")), [doc, "node_key"], "row_ix", "n", params.size_cap)
        groups = cut.where(~F.col("is_header")).groupBy(doc, "node_key", "group_no").agg(F.array_sort(F.collect_list(F.struct("row_ix", "text"))).alias("r"))
        head = cut.where("is_header").select(doc, "node_key", F.struct("row_ix", "text").alias("h"))
        whole = head.join(groups, [doc, "node_key"], "left").select(doc, "node_key", F.coalesce("group_no", F.lit(0)).alias("__no"), F.concat(F.array("h"), F.coalesce("r", F.array().cast("array<struct<row_ix:int,text:string>>"))).alias("r"))
        pieces = whole.select(doc, "node_key", "__no", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("__text"))
        packed = packed.join(pieces, [doc, "node_key"], "left").withColumns({"text": F.coalesce("__text", "text"), "part_no": F.coalesce("__no", "part_no")}).drop("__text", "__no")
    parts = F.array_sort(F.collect_list(F.struct("node_ord", "text", "leaf_keys")))
    made = packed.groupBy(doc, "group", "chunk_no", "part_no").agg(parts.alias("p"), F.min("node_ord").alias("first"))
    made = made.select(doc, "group", F.struct("first", "part_no").alias("chunk_ord"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.flatten(F.transform("p", lambda x: x["leaf_keys"])).alias("node_keys"), F.lit(view).alias("view_id"))
    paths = sections.select(doc, F.col("pre_order").alias("group"), "path")
    out = identify(made).join(paths, [doc, "group"], "left")
    return out.select(doc, "view_id", "chunk_ord", F.col("group").alias("section_ix"), F.coalesce("path", F.array().cast("array<string>")).alias("section_path"), "node_keys", "text", "content_hash", "occurrence_index", "chunk_id", F.length("text").alias("size_cp"))


def heading_comment_chunks(comments: DataFrame, headings: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(comment_key, chunk_id) of comments that begin in a heading: the first chunk of its section, or of the first section below that has one.

    ``comments(document_id, comment_key, heading_key)``, ``headings(document_id, node_key, pre_order)``, ``sections(document_id,
    pre_order, level)`` in pre-order; ``chunks`` of :func:`chunk_blocks`.  A section's own and lower sections are those up to
    the next of its level or above.
    """
    doc = "document_id"
    s = sections.select(doc, "pre_order", "level")
    later = s.select(doc, F.col("pre_order").alias("q"), F.col("level").alias("lq"))
    ends = s.join(later, doc).where("q > pre_order and lq <= level").groupBy(doc, "pre_order").agg(F.min("q").alias("stop"))
    span = s.join(ends, [doc, "pre_order"], "left").select(doc, "pre_order", F.coalesce("stop", F.lit(2**31 - 1)).alias("stop"))
    first = chunks.groupBy(doc, "section_ix").agg(F.min(F.struct("chunk_ord", "chunk_id")).alias("c"))
    of = comments.join(headings.select(doc, F.col("node_key").alias("heading_key"), "pre_order"), [doc, "heading_key"]).join(span, [doc, "pre_order"])
    met = of.join(first, doc).where("section_ix >= pre_order and section_ix < stop")
    return met.groupBy(doc, "comment_key").agg(F.min_by("c", "section_ix").alias("c")).select(doc, "comment_key", "c.chunk_id")
