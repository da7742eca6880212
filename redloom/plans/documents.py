"""From parsed packages to chunks and hits: the tables of :func:`redloom.sources.docx.tables_of` through the operators.

Nodes are told apart by a 64-bit hash of document and id; all else is what the operators do for any tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redloom.operators import chunks, hierarchy, matching
from redloom.session import staged

BODY = "officeDocument:0"


def _key(node: str = "node_id") -> Column:
    return F.xxhash64("document_id", node)


def leaves_of(t: dict[str, DataFrame]) -> DataFrame:
    """The paragraph-like nodes outside comments: (document_id, part_id, owner, node_ord, leaf_ix, start_off, end_off)."""
    n = t["node"].where(F.col("kind").isin(*matching.UNITS) & F.col("start_off").isNotNull() & ~F.col("part_id").startswith("comments"))
    return n.select("document_id", "part_id", F.col("node_id").alias("owner"), "node_ord", F.lit(0).alias("leaf_ix"), "start_off", "end_off")


def hits_of(t: dict[str, DataFrame], forms: DataFrame) -> DataFrame:
    """Every hit of the forms in both views, then in comments."""
    body = matching.document_hits(leaves_of(t), t["span"], forms).drop("hit_ord", "view_spans")
    n = t["node"].where(F.col("part_id").startswith("comments") & F.col("kind").isin(*matching.UNITS) & F.col("start_off").isNotNull())
    said = n.select("document_id", "part_id", F.concat(F.lit("comment:"), "node_id").alias("owner"), F.lit(0).alias("leaf_ix"), "start_off", "end_off")
    return body.unionByName(matching.comment_hits(said, t["span"], forms))


def chunks_of(t: dict[str, DataFrame], view: str = "accepted", params: chunks.ChunkParams = chunks.ChunkParams()) -> DataFrame:
    """The chunks of each document's body in a view: see :func:`redloom.operators.chunks.chunk_blocks`."""
    n = t["node"].where(F.col("part_id") == BODY).withColumn("node_key", _key())
    # a parent outside the body counts as none
    links = n.select(F.col("document_id").alias("scope"), "node_key", F.when(F.col("parent_id").isNotNull(), _key("parent_id")).alias("parent_key"))
    forest = staged(hierarchy.build_hierarchy(links), "node-forest")
    ranges = leaves_of(t).where(F.col("part_id") == BODY).withColumn("owner", F.xxhash64("document_id", "owner"))
    texts = matching.leaf_texts(ranges, matching.projections(t["span"], (view,))).select("document_id", F.col("owner").alias("node_key"), F.regexp_replace("text", "\n$", "").alias("text"))
    texts = staged(texts, "leaf-texts")
    blocks = staged(chunks.blocks_of(n, forest, texts), "blocks")
    headings = n.where("kind = 'heading'").join(texts, ["document_id", "node_key"], "left").select("document_id", "node_key", "node_ord", F.coalesce("text", F.lit("")).alias("title"), F.col("level").alias("stated_level"))
    return chunks.chunk_blocks(blocks, headings, view, params)
