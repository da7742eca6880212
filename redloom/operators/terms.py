"""Exact matching of a term registry: canonical forms, synonyms, hyphen readings and opt-in stems.

Forms meet text on their first token, then token by token; the cost follows the text, not the registry.  Of the matches
of one group in a line the longest in characters wins, then the leftmost, then exact before synonym before stem; matches
of one group never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redloom.functions import text as T
from redloom.functions.canon import sha256_json
from redloom.functions.stem import STEMMERS, stem_tokens, stemmer
from redloom.operators.views import overlap_join

MATCH_TYPES = ("exact", "synonym", "stem")
PART = ["document_id", "part_id"]
SEGMENT = ["document_id", "part_id", "seg_ix"]


def check_registry(groups: DataFrame) -> None:
    """Raise for a registry that cannot be compiled: repeated canonical, blank form, form with a line break, unknown stemmer."""
    rows = groups.select("canonical", "synonyms", "stemming")
    if not rows.groupBy("canonical").count().where("count > 1").isEmpty():
        raise ValueError("a canonical form is stated twice")
    forms = rows.select(F.explode(F.concat(F.array("canonical"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("form"))
    if not forms.where(F.col("form").isNull() | (F.size(T.token_words(F.col("form"))) == 0) | F.col("form").contains("\n")).isEmpty():
        raise ValueError("a form is blank or holds a line break")
    for (name,) in rows.where("stemming is not null").select("stemming").distinct().collect():
        stemmer(name)


def registry_hash(groups: list[dict]) -> str:
    """The hash of a registry, whatever the order of its groups and synonyms."""
    rows = [{"canonical": g["canonical"], "synonyms": sorted(g.get("synonyms") or []), "stemming": g.get("stemming"), "rules": g.get("rules") or {}, "tags": g.get("tags") or {}} for g in groups]
    return sha256_json(sorted(rows, key=lambda g: g["canonical"]))


def compile_forms(groups: DataFrame) -> DataFrame:
    """``groups(group_key, canonical, synonyms, stemming)`` as forms: group, type, rank, reading, stemmer, tokens."""
    none = F.lit(None).cast("string")
    base = groups.select("group_key", F.col("canonical").alias("form"), F.lit("exact").alias("match_type"), none.alias("algorithm"))
    syn = groups.select("group_key", F.explode("synonyms").alias("form"), F.lit("synonym").alias("match_type"), none.alias("algorithm"))
    stems = groups.where(F.col("stemming").isin(*STEMMERS)).select("group_key", F.col("canonical").alias("form"), F.lit("stem").alias("match_type"), F.col("stemming").alias("algorithm"))
    all_ = base.unionByName(syn).unionByName(stems).where("form is not null")
    read = None
    for reading in T.READINGS:
        one = all_.withColumn("reading", F.lit(reading)).withColumn("tokens", T.token_words(F.col("form"), reading))
        read = one if read is None else read.unionByName(one)
    for name in STEMMERS:
        read = read.withColumn("tokens", F.when(F.col("algorithm") == name, stem_tokens(F.col("tokens"), name)).otherwise(F.col("tokens")))
    rank = F.array_position(F.array(*map(F.lit, MATCH_TYPES)), F.col("match_type")).cast("int")
    return read.where("size(tokens) > 0").select("group_key", "match_type", rank.alias("rank"), "reading", F.coalesce("algorithm", F.lit("")).alias("algorithm"), "tokens", F.col("tokens")[0].alias("first"), F.size("tokens").alias("width")).distinct()


def lines_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts(document_id, part_id, ..., text)`` as lines (seg_ix, base, line): no match crosses a line end."""
    return texts.withColumn("__s", T.segments(F.col(text))).select(*[c for c in texts.columns if c != text], F.posexplode("__s").alias("seg_ix", "__x")).select("*", F.col("__x.base").alias("base"), F.col("__x.line").alias("line")).drop("__x").where("line <> ''")


def candidates(segments: DataFrame, forms: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """Every place a form matches: (keys, group_key, start, end, rank) in offsets of the line.

    Words are exploded alone and meet forms on the first one; only where that holds are a line's tokens with their
    offsets worked out and the other words compared.
    """
    algorithms = [r[0] for r in forms.select("algorithm").distinct().collect()]  # at most the stemmers there are
    out = None
    for reading in T.READINGS:
        for algorithm in algorithms:
            read = lambda c, a=algorithm: stem_tokens(c, a) if a else c
            words = segments.select(*keys, "line", F.posexplode(read(T.token_words(F.col("line"), reading))).alias("i", "first"))
            f = forms.where((F.col("reading") == reading) & (F.col("algorithm") == algorithm)).select("group_key", "rank", "tokens", "first", "width")
            met = words.join(f, "first").withColumn("spans", F.slice(T.token_spans(F.col("line"), reading), F.col("i") + 1, F.col("width")))
            hit = met.withColumn("next", read(F.transform("spans", lambda x: x["t"]))).where("next = tokens").select(*keys, "group_key", F.col("spans")[0]["s"].alias("start"), F.expr("spans[width - 1].e").alias("end"), "rank")
            out = hit if out is None else out.unionByName(hit)
    return out


def resolve(found: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """The matches that stand: longest, leftmost, lowest rank first, no overlap within a group."""
    ranked = found.groupBy(*keys, "group_key", "start", "end").agg(F.min("rank").alias("rank"))
    order = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("n"), F.col("start").alias("s"), "rank", F.col("end").alias("e"))))
    taken = F.array().cast("array<struct<n:int,s:int,rank:int,e:int>>")
    fold = lambda acc, x: F.when(F.forall(acc, lambda t: (x["e"] <= t["s"]) | (x["s"] >= t["e"])), F.array_append(acc, x)).otherwise(acc)
    kept = ranked.groupBy(*keys, "group_key").agg(order.alias("o")).select(*keys, "group_key", F.explode(F.aggregate("o", taken, fold)).alias("m"))
    kind = F.element_at(F.array(*map(F.lit, MATCH_TYPES)), F.col("m.rank"))
    return kept.select(*keys, "group_key", F.col("m.s").alias("start"), F.col("m.e").alias("end"), kind.alias("match_type"), F.col("m.rank").alias("rank"))


def match_lines(segments: DataFrame, forms: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    return resolve(candidates(segments, forms, keys), keys)


def match_texts(texts: DataFrame, forms: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Matches of whole texts (document_id, part_id, text) in offsets of the text."""
    lines = lines_of(texts)
    hits = match_lines(lines, forms, [*SEGMENT, "base", *extra])
    return hits.select(*SEGMENT, *extra, "group_key", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "match_type", "rank")


def cross_line_misses(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """Matches that only exist when line ends are read as blanks; a report, never hits."""
    flat = texts.select("document_id", "part_id", F.lit(0).alias("seg_ix"), F.translate("text", "\n", " ").alias("line"), F.col("text").alias("raw"))
    loose = match_lines(flat.select(*SEGMENT, "line"), forms).join(flat.select("document_id", "part_id", "raw"), PART)
    broken = loose.where(F.substring("raw", F.col("start") + 1, F.col("end") - F.col("start")).contains("\n"))
    strict = match_texts(texts, forms).select(*PART, "group_key", "start", "end")
    return broken.join(strict, [*PART, "group_key", "start", "end"], "left_anti").select(*PART, "group_key", "start", "end", "match_type")


def merge_views(hits: DataFrame) -> DataFrame:
    """One hit a (group, node, stream spans): the views it is in, their spans and the strongest type.

    ``hits(document_id, node_id, group_key, spans, view, view_start, view_end, rank, ord)``.
    """
    merged = hits.groupBy("document_id", "group_key", "node_id", "spans").agg(F.array_sort(F.collect_set("view")).alias("present_in"), F.array_sort(F.collect_set(F.struct("view", "view_start", "view_end"))).alias("view_spans"), F.min("rank").alias("rank"), F.min("ord").alias("hit_ord"))
    return merged.withColumn("match_type", F.element_at(F.array(*map(F.lit, MATCH_TYPES)), F.col("rank")))


def move_group(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost move every run under a hit shares, or null: ``hits(..., hit_id, start, end)``, ``spans(..., stack, moves map)``."""
    inner = F.try_element_at(F.filter("stack", lambda r: F.split_part(r, F.lit(":"), F.lit(1)).isin("moveFrom", "moveTo")), F.lit(-1))
    runs = spans.withColumn("__g", F.try_element_at(F.col("moves"), inner)).select(*PART, "start_off", "end_off", "__g")
    met = overlap_join(hits, runs, PART, "start", "end", "start_off", "end_off")
    one = met.groupBy("hit_id").agg(F.count_distinct("__g").alias("n"), F.count(F.lit(1)).alias("all"), F.count("__g").alias("some"), F.min("__g").alias("g"))
    return hits.join(one, "hit_id", "left").withColumn("move_group_id", F.when((F.col("n") == 1) & (F.col("all") == F.col("some")), F.col("g"))).drop("n", "all", "some", "g")


def fold_moves(hits: DataFrame) -> DataFrame:
    """Both ends of a move as one: ``hits(document_id, group_key, move_group_id, norm_text, present_in, hit_ord)``.

    The n-th hit of a text at one end pairs with the n-th at the other; the first in order is kept.
    """
    own = Window.partitionBy("document_id", "group_key", "move_group_id", "norm_text", "present_in").orderBy("hit_ord")
    both = Window.partitionBy("document_id", "group_key", "move_group_id", "norm_text", "__nth").orderBy("hit_ord")
    moved = hits.where("move_group_id is not null").withColumn("__nth", F.row_number().over(own)).withColumn("__k", F.row_number().over(both))
    ends = Window.partitionBy("document_id", "group_key", "move_group_id", "norm_text", "__nth")
    moved = moved.withColumn("n_ends", F.count(F.lit(1)).over(ends)).where("__k = 1").drop("__nth", "__k")
    return moved.unionByName(hits.where("move_group_id is null").withColumn("n_ends", F.lit(1).cast("long")))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Drop a hit that shares a view span with one kept before it: ``hits(document_id, group_key, hit_ord, view_spans)``.

    Order decides, so the hits of one document and group are folded in order; a hit without view spans always stays.
    """
    one = F.struct("hit_ord", "view_spans")
    rows = hits.groupBy("document_id", "group_key").agg(F.array_sort(F.collect_list(one)).alias("h"))
    kind = rows.schema["h"].dataType.simpleString()
    start = F.array().cast(kind)
    kept = F.aggregate("h", start, lambda acc, x: F.when(F.exists(acc, lambda k: F.arrays_overlap(k["view_spans"], x["view_spans"])), acc).otherwise(F.array_append(acc, x)))
    order = rows.select("document_id", "group_key", F.explode(kept).alias("k")).select("document_id", "group_key", "k.hit_ord")
    return hits.join(order, ["document_id", "group_key", "hit_ord"], "left_semi")


def resolve_group(forms: DataFrame, query: str) -> int | None:
    """The one group that has a form reading like ``query``; None if none has, an error if several have."""
    spark = forms.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(T.token_words(F.col("q")).alias("tokens"))
    keys = [r[0] for r in forms.where("algorithm = '' and reading = 'joined'").join(F.broadcast(asked), "tokens").select("group_key").distinct().limit(3).collect()]
    if len(keys) > 1:
        raise ValueError(f"{query!r} names several groups: {sorted(keys)}")
    return keys[0] if keys else None


def pick_term_list(registries: DataFrame, wanted: str | None = None) -> str:
    """The named term list, or the only one stored."""
    known = [r[0] for r in registries.select("term_list_hash").distinct().limit(100).collect()]
    if wanted is not None:
        if registries.where(F.col("term_list_hash") == wanted).isEmpty():
            raise ValueError(f"no term list {wanted!r} is stored")
        return wanted
    if len(known) != 1:
        raise ValueError(f"{len(known)} term lists are stored; name one")
    return known[0]


def hit_location(part_kind: Column, in_cell: Column, fragment: Column) -> Column:
    """textbox, table_cell or the kind of the part a hit stands in."""
    return F.when(fragment.isNotNull(), "textbox").when(in_cell, "table_cell").otherwise(part_kind)
