"""Parent-child links to nested-set hierarchies.

Subtree sizes are computed upward, sibling ranges are allocated downward by prefix sums, and a record's descendants are
the records whose ``pre`` lies inside its ``[pre, pre_end)`` in the same tree.

Both passes double the way they look in each round, so a tree of depth d takes about log2(d) rounds of joins, whatever
its size: after round k a record knows its ancestor 2^k steps up and how much lies less than 2^k steps below it.  Only
records with children take part; the others are one step below one of them.  Siblings are ordered by key; their prefix
sums are taken over ranges of (scope, parent, key), so no parent's children have to meet in one task.  A record that finds
itself the smallest on its own way up lies on a loop and is that loop's root.

Defined results
* a record without a parent, or whose parent is not in its scope: a top, ``depth`` 0, ``root_key`` its own key.
* a record on a loop or below one: ``depth`` -1, ``root_key`` the smallest key on that loop, ``pre`` and ``pre_end`` -1; a
  record naming itself is a loop.
* a child listed more than once: the smallest parent key counts.  Repeated keys: one row each.
* empty input: no rows, same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from redloom.operators.skew import skew_join
from redloom.session import discard, staged

#: Places of a block of ranges, as many times those of the next smaller one.
BASE = 16
COLUMNS = ["scope", "node_key", "parent_key", "root_key", "depth", "pre", "pre_end"]
_KEY = ["scope", "node_key"]


def _upward(parents: DataFrame) -> DataFrame:
    """Root, depth and number of descendants of ``parents(scope, node_key, parent_key, kids)``, the records with children.

    Gives (scope, node_key, anc, dist, below, loop): the root, the steps to it, the descendants, and whether a loop is its
    root.  ``low`` is the smallest key on the way up so far; ``found`` marks the roots of loops in the round they were found.
    """
    own = F.coalesce(F.col("parent_key") == F.col("node_key"), F.lit(False))
    at_end = own | F.col("parent_key").isNull()
    first = parents.select(*_KEY, F.when(at_end, F.col("node_key")).otherwise(F.col("parent_key")).alias("anc"), F.when(at_end, 0).otherwise(1).cast("long").alias("dist"), F.col("kids").alias("below"), F.coalesce("parent_key", "node_key").alias("low"), at_end.alias("end"), own.alias("loop"), F.lit(False).alias("found"))
    state, step = None, 1
    while True:
        seen = Observation()
        new = staged((first if state is None else later).observe(seen, F.count_if(~F.col("end")).alias("open"), F.count_if("found").alias("found")), "forest-up")
        if state is not None:
            discard(state)
            step *= 2
        state = new
        if not seen.get["open"]:
            return state.select(*_KEY, "anc", "dist", "below", "loop")
        told = state.where((F.col("dist") == step) & ~F.col("loop")).groupBy("scope", F.col("anc").alias("node_key")).agg(F.sum("below").alias("__more"))
        ahead = state.select("scope", F.col("node_key").alias("anc"), F.col("anc").alias("__anc"), F.col("dist").alias("__dist"), F.col("low").alias("__low"), F.col("end").alias("__end"), F.col("loop").alias("__loop"))
        # adaptive execution splits the rows of a record that is ahead of many
        going = state.where("not end").join(ahead, ["scope", "anc"], "left")
        # an ancestor that is not there: a parent outside the scope
        lost, low = F.col("__anc").isNull(), F.least("low", "__low")
        looped = ~lost & ~F.col("__end") & (low == F.col("node_key"))
        stays = lost | looped
        going = going.select(*_KEY, F.when(stays, F.col("node_key")).otherwise(F.col("__anc")).alias("anc"), F.when(stays, 0).otherwise(F.col("dist") + F.col("__dist")).alias("dist"), "below", low.alias("low"), (stays | F.col("__end")).alias("end"), (looped | (~lost & F.col("__end") & F.col("__loop"))).alias("loop"), looped.alias("found"))
        if seen.get["found"]:
            # the others of a loop have its smallest key on their way
            roots = state.where("found").select("scope", F.col("node_key").alias("low"), F.lit(True).alias("__root"))
            here = F.col("__root").isNotNull() & ~F.col("end")
            going = going.join(roots, ["scope", "low"], "left").select(*_KEY, F.when(here, F.col("low")).otherwise(F.col("anc")).alias("anc"), "dist", "below", "low", (here | F.col("end")).alias("end"), (here | F.col("loop")).alias("loop"), "found")
        both = going.unionByName(state.where("end").withColumn("found", F.lit(False))).join(told, _KEY, "left")
        later = both.select(*_KEY, "anc", "dist", (F.col("below") + F.coalesce("__more", F.lit(0))).alias("below"), "low", "end", "loop", "found")


def _downward(parents: DataFrame) -> DataFrame:
    """The sum of the offsets from the top down to each record: ``parents(scope, node_key, up, offset)``, ``up`` null at a top."""
    top = F.col("up").isNull()
    later = parents.select(*_KEY, F.coalesce("up", "node_key").alias("anc"), F.when(top, 0).otherwise(F.col("offset")).cast("long").alias("pre"), top.alias("end"))
    state = None
    while True:
        seen = Observation()
        new = staged(later.observe(seen, F.count_if(~F.col("end")).alias("open")), "forest-down")
        if state is not None:
            discard(state)
        state = new
        if not seen.get["open"]:
            return state.select(*_KEY, "pre")
        ahead = state.select("scope", F.col("node_key").alias("anc"), F.col("anc").alias("__anc"), F.col("pre").alias("__pre"), F.col("end").alias("__end"))
        going = state.where("not end").join(ahead, ["scope", "anc"]).select(*_KEY, F.col("__anc").alias("anc"), (F.col("pre") + F.col("__pre")).alias("pre"), F.col("__end").alias("end"))
        later = going.unionByName(state.where("end"))


def _offsets(children: DataFrame) -> DataFrame:
    """``children(scope, parent_key, node_key, size, ...)`` with ``offset``: 1 more than the sizes of the siblings of smaller keys."""
    ranged = children.repartitionByRange("scope", "parent_key", "node_key").withColumn("__part", F.spark_partition_id())
    ranged = staged(ranged, "forest-sized")
    group = ["scope", "parent_key", "__part"]
    within = Window.partitionBy(*group).orderBy("node_key").rowsBetween(Window.unboundedPreceding, 0)
    between = Window.partitionBy("scope", "parent_key").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*group).agg(F.sum("size").alias("__t"))
    # only the first parent of a range may have children in ranges before: no more rows than ranges
    earlier = totals.withColumn("__before", F.sum("__t").over(between) - F.col("__t")).where("__before > 0").drop("__t")
    own = ranged.withColumn("__own", F.sum("size").over(within) - F.col("size"))
    return own.join(F.broadcast(earlier), group, "left").withColumn("offset", F.col("__own") + F.coalesce("__before", F.lit(0)) + 1).drop("__own", "__before", "__part")


def build_hierarchy(links: DataFrame) -> DataFrame:
    """``links(scope, node_key bigint, parent_key bigint)`` with root, depth and nested-set range of each record.

    Where keys are unique beyond their scope, a hash of the scope will do for it: two scopes of one hash only share a task.
    """
    links = links.select("scope", F.col("node_key").cast("long"), F.col("parent_key").cast("long"))
    links = staged(links.groupBy(*_KEY).agg(F.min("parent_key").alias("parent_key")), "links")
    kids = links.where("parent_key is not null").groupBy("scope", F.col("parent_key").alias("node_key")).agg(F.count(F.lit(1)).alias("kids"))
    up = _upward(links.join(kids, _KEY))
    sized = links.join(up.select(*_KEY, "below", F.lit(True).alias("inner")), _KEY, "left").select(*_KEY, "parent_key", (F.coalesce("below", F.lit(0)) + 1).alias("size"), F.coalesce("inner", F.lit(False)).alias("inner"))
    children = staged(_offsets(sized.where("parent_key is not null")), "forest-placed")
    # offsets of the records with children, none for tops
    placed = children.where("inner").select(*_KEY, F.col("parent_key").alias("up"), "offset")
    sound = up.where("not loop").join(placed, _KEY, "left").select(*_KEY, F.when(F.col("dist") > 0, F.col("up")).alias("up"), "offset")
    pre = _downward(sound)
    above = up.join(pre, _KEY, "left").select("scope", F.col("node_key").alias("parent_key"), F.col("anc").alias("root_key"), F.col("dist").alias("__dist"), "loop", F.col("pre").alias("__pre"))
    joined = skew_join(children.select("scope", "node_key", "parent_key", "size", "offset"), above, ["scope", "parent_key"], "left", spread=F.col("node_key"))
    lost, looped = F.col("root_key").isNull(), F.coalesce("loop", F.lit(False))
    begin = F.when(lost, 0).when(looped, -1).otherwise(F.col("__pre") + F.col("offset")).cast("long")
    below = joined.select(*_KEY, F.when(~lost, F.col("parent_key")).alias("parent_key"), F.coalesce("root_key", "node_key").alias("root_key"), F.when(lost, 0).when(looped, -1).otherwise(F.col("__dist") + 1).cast("int").alias("depth"), begin.alias("pre"), F.when(looped, -1).otherwise(begin + F.col("size")).cast("long").alias("pre_end"))
    tops = sized.where("parent_key is null").select(*_KEY, "parent_key", F.col("node_key").alias("root_key"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pre"), F.col("size").cast("long").alias("pre_end"))
    return below.unionByName(tops).select(*COLUMNS)


def child_links(nodes: DataFrame, scope: str, key: str, name: str, children: str, as_scope: Column | None = None) -> DataFrame:
    """Links of records that list the names of their children; names that no record of the scope has are dropped.

    ``as_scope`` is what the links carry for the scope.  Repeated rows give repeated links, which ``build_hierarchy`` joins.
    """
    own = nodes.select(F.col(scope).alias("__in"), (F.col(scope) if as_scope is None else as_scope).alias("scope"), F.col(key).alias("node_key"), F.col(name).alias("__name"))
    listed = nodes.select(F.col(scope).alias("__in"), F.explode(children).alias("__name"), F.col(key).alias("__parent")).groupBy("__in", "__name").agg(F.min("__parent").alias("parent_key"))
    return own.join(listed, ["__in", "__name"], "left").select("scope", "node_key", "parent_key")


def named_parent_links(rows: DataFrame, scope: str, key: str, name: str, parent: str, as_scope: Column | None = None) -> DataFrame:
    """Links of records that name their parent; of records with the same name the one with the smallest key is the parent."""
    own = rows.select(F.col(scope).alias("__in"), (F.col(scope) if as_scope is None else as_scope).alias("scope"), F.col(key).alias("node_key"), F.col(name).alias("__name"), F.col(parent).alias("__up"))
    named = own.where("__name is not null").groupBy("__in", F.col("__name").alias("__up")).agg(F.min("node_key").alias("parent_key"))
    linked = skew_join(own.where("__up is not null").select("__in", "scope", "node_key", "__up"), named, ["__in", "__up"], "left", spread=F.col("node_key")).select("scope", "node_key", "parent_key")
    return linked.unionByName(own.where("__up is null").select("scope", "node_key", F.lit(None).cast("long").alias("parent_key")))


def inside(points: DataFrame, ranges: DataFrame, most: int) -> DataFrame:
    """``points(scope, root_key, pre, ...)`` in ``ranges(scope, root_key, lo, hi, ...)``, each pair once; ``most`` is the highest end.

    A range is the fewest aligned blocks of 1, 16, 256, ... places, a point lies in one block of each size, and equal blocks
    meet: rows are formed for pairs that hold only, whatever the size of the tree.
    """
    top = 0
    while BASE ** (top + 1) <= most:
        top += 1
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(BASE**k).cast("long").alias("b")) for k in range(top + 1)]))
    at = points.withColumn("__l", levels).withColumn("__k", F.col("__l.k")).withColumn("__block", F.expr("pre div __l.b")).drop("__l")
    r = ranges.withColumn("__l", levels).withColumn("__k", F.col("__l.k"))
    r = r.withColumn("__c", F.expr("(lo + __l.b - 1) div __l.b")).withColumn("__d", F.expr("hi div __l.b")).where("__c < __d")
    # without the blocks that a larger one holds
    r = r.withColumn("__e", F.expr(f"(__c + {BASE - 1}) div {BASE} * {BASE}")).withColumn("__f", F.expr(f"__d div {BASE} * {BASE}"))
    run = lambda x, y: F.when(F.col(x) < F.col(y), F.sequence(F.col(x), F.col(y) - 1)).otherwise(F.array().cast("array<bigint>"))
    blocks = F.when((F.col("__e") < F.col("__f")) & (F.col("__k") < top), F.concat(run("__c", "__e"), run("__f", "__d"))).otherwise(run("__c", "__d"))
    r = r.withColumn("__block", F.explode(blocks)).drop("__l", "__c", "__d", "__e", "__f", "lo", "hi")
    return at.join(r, ["scope", "root_key", "__k", "__block"]).drop("__k", "__block")


def _most(forest: DataFrame) -> int:
    return forest.agg(F.max("pre_end")).first()[0] or 1


def paths(forest: DataFrame) -> DataFrame:
    """Every record of a sound tree with the keys from its root down to it, found by nested-set ranges; ``forest`` is read several times."""
    a = forest.where("depth >= 0").select("scope", "root_key", F.col("node_key").alias("a_key"), F.col("pre").alias("lo"), F.col("pre_end").alias("hi"), F.col("depth").alias("a_depth"))
    d = forest.where("depth >= 0").select("scope", "root_key", "node_key", "pre", "depth")
    return inside(d, a, _most(forest)).groupBy("scope", "root_key", "node_key", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("a_depth", "a_key"))), lambda x: x["a_key"]).alias("path"))


def descendants(forest: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The descendants of the records ``of(scope, node_key)``, or of all, by nested-set ranges: (scope, node_key, descendant_key)."""
    a = forest.where("depth >= 0 and pre_end > pre + 1")
    if of is not None:
        a = a.join(of.select("scope", "node_key").distinct(), ["scope", "node_key"], "left_semi")
    a = a.select("scope", "root_key", "node_key", (F.col("pre") + 1).alias("lo"), F.col("pre_end").alias("hi"))
    d = forest.where("depth > 0").select("scope", "root_key", F.col("node_key").alias("descendant_key"), "pre")
    return inside(d, a, _most(forest)).select("scope", "node_key", "descendant_key")


def ancestors_among(forest: DataFrame, some: DataFrame) -> DataFrame:
    """(scope, node_key, ancestor_key, ancestor_depth): the proper ancestors of each record that are in ``some(scope, node_key)``, by nested-set ranges."""
    a = forest.where("depth >= 0 and pre_end > pre + 1").join(some.select("scope", "node_key").distinct(), ["scope", "node_key"], "left_semi")
    a = a.select("scope", "root_key", F.col("node_key").alias("ancestor_key"), F.col("depth").alias("ancestor_depth"), (F.col("pre") + 1).alias("lo"), F.col("pre_end").alias("hi"))
    d = forest.where("depth > 0").select("scope", "root_key", "node_key", "pre")
    return inside(d, a, _most(forest)).select("scope", "node_key", "ancestor_key", "ancestor_depth")


def ancestor_of_kind(forest: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """(scope, node_key, ancestor_key): the nearest proper ancestor of that kind, of ``kinds(scope, node_key, kind)``; records without one have no row."""
    met = ancestors_among(forest, kinds.where(F.col("kind") == kind))
    return met.groupBy("scope", "node_key").agg(F.max_by("ancestor_key", "ancestor_depth").alias("ancestor_key"))
