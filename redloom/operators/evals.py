"""Evaluation: facts against expectations, recall, costs, fingerprints and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redloom.functions.text import collapse
from redloom.session import staged

#: Fewer strict hits than this and a report is inconclusive.
LEAST_EVIDENCE = 20


def score_facts(facts: DataFrame) -> DataFrame:
    """``facts(family, document, what, want, got, stated)``: compared, failed and skipped by family; accuracy 0.0 when nothing is compared."""
    same = F.col("want").eqNullSafe(F.col("got"))
    rows = facts.groupBy("family").agg(F.count_if("stated").alias("n_compared"), F.count_if(F.col("stated") & ~same).alias("n_failed"), F.count_if(~F.col("stated")).alias("n_skipped"))
    return rows.withColumn("accuracy", F.when(F.col("n_compared") == 0, 0.0).otherwise((F.col("n_compared") - F.col("n_failed")) / F.col("n_compared")))


def examples(facts: DataFrame, most: int = 5) -> DataFrame:
    """The first failures of each family."""
    w = Window.partitionBy("family").orderBy("document", "what")
    return facts.where(F.col("stated") & ~F.col("want").eqNullSafe(F.col("got"))).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def tile_defects(spans: DataFrame, streams: DataFrame) -> DataFrame:
    """Where a part's spans leave a gap, overlap or miss its end: (document_id, part_id, at, expected)."""
    w = Window.partitionBy("document_id", "part_id").orderBy("start_off", "end_off")
    inner = spans.withColumn("expected", F.coalesce(F.lag("end_off").over(w), F.lit(0))).where("start_off <> expected").select("document_id", "part_id", F.col("start_off").alias("at"), "expected")
    ends = spans.groupBy("document_id", "part_id").agg(F.max("end_off").alias("at"))
    last = streams.select("document_id", "part_id", F.length("text").alias("expected")).join(ends, ["document_id", "part_id"], "left").withColumn("at", F.coalesce("at", F.lit(0))).where("at <> expected").select("document_id", "part_id", "at", "expected")
    return inner.unionByName(last)


def uncovered(spans: DataFrame, streams: DataFrame) -> DataFrame:
    """Stretches of a part's text in no node's span that hold more than line ends: (document_id, part_id, start_off, end_off)."""
    part = ["document_id", "part_id"]
    ends = streams.select(*part, F.length("text").alias("start_off"), F.length("text").alias("end_off"))
    before = Window.partitionBy(*part).orderBy("start_off", "end_off").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.select(*part, "start_off", "end_off").unionByName(ends).withColumn("from", F.coalesce(F.max("end_off").over(before), F.lit(0))).where("from < start_off")
    gaps = cut.join(streams.select(*part, "text"), part).withColumn("gap", F.expr("substring(text, from + 1, start_off - from)"))
    return gaps.where(F.translate("gap", "\n", "") != "").select(*part, F.col("from").alias("start_off"), F.col("start_off").alias("end_off"))


def table_shape(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table ``cells(document_id, table_id, row_ix, col_ix)``; a shorter row tells of a merge at its end."""
    rows = cells.groupBy("document_id", "table_id", "row_ix").agg((F.max("col_ix") + 1).alias("width"))
    w = Window.partitionBy("document_id", "table_id")
    wide = rows.withColumn("columns", F.max("width").over(w)).withColumn("rows", F.count(F.lit(1)).over(w))
    merges = F.array_sort(F.collect_list(F.when(F.col("width") < F.col("columns"), F.struct("row_ix", (F.col("width") - 1).alias("from_col"), (F.col("columns") - 1).alias("to_col")))))
    return wide.groupBy("document_id", "table_id").agg(F.first("rows").alias("n_rows"), F.first("columns").alias("n_columns"), merges.alias("merges"))


def recall(expected: DataFrame, found: DataFrame, by: list[str], term: str = "term") -> DataFrame:
    """Found of expected by ``by``, terms compared without regard to blanks and case; null where nothing is expected."""
    want = expected.select(*by, F.when(F.col(term).isNotNull(), collapse(F.col(term))).alias("t")).distinct()
    got = found.select(*by, collapse(F.col(term)).alias("t")).distinct().withColumn("hit", F.lit(1))
    rows = want.join(got, [*by, "t"], "left").groupBy(*by).agg(F.count("t").alias("n_expected"), F.count("hit").alias("n_found"))
    return rows.withColumn("recall", F.try_divide(F.col("n_found").cast("double"), F.col("n_expected")))


def total_recall(rows: DataFrame) -> DataFrame:
    """Found over expected of all rows together, not the mean of their ratios."""
    return rows.agg(F.sum("n_expected").alias("n_expected"), F.sum("n_found").alias("n_found"), F.try_divide(F.sum("n_found").cast("double"), F.sum("n_expected")).alias("recall"))


def unclassified(found: DataFrame, claimed: DataFrame, by: list[str], term: str = "term") -> DataFrame:
    """Distinct found terms nobody claimed."""
    return found.select(*by, collapse(F.col(term)).alias("t")).exceptAll(found.select(*by, collapse(F.col(term)).alias("t")).intersectAll(claimed.select(*by, collapse(F.col(term)).alias("t")))).distinct()


def grade_states(samples: DataFrame, grades: DataFrame, criteria: list[str]) -> DataFrame:
    """Each sample's state: ungraded, stale (graded under another prompt), partial or graded."""
    g = grades.select("document_id", "chunk_id", F.col("prompt_hash").alias("graded_hash"), "criteria")
    given = F.size(F.array_intersect(F.map_keys("criteria"), F.array(*map(F.lit, criteria))))
    state = F.when(F.col("criteria").isNull(), "ungraded").when(F.col("graded_hash") != F.col("prompt_hash"), "stale").when(given < len(criteria), "partial").otherwise("graded")
    return samples.join(g, ["document_id", "chunk_id"], "left").withColumn("state", state).drop("graded_hash", "criteria")


def even_sample(rows: DataFrame, order: list[str], n: int = 12) -> DataFrame:
    """``n`` rows evenly spread over the order, first and last among them; all rows if there are no more.

    Rows are numbered by their partition of the sorted table and their place in it, so no task holds all rows.
    """
    kept = staged(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "even-sample")
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    # one row a partition
    sizes = kept.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    begin = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = kept.count()
    wanted = range(total) if total <= n else sorted({int(round(i * (total - 1) / max(1, n - 1))) for i in range(n)})
    return kept.withColumn("__p", part).join(F.broadcast(begin), "__p").where((F.col("__b") + place).isin(list(wanted))).select(*rows.columns)


def cost(calls: DataFrame) -> DataFrame:
    """Calls, cache hits and tokens; tokens are null unless every call reports them."""
    made = F.col("cache") == "miss"
    tokens = lambda c: F.when(F.count_if(made) == F.count_if(made & F.col(c).isNotNull()), F.sum(F.when(made, F.col(c))))
    return calls.agg(F.count_if(made).alias("n_calls"), F.count_if(~made).alias("n_hits"), tokens("prompt_tokens").alias("prompt_tokens"), tokens("answer_tokens").alias("answer_tokens"))


def boundary_report(misses: DataFrame, n_strict: int) -> DataFrame:
    """Misses by the kind of boundary they cross, and whether the evidence is enough to act on."""
    rows = misses.groupBy("boundary").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("verdict", F.lit("inconclusive" if n_strict < LEAST_EVIDENCE else "reported"))


def fingerprint(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """A hash of each component's canonical lines, whatever their order: hashes are sorted, then hashed."""
    return rows.select(*by, F.sha2(line, 256).alias("h")).groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def ledger_changes(ledger: DataFrame, now: DataFrame) -> DataFrame:
    """Recorded fingerprints that no longer hold: a changed result under an unchanged version."""
    k = ["component", "version", "corpus"]
    return now.join(ledger.withColumnRenamed("fingerprint", "recorded"), k).where("fingerprint <> recorded")


def gate_failures(metrics: dict[str, float | None], gates: dict[str, float]) -> list[str]:
    """Gated metrics below their gate; one that could not be measured does not fail."""
    return [f"{k}: {metrics[k]} < {v}" for k, v in gates.items() if metrics.get(k) is not None and metrics[k] < v]
