"""Mixed timestamp notations to one instant.

Raw strings are collapsed to a dictionary of distinct (source, zone, raw) values, each value is parsed once, the
dictionary is kept as a table that later runs only add to, and the instants are joined back to the rows.  Parsing stays
in JVM expressions.

Defined results
* null or blank text, text without a real date and a time of day, or without a known zone: null instant.
* a zone in the text wins over the zone column; an offset wins over a bracketed zone name after it; an unknown zone in
  the text gives null and is not replaced by the zone column.
* an unknown zone column counts as none.
* two instants for one wall time: the earlier; a skipped wall time takes the offset before the jump.
* seconds missing: zero; digits beyond microseconds are cut; ``24:00``, minute or second 60 are no times of day.
* bare numbers need nine digits or more: below 1e11 seconds, below 1e14 milliseconds, below 1e17 microseconds.
* repeated rows stay repeated; columns of the input are kept whatever their names are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.operators.skew import skew_join
from redloom.session import path_exists, scratch, write_table

#: Part of a kept dictionary's path: entries made by other rules are never mixed in.
PARSER_VERSION = 1

#: Fixed offsets, in minutes, of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(.*)$"
#: Notation and where year, month, day, hour, minute, second, fraction and the rest stand in it.
NOTATIONS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s*[Tt]\s*|\s+)" + _TIME, "$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*(.*)$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(?:[A-Za-z]{3,9}\.?,? +)?(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4}),?(?: at)? " + _TIME, "$3|$2|$1|$4|$5|$6|$7|$8"),
    (r"^(?:[A-Za-z]{3,9}\.?, +)?([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4}),?(?: at)? " + _TIME, "$3|$1|$2|$4|$5|$6|$7|$8"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? " + _TIME, "$3|$1|$2|$4|$5|$6|$7|$8"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2}),? " + _TIME, "$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),? " + _TIME, "$3|$2|$1|$4|$5|$6|$7|$8"),
)


def known_zones(spark: SparkSession) -> list[str]:
    """Names the JVM can convert; about 600."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if not z.startswith("SystemV"))


def _case(pairs, default=None) -> Column:
    out = reduce(lambda acc, p: acc.when(p[0], p[1]), pairs[1:], F.when(*pairs[0]))
    return out if default is None else out.otherwise(default)


def parse_instants(df: DataFrame, raw: str, zone: str, out: str) -> DataFrame:
    """``df`` with ``out``: microseconds since 1970 UTC of the text in ``raw``, or null."""
    zones = known_zones(df.sparkSession)
    blank = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
    text = F.trim(F.regexp_replace(F.translate(F.col(raw), "−‐‑‒–", "-----"), blank, " "))
    # ``text`` is named by a projection first, so that it is computed once
    df = df.withColumn("__t", text)
    t = F.col("__t")
    df = df.withColumn("__p", F.split(_case([(t.rlike(p), F.regexp_replace(t, p, to)) for p, to in NOTATIONS]), r"\|", 8))
    part = lambda i: F.col("__p")[i]
    number = lambda c: F.when(c != "", c.try_cast("int"))
    month = part(1)
    df = df.withColumns({
        "__y": number(part(0)),
        "__mo": F.when(month.rlike(r"^\d+$"), month.try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(month, 1, 3))).cast("int")),
        "__d": number(part(2)), "__h": number(part(3)), "__mi": number(part(4)), "__s": F.coalesce(number(part(5)), F.lit(0)),
        "__us": F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("int"),
        "__half": F.lower(F.regexp_extract(part(7), r"^([AaPp])\.?[Mm]\.?(?![A-Za-z])", 1)),
        "__z": F.trim(F.regexp_replace(part(7), r"^[AaPp]\.?[Mm]\.?(?![A-Za-z])", "")),
    })
    h, half, z = F.col("__h"), F.col("__half"), F.col("__z")
    hour = F.when(half == "", F.when(h <= 23, h)).when((h >= 1) & (h <= 12), F.pmod(h, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    month_ok = F.col("__mo").between(1, 12) & F.col("__y").between(1, 9999)
    first = F.when(month_ok, F.make_date("__y", "__mo", F.lit(1)))
    day = F.when(F.col("__d").between(1, 31) & (F.col("__d") <= F.dayofmonth(F.last_day(first))), F.date_add(first, F.col("__d") - 1))
    clock_ok = (F.col("__mi") <= 59) & (F.col("__s") <= 59)
    seconds = F.unix_date(day).cast("long") * 86400 + hour * 3600 + F.col("__mi") * 60 + F.col("__s")
    offset = r"^(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?(?: ?[\[(].*[\])])?$"
    df = df.withColumns({
        "__local": F.when(clock_ok, seconds * 1_000_000 + F.coalesce(F.when(part(6) != "", F.col("__us")), F.lit(0))),
        "__oh": F.when(z.rlike(offset), F.regexp_extract(z, offset, 2).cast("int")),
        "__om": F.when(z.rlike(offset), F.coalesce(number(F.regexp_extract(z, offset, 3)), F.lit(0))),
        "__named": F.when(z == "", F.col(zone)).otherwise(F.regexp_replace(z, r"^\[(.*)\]$", "$1")),
    })
    minutes = _case([
        (F.col("__oh").isNotNull() & (F.col("__oh") <= 18) & (F.col("__om") <= 59), (F.col("__oh") * 60 + F.col("__om")) * F.when(F.substring(F.regexp_extract(z, offset, 1), 1, 1) == "-", -1).otherwise(1)),
        (z != "", F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.regexp_replace(F.upper(z), r"^Z ?\[.*\]$", "Z"))),
    ])
    local = F.col("__local")
    named = F.when(F.col("__named").isin(zones), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("__named"))))
    digits = F.when(t.rlike(r"^\d{9,17}$"), t.cast("long"))
    bare = _case([(digits < 10**11, digits * 1_000_000), (digits < 10**14, digits * 1000), (digits < 10**17, digits)])
    df = df.withColumn("__minutes", minutes)
    done = F.when(local.isNotNull(), F.coalesce(local - F.col("__minutes").cast("long") * 60_000_000, F.when(F.col("__oh").isNull(), named))).otherwise(bare)
    return df.withColumn(out, done.cast("long")).drop("__t", "__p", "__y", "__mo", "__d", "__h", "__mi", "__s", "__us", "__half", "__z", "__local", "__oh", "__om", "__named", "__minutes")


def grow_dictionary(values: DataFrame, path: str) -> DataFrame:
    """Add the values of ``values(__src, __zone, __raw)`` that the table at ``path`` lacks, and read it whole."""
    spark = values.sparkSession
    keys = ["__src", "__zone", "__raw"]
    fresh = values.select(*keys).where(F.col("__raw").isNotNull()).distinct()
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    write_table(parse_instants(fresh, "__raw", "__zone", "__utc_us"), path, "append")
    # runs that started together may have added the same value; its instant is the same
    return spark.read.parquet(path).groupBy(*keys).agg(F.max("__utc_us").alias("__utc_us"))


def normalise_timestamps(df: DataFrame, raw: str, zone: str, source: Column | str, *, spread: str, out: str = "utc_us", dictionary: str | None = None) -> DataFrame:
    """``df`` with the instant of ``raw`` in ``out`` (bigint, microseconds since 1970 UTC).

    ``dictionary`` is the path of the kept value table, shared by runs; without it one is made for this call.
    ``spread`` names a column that differs between rows; it splits values that a large share of the rows have.
    """
    spark = df.sparkSession
    src = F.lit(source) if isinstance(source, str) else source
    # an absent zone is the empty string, so that the key has no nulls
    rows = df.withColumns({"__src": src, "__zone": F.coalesce(F.col(zone), F.lit("")), "__raw": F.col(raw)})
    path = dictionary and f"{dictionary.rstrip('/')}/v{PARSER_VERSION}" or scratch(spark, "instants")
    known = grow_dictionary(rows, path)
    stated = skew_join(rows.where(F.col("__raw").isNotNull()), known, ["__src", "__zone", "__raw"], "left", spread=F.col(spread))
    blank = rows.where(F.col("__raw").isNull()).withColumn("__utc_us", F.lit(None).cast("long"))
    both = stated.select(*[F.col(f"`{c}`") for c in df.columns if c != out], "__utc_us").unionByName(blank.select(*[F.col(f"`{c}`") for c in df.columns if c != out], "__utc_us"))
    return both.withColumnRenamed("__utc_us", out)
