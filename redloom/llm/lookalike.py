"""Visually identical text brought to one form by SQL that runs inside the partitions.

Each Arrow batch is handed to an embedded DuckDB, whose ``nfc_normalize``, ``translate`` and ``regexp_replace`` map
compatibility forms, invisible characters, blanks and look-alike letters; the text never becomes Python strings.

Defined results
* null text: null.  Text of nothing but invisible characters: the empty string.
* one blank of any width is one plain blank; line breaks stay; runs of blanks are not joined (``words`` ignores them).
* accents, visible punctuation and letter case are kept; the hyphens U+2010 and U+2011 are drawn like the plain one.
* composed and combining accents come out composed.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redloom.session import staged

#: Letters of other scripts drawn like Latin ones: (those, Latin).
LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТҮХ", "ABESIJKMHOPCTYX"),  # Cyrillic capitals
    ("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("ονϲϳ", "ovcj"),  # Greek small letters
    ("ɑɡı", "agi"),  # Latin letters of other shape
    ("ՕոսԼ", "OnuL"),  # Armenian
    ("‐‑", "--"),  # hyphens
)


def _compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form is another one (single, several), without blanks, fractions and raised digits."""
    single, several = {}, {}
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.decomposition(c).split(" ")[0]
        wide = kind in ("<wide>", "<narrow>", "<font>", "<compat>") or code in (0x212A, 0x212B)
        if not wide or unicodedata.category(c) == "Zs" or kind == "<compat>" and not 0xFB00 <= code <= 0xFB06:
            continue
        to = unicodedata.normalize("NFKC", c)
        if len(to) == 1:
            single[c] = to
        elif to and len(to) <= 3:
            several[c] = to
    return single, several


_SINGLE, _SEVERAL = _compatibility()
_FROM = "".join(a for a, _ in LOOKALIKES) + "".join(_SINGLE)
_TO = "".join(b for _, b in LOOKALIKES) + "".join(_SINGLE.values())
_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
#: Blanks of any width; tabs count, line breaks do not.
_BLANK = r"[\t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normal_sql(column: str) -> str:
    """The SQL expression of the one form of ``column``."""
    text = f"regexp_replace({column}, '{_INVISIBLE}', '', 'g')"
    for c, to in _SEVERAL.items():
        if c in "ﬀﬁﬂﬃﬄﬅﬆ":
            text = f"replace({text}, '{c}', '{to}')"
    # accents compose with the letter they look to stand on, so look-alikes are mapped first
    text = f"nfc_normalize(translate(nfc_normalize({text}), {_quoted(_FROM)}, {_quoted(_TO)}))"
    text = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    plain = f"regexp_replace({text}, '{_BLANK}', ' ', 'g')"
    # plain ASCII needs no mapping: most text
    return f"CASE WHEN {column} IS NULL THEN NULL WHEN regexp_full_match({column}, '[\\x0A\\x20-\\x7E]*') THEN {column} ELSE {plain} END"


def _batches(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for batch in batches:
            chunk = pa.Table.from_batches([batch])  # noqa: F841
            con.register("chunk", chunk)
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("chunk")

    return run


def normalise_text(df: DataFrame, column: str, out: str = "plain") -> DataFrame:
    """``df`` with the one form of ``column`` in ``out``.  Columns keep their names and order; ``out`` may not exist yet."""
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(column)
    sql = f"SELECT *, {normal_sql(f'c{at}')} AS plain FROM chunk"
    schema = renamed.select("*", F.lit("").cast("string").alias("plain")).schema
    for f in schema:
        f.nullable = True
    return renamed.mapInArrow(_batches(sql), schema).toDF(*names, out)


def same_look_pairs(df: DataFrame, key: str, column: str, plain: str) -> DataFrame:
    """(key_a, key_b) of texts that look the same but differ in characters.

    Equal texts are joined as one class first, so copies only meet when the pairs of differing classes are written out.
    """
    d = df.where(F.col(plain).isNotNull()).select(F.col(key).alias("key"), F.col(plain).alias("plain"), F.col(column).alias("raw"))
    classes = d.groupBy("plain", "raw").agg(F.min("key").alias("class"))
    several = classes.groupBy("plain").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("plain")
    classes = staged(classes.join(several, "plain"), "look-classes")
    pairs = classes.select("plain", F.col("class").alias("ca")).join(classes.select("plain", F.col("class").alias("cb")), "plain").where("ca < cb").select("ca", "cb")
    members = d.join(classes, ["plain", "raw"]).select("key", "class")
    both = pairs.join(members.toDF("a", "ca"), "ca").join(members.toDF("b", "cb"), "cb")
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def words(plain: Column) -> Column:
    """The words of a normal form: what stands between blanks and line breaks."""
    return F.filter(F.split(plain, r"[ \n]+"), lambda w: w != "")


def form_hits(texts: DataFrame, key: str, plain: str, forms: DataFrame) -> DataFrame:
    """(group_key, key) where a form of ``forms(group_key, form)`` (normal forms) is read in the text as whole words.

    Forms are met through their first word, then compared word by word; nothing is made for positions that no form
    starts at.  ``forms`` comes from a registry of fixed size; Spark broadcasts it only while it is under its threshold.
    """
    f = forms.select("group_key", words(F.col("form")).alias("fw")).where("size(fw) > 0").distinct()
    f = f.select("group_key", "fw", F.col("fw")[0].alias("first"), F.size("fw").alias("width"))
    t = texts.select(F.col(key).alias("key"), words(F.col(plain)).alias("w")).where("size(w) > 0")
    # as many following words as the longest form has
    longest = f.agg(F.max("width").alias("longest"))
    t = t.join(F.broadcast(longest))
    at = t.select("key", F.explode(F.expr("transform(w, (x, i) -> struct(x as first, slice(w, i + 1, longest) as next))")).alias("p")).select("key", "p.first", "p.next")
    return at.join(f, "first").where("slice(next, 1, width) = fw").select("group_key", "key").distinct()


def find_lookalikes(streams: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, key_a, key_b) over ``streams(stream_key, text)`` and ``groups(group_key, canonical, synonyms)``: see same_look_pairs and form_hits."""
    s = staged(normalise_text(streams.dropDuplicates(["stream_key"]), "text"), "streams-plain")
    forms = groups.select("group_key", F.explode(F.concat(F.array("canonical"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("form")).where("form is not null")
    g = staged(normalise_text(groups.select("group_key", "canonical").dropDuplicates(["group_key"]), "canonical"), "groups-plain")
    forms = staged(normalise_text(forms, "form").select("group_key", F.col("plain").alias("form")), "forms-plain")
    a = same_look_pairs(s, "stream_key", "text", "plain").select(F.lit("stream").alias("src"), "key_a", "key_b")
    b = same_look_pairs(g, "group_key", "canonical", "plain").select(F.lit("group").alias("src"), F.col("key_a").cast("long"), F.col("key_b").cast("long"))
    c = form_hits(s, "stream_key", "plain", forms).select(F.lit("hit").alias("src"), F.col("group_key").cast("long").alias("key_a"), F.col("key").alias("key_b"))
    return a.unionByName(b).unionByName(c)
