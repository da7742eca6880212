"""Variant spellings of people's and organisations' names, linked by shared rewritings.

Every distinct spelling is rewritten by rules (token order, nicknames, initials, user names, legal forms, acronyms,
one-letter slips); the rewritings are exploded and equi-joined.  A rewriting scores by its rarity, 1 / (number of
entities it may stand for); only rewritings that stand for one entity link.

Two stages: spellings with a whole name form entities first (order, nickname, slip), then initials, user names and
acronyms join the one entity whose rewriting they are.  A slip joins two entities that are each written in several
ways only where one has at most 1 / ``SLIP_ROWS`` of the other's rows and no other such entity within one slip; it never
joins two known first names (Ned and Ted).

Defined results
* null, blank and placeholder names ("Author", "Unknown") link to nothing and are left out.
* an initial, user name or acronym that may stand for several entities stays on its own.
* case, accents, extra blanks, titles, "(Legal)"-like suffixes and hyphens inside a surname do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redloom.session import staged

#: A name written in several ways counts as a slip of one that has at least so many times its rows.
SLIP_ROWS = 4
PLACEHOLDERS = {"", "author", "unknown", "user", "admin", "administrator", "guest", "anonymous", "none", "n/a", "na", "reviewer", "owner", "editor", "tbd", "-"}
#: First names and the short forms people type for them.
NICKNAMES = {
    "alexander": "alex sasha sandy xander lex", "alexandra": "alex sasha sandra lexi", "amelie": "amy", "andrew": "andy drew", "anneliese": "anne anna liese lisa", "anthony": "tony", "benjamin": "ben benny benji",
    "catherine": "cathy kate katie", "charles": "charlie chuck", "christopher": "chris kit topher", "christine": "chris tina", "daniel": "dan danny", "david": "dave davy", "edward": "ed ned eddie", "elizabeth": "liz beth lizzie eliza betty bess",
    "francesca": "fran franny cesca", "francis": "frank fran", "frederick": "fred freddie freddy", "giuseppe": "beppe peppe pino", "gregory": "greg", "henry": "harry hank", "ignacio": "nacho iggy", "james": "jim jimmy jamie", "jonathan": "jon jonny john",
    "john": "jack johnny", "jose": "pepe chepe", "joseph": "joe joey", "josephine": "jo josie josy", "jurgen": "jurg", "katherine": "kathy kate katie kath kat kitty", "kenneth": "ken kenny", "leonard": "len lenny leo", "lucia": "lucy lu", "margaret": "maggie peg meg peggy marge greta",
    "marta": "marty", "matilda": "tilly mattie tilda", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky", "olav": "ole", "patricia": "pat trish patty tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "rob bob bobby robbie bert",
    "samuel": "sam sammy", "samantha": "sam", "stephen": "steve", "susannah": "sue susie suzie susan", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori vicki", "wilhelmina": "mina willa billie minna", "william": "will bill billy willy liam",
}
#: Words organisations' names are shortened by.
LEGAL_FORMS = {
    "intl": "international", "int'l": "international", "eng": "engineering", "engg": "engineering", "dept": "department", "dep": "department", "bd": "board", "assoc": "association", "assn": "association", "off": "office", "ofc": "office", "co": "company", "corp": "corporation", "ltd": "limited", "inc": "incorporated",
    "lab": "laboratory", "labs": "laboratories", "cttee": "committee", "cmte": "committee", "inst": "institute", "univ": "university", "govt": "government", "natl": "national", "mgmt": "management", "svcs": "services", "grp": "group", "comm": "commission", "auth": "authority", "admin": "administration",
}
ORG_WORDS = set(LEGAL_FORMS.values()) | {"council", "trust", "agency", "bureau", "centre", "center", "union", "society", "foundation", "partners", "ministry", "of", "the"}
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "sir", "dame", "rev", "herr", "frau"}
_FORMAL: dict[str, list[str]] = {}
for _given, _short in NICKNAMES.items():
    for _x in _short.split():
        _FORMAL.setdefault(_x, []).append(_given)
GIVEN = set(NICKNAMES) | set(_FORMAL)
_SPECIAL = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i", "’": "'"})


def fold(name: str) -> str:
    """Lower case without accents, look-alike blanks or repeated blanks."""
    text = unicodedata.normalize("NFKD", name.casefold().translate(_SPECIAL))
    return " ".join("".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").split())


def deletions(text: str) -> list[str]:
    """The text and all its forms without one letter; texts one slip apart share one."""
    return list(dict.fromkeys([text, *(text[:i] + text[i + 1 :] for i in range(len(text)))]))


def one_slip(a: str, b: str) -> bool:
    """Whether one letter added, dropped, changed or swapped with its neighbour turns ``a`` into ``b``."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) != len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _acronyms(tokens: list[str]) -> list[str]:
    tokens = [t for t in tokens if t not in ("of", "the", "and", "for")]
    whole = "".join(t[0] for t in tokens)
    return [f"a|{whole}", f"b|{tokens[0]}|{whole[1:]}"] if len(tokens) > 1 else []


def _organisation(tokens: list[str]) -> dict:
    tokens = [LEGAL_FORMS.get(t.rstrip("."), t.rstrip(".")) for t in tokens]
    if tokens[0] == "the" and len(tokens) > 1:
        tokens = tokens[1:]
    if "of" in tokens[1:-1]:  # "X Board of Works" is "X Works Board"
        at = tokens.index("of", 1)
        tokens = tokens[: at - 1] + tokens[at + 1 :] + [tokens[at - 1]]
    text = " ".join(tokens)
    return {"ident": f"o|{text}", "kind": "o", "forms": [], "slips": [f"o|{x}" for x in deletions(text)], "marks": _acronyms(tokens)}


def _person(given: str, surname: str, middle: str, other_order: bool) -> dict:
    surname = re.sub(r"[^\w]", "", surname)
    given = re.sub(r"[^\w]", "", given)
    if len(given) == 1:
        marks = [f"m|{given}|{middle}|{surname}"] if middle else []
        return {"ident": f"i|{given}|{surname}", "kind": "i", "forms": [], "slips": [f"i|{given}|{x}" for x in deletions(surname)], "marks": [*marks, f"i|{given}|{surname}"]}
    formal = _FORMAL.get(given, [])
    marks = []
    for g in dict.fromkeys([given, *formal]):
        marks.append(f"i|{g[0]}|{surname}")
        if middle:
            marks.append(f"m|{g[0]}|{middle}|{surname}")
    forms = [f"n|p|{g}|{surname}" for g in formal] + ([f"o|p|{surname}|{given}"] if other_order else [])
    return {"ident": f"p|{given}|{surname}", "kind": "p", "forms": forms, "slips": [f"p|{x}" for x in deletions(f"{given}|{surname}")], "marks": list(dict.fromkeys(marks))}


def rewrite(name: str) -> dict | None:
    """The identity a spelling states and its rewritings.

    ``ident`` p|given|surname, i|initial|surname, o|words or a|acronym; ``forms`` other identities it may state
    (n| by nickname, o| by order); ``slips`` its deletion forms; ``marks`` initials and acronyms that stand for it.
    """
    text = fold(name)
    text = re.sub(r"\s*[(\[][^)\]]*[)\]]\s*", " ", text).strip(" .;:_")
    plain = re.sub(r"\s*[(\[][^)\]]*[)\]]\s*", " ", name).strip()
    if text in PLACEHOLDERS or not re.search(r"\w", text):
        return None
    quoted = re.search(r"[\"“'‘](\w+)[\"”'’]", text)
    if quoted and quoted.start() > 0:
        text = " ".join((text[: quoted.start()] + text[quoted.end() :]).split())
    words = text.split()
    while len(words) > 1 and words[0].rstrip(".") in TITLES:
        words = words[1:]
    text = " ".join(words)
    if "," in text:
        left, right = (x.strip() for x in text.split(",", 1))
        lw, rw = left.split(), right.split()
        if not left or not right:
            return rewrite(left or right)
        if len(lw) >= 2 and (len(rw) == 1 or {x.rstrip(".") for x in lw} & (ORG_WORDS | set(LEGAL_FORMS))):
            return _organisation(rw + lw)
        if rw[-1].rstrip(".") in ORG_WORDS | set(LEGAL_FORMS):
            return _organisation(lw + rw)
        given = rw[0].rstrip(".")
        if "." in given:
            letters = given.split(".")
            return _person(letters[0], left, letters[1][:1] if len(letters[1]) == 1 else "", False)
        middle = rw[1].rstrip(".")[:1] if len(rw) > 1 else ""
        return _person(given, left, middle, False)
    if len(words) == 1:
        caps = plain.split()[-1].replace(".", "")
        if re.fullmatch(r"[A-Z]{2,6}", caps):
            return {"ident": f"a|{caps.lower()}", "kind": "a", "forms": [], "slips": [], "marks": [f"a|{caps.lower()}"]}
        bits = [b for b in re.split(r"[._]", text) if b]
        if len(bits) >= 2 and "-" not in bits[0]:
            if len(bits[0]) == 1:
                return _person(bits[0], bits[-1], bits[1] if len(bits) > 2 and len(bits[1]) == 1 else "", False)
            return _person(bits[0], bits[-1], "", bits[-1] in GIVEN)
        if text.count("-") >= 2:
            return _organisation(text.split("-"))
        if len(text) >= 4 and "-" not in text:
            return _person(text[0], text[1:], "", False)
        return {"ident": f"w|{text}", "kind": "w", "forms": [], "slips": [], "marks": []}
    bare = [w.rstrip(".") for w in words]
    if set(bare) & ORG_WORDS or bare[-1] in LEGAL_FORMS or bare[0] == "the":
        return _organisation([x for w in words for x in w.split("-")])
    tokens = plain.split()
    if len(words) == 2 and re.fullmatch(r"[A-Z]{2,5}", tokens[-1]) and not tokens[0].isupper():
        return {"ident": f"b|{bare[0]}|{bare[1]}", "kind": "a", "forms": [], "slips": [f"b|{x}|{bare[1]}" for x in deletions(bare[0])], "marks": [f"b|{bare[0]}|{bare[1]}"]}
    if "." in bare[0]:  # "J.E. Doe"
        letters = [x for x in bare[0].split(".") if x]
        return _person(letters[0], bare[-1], letters[1] if len(letters) > 1 else "", False)
    if len(bare) > 2 and any(len(x) == 1 for x in bare[1:-1]):
        return _person(bare[0], bare[-1], next(x for x in bare[1:-1] if len(x) == 1), False)
    if len(bare) > 2 and len(bare[-1]) == 1:  # "Doe Jane A."
        return _person(bare[1], bare[0], bare[-1], False)
    if len(bare) > 2:
        return _organisation([x for w in words for x in w.split("-")])
    if len(bare[1]) == 1 or (bare[1] in GIVEN and bare[0] not in GIVEN):
        return _person(bare[1], bare[0], "", True)
    return _person(bare[0], bare[1], "", True)


def _rewrite_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(n, c, r["ident"], r["kind"], r["forms"], r["slips"], r["marks"]) for n, c in zip(pdf["name"], pdf["n_rows"]) if (r := rewrite(n))]
        yield pd.DataFrame(rows, columns=["name", "n_rows", "ident", "kind", "forms", "slips", "marks"])


def _slip_ok(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        p, q = x.split("|"), y.split("|")
        ok = p[0] == q[0] and one_slip("|".join(p[1:]), "|".join(q[1:])) and len(max(p[1:], key=len)) >= 5
        if ok and p[0] == "p" and p[1] != q[1]:
            # a slip in the first name: one of the two is then no name that anyone has
            ok = not (p[1] in GIVEN and q[1] in GIVEN) and min(len(p[1]), len(q[1])) >= 3
        out.append(ok)
    return pd.Series(out)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; rounds of joins until nothing changes."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "name-edges")
    labels = staged(nodes.select("node", F.col("node").alias("label")), "name-labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("told"))
        new = staged(labels.join(told, labels["node"] == told["a"], "left").select("node", F.least("label", F.coalesce("told", "label")).alias("label"), (F.coalesce("told", "label") < F.col("label")).alias("changed")), "name-labels")
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels


def link_names(names: DataFrame, column: str) -> DataFrame:
    """(name, ident, entity, rule, score) of every distinct spelling in ``column``.

    ``rule`` and ``score`` tell how a spelling without a whole name was linked: by which rewriting, and its rarity.
    """
    distinct = names.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    slip = F.pandas_udf(_slip_ok, "boolean")
    parsed = staged(distinct.mapInPandas(_rewrite_batches, "name string, n_rows long, ident string, kind string, forms array<string>, slips array<string>, marks array<string>"), "name-forms")
    idents = staged(parsed.groupBy("ident", "kind").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n_rows").alias("n_rows"), F.flatten(F.collect_set("forms")).alias("forms"), F.array_distinct(F.flatten(F.collect_set("slips"))).alias("slips"), F.array_distinct(F.flatten(F.collect_set("marks"))).alias("marks")), "name-idents")
    whole = idents.where("kind in ('p', 'o')")
    # nickname and order: the rewriting must be written by someone; where none is, nicknames of one reading still meet in it
    forms = whole.select("ident", F.posexplode(F.array_distinct("forms")).alias("place", "form")).select("ident", "place", F.substring("form", 1, 1).alias("rule"), F.expr("substring(form, 3)").alias("form"))
    written = forms.join(idents.select(F.col("ident").alias("form"), F.lit(True).alias("there")), "form", "left")
    counted = written.groupBy("ident", "rule").agg(F.count("there").alias("n"), F.count(F.lit(1)).alias("readings"), F.max_by("form", F.when(F.col("there"), 1).otherwise(0)).alias("hit"), F.min_by("form", "place").alias("first"))
    nick = counted.where("rule = 'n' and (n = 1 or n = 0 and readings = 1)").select(F.col("ident").alias("a"), F.when(F.col("n") == 1, F.col("hit")).otherwise(F.col("first")).alias("b"))
    order = counted.where("rule = 'o' and n = 1").select(F.col("ident").alias("a"), F.col("hit").alias("b"))
    sure = staged(nick.union(order), "name-sure")
    nodes = idents.select(F.col("ident").alias("node")).union(sure.select("b")).distinct()
    labels = components(sure, nodes)
    # slips: one of the two groups is written in a single way, or is rare beside the only group within one slip that it can be
    group = staged(idents.where("kind in ('p', 'o')").join(labels, idents["ident"] == labels["node"]).select("ident", "label", "spellings", "n_rows", "slips"), "name-groups")
    ways = group.groupBy("label").agg(F.sum("spellings").alias("ways"), F.sum("n_rows").alias("n_rows"))
    deleted = group.drop("n_rows").join(ways, "label").select("ident", "label", "ways", "n_rows", F.explode("slips").alias("form"))
    deleted = staged(deleted, "name-slips")
    end = lambda x: deleted.select("form", F.col("ident").alias(x), F.col("label").alias("l" + x), F.col("ways").alias("w" + x), F.col("n_rows").alias("n" + x))
    rare = F.least("na", "nb") * SLIP_ROWS <= F.greatest("na", "nb")
    met = end("a").join(end("b"), "form").where("a < b and la <> lb").where((F.least("wa", "wb") == 1) | rare).drop("form").distinct()
    near = staged(met.where(slip("a", "b")).withColumn("single", F.least("wa", "wb") == 1).withColumn("rarer", F.when(rare, F.when(F.col("na") < F.col("nb"), F.col("la")).otherwise(F.col("lb")))).withColumn("other", F.when(F.col("rarer") == F.col("la"), F.col("lb")).otherwise(F.col("la"))), "name-slip-pairs")
    few = near.where("rarer is not null").groupBy("rarer").agg(F.count_distinct("other").alias("may_be"))
    slips = near.join(few, "rarer", "left").where("single or may_be = 1").select("a", "b").distinct()
    entities = components(sure.union(slips), nodes)
    # initials, user names and acronyms: the one entity that their rewriting stands for
    base = whole.join(entities, whole["ident"] == entities["node"]).select(F.col("label").alias("entity"), F.explode("marks").alias("mark")).distinct()
    rarity = staged(base.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity")), "name-marks")
    short = idents.where("kind in ('i', 'a')")
    asked = short.select("ident", F.posexplode("marks").alias("place", "mark")).join(rarity, "mark").select("ident", F.col("place"), "mark", "n", "entity")
    exact = asked.where("n = 1").groupBy("ident").agg(F.min_by(F.struct("entity", "mark", "n"), "place").alias("best")).select("ident", "best.*")
    unmet = short.join(asked.select("ident").distinct(), "ident", "left_anti").select("ident", F.explode("slips").alias("form"))
    known = rarity.where("n = 1 and substring(mark, 1, 1) in ('i', 'b')").select("mark", "entity")
    shapes = known.select("mark", "entity", F.split("mark", r"\|").alias("p"))
    spread = shapes.withColumn("word", F.when(F.col("p")[0] == "i", F.col("p")[2]).otherwise(F.col("p")[1]))
    ends = spread.select("mark", "entity", "p", "word", F.explode(F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.length("word")))).alias("cut"))
    cut = F.when(F.col("cut") == 0, F.col("word")).otherwise(F.expr("concat(substring(word, 1, cut - 1), substring(word, cut + 1))"))
    near = ends.withColumn("cutword", cut).select("mark", "entity", F.when(F.col("p")[0] == "i", F.concat_ws("|", F.col("p")[0], F.col("p")[1], "cutword")).otherwise(F.concat_ws("|", F.col("p")[0], "cutword", F.col("p")[2])).alias("form"))
    slipped = unmet.join(near, "form").select("ident", "entity", "mark").distinct().where(slip("ident", "mark")).groupBy("ident").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"), F.min("mark").alias("mark")).where("n = 1")
    met = exact.select("ident", "entity", F.lit("mark").alias("rule"), (F.lit(1.0) / F.col("n")).alias("score")).union(slipped.select("ident", "entity", F.lit("slip").alias("rule"), F.lit(1.0)))
    whole_of = whole.join(entities, whole["ident"] == entities["node"]).select("ident", F.col("label").alias("entity"), F.lit("whole").alias("rule"), F.lit(1.0).alias("score"))
    placed = whole_of.union(met)
    return parsed.select("name", "ident").join(placed, "ident", "left").select("name", "ident", F.coalesce("entity", "ident").alias("entity"), F.coalesce("rule", F.lit("alone")).alias("rule"), F.coalesce("score", F.lit(1.0)).alias("score"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """Spellings of one entity, each two once: (name_a, name_b), the first smaller by code point."""
    s = linked.select("entity", "name")
    return s.select("entity", F.col("name").alias("name_a")).join(s.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
