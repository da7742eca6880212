"""Word-processor packages (.docx) as DataFrames; one package is one task's unit, nothing but the standard library reads it.

``read_packages`` yields tagged rows; ``tables_of`` splits them into typed tables: parts, streams, spans, nodes,
revisions, comments and gaps.  A package that cannot be read gives one ``error`` row, never a failed job.

Inserted and deleted text stand in one stream per part.  Every paragraph ends in a line end with an empty stack; tabs are
U+0009, breaks U+000B; a field's instruction is no text, its result is.  Blocks inside a revision mark that stands around
whole paragraphs are not read; they are reported as the gap ``unrecognized_container``.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.functions.canon import sha256_json

MAX_TOTAL = 256 << 20
MAX_MEMBER = 64 << 20

# fixed values: namespaces and relationship types of ECMA-376 / ISO 29500
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
STRICT = {
    "http://purl.oclc.org/ooxml/wordprocessingml/main": W,
    "http://purl.oclc.org/ooxml/officeDocument/relationships": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "http://purl.oclc.org/ooxml/drawingml/main": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "http://purl.oclc.org/ooxml/drawingml/wordprocessingDrawing": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
}
W14 = "http://schemas.microsoft.com/office/word/2010/wordml"
W15 = "http://schemas.microsoft.com/office/word/2012/wordml"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
STRICT_REL = "http://purl.oclc.org/ooxml/officeDocument/relationships/"

# fixed values: elements of the format that hold blocks, hold runs, or carry no text
_BLOCKS = {"document", "body", "tbl", "tr", "tc", "sdtContent", "hdr", "ftr", "footnotes", "endnotes", "footnote", "endnote", "comment", "comments", "customXml", "sdt"}
_INLINE = {"r", "hyperlink", "fldSimple", "smartTag", "customXml", "dir", "bdo", "sdt", "sdtContent"}
_QUIET = {"sectPr", "tblPr", "tblGrid", "trPr", "tcPr", "sdtPr", "sdtEndPr", "bookmarkStart", "bookmarkEnd", "pPr", "rPr", "proofErr", "lastRenderedPageBreak", "instrText", "tblPrEx", "delInstrText"}
_NODES = {"tbl": "table", "tr": "row", "tc": "cell", "hdr": "header", "ftr": "footer", "footnote": "footnote", "endnote": "footnote", "sdt": "sdt"}
_REVISIONS = {"ins": "ins", "del": "del", "moveFrom": "moveFrom", "moveTo": "moveTo"}
_CHANGES = {"rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange", "tblGridChange", "numberingChange", "cellIns", "cellDel", "cellMerge"}
_ON = {"1": True, "true": True, "on": True, "0": False, "false": False, "off": False}


class PackageError(ValueError):
    pass


def _whole(text: str | None) -> int | None:
    """A whole number as typed, None for anything else."""
    return int(text) if text is not None and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", text) else None


def _tag(e) -> tuple[str, str]:
    name = e.tag if isinstance(e.tag, str) else ""
    uri, _, local = name[1:].rpartition("}") if name[:1] == "{" else ("", "", name)
    return STRICT.get(uri, uri), local


def w_local(e) -> str:
    uri, local = _tag(e)
    return local if uri == W else ""


def attr(e, name: str, uri: str = W) -> str | None:
    """An attribute in the namespace (strict or not), else the bare one."""
    for key, value in e.attrib.items():
        if key[:1] == "{":
            ns, _, local = key[1:].rpartition("}")
            if local == name and STRICT.get(ns, ns) == uri:
                return value
    return e.attrib.get(name)


def child(e, name: str):
    return next((c for c in e if w_local(c) == name), None) if e is not None else None


def value(e, name: str) -> str | None:
    c = child(e, name)
    return None if c is None else attr(c, "val")


def parse_xml(data: bytes):
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise PackageError("the XML declares a document type or an entity")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as x:
        raise PackageError(f"malformed XML: {x}") from x


def resolve_target(source: str, target: str) -> str:
    if target.startswith("/"):
        return posixpath.normpath(target).lstrip("/")
    return posixpath.normpath(posixpath.join(posixpath.dirname(source), target)).lstrip("/")


class Package:
    """The members of a package reachable from its root, with their part ids."""

    def __init__(self, data: bytes) -> None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if sum(i.file_size for i in z.infolist()) > MAX_TOTAL or any(i.file_size > MAX_MEMBER for i in z.infolist()):
                    raise PackageError("the package expands beyond the limit")
                self.members = {i.filename.lstrip("/"): z.read(i) for i in z.infolist() if not i.is_dir()}
        except (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, RuntimeError, EOFError, NotImplementedError, zlib.error) as x:
            raise PackageError(f"no readable zip: {x}") from x
        self.defaults, self.overrides = {}, {}
        if "[Content_Types].xml" in self.members:
            for e in parse_xml(self.members["[Content_Types].xml"]):
                local = _tag(e)[1]
                if local == "Default":
                    self.defaults[e.get("Extension", "").lower()] = e.get("ContentType", "")
                elif local == "Override":
                    self.overrides[e.get("PartName", "").lstrip("/")] = e.get("ContentType", "")
        self.rels: list[dict] = []
        self.parts: dict[str, dict] = {}
        counts: dict[str, int] = {}
        queue, seen = [""], {""}
        while queue:
            source = queue.pop(0)
            for r in self._relationships(source):
                self.rels.append(r)
                name = r["part_name"]
                if name is None or name not in self.members:
                    continue
                if name not in self.parts:
                    kind = r["type"].rsplit("/", 1)[-1]
                    self.parts[name] = {"name": name, "part_id": f"{kind}:{counts.get(kind, 0)}", "rel_type": r["type"], "content_type": self.content_type(name)}
                    counts[kind] = counts.get(kind, 0) + 1
                if name not in seen:
                    seen.add(name)
                    queue.append(name)

    def content_type(self, name: str) -> str:
        return self.overrides.get(name) or self.defaults.get(name.rpartition(".")[2].lower(), "")

    def _relationships(self, source: str) -> list[dict]:
        folder, base = posixpath.split(source)
        data = self.members.get(posixpath.join(folder, "_rels", base + ".rels"))
        if data is None:
            return []
        out = []
        for i, e in enumerate(parse_xml(data)):
            kind, target = e.get("Type", ""), e.get("Target", "")
            if kind.startswith(STRICT_REL):
                kind = REL + kind[len(STRICT_REL) :]
            outside = e.get("TargetMode") == "External" or "://" in target
            out.append({"source": source, "rel_id": e.get("Id"), "type": kind, "target": target, "target_mode": e.get("TargetMode"), "part_name": None if outside else resolve_target(source, target), "ord": i})
        return out

    def of_type(self, kind: str) -> list[str]:
        """Part names of a relationship type, relative to the main document except for itself."""
        main = next((r["part_name"] for r in self.rels if r["source"] == "" and r["type"] == REL + "officeDocument"), None)
        if kind == "officeDocument":
            if main is None or main not in self.members:
                raise PackageError("the package has no main document")
            return [main]
        names = [r["part_name"] for r in self.rels if r["source"] == main and r["type"].rsplit("/", 1)[-1] == kind and r["part_name"] in self.members]
        return list(dict.fromkeys(names))

    def xml(self, kind: str):
        names = self.of_type(kind)
        return parse_xml(self.members[names[0]]) if names else None


class Styles:
    """Paragraph styles; a property comes from the nearest definition along ``basedOn``."""

    def __init__(self, root) -> None:
        self.by_id = {attr(s, "styleId"): s for s in (root if root is not None else []) if w_local(s) == "style"}
        self.broken = False

    def nearest(self, style: str | None, get):
        seen: set[str] = set()
        while style is not None and style in self.by_id:
            if style in seen:
                self.broken = True
                return None
            seen.add(style)
            found = get(self.by_id[style])
            if found is not None:
                return found
            style = value(self.by_id[style], "basedOn")
        return None

    def name(self, style: str | None) -> str | None:
        return None if style is None else value(self.by_id[style], "name") or style if style in self.by_id else style


def _roman(n: int) -> str:
    out = ""
    for size, mark in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += mark * (n // size)
        n %= size
    return out


def format_number(n: int, kind: str) -> str:
    if kind in ("lowerLetter", "upperLetter"):
        text = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1) if n > 0 else ""
        return text.upper() if kind[0] == "u" else text
    if kind in ("lowerRoman", "upperRoman"):
        return _roman(n).upper() if kind[0] == "u" else _roman(n)
    return {"none": "", "decimalZero": f"{n:02d}"}.get(kind, str(n))


class Numbering:
    """List definitions and the counters of one part."""

    def __init__(self, root) -> None:
        self.levels: dict[str, dict[int, dict]] = {}
        self.style_level: dict[tuple[str, str], int] = {}
        if root is None:
            return
        shapes = {}
        for a in root:
            if w_local(a) == "abstractNum":
                shapes[attr(a, "abstractNumId")] = {_whole(attr(v, "ilvl")) or 0: v for v in a if w_local(v) == "lvl"}
        for n in root:
            if w_local(n) != "num":
                continue
            num, own = attr(n, "numId"), {}
            for ix, v in shapes.get(value(n, "abstractNumId"), {}).items():
                own[ix] = {"start": 1 if _whole(value(v, "start")) is None else _whole(value(v, "start")), "fmt": value(v, "numFmt") or "decimal", "text": value(v, "lvlText") or ""}
                if value(v, "pStyle"):
                    self.style_level[num, value(v, "pStyle")] = ix
            for o in n:
                if w_local(o) == "lvlOverride" and _whole(value(o, "startOverride")) is not None:
                    own.setdefault(_whole(attr(o, "ilvl")) or 0, {"fmt": "decimal", "text": ""})["start"] = _whole(value(o, "startOverride"))
            self.levels[num] = own

    def label(self, counters: dict, num: str, level: int) -> str | None:
        levels = self.levels.get(num)
        if not levels or level not in levels:
            return None
        own = levels[level]
        counters[num, level] = counters.get((num, level), own["start"] - 1) + 1
        for k in [k for k in counters if k[0] == num and k[1] > level]:
            del counters[k]
        if own["fmt"] == "bullet":
            return own["text"]

        def count(m: re.Match) -> str:
            at = int(m[1]) - 1
            other = levels.get(at, own)
            return format_number(counters.get((num, at), other.get("start", 1)), other["fmt"])

        return re.sub(r"%([1-9])", count, own["text"])


class _Part:
    def __init__(self, name: str, part_id: str) -> None:
        self.name, self.part_id = name, part_id
        self.pieces: list[list] = []  # [text, stack]
        self.length = 0
        self.open_ranges: dict[str, int] = {}
        self.ranges: dict[str, tuple[int, int]] = {}
        self.counters: dict = {}

    def emit(self, text: str, stack: tuple[str, ...]) -> None:
        if not text:
            return
        if self.pieces and self.pieces[-1][1] == stack and self.pieces[-1][0] != "\n":
            self.pieces[-1][0] += text
        else:
            self.pieces.append([text, stack])
        self.length += len(text)

    def end_paragraph(self) -> None:
        self.pieces.append(["\n", ()])
        self.length += 1

    @property
    def text(self) -> str:
        return "".join(p[0] for p in self.pieces)


class Walker:
    """One pass over a document's parts in document order, collecting rows."""

    def __init__(self, package: Package) -> None:
        self.package = package
        self.styles = Styles(package.xml("styles"))
        self.numbering = Numbering(package.xml("numbering"))
        self.nodes: list[dict] = []
        self.revisions: dict[str, dict] = {}
        self.variants: dict[str, list[tuple]] = {}
        self.gaps: set[str] = set()
        self.parts: list[_Part] = []
        self.noid = 0
        self.moves: list[tuple[str, str]] = []
        self.comments: list[dict] = []
        self.used: set[str] = set()

    def run(self) -> None:
        names = [n for kind in ("officeDocument", "header", "footer", "footnotes", "endnotes", "comments") for n in self.package.of_type(kind)]
        for name in dict.fromkeys(names):
            part = _Part(name, self.package.parts[name]["part_id"])
            self.parts.append(part)
            self.moves = []
            self.noid = 0
            root = parse_xml(self.package.members[name])
            self._block(root, part, (), None, "/", {})
        self._identify()
        self._thread()
        if self.styles.broken:
            self.gaps.add("style_chain_cycle")

    # blocks

    def _open(self, kind: str, part: _Part, parent: dict | None, ref: str) -> dict:
        node = {"kind": kind, "part_id": part.part_id, "source_ref": f"{part.name}#{ref}", "parent": parent, "start": part.length, "end": None, "style": None, "level": None, "label": None, "para_id": None, "bold": None, "outline": None, "inherited": None, "children": [], "list_continues": False}
        self.nodes.append(node)
        if parent is not None:
            parent["children"].append(node)
        return node

    def _block(self, e, part: _Part, stack: tuple[str, ...], parent: dict | None, ref: str, state: dict) -> None:
        local = w_local(e)
        if local == "p":
            self._paragraph(e, part, stack, parent, ref, state)
            return
        if local in ("commentRangeStart", "commentRangeEnd"):
            self._range(e, local, part)
            return
        if local.startswith("move") and "Range" in local:
            self._move(e, local)
            return
        if local in ("trPr",) and any(w_local(c) in _REVISIONS for c in e):
            self.gaps.add("unrecorded_revision_kind")
        if local in _QUIET:
            self._changes(e)
            return
        if local not in _BLOCKS:
            if local or _tag(e)[0]:
                self._skipped(e)
            return
        node = parent
        body = None
        if local in _NODES:
            node = self._open(_NODES[local], part, parent, ref + local)
        elif local == "comment":
            body = {"comment_id": attr(e, "id"), "author": attr(e, "author"), "initials": attr(e, "initials"), "date": attr(e, "date"), "part_id": part.part_id, "start": part.length, "para_id": None}
            self.comments.append(body)
        inner = {"previous": None, "comment": body or state.get("comment")}
        for i, c in enumerate(e):
            self._block(c, part, stack, node, f"{ref}{local}[{i}]/", inner)
        if local in _NODES:
            node["end"] = part.length
        if body is not None:
            body["end"] = max(body["start"], part.length - 1)

    def _paragraph(self, p, part: _Part, stack: tuple[str, ...], parent: dict | None, ref: str, state: dict) -> None:
        pr = child(p, "pPr")
        style = value(pr, "pStyle")
        num = child(pr, "numPr")
        num_id = value(num, "numId")
        if num_id is None:
            num_id = self.styles.nearest(style, lambda s: value(child(child(s, "pPr"), "numPr"), "numId"))
        level = value(num, "ilvl") or self.styles.nearest(style, lambda s: value(child(child(s, "pPr"), "numPr"), "ilvl"))
        if num_id in (None, "0"):
            num_id = None
        ilvl = _whole(level) if _whole(level) is not None else self.numbering.style_level.get((num_id, style), 0)
        outline = _whole(value(pr, "outlineLvl"))
        inherited = self.styles.nearest(style, lambda s: _whole(value(child(s, "pPr"), "outlineLvl")))
        node = self._open("para", part, parent, ref + "p")
        node.update(style=style, para_id=attr(p, "paraId", W14), outline=outline, inherited=inherited)
        for c in pr if pr is not None else []:
            if w_local(c) == "rPr":
                for mark in c:
                    if w_local(mark) in _REVISIONS:
                        self._revision(mark, part, stack)
                        self.gaps.add("paragraph_mark_revision")
                    else:
                        self._changes(mark)
            else:
                self._changes(c)
        runs: list[tuple[int, bool]] = []
        fields: list[bool] = []
        for c in p:
            self._inline(c, part, stack, fields, runs)
        node["end"] = part.length
        part.end_paragraph()
        name = self.styles.name(style) or ""
        titled = re.fullmatch(r"heading\s*[1-9]|title", name, re.I) is not None
        seen = sum(n for n, _ in runs)
        node["bold"] = bool(runs) and all(b for _, b in runs)
        in_cell = parent is not None and self._inside(parent, "cell")
        continues = num_id is not None and state.get("previous") == "list_item"
        rules = [r for r, t in (("style", titled), ("outline_level", node["outline"] is not None and 0 <= node["outline"] <= 8), ("outline_inherited", node["inherited"] is not None and 0 <= node["inherited"] <= 8), ("bold_short", node["bold"] and 0 < seen <= 120 and not in_cell and not continues)) if t]
        node["rules"] = rules
        stated = node["outline"] if node["outline"] is not None else node["inherited"]
        digit = re.fullmatch(r"heading\s*([1-9])", name, re.I)
        if rules:
            node["kind"] = "heading"
            node["level"] = stated + 1 if stated is not None and stated <= 8 else int(digit[1]) if digit else 0 if name.lower() == "title" else None
        elif num_id is not None:
            node["kind"] = "list_item"
        if num_id is not None:
            node["label"] = self.numbering.label(part.counters, num_id, ilvl)
            if node["kind"] == "list_item":
                node["level"] = ilvl
        state["previous"] = node["kind"]
        if state.get("comment") is not None:
            state["comment"]["para_id"] = node["para_id"]

    @staticmethod
    def _inside(node: dict | None, kind: str) -> bool:
        while node is not None:
            if node["kind"] == kind:
                return True
            node = node["parent"]
        return False

    # inline

    def _inline(self, e, part: _Part, stack: tuple[str, ...], fields: list[bool], runs: list, visible: bool = True) -> None:
        local = w_local(e)
        if local in ("t", "delText"):
            text = re.sub(r"\r\n?|\n", "\x0b", e.text or "")
        elif local in ("tab", "ptab"):
            text = "\t"
        elif local in ("br", "cr"):
            text = "\x0b"
        elif local == "softHyphen":
            text = "\xad"
        elif local == "noBreakHyphen":
            text = "‑"
        elif local == "sym":
            code = attr(e, "char") or ""
            text = chr(int(code, 16)) if re.fullmatch("[0-9A-Fa-f]{1,5}", code) else ""
        elif local == "fldChar":
            kind = attr(e, "fldCharType")
            if kind == "begin":
                fields.append(False)
            elif kind == "separate" and fields:
                fields[-1] = True
            elif kind == "end" and fields:
                fields.pop()
            return
        elif local in _REVISIONS:
            inside = self._revision(e, part, stack)
            for c in e:
                self._inline(c, part, inside, fields, runs, visible and local not in ("del", "moveFrom"))
            return
        elif local in ("commentRangeStart", "commentRangeEnd"):
            self._range(e, local, part)
            return
        elif local.startswith("move") and "Range" in local:
            self._move(e, local)
            return
        elif local in _INLINE:
            if local == "sdt":
                self.gaps.add("inline_sdt_transparent")
            for c in e:
                self._inline(c, part, stack, fields, runs, visible)
            said = sum(len(c.text or "") for c in e if w_local(c) == "t") if local == "r" and visible else 0
            if said:  # what a paragraph says: no deleted runs, no tabs alone
                bold = child(child(e, "rPr"), "b")
                runs.append((said, bold is not None and _ON.get((attr(bold, "val") or "true").lower(), True)))
            return
        elif local in _QUIET or local in ("commentReference", "annotationRef", "footnoteReference", "endnoteReference", "footnoteRef", "endnoteRef"):
            self._changes(e)
            return
        else:
            self._skipped(e)
            return
        if all(fields):
            part.emit(text, stack)

    def _skipped(self, e) -> None:
        kinds = {_tag(x)[1] for x in e.iter()}
        if "txbxContent" in kinds:
            self.gaps.add("textbox")
        elif "".join(x.text or "" for x in e.iter() if w_local(x) in ("t", "delText")).strip():
            self.gaps.add("unrecognized_container")

    def _changes(self, e) -> None:
        if any(w_local(x) in _CHANGES for x in e.iter()):
            self.gaps.add("unrecorded_revision_kind")

    # revisions, moves, comment ranges

    def _revision(self, e, part: _Part, stack: tuple[str, ...]) -> tuple[str, ...]:
        kind, wid = _REVISIONS[w_local(e)], attr(e, "id")
        who = (attr(e, "author"), attr(e, "date"))
        if wid is None:
            self.noid += 1
            rid = f"{kind}:noid{self.noid}"
            self.gaps.add("revision_missing_id")
        else:
            rid = f"{kind}:{wid}"
            known = self.variants.setdefault(rid, [])
            if who not in known:
                known.append(who)
            nth = known.index(who)
            if nth:
                rid += f"~{nth}"
                self.gaps.add("revision_id_collision")
        if rid not in self.revisions:
            mark = {"moveFrom": "moveFromRangeStart", "moveTo": "moveToRangeStart"}.get(kind)
            group = next((name for m, name in reversed(self.moves) if m == mark), None)
            self.revisions[rid] = {"revision_id": rid, "kind": kind, "author": who[0], "date": who[1], "move_group_id": group, "ancestors": [x for x in stack if x != rid]}
        return (*stack, rid)

    def _move(self, e, local: str) -> None:
        if local.endswith("Start"):
            self.moves.append((local, attr(e, "name")))
        else:
            start = local[:-3] + "Start"
            at = next((i for i in reversed(range(len(self.moves))) if self.moves[i][0] == start), None)
            if at is not None:
                del self.moves[at]

    def _range(self, e, local: str, part: _Part) -> None:
        cid = attr(e, "id")
        if local == "commentRangeStart":
            part.open_ranges.setdefault(cid, part.length)
        elif cid in part.open_ranges and cid not in part.ranges:
            part.ranges[cid] = (part.open_ranges[cid], part.length)

    # identity and threads

    def _identify(self) -> None:
        texts = {p.part_id: p.text for p in self.parts}
        stated = [n["para_id"] for n in self.nodes if n["para_id"]]
        counts: dict[tuple, int] = {}
        spent: set[str] = set()
        for i, n in enumerate(self.nodes):
            n["ord"] = i
            holds = n["kind"] in ("para", "heading", "list_item", "cell")
            n["text"] = texts[n["part_id"]][n["start"] : n["end"]]
            if n["kind"] == "cell":
                n["text"] = n["text"].removesuffix("\n")
                n["end"] = n["start"] + len(n["text"])
            if n["para_id"] and n["para_id"] not in spent:
                n["id"], n["stability"], n["nth"] = n["para_id"], "paraid", 0
                spent.add(n["para_id"])
            elif n["text"].strip("\n"):
                base = sha256_json({"part": n["part_id"], "kind": n["kind"], "text": n["text"], "style": n["style"], "level": n["level"]})
                n["nth"] = counts.get((n["part_id"], base), 0)
                counts[n["part_id"], base] = n["nth"] + 1
                n["id"], n["stability"] = f"hash:{base}:{n['nth']}", "content_hash"
                if n["nth"]:
                    self.gaps.add("duplicate_content_id_churn")
            else:
                n["id"], n["stability"], n["nth"] = f"path:{n['source_ref']}", "path", 0
            n["span"] = (n["start"], n["end"]) if holds else None
        del stated

    def _thread(self) -> None:
        rows: dict[str, tuple] = {}
        extended = self.package.of_type("commentsExtended")
        if extended:
            for e in parse_xml(self.package.members[extended[0]]):
                if _tag(e)[1] == "commentEx":
                    rows.setdefault(attr(e, "paraId", W15), (attr(e, "paraIdParent", W15), attr(e, "done", W15)))
        texts = {p.part_id: p.text for p in self.parts}
        ranges: dict[str, tuple] = {}
        for p in self.parts:
            for cid, (a, b) in p.ranges.items():
                while b > a and texts[p.part_id][b - 1] == "\n":
                    b -= 1
                while a < b and texts[p.part_id][a] == "\n":
                    a += 1
                ranges.setdefault(cid, (p.part_id, a, b))
        counts: dict[str, int] = {}
        for c in self.comments:
            c["text"] = texts[c["part_id"]][c["start"] : c["end"]]
            c["id_stability"] = "paraid"
            key = c["para_id"]
            if key is None:
                base = sha256_json({"author": c["author"], "date": c["date"], "text": c["text"]})
                counts[base] = counts.get(base, 0) + 1
                c["para_id"], c["id_stability"] = f"hash:{base}:{counts[base] - 1}", "content_hash"
            c["anchor"] = ranges.get(c["comment_id"])
            if c["anchor"] is None:
                self.gaps.add("unanchored_comment")
            row = rows.get(key)
            c["threading_status"] = "absent" if not extended else "verified" if row else "unknown"
            c["parent_id"], done = row or (None, None)
            c["resolved"] = None if done is None else _ON.get(done.strip().lower())
        known = {c["para_id"] for c in self.comments}
        if any(c["parent_id"] is not None and c["parent_id"] not in known for c in self.comments):
            self.gaps.add("dangling_comment_parent")
        bodies = {c["comment_id"] for c in self.comments}
        if any(cid not in bodies for p in self.parts for cid in (*p.open_ranges, *p.ranges)):
            self.gaps.add("unanchored_comment")


def parse_package(data: bytes) -> list[tuple[str, dict]]:
    """(row type, row) of a package; raises PackageError."""
    package = Package(data)
    w = Walker(package)
    w.run()
    rows: list[tuple[str, dict]] = [("part", {**p, "ord": i}) for i, p in enumerate(package.parts.values())]
    rows += [("rel", r) for r in package.rels]
    for i, p in enumerate(w.parts):
        rows.append(("stream", {"part_id": p.part_id, "part_ord": i, "text": p.text}))
        at = 0
        for k, (text, stack) in enumerate(p.pieces):
            rows.append(("span", {"part_id": p.part_id, "span_ord": k, "start_off": at, "end_off": at + len(text), "stack": list(stack), "text": text}))
            at += len(text)
    for n in w.nodes:
        rows.append(("node", {"node_ord": n["ord"], "node_id": n["id"], "kind": n["kind"], "part_id": n["part_id"], "source_ref": n["source_ref"], "start_off": n["span"] and n["span"][0], "end_off": n["span"] and n["span"][1], "style": n["style"], "level": n["level"], "numbering_label": n["label"], "id_stability": n["stability"], "occurrence_index": n["nth"], "child_ids": [c["id"] for c in n["children"]], "parent_id": n["parent"] and n["parent"]["id"], "fired_rules": n.get("rules", [])}))
    rows += [("revision", {**r, "ord": i}) for i, r in enumerate(w.revisions.values())]
    for i, c in enumerate(w.comments):
        a = c["anchor"]
        text = next((p.text for p in w.parts if a and p.part_id == a[0]), "")
        rows.append(("comment", {"ord": i, "comment_id": c["comment_id"], "para_id": c["para_id"], "id_stability": c["id_stability"], "author": c["author"], "initials": c["initials"], "date": c["date"], "text": c["text"], "anchor_part": a and a[0], "anchor_start": a and a[1], "anchor_end": a and a[2], "anchor_text": text[a[1] : a[2]] if a else None, "parent_id": c["parent_id"], "threading_status": c["threading_status"], "resolved": c["resolved"]}))
    rows += [("gap", {"gap": g}) for g in sorted(w.gaps)]
    return rows


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            key = hashlib.sha256(content).hexdigest()
            try:
                out += [(key, path, kind, json.dumps(row, ensure_ascii=False)) for kind, row in parse_package(content)]
            except PackageError as x:
                out.append((key, path, "error", json.dumps({"error": str(x)})))
            except Exception as x:  # noqa: BLE001  (whatever is wrong with one package, too deep a tree too, is that package's row)
                out.append((key, path, "error", json.dumps({"error": f"{type(x).__name__}: {x}"})))
        yield pd.DataFrame(out, columns=["document_id", "path", "row_type", "row"])


SCHEMAS = {
    "part": "name string, part_id string, rel_type string, content_type string, ord int",
    "rel": "source string, rel_id string, type string, target string, target_mode string, part_name string, ord int",
    "stream": "part_id string, part_ord int, text string",
    "span": "part_id string, span_ord int, start_off int, end_off int, stack array<string>, text string",
    "node": "node_ord int, node_id string, kind string, part_id string, source_ref string, start_off int, end_off int, style string, level int, numbering_label string, id_stability string, occurrence_index int, child_ids array<string>, parent_id string, fired_rules array<string>",
    "revision": "revision_id string, kind string, author string, date string, move_group_id string, ancestors array<string>, ord int",
    "comment": "ord int, comment_id string, para_id string, id_stability string, author string, initials string, date string, text string, anchor_part string, anchor_start int, anchor_end int, anchor_text string, parent_id string, threading_status string, resolved boolean",
    "gap": "gap string",
    "error": "error string",
}


def parse_files(files: DataFrame) -> DataFrame:
    """Tagged rows (document_id, path, row_type, row) of a ``binaryFile`` table.

    Packages over the size limit are not opened: their error row comes from path and length, the hash of both being the id.
    """
    schema = "document_id string, path string, row_type string, row string"
    rows = files.where(F.col("length") <= MAX_TOTAL).select("path", "content").mapInPandas(_parse_batches, schema)
    error = F.concat(F.lit("the file has "), F.col("length").cast("string"), F.lit(f" bytes, more than {MAX_TOTAL}"))
    over = files.where(F.col("length") > MAX_TOTAL).select(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string")), 256).alias("document_id"), "path", F.lit("error").alias("row_type"), F.to_json(F.struct(error.alias("error"))).alias("row"))
    return rows.unionByName(over)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path))


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of parsed rows; write or persist the rows first, they are read once a table."""
    return {kind: rows.where(F.col("row_type") == kind).select("document_id", F.from_json("row", schema, {"mode": "FAILFAST"}).alias("r")).select("document_id", "r.*") for kind, schema in SCHEMAS.items()}
