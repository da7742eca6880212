"""Word-processor packages written from tables: what :mod:`redloom.sources.docx` reads, for fixtures and round trips.

``write_packages`` gives one package a document part: its pieces as runs inside their revisions, a paragraph a line, and
the comments of the document.  Characters that XML cannot hold are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: names of ECMA-376
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_W14 = "http://schemas.microsoft.com/office/word/2010/wordml"
_W15 = "http://schemas.microsoft.com/office/word/2012/wordml"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_EXTENDED = "http://schemas.microsoft.com/office/2011/relationships/commentsExtended"
_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
_NO_XML = re.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")


def _root(name: str, inner: str) -> str:
    return f'<{name} xmlns:w="{_W}" xmlns:w14="{_W14}" xmlns:w15="{_W15}">{inner}</{name}>'


def run_xml(text: str, stack: list[str]) -> str:
    """A run of ``text`` inside the revisions of ``stack`` (``kind:id``), the outermost first."""
    tag = "delText" if any(r.split(":", 1)[0] == "del" for r in stack) else "t"
    out = f'<w:r><w:{tag} xml:space="preserve">{escape(_NO_XML.sub("", text))}</w:{tag}></w:r>'
    for r in reversed(stack):
        kind, wid = r.split(":", 1)
        out = f"<w:{kind} w:id={quoteattr(wid)}>{out}</w:{kind}>"
    return out


def package_bytes(pieces: list[tuple[str, list[str]]], comments: list[dict] | None = None) -> bytes:
    """A package of ``pieces`` (text, stack), each ``\\n`` with an empty stack ending a paragraph; fields of a comment may be None."""
    paragraphs, runs = [], []
    for text, stack in pieces:
        if text == "\n" and not stack:
            paragraphs.append(f"<w:p>{''.join(runs)}</w:p>")
            runs = []
        else:
            runs.append(run_xml(text, stack))
    if runs:
        paragraphs.append(f"<w:p>{''.join(runs)}</w:p>")
    parts = {"word/document.xml": _root("w:document", f"<w:body>{''.join(paragraphs)}</w:body>")}
    rels = {}
    if comments:
        said = lambda c, names: "".join(f" {n}={quoteattr(_NO_XML.sub('', c[k]))}" for n, k in names if c.get(k) is not None)
        parts["word/comments.xml"] = _root("w:comments", "".join(f"<w:comment{said(c, (('w:id', 'comment_id'), ('w:author', 'author'), ('w:initials', 'initials'), ('w:date', 'date')))}><w:p{said(c, (('w14:paraId', 'para_id'),))}>{run_xml(c['text'] or '', [])}</w:p></w:comment>" for c in comments))
        flag = {None: None, True: "1", False: "0"}
        rows = [{**c, "done": flag[c.get("resolved")]} for c in comments if c.get("para_id") is not None]
        parts["word/commentsExtended.xml"] = _root("w15:commentsEx", "".join(f"<w15:commentEx{said(c, (('w15:paraId', 'para_id'), ('w15:paraIdParent', 'parent_id'), ('w15:done', 'done')))}/>" for c in rows))
        rels = {"comments.xml": f"{_REL}/comments", "commentsExtended.xml": _EXTENDED}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{_MAIN}"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>')
        if rels:
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="c{i}" Type="{kind}" Target="{name}"/>' for i, (name, kind) in enumerate(rels.items())) + "</Relationships>")
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def write_packages(pieces: DataFrame, path: list[str], comments: DataFrame | None = None) -> DataFrame:
    """(path, length, content) of ``pieces(*path, piece_ord, text, stack)``, the values of ``path`` joined by a slash being the path.

    ``comments(*path, comment_ord, comment_id, para_id, author, initials, date, text, parent_id, resolved)`` go into the
    package of the same path.  A package is one row, as in any table of files.
    """
    rows = pieces.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("piece_ord", "text", "stack"))).alias("pieces"))
    if comments is None:
        rows = rows.withColumn("comments", F.array().cast("array<struct<comment_ord:bigint,comment_id:string,para_id:string,author:string,initials:string,date:string,text:string,parent_id:string,resolved:boolean>>"))
    else:
        own = comments.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("comment_ord", "comment_id", "para_id", "author", "initials", "date", "text", "parent_id", "resolved"))).alias("comments"))
        rows = rows.join(own, path, "left")

    def run(batches):
        for pdf in batches:
            pdf["content"] = [package_bytes([(x["text"], list(x["stack"])) for x in p], None if c is None else list(c)) for p, c in zip(pdf["pieces"], pdf["comments"])]
            pdf["length"] = pdf["content"].map(len)
            yield pdf[["path", "length", "content"]]

    return rows.select(F.concat_ws("/", *path).alias("path"), "pieces", "comments").mapInPandas(run, "path string, length long, content binary")
