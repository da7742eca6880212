"""Small packages written with the standard library."""

import io
import zipfile

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
STRICT_W = "http://purl.oclc.org/ooxml/wordprocessingml/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STRICT_REL = "http://purl.oclc.org/ooxml/officeDocument/relationships"
NS = 'xmlns:w="{w}" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml" xmlns:wps="urn:wps"'


def part(name, body, w=W):
    root = {"document": "w:document", "styles": "w:styles", "numbering": "w:numbering", "comments": "w:comments", "commentsExtended": "w15:commentsEx", "header": "w:hdr", "footer": "w:ftr", "footnotes": "w:footnotes", "endnotes": "w:endnotes"}[name]
    if name == "document":
        body = f"<w:body>{body}</w:body>"
    return f"<{root} {NS.format(w=w)}>{body}</{root}>"


def package(document, strict=False, extra=None, **parts):
    """Bytes of a package; ``parts`` maps part kinds to their inner XML."""
    w, rel = (STRICT_W, STRICT_REL) if strict else (W, REL)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        head = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        z.writestr("_rels/.rels", f'{head}<Relationship Id="r1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>')
        rels = "".join(f'<Relationship Id="d{i}" Type="{"http://schemas.microsoft.com/office/2011/relationships" if k == "commentsExtended" else rel}/{k}" Target="{k}.xml"/>' for i, k in enumerate(parts))
        rels += f'<Relationship Id="x" Type="{rel}/hyperlink" Target="http://example.org/" TargetMode="External"/>'
        z.writestr("word/_rels/document.xml.rels", f"{head}{rels}</Relationships>")
        z.writestr("word/document.xml", part("document", document, w))
        for k, body in parts.items():
            z.writestr(f"word/{k}.xml", part(k, body, w))
        for k, body in (extra or {}).items():
            z.writestr(k, body)
    return out.getvalue()


def p(text, props="", para=None):
    run = text if text.startswith("<") else f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'
    mark = f' w14:paraId="{para}"' if para else ""
    return f"<w:p{mark}>{f'<w:pPr>{props}</w:pPr>' if props else ''}{run}</w:p>"


def r(text, props=""):
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def rev(kind, body, i="1", author="A. Ito", date="2026-01-01T00:00:00Z"):
    mark = f' w:id="{i}"' if i is not None else ""
    return f'<w:{kind}{mark} w:author="{author}" w:date="{date}">{body}</w:{kind}>'


def deleted(text):
    return f'<w:r><w:delText xml:space="preserve">{text}</w:delText></w:r>'
