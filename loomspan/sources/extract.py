"""Text of files of many formats (S12): text, HTML, JSON, office and e-book archives, zip and gzip.

Formats are told by content, not by name. What has no reader here (PDF, images,
sound, video, old binary office files) comes out with the format and no text.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from loomspan.sources import html

#: Bounds against archives that unfold without end: depth, members and bytes of one file.
DEPTH, MEMBERS, BYTES = 3, 10_000, 1 << 28
#: Members of office and e-book archives that hold their text.
MEMBERS_OF = {
    "docx": r"word/document\.xml",
    "pptx": r"ppt/slides/slide\d+\.xml",
    "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml",
    "odf": r"content\.xml",
    "epub": r".*\.x?html?",
}
_BREAKS = ("p", "h", "tr", "row", "br", "line-break", "table-row")


def _xml_text(data: bytes) -> str:
    """Text of an XML member, a line for each paragraph, heading or row."""
    lines: list[str] = [""]

    def walk(e: ElementTree.Element) -> None:
        tag = e.tag.rsplit("}", 1)[-1]
        lines[-1] += e.text or ""
        for child in e:
            walk(child)
            lines[-1] += child.tail or ""
        if tag in _BREAKS:
            lines.append("")

    walk(ElementTree.fromstring(data))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def kind_of_archive(names: list[str]) -> str:
    for kind, pattern in MEMBERS_OF.items():
        if kind == "epub" and "META-INF/container.xml" not in names:
            continue
        if any(re.fullmatch(pattern, n) for n in names):
            return kind
    return "zip"


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def extract(data: bytes | None, depth: int = 0) -> tuple[str, str | None]:
    """(format, text) of a file's bytes; the text is null where there is no reader or the file is damaged."""
    data = data or b""
    if not data:
        return "empty", ""
    try:
        if data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if len(infos) > MEMBERS or sum(i.file_size for i in infos) > BYTES:
                    return "zip", None
                kind = kind_of_archive([i.filename for i in infos])
                if kind == "zip":
                    if depth >= DEPTH:
                        return "zip", None
                    parts = [extract(z.read(i), depth + 1)[1] for i in sorted(infos, key=lambda i: i.filename)]
                    return "zip", "\n\n".join(p for p in parts if p)
                wanted = sorted((i.filename for i in infos if re.fullmatch(MEMBERS_OF[kind], i.filename)), key=_natural)
                read = (lambda b: html.extract(b.decode("utf-8", "replace"))[0]) if kind == "epub" else _xml_text
                return kind, "\n\n".join(t for t in (read(z.read(n)) for n in wanted) if t)
        if data[:2] == b"\x1f\x8b":
            if depth >= DEPTH:
                return "gzip", None
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
                inner = g.read(BYTES + 1)
            return "gzip", extract(inner, depth + 1)[1] if len(inner) <= BYTES else None
    except (zipfile.BadZipFile, ElementTree.ParseError, OSError, EOFError, RuntimeError, NotImplementedError, zlib.error):
        return "damaged", None
    for kind, head in (("pdf", b"%PDF"), ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("ole", b"\xd0\xcf\x11\xe0")):
        if data.startswith(head):
            return kind, None
    if b"\0" in data[:4096]:
        return "binary", None
    text = data.decode("utf-8-sig", "replace")
    head = text[:512].lstrip().lower()
    if head.startswith(("<!doctype html", "<html")) or "<body" in head:
        return "html", html.extract(text)[0]
    if head[:1] in ("{", "["):
        try:
            return "json", json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, indent=1)
        except ValueError:
            pass
    return "text", text


def texts(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, format, text of each file."""
    kind = dict(files.dtypes)[key]

    def run(batches):
        for pdf in batches:
            got = [extract(None if c is None else bytes(c)) for c in pdf[content]]
            yield pd.DataFrame({key: pdf[key], "format": [g[0] for g in got], "text": [g[1] for g in got]})

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, format string, text string")
