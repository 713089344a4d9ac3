"""HTML to text with title and links, with the standard parser, over batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.operators import records

#: Elements without content of their own, and those that end a line.
CHROME = {"script", "style", "nav", "footer", "aside", "noscript", "form", "svg"}
BLOCKS = {"p", "div", "section", "article", "li", "tr", "br", "table", "ul", "ol", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}


def extract(html: str | None, base: str = "") -> tuple[str, str, list[str]]:
    """(text with Markdown headings and list marks, title, distinct links in order)."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.title, self.links, self.skip, self.in_title = [], [], {}, 0, False

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in CHROME:
                self.skip += 1
            if tag == "title":
                self.in_title = True
            if self.skip:
                return
            if tag == "a" and a.get("href") and not a["href"].startswith(("javascript:", "#", "mailto:")):
                self.links.setdefault(urljoin(base, a["href"]), None)
            if tag in BLOCKS:
                self.out.append("\n")
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.out.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("- ")
            elif tag in ("td", "th"):
                self.out.append(" | ")

        def handle_endtag(self, tag):
            if tag in CHROME:
                self.skip = max(0, self.skip - 1)
            if tag == "title":
                self.in_title = False
            if tag in BLOCKS and not self.skip:
                self.out.append("\n")

        def handle_data(self, data):
            if self.in_title:
                self.title.append(data)
            elif not self.skip:
                self.out.append(data)

    p = Parser()
    p.feed(html or "")
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return "\n".join(x for x in lines if x), " ".join("".join(p.title).split()), list(p.links)


#: Elements that are left out whole, and those without an end tag.
EXCLUDED = {"nav", "footer", "header", "aside", "script", "style", "form", "iframe", "noscript", "template", "svg", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def prune(html: str | None) -> str:
    """The page without blocks that score low (P28); links and images keep their addresses.

    A block's score weighs the share of text in its markup, of text outside
    links, its element, its class and its length. The sizes a score needs are
    added up once when an element closes, so a page costs one pass whatever
    its depth. Blocks of ``PRUNE_KEEP_LENGTH`` characters stay in any case.
    """
    from html import escape
    from html.parser import HTMLParser

    negative = re.compile(fixed.PRUNE_NEGATIVE)

    class Block:
        """An open element: its size so far, and the markup of what it keeps."""

        def __init__(self, tag: str, attrs: dict):
            self.tag, self.attrs, self.text, self.out = tag, attrs, "", []
            self.length, self.linked, self.markup, self.children = 0, 0, 0, 0

    def score(b: Block) -> float:
        if not b.length:
            return 0.0
        names = f"{b.attrs.get('class') or ''} {b.attrs.get('id') or ''}"
        parts = {
            "density": min(b.length / max(b.markup, 1), 1.0),
            "links": 1.0 - min(b.linked / b.length, 1.0),
            "tag": min(fixed.PRUNE_TAGS.get(b.tag, 0.5) / 1.5, 1.0),
            "class": 0.0 if negative.search(names) else 1.0,
            "length": min(b.length / 100.0, 1.0),
        }
        return sum(fixed.PRUNE_WEIGHTS[k] * v for k, v in parts.items())

    def opening(tag: str, attrs: dict, end: str) -> str:
        kept = "".join(f' {k}="{escape(v or "", quote=True)}"' for k, v in attrs.items() if k in ("href", "src", "alt", "title"))
        return f"<{tag}{kept}{end}"

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open = [Block("", {})]
            self.skipped, self.depth = "", 0

        def _settle(self):
            """Own text of the innermost element into its sizes."""
            b = self.open[-1]
            n = len(b.text.strip())
            b.length, b.markup = b.length + n, b.markup + len(b.text)
            if n:
                b.out.insert(0, escape(b.text))

        def _close(self):
            self._settle()
            b = self.open.pop()
            if b.tag == "a":
                b.linked = b.length
            up = self.open[-1]
            up.length, up.linked, up.markup, up.children = up.length + b.length, up.linked + b.linked, up.markup + b.markup + len(b.tag) + 4, up.children + 1
            if b.tag == "a" or ((b.length or b.children) and (b.length >= fixed.PRUNE_KEEP_LENGTH or score(b) >= fixed.PRUNE_LEAST)):
                up.out.append(opening(b.tag, b.attrs, ">") + "".join(b.out) + f"</{b.tag}>")
            else:
                # What goes takes its size with it.
                up.length, up.linked, up.markup, up.children = up.length - b.length, up.linked - b.linked, up.markup - b.markup - len(b.tag) - 4, up.children - 1

        def handle_starttag(self, tag, attrs):
            if self.skipped:
                self.depth += tag == self.skipped
            elif tag in EXCLUDED:
                self.skipped, self.depth = tag, 1
            elif tag in VOID:
                self.handle_startendtag(tag, attrs)
            else:
                self.open.append(Block(tag, dict(attrs)))

        def handle_startendtag(self, tag, attrs):
            if not self.skipped:
                up = self.open[-1]
                up.out.append(opening(tag, dict(attrs), "/>"))
                up.markup, up.children = up.markup + len(tag) + 4, up.children + 1

        def handle_endtag(self, tag):
            if self.skipped:
                self.depth -= tag == self.skipped
                if not self.depth:
                    self.skipped = ""
            elif any(b.tag == tag for b in self.open[1:]):
                while self.open[-1].tag != tag:
                    self._close()
                self._close()

        def handle_data(self, data):
            if not self.skipped and data.strip():
                self.open[-1].text += data

    p = Parser()
    p.feed(html or "")
    p.close()
    while len(p.open) > 1:
        p._close()
    p._settle()
    return "".join(p.open[0].out)


def main_content(df: DataFrame, key: str, html: str = "html", url: str = "url", query: list[str] | None = None, most: int | None = None) -> DataFrame:
    """key, title, text of a page's main content (P30): pruned, read as text, blocks of query words picked, cut to ``most``.

    A page of which pruning leaves no text is read whole.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = []
            for h, u in zip(pdf[html], pdf[url], strict=True):
                text, _, _ = extract(prune(h), u or "")
                whole, title, _ = extract(h, u or "") if not text.strip() or "<title" in (h or "").lower() else ("", "", [])
                rows.append((title, text if text.strip() else whole))
            yield pd.DataFrame({key: pdf[key], "title": [r[0] for r in rows], "text": [r[1] for r in rows]})

    out = df.select(key, html, url).mapInPandas(run, f"{key} {kind}, title string, text string")
    if query:
        out = out.withColumn("text", records.query_blocks(F.col("text"), query))
    return out if most is None else out.withColumn("text", F.substring("text", 1, most))


def pages(df: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """key, title, text, links of HTML pages."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            got = [extract(h, u or "") for h, u in zip(pdf[html], pdf[url], strict=True)]
            yield pd.DataFrame({key: pdf[key], "title": [g[1] for g in got], "text": [g[0] for g in got], "links": [g[2] for g in got]})

    return df.select(key, html, url).mapInPandas(run, f"{key} {kind}, title string, text string, links array<string>")
