import random
import re
from types import SimpleNamespace

import pyarrow as pa

from loomspan.llm import filters, style_tree

SCHEMA = "page_id long, host string, title string, text string, links array<struct<url:string,text:string,rel:string>>, status int, extra string"
NAV = ["Home", "Docs", "Pricing"]
FOOT = ["Was this page helpful?", "© 2024 Acme. All rights reserved.", "Terms · Privacy"]


def page(i, host, body, title, links=True, status=200):
    lines = ["Skip to content", *NAV, f"Home > Guides > {title}", title, "4 min read", *body, "Related articles", f"Another story about thing {i}", *FOOT]
    a = [(f"https://{host}/{n.lower()}", n, None) for n in NAV] + [(f"https://{host}/docs/{i}x", f"Another story about thing {i}", "related")]
    return (i, host, title, "\n".join(lines), a if links else None, status, "x"), {j for j, x in enumerate(lines) if x == title and j > 4 or x in body}


def site():
    rows, want = [], {}
    for i in range(40):
        body = [f"The machine u{i}x was opened by the crew of v{i}y at night and nobody knew what it held inside.", f"## Part {'abcdefgh'[i % 8]} of story {i}q", f"* item v{i}z: {i}", f"A second paragraph tells how unit u{i}k came to rest near the station after dark."]
        r, w = page(i, f"docs.host{i % 10}.example", body, f"Story of the machine m{i}x", links=i % 9 != 0)
        rows.append(r)
        want[i] = w
    return rows, want


def test_body_is_kept_and_the_rest_removed(spark):
    rows, want = site()
    got = {}
    for r in style_tree.main_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["page_id"], set()).add(r["line_no"])
    right = sum(len(got.get(i, set()) & w) for i, w in want.items())
    assert right / sum(map(len, want.values())) > 0.97
    assert right / sum(len(v) for v in got.values()) > 0.97


def test_hosts_in_blocks(spark):
    rows, want = site()
    got = style_tree.main_lines(spark.createDataFrame(rows, SCHEMA), block_pages=2).count()
    assert got >= 0.9 * sum(map(len, want.values()))


def test_dirty_pages(spark):
    rows, _ = site()
    rows += [rows[0], (100, None, None, "", None, None, None), (101, "h", None, None, [], 200, None), (102, "docs.host1.example", "Page not found", "Skip to content\nHome\nPage not found\nTerms · Privacy", None, 404, None), (103, "a.b", "t", "word " * 200_000, [(None, None, None), ("::bad[", "x", "y")], 200, None), (None, "h", None, "x", None, 200, None)]
    got = style_tree.main_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert not {100, 101, 102, None} & {r["page_id"] for r in got}
    assert style_tree.main_lines(spark.createDataFrame([], SCHEMA)).count() == 0


class _Counted:
    """A pattern that counts how often it is asked for all words of a line."""

    def __init__(self, pattern):
        self.pattern, self.asked = pattern, 0

    def findall(self, s):
        self.asked += 1
        return self.pattern.findall(s)


def batch(pages):
    hid, host, text, links = zip(*pages, strict=True)
    return pa.record_batch([pa.array(hid, pa.int64()), pa.array(host, pa.string()), pa.array(text, pa.string()), pa.array(links, pa.string())], names=["hid", "host", "text", "links"])


def test_lines_of_many_pages_are_taken_apart_once(monkeypatch):
    lines = [*NAV, "Home > Guides > Story", "* a list item of the site", *FOOT]
    pages = batch([(i, f"docs.host{i}.example", "\n".join(lines), None) for i in range(100)])
    no_entries = SimpleNamespace(value=bytes(filters.BITS // 8))
    for scan in (style_tree._contents, style_tree._scan_styles(no_entries)):
        counted = _Counted(re.compile(r"\w+"))
        monkeypatch.setattr(style_tree, "_WORD", counted)
        rows = sum(b.num_rows for b in scan(iter([pages])))
        assert counted.asked <= 2 * len(lines)  # not those of 100 pages
        assert rows % 100 == 0  # each host's are there all the same


def test_lines_met_on_other_hosts_change_nothing():
    texts = ["News of Dusranix\n1. Read 12 more\n© 2024 Dusranix 7", "News of Dusranix\nSee www.dusranix.example\n1. Read 12 more\n  1. Read 13 more  \nA | B  c\t→ d"]
    pages = [(i, f"www.{n}.example", t, None) for i, (n, t) in enumerate((n, t) for t in texts for n in ("dusranix", "other", "dusranixum"))]
    common = filters_of("news of ~s", "a", "read")
    for scan in (style_tree._contents, style_tree._counted_contents, style_tree._scan_styles(SimpleNamespace(value=common))):
        rows = lambda many: sorted(tuple(r.values()) for one in many for b in scan(iter([batch(one)])) for r in b.to_pylist())  # noqa: B023, E731
        assert rows([pages]) == rows([[p] for p in pages])


def filters_of(*contents):
    """A filter that holds some contents and words."""
    data = bytearray(filters.BITS // 8)
    mask = filters.BITS - 1
    for c in contents:
        for h in (style_tree._content_hash(c), style_tree._h("w", c) & ~1):
            at, step = h & mask, ((h & 0xFFFFFFFFFFFFFFFF) >> 26) & mask | 1
            for _ in range(filters.PROBES):
                data[at >> 3] |= 1 << (at & 7)
                at = at + step & mask
            assert filters.holds(bytes(data), h)
    return bytes(data)


def test_quick_patterns_equal_the_plain_ones():
    plain_number, plain_parts = re.compile(r"\b\d+\b"), re.compile(r"\s+[|·•/>»›]\s+|\s{2,}|\s*[→←]\s*")
    pick = random.Random(1)
    for _ in range(20_000):
        x = "".join(pick.choice("a1 _|/→←•\t\xa0٣².-") for _ in range(pick.randrange(12)))
        assert style_tree._NUMBER.sub("0", x) == plain_number.sub("0", x)
        assert style_tree._PARTS.split(x) == plain_parts.split(x)
