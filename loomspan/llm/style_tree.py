"""Main content of web pages: a site style tree over the lines of pages.

The pages carry the text of their DOM as lines and all anchors, so the tree is
merged from lines: host -> presentation style of a line -> content of a line.

* Content nodes. A content is a line without marker, host name and numbers. On
  a host with m pages the importance of a content that k of them have is
  1 - log k / log m, one minus the normalised entropy of where it stands; what
  recurs is unimportant. Over all hosts a content is unimportant from a share of
  the hosts on (``host_share``); the entropy of its hosts grows with that share.
* Presentation nodes: shape of the line's link (first path segment, fragment),
  the label before a colon, the line with rare words left out, its last words, a
  leading hash sign. They are kept per host and over all hosts. A style's
  importance is composed of that of its surroundings, the share of its
  occurrences that stand beside important content, and on its own host, with the
  weight 1 - ``GAMMA``, of its own: 1 - log k / log m for k of m pages. A line
  goes if either its host or all hosts together call one of its styles
  unimportant.

Three scans: contents and words; styles; then each page with its host's tree.
Most short lines stand on many pages, so what does not depend on the page is
found once a task (``Known.lines``); only what the rules ask for is worked out.
What is common over all hosts goes to the tasks as a filter of a fixed size
(``filters``), what is known of a host only to the tasks with its pages. Hosts of
more than ``block_pages`` pages are cut into blocks by page; their contents are
counted over all their pages all the same. A host's recurring contents stand on
2 % of its pages at least, so they are at most 50 times a page's lines.

A page keeps the lines of important branches between its title and the end of
its body. Pages of which no paragraph, code, list, table or heading is left, and
pages served with an error status, have no main body. Null texts give no rows;
repeated page ids count once (the least text); null links are no links.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter, defaultdict
from contextlib import contextmanager
from operator import eq
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import filters
from loomspan.session import cut

_MARK = re.compile(r"^([*•‣◦▪\-–+]|#{1,6}|\d{1,3}[.)])\s+")
_NUMBER = re.compile(r"\d(?<!\w\d)\d*\b")  # \b\d+\b, with a first character that the search can skip to
_WORD = re.compile(r"\w+")
_TILDE = re.compile(r"~s?(?!\w)|\w+")
# \s+[|·•/>»›]\s+|\s{2,}|\s*[→←]\s*, likewise.
_PARTS = re.compile(r"[\s→←](?:(?<=\s)(?:\s*[|·•/>»›]\s+|\s+|\s*[→←]\s*)|(?<=[→←])\s*)")
_CRUMB = re.compile(r"\s+[/>»›]\s+")
_LABEL = re.compile(r"^([^:：]{2,32}?)\s?[:：]\s+(.+)$")
MARKS = "*•‣◦▪-–+#"
SHORT = 12  # words of a line whose template is looked at
LONG = 110  # characters beyond which a line is not short


def _has_parts(t: str) -> bool:
    """Whether a separator of ``_PARTS`` may stand in the text; substring tests are far cheaper than the pattern."""
    return (
        " | " in t or " · " in t or " > " in t or " / " in t or " » " in t or " › " in t or " • " in t
        or "  " in t or "→" in t or "←" in t or "\t" in t or "\xa0" in t
    )


def _h(kind: str, s: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{s}") - (1 << 63)


def _content_hash(c: str) -> int:
    """Odd for single words, which meet by chance: they have to be twice as common."""
    return (xxhash.xxh3_64_intdigest(f"c\0{c}") - (1 << 63)) & ~1 | (" " not in c)


def _tidy(s: str) -> str:
    return " ".join(s.split())


class Line:
    """A line, whatever its page. ``words`` are listed of short lines only, ``n`` counts those of any.

    What is costly is None until a rule asks for it.
    ``label``: style of the label or None, what follows it, and whether that is a list of keywords; False without.
    ``parts``: those of a line of several; empty of others.
    ``levels``: hash and level over all hosts of each of the styles, see ``Tree``.
    """

    __slots__ = ("text", "low", "mark", "key", "words", "n", "hash", "common", "label", "parts", "styles", "levels")

    def __init__(self, text: str, low: str, mark: str, key: str, words: list[str], n: int, known: Known):
        self.text, self.low, self.mark, self.key, self.words, self.n = text, low, mark, key, words, n
        self.hash = _content_hash(key)
        self.common = filters.holds(known.entries, self.hash)
        start = low[:34]  # no label is longer
        self.label = None if ":" in start or "：" in start else False
        self.parts = self.styles = self.levels = None

    def labels(self, known: Known) -> tuple[str | None, str, bool] | bool:
        if self.label is None:
            self.label = _label(self.low, known)
        return self.label

    def linked(self, anchor: str | None, anchors: dict[str, str], known: Known) -> bool:
        """Whether a line that is not common, and of which ``anchor`` is not the whole, is made of links."""
        if self.label is not False and (label := self.labels(known)) and label[1] in anchors:
            return True
        if anchor:
            return False
        parts = self.parts
        if parts is None:
            parts = self.parts = _parts(self.text[len(self.mark) :]) if _has_parts(self.text) else ()
        if not parts:
            return False
        alone = known.part
        for p in parts:
            q = alone[p]
            if q and q not in anchors:
                return False
        return True

    def styles_at(self, anchor: str | None, known: Known) -> list[str]:
        if anchor:
            return [f"a {anchor}", *_pinned(self, known)]
        if self.styles is None:
            self.styles = _pinned(self, known) if self.label is not False or self.text[0] == "#" else []
            if self.words or self.n > 8:
                self.styles += _loose(self, known)
        return self.styles


def _label(low: str, known: Known) -> tuple[str | None, str, bool] | bool:
    m = _LABEL.match(low)
    if not m:
        return False
    label, rest = _NUMBER.sub("0", m.group(1).strip()), m.group(2).strip()
    keywords = "," in rest and all(k and " " not in k.strip() for k in rest.split(", "))
    return f"p {label}" if all(map(known.words.__getitem__, _WORD.findall(label))) else None, rest, keywords


def _parts(text: str) -> list[str] | tuple:
    parts = [p for p in _PARTS.split(text.strip()) if p and p.strip()]
    return parts if len(parts) > 1 else ()


def _pinned(x: Line, known: Known) -> list[str]:
    """Styles of a line whether or not it is a link."""
    styles = []
    if x.label is not False and (label := x.labels(known)) and label[0]:
        styles.append(label[0])
    if x.text[0] == "#" and not x.mark:
        styles.append("#")
    return styles


def _loose(x: Line, known: Known) -> list[str]:
    """Styles of a line that is no link: its template, its last words."""
    styles, word = [], known.words
    if x.words:
        flags = [word[w] for w in x.words]
        if True in flags and False in flags:
            filled = " ".join([w if f else "~" for w, f in zip(x.words, flags, strict=True)])
            styles.append(f"t {x.mark[:1]}{filled}" if x.key[-1].isalnum() else f"t {x.mark[:1]}{filled}{x.key[-1]}")
    if x.n > 8 and x.text[-1].isalnum() and x.text[-1] != "0":
        tail = _WORD.findall(x.key[-60:])[-3:]
        if all([word[w] for w in tail]):
            styles.append("s " + " ".join(tail))
    return styles


def _site(host: str | None) -> tuple[str, ...]:
    """The names by which a page may call its own site."""
    host = (host or "").lower()
    labels = host.split(".")
    return tuple(x for x in (host, max(labels[:-1] or labels, key=len)) if x)


def _shape(url: str, host: str) -> str:
    """The presentation of a link: where it leads, not what it is called."""
    rest = url
    if url.startswith("https://") and url.startswith(host, 8):
        rest = url[8 + len(host) :] or "/"
    if rest[:1] == "/" and rest[1:2] != "/" and "#" not in rest and "?" not in rest:
        seg = rest[1:].split("/", 2)
        return f"/{seg[0]}/" if len(seg) > 1 and seg[1] else "/"
    try:
        u = urlsplit(url.strip())
    except ValueError:
        return "other"
    if u.scheme not in ("", "http", "https"):
        return "script"
    if u.fragment:
        return "#"
    if u.netloc and u.netloc.lower() != host:
        return "out"
    seg = [x for x in u.path.split("/") if x]
    return f"/{seg[0]}/" if len(seg) > 1 else "/"


def _folded(text: str, names: tuple[str, ...]):
    """The site's name as the page has it; of each line: as it is, in lower case, with names and numbers folded, and whether it is the same on any host."""
    low_text = text.lower()
    key_text, name = low_text, ""
    if names:
        key_text = key_text.replace(names[0], "~s")
        # A site's name in words may be a little shorter than its label in the address.
        label = names[-1]
        for n in range(len(label), max(4, len(label) - 5), -1):
            if label[:n] in key_text:
                name = label[:n]
                key_text = key_text.replace(name, "~s")
                break
    lows = low_text.split("\n")
    plain = [True] * len(lows) if key_text is low_text else list(map(eq, lows, key_text.split("\n")))
    return name, zip(text.split("\n"), lows, _NUMBER.sub("0", key_text).split("\n"), plain, strict=True)


def _row(raw: str, low: str, key: str):
    """What ``Line`` takes, of a line of ``_folded``; None of a blank one."""
    raw = raw.strip()
    if not raw:
        return None
    low, key, mark = low.strip(), key.strip(), ""
    c = raw[0]
    if c in MARKS or c.isdigit():
        m = _MARK.match(raw)
        if m:
            mark = m.group(1)
            low, m = low[m.end() :], _MARK.match(key)
            if m:
                key = key[m.end() :]
    if "  " in low or "\t" in low:
        low = _tidy(low)
    if len(key) > LONG:
        return raw, low, mark, key, (), key.count(" ") + 1
    words = _WORD.findall(key)
    n = len(words)
    return raw, low, mark, key, words if n <= SHORT else (), n


def lines_of(text: str, names: tuple[str, ...], known: Known) -> tuple[list[int], list[Line]]:
    """Numbers and lines, without blank ones."""
    name, rows = _folded(text, names)
    cache, named = known.lines, None
    nos, lines = [], []
    for no, (raw, low, key, plain) in enumerate(rows):
        if not raw:
            continue
        if plain:
            met, keep = cache, len(raw) <= LONG
        else:
            if named is None:
                named = known.named[names[0], name]
            met, keep = named, len(raw) <= 3 * LONG
        x = met.get(raw) if keep else None
        if x is None:
            r = _row(raw, low, key)
            if r is None:
                continue
            x = Line(*r, known)
            if keep:
                known.room()
                met[raw] = x
        nos.append(no)
        lines.append(x)
    return nos, lines


ITEM, FIELD = "\x01", "\x02"


def links_column():
    """All anchors of a page in one string, which is cheaper to hand over than structs."""
    one = lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit(FIELD), F.coalesce(x["url"], F.lit("")))
    return F.array_join(F.transform("links", one), ITEM)


def anchors_of(links: str | None, host: str | None, shapes: dict[str, str]) -> dict[str, str]:
    """Shape of each link by its text. ``shapes``: those of paths met before, which are alike on all hosts."""
    out: dict[str, str] = {}
    if links:
        host = (host or "").lower()
        own = f"https://{host}"
        n = len(own)
        for item in links.lower().split(ITEM):
            t, _, u = item.partition(FIELD)
            t = " ".join(t.split())
            if t and t not in out:
                rest = u[n:] if u.startswith(own) else u
                s = shapes.get(rest)
                if s is None:
                    s = _shape(u, host)
                    if len(rest) < 200 and rest[:1] == "/" and rest[1:2] != "/" and "#" not in rest and "?" not in rest:
                        if len(shapes) > 100_000:
                            shapes.clear()
                        shapes[rest] = s
                out[t] = s
    return out


class _Words(dict):
    """Whether a word is common over all hosts."""

    def __init__(self, entries: bytes):
        self.entries = entries

    def __missing__(self, w: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        k = self[w] = filters.holds(self.entries, _h("w", w) & ~1)
        return k


class _Parts(dict):
    """A part of a line as a link's text may have it, empty if it is common by itself."""

    def __init__(self, entries: bytes):
        self.entries = entries

    def __missing__(self, p: str) -> str:
        q = _tidy(p).lower()
        if filters.holds(self.entries, _content_hash(_NUMBER.sub("0", q))):
            q = ""
        if len(p) < 60:
            if len(self) > 50_000:
                self.clear()
            self[p] = q
        return q


class Known:
    """Which contents (``entries``), words and parts of lines are common over all hosts; lines and paths of links that were met before."""

    def __init__(self, entries: bytes):
        self.entries = entries
        self.words = _Words(entries)
        self.part = _Parts(entries)
        self.lines: dict[str, Line] = {}
        self.named: dict[tuple[str, str], dict[str, Line]] = defaultdict(dict)  # lines with a site's name in them, by site and name
        self.held = 0
        self.shapes: dict[str, str] = {}

    def room(self) -> None:
        """Ahead of one more line that is kept: at most 50,000 are."""
        self.held += 1
        if self.held > 50_000:
            self.lines.clear()
            for x in self.named.values():
                x.clear()  # a page may be at it
            self.named.clear()
            self.held = 1


@contextmanager
def _no_cycles():
    """Lines and their lists hold no reference cycles, so looking for them is time lost."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _quick(scan):
    def run(batches):
        with _no_cycles():
            yield from scan(batches)

    return run


def _contents(batches):
    """(entry, host) of the distinct contents and words of each host in a batch."""
    hashes: dict[str, int] = {}
    lines: dict[str, tuple[int, ...]] = {}
    for b in batches:
        by_host: dict[int, set[int]] = defaultdict(set)
        if len(hashes) > 200_000:
            hashes.clear()
        for hid, host, text in zip(*(b.column(c).to_pylist() for c in ("hid", "host", "text")), strict=True):
            found = by_host[hid]
            for raw, low, key, plain in _folded(text, _site(host))[1]:
                if not raw:
                    continue
                entries = lines.get(raw) if plain else None
                if entries is None:
                    r = _row(raw, low, key)
                    if r is None:
                        continue
                    entries = [_content_hash(r[3])]
                    for w in r[4]:
                        k = hashes.get(w)
                        if k is None:
                            k = hashes[w] = _h("w", w) & ~1
                        entries.append(k)
                    if plain and len(raw) <= LONG:
                        if len(lines) > 50_000:
                            lines.clear()
                        lines[raw] = entries
                found.update(entries)
        entries, hosts = [], []
        for hid, found in by_host.items():
            entries += found
            hosts += [hid] * len(found)
        yield pa.record_batch([pa.array(entries, pa.int64()), pa.array(hosts, pa.int64())], names=["entry", "hid"])


def _counted_contents(batches):
    """(hid, entry, pages) of the contents of each host in a batch."""
    for b in batches:
        count: dict[tuple[int, str], int] = defaultdict(int)
        for hid, host, text in zip(*(b.column(c).to_pylist() for c in ("hid", "host", "text")), strict=True):
            for c in {r[3] for x in _folded(text, _site(host))[1] if (r := _row(*x[:3]))}:
                count[hid, c] += 1
        yield pa.record_batch([pa.array([h for h, _ in count], pa.int64()), pa.array([_content_hash(c) for _, c in count], pa.int64()), pa.array(list(count.values()), pa.int64())], names=["hid", "entry", "pages"])


# What a style is judged by.
PLAIN, OPENER, LABEL, TEMPLATE, FILLED = range(5)


def _rule(style: str) -> int:
    if style[0] == "o":
        return OPENER
    if style[0] == "p":
        return LABEL
    if style[0] in "ts":
        words = _TILDE.findall(style[2:])
        slots = sum(w in ("~", "0") for w in words)
        # One text with a name filled in, on many hosts.
        return FILLED if len(words) - slots >= 5 + (slots > 1) and slots <= 2 else TEMPLATE
    return PLAIN


COUNTS = ("beside", "dull", "before", "n", "pages")


def _scan_styles(plan):
    def scan(batches):
        known = Known(plan.value)
        names: dict[str, tuple[int, int]] = {}
        for b in batches:
            seen: dict[int, dict[str, list[int]]] = defaultdict(dict)
            for hid, host, text, links in zip(*(b.column(c).to_pylist() for c in ("hid", "host", "text", "links")), strict=True):
                _, lines = lines_of(text, _site(host), known)
                anchors = anchors_of(links, host, known.shapes)
                at = [anchors.get(x.low) for x in lines]
                dull = [x.common or x.linked(a, anchors, known) for x, a in zip(lines, at, strict=True)]
                styles = [x.styles if a is None and x.styles is not None else x.styles_at(a, known) for x, a in zip(lines, at, strict=True)]
                last = len(lines) - 1
                here, of_host = set(), seen[hid]
                for i, (x, own) in enumerate(zip(lines, styles, strict=True)):
                    if x.common and not at[i]:
                        k = f"o {x.key}"
                        s = of_host.get(k)
                        if s is None:
                            s = of_host[k] = [0, 0, 0, 0, 0]
                        s[3] += 1
                        if i < last and not (nxt := lines[i + 1]).common:
                            a = at[i + 1]
                            s[0] += 1
                            s[1] += a is not None and a not in ("/", "#", "out") and nxt.n > 1 or nxt.text[0] == "#" and not nxt.mark
                            s[2] += a == "#"
                    for st in own:
                        s = of_host.get(st)
                        if s is None:
                            s = of_host[st] = [0, 0, 0, 0, 0]
                        if i and st not in styles[i - 1]:
                            s[0] += 1
                            s[1] += dull[i - 1]
                        if i < last and st not in styles[i + 1]:
                            s[0] += 1
                            s[1] += dull[i + 1]
                        s[2] += (x.label[1] in anchors or x.label[2]) if st[0] == "p" else i > 0 and dull[i - 1]
                        s[3] += 1
                        if st not in here:
                            here.add(st)
                            s[4] += 1
            if len(names) > 200_000:
                names.clear()
            ids, rules, hosts, counts = [], [], [], []
            for hid, of_host in seen.items():
                for st, s in of_host.items():
                    got = names.get(st)
                    if got is None:
                        got = names[st] = (_h("s", st), _rule(st))
                    ids.append(got[0])
                    rules.append(got[1])
                    counts.append(s)
                hosts += [hid] * len(of_host)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(rules, pa.int32()), pa.array(hosts, pa.int64()), *(pa.array([int(s[i]) for s in counts], pa.int32()) for i in range(len(COUNTS)))],
                names=["style", "rule", "hid", *COUNTS],
            )

    return _quick(scan)


def _dull_share():
    """Share of a style's occurrences in unimportant surroundings."""
    share = F.col("dull") / F.greatest(F.lit(1), F.col("beside"))
    before = F.col("before") / F.greatest(F.lit(1), F.col("n"))
    # Of a label, ``before`` counts how often a link or a list of keywords follows it.
    share = F.when((F.col("rule") == LABEL) & (before >= 0.4), F.lit(1.0)).otherwise(share)
    return F.when(F.col("rule").isin(TEMPLATE, FILLED), F.greatest(share, before)).otherwise(share)


def _levels(share):
    """2 where lines of the style go, 1 where those go that are nothing but a link."""
    return F.when(1 - share < LEAST, 2).when(1 - share < LEAST_LINK, 1).otherwise(0)


def _over_hosts(sums: DataFrame, least: int) -> DataFrame:
    """hash: what is known of the styles of many hosts, as entries of the filter."""
    total = sums.groupBy("style", "rule").agg(F.count("*").alias("hosts"), *(F.sum(c).alias(c) for c in COUNTS)).filter(F.col("hosts") >= least)
    share = F.when(F.col("rule") == FILLED, F.lit(1.0)).otherwise(_dull_share())
    opens = F.when((F.col("beside") >= 3) & (F.col("dull") >= 0.4 * F.col("beside")), 3).when((F.col("beside") >= 3) & (F.col("before") >= 0.4 * F.col("beside")), 4).otherwise(0)
    level = F.when(F.col("rule") == OPENER, opens).when(F.col("n") >= STYLED, _levels(share)).otherwise(0)
    known = total.select("style", level.cast("long").alias("level")).filter("level > 0")
    return known.select(F.col("style").bitwiseXOR(F.col("level") * LEVEL).alias("hash"))


class Tree:
    """What is known of the styles of all hosts, by name."""

    def __init__(self, data: bytes):
        self.data = data
        self.styles: dict[str, tuple[int, int]] = {}
        self.openers: dict[str, str | None] = {}

    def _has(self, style: int, level: int) -> bool:
        return filters.holds(self.data, style ^ level * LEVEL)

    def style(self, s: str) -> tuple[int, int]:
        """Hash and level of a style."""
        k = self.styles.get(s)
        if k is None:
            if len(self.styles) > 200_000:
                self.styles.clear()
            h = _h("s", s)
            k = self.styles[s] = (h, 2 if self._has(h, 2) else int(self._has(h, 1)))
        return k

    def opens(self, key: str) -> str | None:
        """Which block a common line opens."""
        if key not in self.openers:
            if len(self.openers) > 100_000:
                self.openers.clear()
            h = _h("s", f"o {key}")
            self.openers[key] = "related" if self._has(h, 3) else "contents" if self._has(h, 4) else None
        return self.openers[key]

    def level(self, x: Line, anchor: str | None, local: dict[int, int], known: Known) -> int:
        """2 where the line's branch is unimportant, 1 where it is if nothing but a link."""
        levels = None if anchor else x.levels
        if levels is None:
            levels = [self.style(s) for s in x.styles_at(anchor, known)]
            if not anchor:
                x.levels = levels
        return max([max(k, local.get(h, 0)) for h, k in levels], default=0)


LEAST = 0.35  # importance under which a branch goes
LEAST_LINK = 0.7  # and one that is nothing but a link
LEVEL = 1 << 44 | 1 << 20  # what tells the entries of a style's levels apart
STYLED = 10  # occurrences from which on a style is judged
GAMMA = 0.9  # weight of a style's surroundings against its own spread over its host's pages
CONTENT = 0.65  # importance under which a content of a host goes
RECURS = 0.02  # and the least share of its pages


def _strong(x: Line) -> bool:
    """Whether a line by itself is a piece of an article."""
    t = x.text
    return len(t) >= 60 or (x.n >= 8 and t[-1] in ".!?。！？:") or x.mark != "" or t.startswith(("$ ", "```", "|")) or " = " in t or bool(re.search(r"\w: \S|\w \| \w", t))


def keep_lines(nos: list[int], lines: list[Line], anchors: dict[str, str], title: str | None, known: Known, tree: Tree, host_common: set[int], status: int | None, local: dict[int, int]) -> list[int]:
    """Numbers of the lines of the main body."""
    if status is not None and status >= 400:
        return []
    n = len(lines)
    bare = [x.low for x in lines]
    at = list(map(anchors.get, bare))
    where: dict[str, list[int]] = defaultdict(list)
    for i, b in enumerate(bare):
        where[b].append(i)
    drop = [False] * n
    name = _tidy(title or "").lower()
    for i, x in enumerate(lines):
        a = at[i]
        if x.common or x.hash in host_common or x.linked(a, anchors, known):
            drop[i] = True
        elif not x.mark and x.n <= 30 and ("/" in x.text or ">" in x.text or "»" in x.text or "›" in x.text) and len(parts := _CRUMB.split(x.text)) > 1 and ((end := _tidy(parts[-1]).lower()) == name or end in where):
            drop[i] = True  # a path that ends in the page's own title
        elif x.text[0] in "←‹«" or x.text[-1] in "→›":
            drop[i] = True
        elif a in ("/", "script"):
            drop[i] = True
        elif a == "#":
            pass  # a heading or its entry in the contents list
        elif a and a != "out" and not x.mark and x.n > 1:
            drop[i] = True  # a branch that is nothing but a link
        elif bare[i] != name and tree.level(x, a, local, known) >= (1 if a else 2):
            drop[i] = True

    # A single word that others use as well, between lines of the body, is an item of it.
    for i in range(1, n - 1):
        x = lines[i]
        if drop[i] and not at[i] and x.n == 1 and not (drop[i - 1] or drop[i + 1]) and not tree.opens(x.key):
            drop[i] = False

    # Blocks that a common line opens.
    has_links = any(a and a not in ("/", "#") for a in at)
    i = 0
    while i < n:
        kind = tree.opens(lines[i].key) if drop[i] else None
        i += 1
        if kind is None:
            continue
        j = i
        while j < n:
            x = lines[j]
            if bare[j] == name or x.mark.startswith("#") or (x.common or x.hash in host_common):
                break
            if kind == "contents":
                if at[j] == "#" or (len(where[bare[j]]) > 1 and any(k > j or k < i - 1 for k in where[bare[j]])):
                    drop[j] = True
                else:
                    break
            else:
                if drop[j] or (at[j] and at[j] != "out") or (x.text[0] == "#" and not x.mark):
                    drop[j] = True
                elif has_links:
                    break  # what is listed here would be linked
                elif not x.mark and x.n <= 40 and j - i < 8 and len(re.findall(r"[.!?。！？]\s", x.text)) == 0 and not re.search(r" \| | = |^\$", x.text):
                    drop[j] = True
                else:
                    break
            j += 1
        i = max(i, j)
    # A contents list without a heading of its own: entries in a row that come again below.
    j = 0
    while j < n:
        k = j
        while k < n and at[k] == "#" and not lines[k].mark.startswith("#") and len(where[bare[k]]) > 1 and not drop[k]:
            k += 1
        if k - j >= 2:
            for q in range(j, k):
                drop[q] = True
        j = k + 1

    if name and name in where:
        # The title may also be listed elsewhere; the body begins at its first own line.
        first = next((i for i in where[name] if not at[i] and not (lines[i].common)), None)
        if first is not None:
            for i in reversed(range(first)):
                if drop[i] or not _strong(lines[i]) or any(drop[i + 1 : first]) or first - i <= 2:
                    drop[i] = True
            drop[first] = False
    kept = [i for i in range(n) if not drop[i]]
    strong = [i for i in kept if _strong(lines[i])]
    if not strong:
        return []
    # Weak lines cut off from the body by a dropped one.
    out = []
    for i in kept:
        if i < strong[0] and bare[i] != name and not lines[i].mark and any(drop[i + 1 : strong[0]]):
            continue
        if i > strong[-1] and any(drop[strong[-1] + 1 : i]):
            continue
        out.append(nos[i])
    return out


def host_contents(pages: list[list[Line]]) -> set[int]:
    """Contents of one host that are too evenly spread over its pages to be important."""
    m = len(pages)
    if m < 4:
        return set()
    count = Counter(k for lines in pages for k in {x.hash for x in lines})
    least = max(3, RECURS * m)
    return {k for k, c in count.items() if c >= least and 1 - math.log(c) / math.log(m) < CONTENT}


def _host_contents(pages: DataFrame, large: DataFrame) -> DataFrame:
    """hid, entry: the same of the hosts that are cut into blocks, over all their pages."""
    one = pages.join(large, "hid").groupBy("page_id", "hid").agg(F.min(F.struct("text", "host")).alias("r")).select("hid", "r.host", "r.text")
    count = one.mapInArrow(_quick(_counted_contents), "hid long, entry long, pages long").groupBy("hid", "entry").agg(F.sum("pages").alias("c"))
    size = one.groupBy("hid").agg(F.count("*").alias("m"))
    c, m = F.col("c"), F.col("m")
    recurs = (c >= F.greatest(F.lit(3.0), RECURS * m)) & (1 - F.log(c) / F.log(m) < CONTENT)
    return count.filter("c >= 3").join(size, "hid").filter(recurs).select("hid", "entry")


def _body(t: pa.Table, own: pa.Table, known: Known, tree: Tree) -> pa.Table:
    """page_id, line_no of the lines kept of pages ``t``, by what is known of their hosts (``own``) and of all."""
    recurring, local = defaultdict(set), defaultdict(dict)
    for hid, entry, level in zip(*(own.column(c).to_pylist() for c in ("hid", "entry", "level")), strict=True):
        if level:
            local[hid][entry] = level
        else:
            recurring[hid].add(entry)
    once: dict[int, dict] = {}
    for values in zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True):
        r = dict(zip(t.column_names, values, strict=True))
        o = once.get(r["page_id"])
        if o is None or r["text"] < o["text"]:
            once[r["page_id"]] = r
    by_host = defaultdict(list)
    for r in once.values():
        by_host[(r["hid"], r["host"], r["part"])].append(r)
    ids, nos = [], []
    for (hid, host, _), group in by_host.items():
        names = _site(host)
        parsed = [lines_of(r["text"], names, known) for r in group]
        found = host_contents([lines for _, lines in parsed]) if group[0]["whole"] else recurring[hid]
        for r, (at, lines) in zip(group, parsed, strict=True):
            got = keep_lines(at, lines, anchors_of(r["links"], host, known.shapes), r["title"], known, tree, found, r["status"], local[hid])
            ids += [r["page_id"]] * len(got)
            nos += got
    return pa.table({"page_id": pa.array(ids, pa.int64()), "line_no": pa.array(nos, pa.int32())})


def main_lines(pages: DataFrame, host_share: float = 0.005, block_pages: int = 2000, task_pages: int = 500) -> DataFrame:
    """page_id, line_no of the lines of the main body.

    ``pages``: page_id, host, title, text, links array<struct<url, text, ...>>, status.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", F.xxhash64("host").alias("hid"), "host", "title", "text", links_column().alias("links"), "status").filter("text is not null and page_id is not null")
    texts = pages.select("hid", "host", "text")
    sizes = cut(texts.groupBy("hid").agg(F.count("*").alias("m")))
    hosts, total = sizes.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).collect()[0]
    least = max(3, math.ceil(host_share * hosts))
    entries = texts.mapInArrow(_quick(_contents), "entry long, hid long").distinct()
    kept = entries.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= least * (1 + F.col("entry").bitwiseAND(F.lit(1))))
    common = spark.sparkContext.broadcast(filters.build(kept, "entry"))
    found = pages.select("hid", "host", "text", "links").mapInArrow(_scan_styles(common), "style long, rule int, hid long, " + ", ".join(f"{c} int" for c in COUNTS))
    sums = cut(found.groupBy("style", "rule", "hid").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    tree = spark.sparkContext.broadcast(filters.build(_over_hosts(sums, least), "hash"))

    large = sizes.filter(F.col("m") > block_pages).select("hid", F.ceil(F.col("m") / block_pages).cast("long").alias("blocks"))
    cut_up = not large.isEmpty()
    # What is known of a host alone: levels of its styles, and its recurring contents (level 0).
    own = sums.filter((F.col("n") >= STYLED) & (F.col("rule") != OPENER)).join(sizes.filter("m >= 4"), "hid")
    spread_out = 1 - F.log(F.least("pages", "m")) / F.log("m")
    level = _levels(1 - (GAMMA * (1 - _dull_share()) + (1 - GAMMA) * spread_out))
    own = own.select("hid", F.col("style").alias("entry"), level.alias("level")).filter("level > 0")
    if cut_up:
        own = own.union(_host_contents(pages.select("page_id", "hid", "host", "text"), large.select("hid")).withColumn("level", F.lit(0)))
    spread = pages
    if cut_up:
        own, spread = own.join(large, "hid", "left"), spread.join(large, "hid", "left")
    else:
        own, spread = (d.withColumn("blocks", F.lit(None).cast("long")) for d in (own, spread))
    groups = max(1, math.ceil(total / task_pages))
    task = F.pmod(F.xxhash64("hid", "part"), F.lit(groups)).alias("task")
    spread = spread.withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("blocks")), F.lit(0))).select(task, "page_id", "hid", "part", "host", "title", "text", "links", "status", F.col("blocks").isNull().alias("whole"))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0))))).select(task, "hid", "entry", "level")
    # Partitions of a bounded number of pages; a group is a few hundred pages and a host's block at most.
    n = min(groups, max(3 * spark.sparkContext.defaultParallelism, math.ceil(total / (4 * block_pages))))

    state: list = []

    def run(t: pa.Table, own: pa.Table) -> pa.Table:
        if not state:
            state.extend((Known(common.value), Tree(tree.value)))
        with _no_cycles():
            return _body(t, own, *state)

    out = spread.repartition(n, "task").groupBy("task").cogroup(own.repartition(n, "task").groupBy("task")).applyInArrow(run, "page_id long, line_no int")
    return out.distinct()
