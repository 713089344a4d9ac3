"""Splitting oversized items at natural boundaries.

Natural places are the beginnings of sentences, headings, list items and code
blocks. Pieces come from dynamic programming over the places: a cut costs by
its kind (heading, block, sentence, word, character), a piece by how far it is
from equal size, an overlap by how far it is from the one wanted; no piece is
longer than the limit. Where no place is near, word and then character
boundaries stand in, at a price that keeps them last.

Texts up to the limit are one piece as they are; null texts are one null piece.
Everything is counted in code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations after which a full stop does not end a sentence.
ABBREVIATIONS = frozenset("abb. al. approx. aprox. art. bzw. c.-à-d. ca. cf. d.h. dr. e.g. eds. ej. env. evtl. ex. fig. ggf. i.e. inkl. mr. mrs. ms. nr. núm. p.ej. p.ex. pp. pág. resp. s. sec. st. u.a. usw. vgl. vol. vs. z.b.".split())
BEFORE_NUMBER = frozenset("no. nos. n. p. pp. s. art. ch. eq. fig. vol.".split())
OPENING, CLOSING = "([{\"'“”„«‹‘「『【（《", ")]}\"'”“»›’」』】）》"
WIDE_END = "。！？"

WRAP = 120  # longer lines are not hard-wrapped

HEADING, BLOCK, SENTENCE, WORD, CHARACTER = 0, 1, 2, 3, 4
PENALTY = (0.0, 0.05, 0.2, 3.0, 6.0)

_FENCE = re.compile(r"[ \t]*(```|~~~)")
_HASH = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
_NUMBERED_HEADING = re.compile(r"[ \t]*\d+(\.\d+)+\.?[ \t]+\S")
_BULLET = re.compile(r"[ \t]*([*•‣◦▪+\-–—])[ \t]+\S")
_NUMBER = re.compile(r"[ \t]*(\d{1,3}|[A-Za-z])[.)][ \t]+\S")
_RULE = re.compile(r"[ \t]*([=\-~_*])\1{2,}[ \t]*$")
_END = re.compile(r"[.!?。！？]+")
_LINE = re.compile(r"[^\n]*\n?")
_GAP = re.compile(r"\s+(?=\S)")


def _ends_sentence(line: str) -> bool:
    line = line.rstrip().rstrip(CLOSING + " ")
    return line.endswith((".", "!", "?", *WIDE_END, "…", ":", "：")) and not _abbreviated(line, len(line) - 1, "")


def _abbreviated(text: str, at: int, after: str) -> bool:
    """Whether the full stop at ``at`` belongs to an abbreviation; ``after`` is what follows it."""
    if text[at] != ".":
        return False
    start = at
    while start > 0 and not text[start - 1].isspace() and text[start - 1] not in "([{\"“„«‘":
        start -= 1
    word = text[start : at + 1].lower()
    if word in ABBREVIATIONS:
        return True
    if len(word) == 2 and word[0].isalpha():
        return True
    return word in BEFORE_NUMBER and after[:1].isdigit()


def _sentences(text: str, start: int, end: int) -> list[int]:
    """Beginnings of the sentences of a paragraph after its first one."""
    out = []
    for m in _END.finditer(text, start, end):
        at = m.end()
        mark = m.group()
        wide = mark[-1] in WIDE_END
        # Closing quotes and brackets belong to the sentence.
        while at < end and text[at] in CLOSING:
            c = text[at]
            # Without a space before it, only wide text can open a quote here.
            if wide and (c == "“" or (c in "\"'" and text.count(c, start, at) % 2 == 0)):
                break
            at += 1
        gap = at
        while gap < end and text[gap].isspace():
            gap += 1
        if gap < end and text[gap] in "»›" and gap - at == 1:
            at = gap = gap + 1
            while gap < end and text[gap].isspace():
                gap += 1
        if gap >= end or (gap == at and not wide):
            continue
        if mark.startswith("..") and (m.start() == start or text[m.start() - 1].isspace() or text[gap].islower()):
            continue
        if mark == "." and _abbreviated(text, m.start(), text[gap : gap + 1]):
            continue
        if text[gap] in ",;:，；：" or not any(ch.isalnum() for ch in text[gap:end]):
            continue
        out.append(gap)
    return out


def natural_places(text: str) -> list[tuple[int, int]]:
    """(position, kind) of every natural place but the one that begins the text, in order."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        if m.end() > m.start():
            lines.append((m.start(), m.group().rstrip("\r\n")))
    # Hard-wrapped text: a line is broken because the next word would not have fitted.
    fenced, widths, run = False, [0] * len(lines), []
    for i, (_, line) in enumerate([*lines, (0, "")]):
        if _FENCE.match(line):
            fenced = not fenced
        elif line.strip() and not fenced and not _RULE.match(line):
            run.append(i)
            continue
        width = max((len(lines[j][1].rstrip()) for j in run if len(lines[j][1]) <= WRAP), default=0)
        for j in run:
            widths[j] = width
        run = []

    out: list[tuple[int, int]] = []
    paragraph: list[int] = []  # start and end of the running one

    def close() -> None:
        if paragraph:
            out.extend((p, SENTENCE) for p in _sentences(text, paragraph[0], paragraph[1]))
            paragraph.clear()

    fenced, last, count = False, "", -1
    broken = True  # whether the next line begins something new
    for (at, line), width in zip(lines, widths, strict=True):
        bare = line.strip()
        begin = at + len(line) - len(line.lstrip())
        if fenced:
            if _FENCE.match(line):
                fenced, broken = False, True
            continue
        if not bare:
            close()
            broken = True
            continue
        if _FENCE.match(line):
            close()
            out.append((begin, BLOCK))
            fenced = True
            continue
        if _RULE.match(line):
            close()
            broken = True
            continue
        first_word = bare.split(None, 1)[0]
        if not broken and not _ends_sentence(last):
            # A short line was ended on purpose.
            room = width - len(last.rstrip())
            broken = max(len(line), len(last)) > WRAP or room > len(first_word) + 1
        number = _NUMBER.match(line)
        # The next number of a running list begins an item even where no stop ends the one before.
        follows = bool(number) and number.group(1).isdigit() and int(number.group(1)) == count + 1
        ended = broken or follows or _ends_sentence(last)
        if _HASH.match(line) or (ended and _NUMBERED_HEADING.match(line)):
            close()
            out.append((begin, HEADING))
            broken = True
            last = line
            continue
        if _BULLET.match(line) or (ended and number):
            count = int(number.group(1)) if number and number.group(1).isdigit() else -1
            close()
            out.append((begin, BLOCK))
            paragraph[:] = [begin + len(bare.split(None, 1)[0]), at + len(line)]
        elif broken or not paragraph:
            count = -1
            close()
            out.append((begin, SENTENCE))
            paragraph[:] = [begin, at + len(line)]
        else:
            paragraph[1] = at + len(line)
        broken, last = False, line
    close()
    lead = len(text) - len(text.lstrip())
    return sorted((p, k) for p, k in set(out) if p > lead)


def split_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of consecutive pieces of at most ``limit`` that repeat about ``overlap``.

    Candidates are at most ``near`` apart and a piece goes on from at most
    ``limit - near - 1`` before the end of the last one. The longest piece from
    any start is therefore followed by a later start, and the dynamic
    programming reaches the end of every text.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    kind = {0: HEADING, **{p: k for p, k in reversed(natural_places(text))}}
    near = max(1, min(max(20, overlap // 2), limit // 4))
    step = max(1, near // 2)
    back_most = min(2 * overlap, limit - near - 1)
    marks = [*sorted(kind), n]
    for a, b in zip(marks, marks[1:], strict=False):
        # Stand-ins where places are further apart than an overlap can bridge.
        if b - a <= near:
            continue
        p = a + step
        while p < b:
            m = _GAP.search(text, p, min(b, p + near - step))
            q = m.end() if m else p
            kind.setdefault(q, WORD if m else CHARACTER)
            p = q + step
    cand = sorted(kind)
    count = -(-(n - overlap) // (limit - overlap))
    ideal = (n + overlap * (count - 1)) / count

    def start_for(end: int) -> int:
        """The best place to go on from, for a piece that ends here."""
        lo, hi = bisect_left(cand, end - back_most), bisect_right(cand, end - near)
        options = cand[lo:hi] or [max(0, end - overlap)]
        return min(options, key=lambda p: (PENALTY[kind.get(p, CHARACTER)] + abs(end - overlap - p) / overlap, p)) if overlap else end

    ends = [*[p for p in cand if p > 0], n]
    begin = [0] + [start_for(e) if e < n else n for e in ends]
    cost, back = [0.0] + [float("inf")] * len(ends), [-1] * (len(ends) + 1)
    for i in range(len(ends)):
        s = begin[i]
        if cost[i] == float("inf"):
            continue
        for j in range(bisect_right(ends, s), len(ends)):
            e = ends[j]
            if e - s > limit:
                break
            if j + 1 <= i or begin[j + 1] <= s:
                continue
            if e == n:
                c = 0.5 * max(0.0, (ideal - (e - s)) / ideal) ** 2
            else:
                c = PENALTY[kind[e]] + PENALTY[kind.get(begin[j + 1], CHARACTER)] + ((e - s) / ideal - 1) ** 2 + 0.3 * abs(e - begin[j + 1] - overlap) / max(1, overlap) + 0.2
            if cost[i] + c < cost[j + 1]:
                cost[j + 1], back[j + 1] = cost[i] + c, i
    if cost[-1] == float("inf"):
        raise AssertionError(f"no way to cut a text of {n} characters")
    out, i = [], len(ends)
    while i > 0:
        b = back[i]
        out.append((begin[b], ends[i - 1]))
        i = b
    return out[::-1]


def places(chunks: DataFrame, limit: int = 2400) -> DataFrame:
    """chunk_id, cut_at: the natural places of every text of more than ``limit`` characters."""
    long = chunks.select("chunk_id", "text").filter(F.char_length("text") > limit)

    def run(batches):
        for b in batches:
            ids, at = [], []
            for c, t in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = natural_places(t)
                ids += [c] * len(found)
                at += [p for p, _ in found]
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(at, pa.int32())], names=["chunk_id", "cut_at"])

    # Ids with rows that differ count every place once.
    return long.mapInArrow(run, "chunk_id string, cut_at int").distinct()


def split(chunks: DataFrame, limit: int = 2400, overlap: int = 200) -> DataFrame:
    """chunk_id, parent_id, document_id, piece, span_start, span_end, text, position of all pieces.

    Repeated chunk ids of a document count once (the least text of different
    ones). An uncut chunk keeps its id; a piece's id is derived from its parent's
    and its number. Positions count from 0 in each document, in the order of the
    old position (null last) and id.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    one = chunks.groupBy("document_id", "chunk_id").agg(F.min(F.struct(F.coalesce("position", F.lit((1 << 31) - 1)).alias("old"), "text")).alias("c"))
    one = one.select("document_id", F.col("chunk_id").alias("parent_id"), "c.old", "c.text")

    def run(batches):
        for b in batches:
            keep, piece, start, end, text = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, (s, e) in enumerate(split_points(t, limit, overlap) if t is not None else [(0, 0)]):
                    keep.append(i)
                    piece.append(k)
                    start.append(s)
                    end.append(e)
                    text.append(None if t is None else t[s:e])
            take = pa.array(keep, pa.int64())
            yield pa.record_batch([*(b.column(c).take(take) for c in ("document_id", "parent_id", "old")), pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string())], names=["document_id", "parent_id", "old", "piece", "span_start", "span_end", "text"])

    # Only oversized texts go through Python.
    long = F.char_length("text") > limit
    cut_ones = one.filter(long).mapInArrow(run, "document_id string, parent_id string, old int, piece int, span_start int, span_end int, text string")
    whole = one.filter(~F.coalesce(long, F.lit(False))).select("document_id", "parent_id", "old", F.lit(0).alias("piece"), F.lit(0).alias("span_start"), F.coalesce(F.char_length("text"), F.lit(0)).alias("span_end"), "text")
    pieces = whole.withColumn("chunk_id", F.col("parent_id")).union(cut_ones.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.substring(F.sha2(F.concat_ws("|", "parent_id", "piece"), 256), 1, 16))))
    w = Window.partitionBy("document_id").orderBy("old", "parent_id", "piece")
    return pieces.select("chunk_id", "parent_id", "document_id", "piece", "span_start", "span_end", "text", (F.row_number().over(w) - 1).alias("position"))


def chunk_counts(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, document_id, chunk_count; documents without chunks have 0."""
    n = pieces.groupBy("document_id").agg(F.count("*").cast("int").alias("n"))
    return documents.select("doc_id", "document_id").join(n, "document_id", "left").select("doc_id", "document_id", F.coalesce("n", F.lit(0)).alias("chunk_count"))
