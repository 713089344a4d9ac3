"""Long exact spans shared between records: Rabin-Karp window hashes.

Every window of a record is hashed by a rolling polynomial. One row per
character would go through the shuffle if all windows of the full length were
counted, so the windows counted in Spark are selected by their content: of the
``gram``-character windows the leftmost least of every ``length - gram + 1``
consecutive ones is selected. A run of ``length`` equal characters therefore
holds the same selected gram in both records, and beside it the run reaches at
least half of the remaining length to the left or to the right. The two windows
that extend a gram by that half are its keys: no run is lost, and sharing a key
means that about two thirds of ``length`` agree already.

Two results come from the keys. ``sharing_pairs`` compares the records that share
a key around the gram; where a key is not unique in its record, by the hashes of
all windows of the full length; characters are compared before a pair comes out.
``shared_spans`` forms no pairs: the windows of the full length around repeated
keys are counted by hash in Spark, and repeated ones merge into maximal intervals.

Copies of one text are one class and cost one set of rows per task. Keys that
more than ``run_limit`` texts share are cut into block pairs (see ``runs``).

Null texts and texts shorter than ``length`` share nothing. White space, case
and control characters count as they are. Repeated ids are taken once per
different text. Columns other than id and text are ignored.
"""

from __future__ import annotations

import os.path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import chars, copies, runs
from loomspan.session import cut

SEEN = 1 << 18


def occurrences(part: list[str], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, key, position of its gram) of every key, in no order."""
    width, side = length - gram + 1, (length - gram) // 2
    cp, bounds = chars.code_points(part)
    h = chars.window_hashes(cp, gram)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    place = h & ~((np.uint64(1) << bits) - np.uint64(1)) | np.arange(len(h), dtype=np.uint64)
    least = chars.sliding_min(place, width)
    none = np.empty(0, np.int64)
    if not len(least):
        return none, none.astype(np.uint64), none
    pos = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begin = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]) | np.isin(np.arange(len(pos)), bounds))
    # A selection counts where one of its windows lies within one text.
    last = np.append(begin[1:], len(pos)) - 1
    doc = np.searchsorted(bounds, pos[begin], side="right") - 1
    first_own = np.maximum(begin, bounds[doc])
    own = first_own + length <= np.minimum(last + length, bounds[doc + 1])
    pos, doc = pos[begin][own], doc[own]
    wide = chars.window_hashes(cp, gram + side)
    left = pos - side >= bounds[doc]
    right = pos + gram + side <= bounds[doc + 1]
    d = np.concatenate([doc[left], doc[right]])
    key = np.concatenate([wide[pos[left] - side], wide[pos[right]]])
    at = np.concatenate([pos[left], pos[right]])
    return d, key, at - bounds[d]


def keys_of(part: list[str], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, key, position of its gram or -1 if the key is not unique there), distinct per text."""
    d, key, at = occurrences(part, length, gram)
    order = np.lexsort((at, key, d))
    d, key, at = d[order], key[order], at[order]
    new = np.append(True, (d[1:] != d[:-1]) | (key[1:] != key[:-1]))[: len(d)]
    start = np.flatnonzero(new)
    if len(start):
        ends = np.append(start[1:], len(d)) - 1
        at = np.where(at[start] == at[ends], at[start], -1)
    return d[start], key[start], at


def _anchors(length: int, gram: int):
    def run(batches):
        seen: dict[int, None] = {}
        for batch in batches:
            classes = batch.column("class").to_pylist()
            texts = []
            for c, t in zip(classes, batch.column("text").to_pylist(), strict=True):
                if c in seen:
                    continue
                seen[c] = None
                if len(seen) > SEEN:
                    del seen[next(iter(seen))]
                texts.append((c, t))
            for start, part in chars.slabs([t for _, t in texts]):
                cls = np.array([c for c, _ in texts[start : start + len(part)]], np.int64)
                d, key, at = keys_of(part, length, gram)
                yield pa.record_batch([pa.array(chars.signed(key)), pa.array(cls[d]), pa.array(at)], names=["key", "class", "pos"])

    return run


def _key_pairs(cols, cross):
    cls = cols["class"]
    if not cross:
        again = np.append(False, (cols["key"][1:] == cols["key"][:-1]) & (cls[1:] == cls[:-1]))
        if again.any():
            cols = {k: v[~again] for k, v in cols.items()}
            cls = cols["class"]
    pos = cols["pos"]

    def keep(i, j):
        ok = cls[i] != cls[j]
        if cross:
            ok &= cols["key"][i] == cols["key"][j]
            ok &= (cols["low"][i] == cols["high"][i]) | (cols["block"][i] != cols["block"][j])
        return ok

    for i, j in runs.pairs_in_runs(cols, "task" if cross else "key", lambda i, j: np.ones(len(i), np.bool_), keep):
        swap = cls[i] > cls[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        yield {"class_a": cls[i], "class_b": cls[j], "pos_a": pos[i], "pos_b": pos[j]}


def _runs_here(a: str, b: str, pa_: int, pb: int, length: int) -> bool:
    """Whether a run of ``length`` through these positions is common."""
    ahead = len(os.path.commonprefix([a[pa_ : pa_ + length], b[pb : pb + length]]))
    back = len(os.path.commonprefix([a[max(0, pa_ - length) : pa_][::-1], b[max(0, pb - length) : pb][::-1]]))
    return ahead + back >= length


def common_windows(a: str, b: str, length: int) -> bool:
    """Whether a window of one text stands in the other, hashes checked against the characters."""
    ha, hb = (chars.window_hashes(chars.code_points([t])[0], length) for t in (a, b))
    first: dict[int, int] = {}
    both = np.intersect1d(ha, hb)
    for i in np.flatnonzero(np.isin(hb, both))[::-1].tolist():
        first[int(hb[i])] = i
    for i in np.flatnonzero(np.isin(ha, both)).tolist():
        j = first[int(ha[i])]
        if a[i : i + length] == b[j : j + length]:
            return True
    return False


def _verify(length: int):
    def shared(a: str, b: str, row: dict) -> bool:
        for x, y in {(row["first"]["pos_a"], row["first"]["pos_b"]), (row["last"]["pos_a"], row["last"]["pos_b"])}:
            if x >= 0 and y >= 0 and _runs_here(a, b, x, y, length):
                return True
        known = min(row["first"]["pos_a"], row["first"]["pos_b"], row["lowest"]) >= 0
        if known and (row["n"] <= 2 or row["first"] == row["last"]):
            return False
        return common_windows(a, b, length)

    def run(batches):
        for batch in batches:
            rows = [(r["class_a"], r["class_b"]) for r in batch.to_pylist() if shared(r["text_a"], r["text_b"], r)]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["class_a", "class_b"])

    return run


def _gram(length: int, gram: int) -> int:
    return gram or max(8, length * 8 // 25)


def _classes(docs: DataFrame, length: int) -> DataFrame:
    """id, class, text of the texts that are long enough; equal texts have one class."""
    return docs.select("id", F.xxhash64("text").alias("class"), "text").filter(F.char_length("text") >= length)


def candidate_pairs(docs: DataFrame, length: int, gram: int, run_limit: int) -> DataFrame:
    """class_a < class_b of texts that share a key, with the outermost positions of their keys."""
    posted = _classes(docs, length).select("class", "text").mapInArrow(_anchors(length, gram), "key long, class long, pos long")
    pairs = runs.compare(posted, "key", ["class"], "class_a long, class_b long, pos_a long, pos_b long", _key_pairs, run_limit)
    at = F.struct("pos_a", "pos_b")
    return pairs.groupBy("class_a", "class_b").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min(F.least("pos_a", "pos_b")).alias("lowest"), F.count("*").alias("n"))


def _matches(docs: DataFrame, length: int, gram: int, run_limit: int) -> DataFrame:
    pairs = cut(candidate_pairs(docs, length, _gram(length, gram), run_limit))
    texts = _classes(docs, length).select("class", "text").dropDuplicates(["class"])
    a = texts.select(F.col("class").alias("class_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("class").alias("class_b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "class_a").join(b, "class_b")
    return both.mapInArrow(_verify(length), "class_a long, class_b long")


def sharing_pairs(docs: DataFrame, length: int = 200, gram: int = 0, run_limit: int = 8192, paired_copies: int | None = copies.PAIRED_COPIES, form: bool = False) -> DataFrame:
    """id_a, id_b (smaller first) of records with a common run of at least ``length`` characters.

    ``docs``: id, text. ``gram`` 0 takes a third of the length. Groups of more
    than ``paired_copies`` equal texts take the class form, told apart by
    ``form`` (see ``copies.expand``); None pairs all copies.
    """
    classes = cut(_matches(docs, length, gram, run_limit))
    members = cut(_classes(docs, length).select("id", "class").distinct())
    return copies.expand(members, classes, [], paired_copies, form=form)


def _repeated_windows(length: int, gram: int):
    """Windows that hold a gram of a repeated key; ``first`` marks one of each hash in a text."""

    def run(batches):
        for batch in batches:
            hashes, classes, starts, firsts = [], [], [], []
            for c, t, keys in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist(), batch.column("keys"), strict=True):
                _, key, at = occurrences([t], length, gram)
                at = at[np.isin(chars.signed(key), keys.values.to_numpy())]
                h = chars.window_hashes(chars.code_points([t])[0], length)
                # A window that holds a gram begins at most length - gram before it.
                edge = np.zeros(len(h) + 1, np.int32)
                np.add.at(edge, np.maximum(at - (length - gram), 0), 1)
                np.add.at(edge, np.minimum(at + 1, len(h)), -1)
                pos = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                h = h[pos]
                once = np.zeros(len(h), np.bool_)
                once[np.unique(h, return_index=True)[1]] = True
                hashes.append(chars.signed(h))
                classes.append(np.full(len(h), c, np.int64))
                starts.append(pos.astype(np.int32))
                firsts.append(once)
            if hashes:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (hashes, classes, starts, firsts)], names=["window", "class", "pos", "first"])

    return run


def _merge(length: int):
    """Maximal intervals from (class, pos, n) rows in order of class and pos."""

    def run(batches):
        open_ = None  # class, start, end, most
        for batch in batches:
            cls, pos, n = (batch.column(c).to_numpy() for c in ("class", "pos", "n"))
            if not len(cls):
                continue
            new = np.append(True, (cls[1:] != cls[:-1]) | (pos[1:] > pos[:-1] + length))
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(cls)) - 1
            spans = list(zip(cls[at].tolist(), pos[at].tolist(), (pos[ends] + length).tolist(), np.maximum.reduceat(n, at).tolist(), strict=True))
            if open_ is not None:
                c, s, e, m = spans[0]
                if c == open_[0] and s <= open_[2]:
                    spans[0] = (c, open_[1], e, max(m, open_[3]))
                else:
                    spans.insert(0, open_)
            open_ = spans.pop()
            yield _span_rows(spans)
        if open_ is not None:
            yield _span_rows([open_])

    return run


def _span_rows(spans: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([s[k] for s in spans], pa.int64()) for k in range(4)], names=["class", "span_start", "span_end", "partners"])


def shared_spans(docs: DataFrame, length: int = 200, gram: int = 0) -> DataFrame:
    """id, span_start, span_end, partners: maximal intervals of each record that stand elsewhere.

    No pair of records is formed. Keys that at least two texts have lead to the
    windows of the full length around their grams; those windows are counted by
    hash, one count per text, and the ones of at least two texts merge into
    maximal intervals. Rows are in proportion to the characters near a repeated
    key. Two windows of one 64-bit hash count as equal here.

    Positions are code points, the end exclusive; overlapping finds merge, and
    ``partners`` is the largest number of other texts that hold one and the same
    window of the interval. A text held by several ids is shared as a whole,
    with its other ids as partners where they are more.
    """
    gram = _gram(length, gram)
    texts = _classes(docs, length).select("class", "text").dropDuplicates(["class"])
    # Whether a key stands in two texts shows in its least and greatest class, which combine ahead of the shuffle.
    keys = cut(texts.mapInArrow(_anchors(length, gram), "key long, class long, pos long").select("key", "class"))
    repeated = keys.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key")
    wanted = keys.join(repeated, "key").groupBy("class").agg(F.collect_list("key").alias("keys"))
    windows = cut(texts.join(wanted, "class").mapInArrow(_repeated_windows(length, gram), "window long, class long, pos int, first boolean"))
    counted = windows.filter("first").groupBy("window").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    found = windows.join(counted, "window").select("class", "pos", "n").repartition("class").sortWithinPartitions("class", "pos")
    merged = found.mapInArrow(_merge(length), "class long, span_start long, span_end long, partners long")
    members = cut(_classes(docs, length).select("id", "class", F.char_length("text").cast("long").alias("size")).distinct())
    whole = members.groupBy("class").agg(F.countDistinct("id").alias("c"), F.max("size").alias("size")).filter("c > 1")
    spans = merged.join(members, "class").join(whole.select("class", "c"), "class", "left").filter("c is null").select("id", "span_start", "span_end", "partners")
    most = merged.groupBy("class").agg(F.max("partners").alias("partners"))
    copied = members.join(whole.select("class", "c"), "class").join(most, "class", "left").select("id", F.lit(0).cast("long").alias("span_start"), F.col("size").alias("span_end"), F.greatest(F.col("c") - 1, F.coalesce("partners", F.lit(0))).alias("partners"))
    # An id with several texts has the spans of each.
    return spans.union(copied)


def share_report(docs: DataFrame, length: int = 200, gram: int = 0) -> DataFrame:
    """id, n_chars, n_spans, shared_chars, shared_fraction for every record.

    Null texts count 0 characters; the fraction of an empty record is 0.
    """
    spans = shared_spans(docs, length, gram).groupBy("id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    size = docs.groupBy("id").agg(F.coalesce(F.max(F.char_length("text")), F.lit(0)).cast("long").alias("n_chars"))
    n, s = F.coalesce("n_spans", F.lit(0)).cast("long"), F.coalesce("shared_chars", F.lit(0)).cast("long")
    return size.join(spans, "id", "left").select("id", "n_chars", n.alias("n_spans"), s.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(s / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_fraction"))
