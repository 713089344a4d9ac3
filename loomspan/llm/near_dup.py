"""Near-duplicate records: size-banded tiles with hashed bitmap signatures.

Exact set-similarity join on the distinct words of a text. Three scans of the
text, none of which moves it:

1. word-set fingerprints of all records (class membership) and a table of word
   counts over all of them, hashed to a fixed number of cells;
2. postings. A word's cell count is an upper bound of its document frequency
   and gives one global order, rarest first; of a set of n words only the first
   n - ceil(t n) + 1 can be the first word two similar sets share, so only those
   become tile keys, and words whose cell was hit once are dropped (nobody else
   has them). A posting carries set size and a parity bitmap of the set;
3. word hashes of the sets that survived, for the exact intersection.

A tile holds the sets that share a key, ordered by size; only the band of sizes
within the threshold is compared, first by bit counts: the bits in which two
parity bitmaps differ are at most the words in which the sets differ, which
bounds the overlap from above. Survivors are intersected exactly as sorted
arrays of 64-bit word hashes.

Equal word sets are one class throughout, so copies cost one posting per task.
Tiles above ``tile_limit`` rows are cut into block pairs (see ``runs``).

Null or empty texts have no words and are similar to nothing, not even to each
other. Repeated rows of one id count once. Columns other than id and text are
ignored. No candidate is dropped at any size.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import chars, copies, runs
from loomspan.session import cut

CELLS = 1 << 22  # of the word count table: 16 MB whatever the input
SLICES = 64
FILTER_BITS = 1 << 25  # of the survivors' filter: 4 MB whatever the input
WIDE = 512  # bits of the second bitmap
SEEN = 1 << 18  # classes a task remembers so as not to post them twice


def _sets(batch: pa.RecordBatch):
    """(offset, kind per row, start of each row's words, words) of slabs of a batch."""
    texts = [chars.composed_lower(t) for t in batch.column("text").to_pylist()]
    for start, part in chars.slabs(texts):
        doc, h = chars.word_sets(part)
        edge = np.searchsorted(doc, np.arange(len(part) + 1))
        yield start, edge, h


def _fingerprints(edge: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with words, 64-bit fingerprint of their sets)."""
    size = np.diff(edge)
    rows = np.flatnonzero(size)
    at = edge[rows]
    total = np.add.reduceat(chars.mix(h * np.uint64(0xC2B2AE3D27D4EB4F)), at)
    parity = np.bitwise_xor.reduceat(h, at)
    return rows, chars.mix(total ^ chars.mix(parity + size[rows].astype(np.uint64)))


def _salt(kind: int) -> np.uint64:
    return chars.mix(np.array([kind + 1], np.uint64))[0]


def _members_and_counts(batches):
    schema = pa.schema([("kind", pa.int32()), ("id", pa.string()), ("class", pa.int64()), ("same", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
    counts = np.zeros(CELLS, np.uint32)
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for start, edge, h in _sets(batch):
            if not len(h):
                continue
            rows, fp = _fingerprints(edge, h)
            kind = kinds[start + rows]
            salt = np.zeros(len(rows), np.uint64)
            for k in np.unique(kind):
                salt[kind == k] = _salt(int(k))
            per_word = np.repeat(salt, np.diff(edge)[rows])
            cell = ((h ^ per_word) & np.uint64(CELLS - 1)).astype(np.int64)
            cell, n = np.unique(cell, return_counts=True)
            counts[cell] += n.astype(np.uint32)
            n = len(rows)
            ids, same = (batch.column(c).take(pa.array(start + rows)) for c in ("id", "same"))
            yield pa.record_batch([pa.array(kind, pa.int32()), ids, pa.array(chars.signed(fp ^ salt)), same, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
    if counts.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SLICES, -1)]
        yield pa.record_batch([pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.string()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _add_slices(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SLICES, np.uint64)
    for part in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(part), np.uint32)
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def similar_sets(records: DataFrame, threshold: float = 0.8, bitmap_words: int = 2, tile_limit: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the records (kind int, id string, text string).

    ``members``: kind, id, class, same - one row per id and text with words;
    ``same`` is the text's hash, as texts of one word set can differ.
    ``pairs``: kind, class_a, class_b, jaccard - classes of one kind whose word
    sets have intersection / union of at least ``threshold``; class_a < class_b.
    Records of different kinds are never compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = records.sparkSession
    records = records.select(F.col("kind").cast("int"), F.col("id").cast("string"), F.col("text").cast("string")).filter("id is not null and kind is not null")
    scanned = cut(records.withColumn("same", F.xxhash64("text")).mapInArrow(_members_and_counts, "kind int, id string, class long, same long, slice int, counts binary"))
    members = scanned.filter("id is not null").select("kind", "id", "class", "same").distinct()
    counts = np.zeros(CELLS, np.uint32)
    for row in scanned.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").collect():
        width = CELLS // SLICES
        counts[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    order = spark.sparkContext.broadcast(counts)
    bits = 64 * bitmap_words

    def prefix_len(n: np.ndarray) -> np.ndarray:
        return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1

    posting_cols = ["token", "size", "class", *(f"bits{i}" for i in range(bitmap_words))]

    def postings(batches):
        table = order.value
        seen: dict[int, None] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for start, edge, h in _sets(batch):
                if not len(h):
                    continue
                rows, fp = _fingerprints(edge, h)
                kind = kinds[start + rows]
                salt = np.zeros(len(rows), np.uint64)
                for k in np.unique(kind):
                    salt[kind == k] = _salt(int(k))
                fp = chars.signed(fp ^ salt)
                new = np.array([f not in seen for f in fp.tolist()])
                _, first = np.unique(fp, return_index=True)
                once = np.zeros(len(fp), np.bool_)
                once[first] = True
                new &= once
                for f in fp[new].tolist():
                    seen[f] = None
                while len(seen) > SEEN:
                    del seen[next(iter(seen))]
                size = np.diff(edge)[rows]
                take = np.repeat(new, size)
                words = (h ^ np.repeat(salt, size))[take]
                size, cls = size[new], fp[new]
                if not len(size):
                    continue
                doc = np.repeat(np.arange(len(size)), size)
                count = table[(words & np.uint64(CELLS - 1)).astype(np.int64)]
                ranked = np.lexsort((words, count, doc))
                at = np.concatenate([[0], np.cumsum(size)[:-1]])
                pos = np.arange(len(words)) - np.repeat(at, size)
                chosen = ranked[pos < np.repeat(prefix_len(size), size)]
                chosen = chosen[count[chosen] > 1]
                bit = ((words >> np.uint64(40)) % np.uint64(bits)).astype(np.int64)
                maps = []
                for i in range(bitmap_words):
                    mine = np.where(bit // 64 == i, np.uint64(1) << (bit % 64).astype(np.uint64), np.uint64(0))
                    maps.append(chars.signed(np.bitwise_xor.reduceat(mine, at)))
                d = doc[chosen]
                yield pa.record_batch([pa.array(x) for x in (chars.signed(words[chosen]), size[d], cls[d], *(m[d] for m in maps))], names=posting_cols)

    def tile_pairs(cols, cross):
        size, cls = cols["size"].astype(np.float64), cols["class"]
        maps = [chars.unsigned(cols[f"bits{i}"]) for i in range(bitmap_words)]
        again = np.append(False, (cols["token"][1:] == cols["token"][:-1]) & (cls[1:] == cls[:-1]) & (not cross))
        if again.any():
            keep = ~again
            cols = {k: v[keep] for k, v in cols.items()}
            size, cls, maps = size[keep], cls[keep], [m[keep] for m in maps]

        def keep(i, j):
            differ = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.float64) for m in maps)
            both = size[i] + size[j]
            ok = (both - differ) / 2 >= both * threshold / (1 + threshold) - 1e-6
            ok &= cls[i] != cls[j]
            if cross:
                ok &= cols["token"][i] == cols["token"][j]
                ok &= (cols["low"][i] == cols["high"][i]) | (cols["block"][i] != cols["block"][j])
            return ok

        for i, j in runs.pairs_in_runs(cols, "task" if cross else "token", lambda i, j: size[i] >= threshold * size[j] - 1e-9, keep):
            a, b = cls[i], cls[j]
            yield {"class_a": np.minimum(a, b), "class_b": np.maximum(a, b)}

    posted = records.mapInArrow(postings, ", ".join(f"{c} long" for c in posting_cols))
    candidates = cut(runs.compare(posted, "token", ["size", "class"], "class_a long, class_b long", tile_pairs, tile_limit).distinct())

    # A filter of fixed size: beyond its capacity it only lets more through.
    words_per = FILTER_BITS // 64
    cells = (
        candidates.select(F.explode(F.array("class_a", "class_b")).alias("c"))
        .select(F.pmod("c", F.lit(FILTER_BITS)).alias("bit"))
        .groupBy((F.col("bit") / 64).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) as int)))").alias("v"))
    )

    def pack(batches):
        out = np.zeros(words_per, np.int64)
        for b in batches:
            out[b.column("w").to_numpy()] |= b.column("v").to_numpy()
        yield pa.record_batch([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["v"])

    packed = np.zeros(words_per, np.int64)
    for row in cells.coalesce(1).mapInArrow(pack, "v binary").collect():
        packed |= np.frombuffer(zlib.decompress(row["v"]), np.int64)
    wanted = spark.sparkContext.broadcast(packed)

    def survivors(batches):
        flags = wanted.value.view(np.uint64)
        seen: dict[int, None] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for start, edge, h in _sets(batch):
                if not len(h):
                    continue
                rows, fp = _fingerprints(edge, h)
                kind = kinds[start + rows]
                for k in np.unique(kind):
                    fp[kind == k] ^= _salt(int(k))
                s = chars.signed(fp)
                bit = np.mod(s, FILTER_BITS)
                hit = (flags[bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1) == 1
                out_k, out_c, out_w, out_n, out_s = [], [], [], [], []
                for r in np.flatnonzero(hit).tolist():
                    c = int(s[r])
                    if c in seen:
                        continue
                    seen[c] = None
                    if len(seen) > SEEN:
                        del seen[next(iter(seen))]
                    out_k.append(int(kind[r]))
                    out_c.append(c)
                    own = h[edge[rows[r]] : edge[rows[r] + 1]]
                    out_w.append(own.tobytes())
                    out_n.append(len(own))
                    parity = np.bincount(((own >> np.uint64(20)) % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1
                    out_s.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                if out_c:
                    wide = np.array(out_s)
                    cols = [pa.array(out_k, pa.int32()), pa.array(out_c, pa.int64()), pa.array(out_n, pa.int32()), *(pa.array(wide[:, i]) for i in range(WIDE // 64)), pa.array(out_w, pa.binary())]
                    yield pa.record_batch(cols, names=["kind", "class", "n", *wide_cols, "words"])

    wide_cols = [f"w{i}" for i in range(WIDE // 64)]
    words = cut(records.mapInArrow(survivors, f"kind int, class long, n int, {', '.join(f'{c} long' for c in wide_cols)}, words binary").dropDuplicates(["class"]))

    # A wider bitmap goes first: it is a fraction of the words and turns most of the rest away.
    def wide(side: str) -> DataFrame:
        return words.select(F.col("class").alias(f"class_{side}"), F.col("n").alias(f"n_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in wide_cols))

    differ = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in wide_cols)
    both = "(n_a + n_b)"
    near = candidates.join(wide("a"), "class_a").join(wide("b"), "class_b").filter(f"({both} - ({differ})) / 2 >= {both} * {threshold / (1 + threshold)} - 1e-6").select("class_a", "class_b")
    left = words.select("kind", F.col("class").alias("class_a"), F.col("words").alias("words_a"))
    right = words.select(F.col("class").alias("class_b"), F.col("words").alias("words_b"))
    joined = near.join(left, "class_a").join(right, "class_b").select("kind", "class_a", "class_b", "words_a", "words_b")

    def exact(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                out.append(common / (len(x) + len(y) - common))
            j = np.array(out)
            ok = pa.array(j >= threshold - 1e-12)
            kept = [batch.column(c).filter(ok) for c in ("kind", "class_a", "class_b")]
            yield pa.record_batch([*kept, pa.array(j).filter(ok)], names=["kind", "class_a", "class_b", "jaccard"])

    pairs = joined.mapInArrow(exact, "kind int, class_a long, class_b long, jaccard double")
    return members, pairs


def similar_pairs(records: DataFrame, threshold: float = 0.8, paired_copies: int | None = copies.PAIRED_COPIES, form: bool = False, **kw) -> DataFrame:
    """kind, id_a, id_b of all different ids whose word sets reach ``threshold``, id_a < id_b.

    More than ``paired_copies`` equal texts take the class form, told apart by
    ``form`` (see ``copies.expand``); None pairs all copies. Different texts of
    one word set are all paired.
    """
    members, classes = similar_sets(records, threshold, **kw)
    members, classes = cut(members), cut(classes)
    return copies.expand(members, classes.select("kind", "class_a", "class_b"), ["kind"], paired_copies, form=form)


def duplicate_classes(records: DataFrame, threshold: float = 0.8, **kw) -> DataFrame:
    """kind, id, class_id, links: one row per id with words.

    ``class_id`` is the smallest id of the connected group; ``links`` counts the
    other word sets within the threshold of this one.
    """
    members, pairs = similar_sets(records, threshold, **kw)
    members, pairs = cut(members.select("kind", "id", "class").distinct()), cut(pairs.select("kind", "class_a", "class_b"))
    both = pairs.select("kind", F.col("class_a").alias("class"), F.col("class_b").alias("near")).union(pairs.select("kind", F.col("class_b").alias("class"), F.col("class_a").alias("near")))
    first = members.groupBy("kind", "class").agg(F.min("id").alias("label"))
    degree = both.groupBy("kind", "class").agg(F.count("*").alias("links"))
    linked = first.join(degree.select("kind", "class"), ["kind", "class"], "left_semi")
    labels, changed = cut(linked), True
    while changed:
        heard = both.join(labels.withColumnRenamed("class", "near"), ["kind", "near"]).groupBy("kind", "class").agg(F.min("label").alias("heard"))
        # The label's own label is taken over as well: chains halve, as in pointer jumping.
        step = labels.join(heard, ["kind", "class"]).select("kind", "class", F.least("label", "heard").alias("new"), F.col("label").alias("old"))
        jump = step.groupBy("kind", "old").agg(F.min("new").alias("best"))
        step = cut(step.join(jump, ["kind", "old"]).select("kind", "class", F.least("new", "best").alias("label"), "old"))
        changed = not step.filter("label <> old").isEmpty()
        labels = step.select("kind", "class", "label")
    flat = first.join(labels.withColumnRenamed("label", "group"), ["kind", "class"], "left").join(degree, ["kind", "class"], "left")
    return members.join(flat, ["kind", "class"]).select("kind", "id", F.coalesce("group", "label").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def minimum_overlap(a: int, b: int, threshold: float) -> int:
    """Least number of common words of sets of ``a`` and ``b`` words that reach ``threshold``."""
    return math.ceil((a + b) * threshold / (1 + threshold) - 1e-9)
