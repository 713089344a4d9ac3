"""Relations between records: shared words, concepts, versions of a text, typed vectors."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import vectors as vc


def concept_pairs(chunks: DataFrame, chunk: str, slug: str, weight: float = 0.3) -> DataFrame:
    """src, dst, weight: concepts of one chunk, in both directions, once per chunk.

    A chunk holds the concepts of one passage, so its pairs are bounded by the
    passage and not by the table.
    """
    one = chunks.select(chunk, slug).distinct()
    a, b = one.select(chunk, F.col(slug).alias("src")), one.select(chunk, F.col(slug).alias("dst"))
    return a.join(b, chunk).filter("src <> dst").select(chunk, "src", "dst", F.lit(weight).alias("weight"))


def concept_table(chunks: DataFrame, chunk: str, terms: str, least: int = 2) -> DataFrame:
    """slug, occurrences, chunks, confidence of terms that recur (G27); confidence grows with the share of its chunks' terms."""
    seen = chunks.select(chunk, F.explode(terms).alias("slug"))
    per = seen.groupBy(chunk, "slug").agg(F.count("*").alias("n"))
    g = per.groupBy("slug").agg(F.sum("n").alias("occurrences"), F.count("*").alias("chunks")).filter(F.col("chunks") >= least)
    return g.withColumn("confidence", F.round(1 - 1 / (1 + F.log1p(F.col("occurrences").cast("double"))), 6))


def symbol_stems(name: Column) -> Column:
    """Parts of a name between underscores, letters and digits only, of two characters or more."""
    parts = F.transform(F.split(name, "_"), lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]", ""))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2)))


def similar_symbols(symbols: DataFrame, file: str, name: str, least: float = 0.8) -> DataFrame:
    """name_a, name_b, similarity: names of different files whose stems overlap by ``least``.

    Names of one stem set are one class. Two sets that overlap so far share one
    of the first (1 - least) n + 1 stems in order of rarity, so candidates are
    an equality join on those.
    """
    one = symbols.select(file, name).distinct().withColumn("stems", symbol_stems(F.col(name))).filter(F.size("stems") > 0)
    sets = one.select("stems").distinct().withColumn("set", F.xxhash64("stems"))
    rare = sets.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))
    ranked = sets.select("set", F.size("stems").alias("n"), F.explode("stems").alias("stem")).join(rare, "stem")
    w = Window.partitionBy("set").orderBy("df", "stem")
    lead = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    keys = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= lead).select("set", "stem")
    pairs = keys.select("stem", F.col("set").alias("set_a")).join(keys.select("stem", F.col("set").alias("set_b")), "stem").filter("set_a <= set_b").select("set_a", "set_b").distinct()
    a, b = (sets.select(F.col("set").alias(f"set_{s}"), F.col("stems").alias(f"stems_{s}")) for s in "ab")
    both = F.size(F.array_intersect("stems_a", "stems_b"))
    close = pairs.join(a, "set_a").join(b, "set_b").withColumn("similarity", F.round(both / (F.size("stems_a") + F.size("stems_b") - both), 6)).filter(F.col("similarity") >= least).select("set_a", "set_b", "similarity")
    named = one.select(F.col(file).alias("file"), F.col(name).alias("name"), F.xxhash64("stems").alias("set"))
    x, y = (named.select(*(F.col(c).alias(f"{c}_{s}") for c in named.columns)) for s in "ab")
    out = close.join(x, "set_a").join(y, "set_b").filter("file_a <> file_b and (set_a <> set_b or name_a <= name_b)")
    return out.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), "similarity").distinct()


def _numbered(df: DataFrame, name: str, group: list[str], key: str, text: str) -> DataFrame:
    """group, name, its text with hash, and the place among equal texts of the section."""
    d = df.select(*group, F.col(key).cast("string").alias(name), F.coalesce(text, F.lit("")).alias(f"{name}_text")).withColumn("_h", F.sha2(f"{name}_text", 256))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_h").orderBy(name)))


def unchanged(old: DataFrame, new: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """group, old, new: the equal chunks alone of ``version_changes``, which take a join and no comparing of texts."""
    a, b = (_numbered(df, name, group, key, text).drop(f"{name}_text") for df, name in ((old, "old"), (new, "new")))
    return a.join(b, [*group, "_h", "_n"]).filter("old is not null and new is not null").select(*group, "old", "new")


def version_changes(old: DataFrame, new: DataFrame, group: list[str], key: str, text: str, least: float = 0.6) -> DataFrame:
    """group, old, new, status, similarity: chunks of two versions matched within their section.

    Equal texts first (unchanged), then each new chunk in order takes the most
    alike one that is left (modified); the rest is removed or added. The greedy
    second step sees the chunks of one section that have no equal, and compares
    all of them; equal ones are matched by a join. ``unchanged`` is for those alone.
    """
    both = _numbered(old, "old", group, key, text).join(_numbered(new, "new", group, key, text), [*group, "_h", "_n"], "full")
    same = both.filter("old is not null and new is not null").select(*group, "old", "new", F.lit("unchanged").alias("status"), F.lit(1.0).alias("similarity"))
    kinds = dict(both.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", old string, new string, status string, similarity double"

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["old"].notna()].sort_values("old")[["old", "old_text"]].values.tolist()
        out = []
        for name, body in pdf[pdf["new"].notna()].sort_values("new")[["new", "new_text"]].values.tolist():
            best, at = 0.0, -1
            for i, (_, other) in enumerate(left):
                m = difflib.SequenceMatcher(None, other, body)
                if m.real_quick_ratio() > best and m.quick_ratio() > best:
                    r = m.ratio()
                    if r > best:
                        best, at = r, i
            if at >= 0 and best >= least:
                out.append((left.pop(at)[0], name, "modified", round(best, 3)))
            else:
                out.append((None, name, "added", 0.0))
        out += [(o, None, "removed", 0.0) for o, _ in left]
        got = pd.DataFrame(out, columns=["old", "new", "status", "similarity"])
        for g in reversed(group):
            got.insert(0, g, pdf[g].iloc[0])
        return got

    rest = both.filter("old is null or new is null").drop("_h", "_n").groupBy(*group).applyInPandas(match, schema)
    return same.union(rest)


def directed_slots(relations: dict[str, str], dim: int) -> dict[str, tuple[int, int, float]]:
    """Coordinate pair and sign of each directed relation (V9): two relations in order share a pair with opposite signs."""
    directed = sorted(r for r, d in relations.items() if d == "directed")
    if len(directed) % 2:
        raise ValueError(f"directed relations come in pairs; got {directed}")
    if directed and dim < 2:
        raise ValueError("a direction takes two dimensions")
    out = {}
    for i, r in enumerate(directed):
        at = 2 * (i // 2 % (dim // 2))
        out[r] = (at, at + 1, 1.0 if i % 2 == 0 else -1.0)
    return out


def triple_score(a: Column, b: Column, relation: str, relations: dict[str, str], dim: int) -> Column:
    """Score of a relation between two unit vectors (V9): their product, and for a directed one what differs by direction."""
    s = vc.dot(a, b)
    slot = directed_slots(relations, dim).get(relation)
    if slot is None:
        return s
    i, j, c = slot
    at = lambda v, k: F.get(v, F.lit(k)).cast("double")
    return s + c * (at(a, i) * at(b, j) - at(a, j) * at(b, i))


def predictability(records: DataFrame, key: str, body: str, dictionary: bytes) -> DataFrame:
    """key, score: how much smaller a record gets with a dictionary of its schema, within 0 and 1."""
    kind = dict(records.dtypes)[key]

    def run(batches):
        import zstandard

        plain = zstandard.ZstdCompressor(level=3)
        primed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for pdf in batches:
            out = []
            for t in pdf[body]:
                raw = (t or "").encode("utf-8")
                n = len(plain.compress(raw))
                out.append(round(max(0.0, min(1.0, 1 - len(primed.compress(raw)) / n)), 6) if raw else 0.0)
            yield pd.DataFrame({key: pdf[key], "score": out})

    return records.select(key, body).mapInPandas(run, f"{key} {kind}, score double")


def portal_candidates(vertices: DataFrame, rank: DataFrame, words: list[str], k: int = 8) -> DataFrame:
    """id, score, matched: vertices that hold words of an intent, raised a little for central ones.

    ``vertices``: id, hay (everything that names the vertex, in one text); ``rank``: id, rank.
    """
    wanted = sorted(set(words))
    low = F.lower(F.coalesce("hay", F.lit("")))
    matched = F.filter(F.array(*(F.when(low.contains(w), F.lit(w)) for w in wanted)), lambda x: x.isNotNull())
    v = vertices.withColumn("m", matched).filter(F.size("m") > 0) if wanted else vertices.withColumn("m", F.array().cast("array<string>"))
    score = F.round(F.size("m") / max(1, len(wanted)) * 0.8 + F.least(F.lit(0.2), F.coalesce("rank", F.lit(0.0)) * 3.0), 4)
    out = v.join(rank, "id", "left").select("id", score.alias("score"), F.array_join("m", ",").alias("matched"))
    return out.orderBy(F.desc("score"), "id").limit(k)


def focus_themes(themes: DataFrame, key: str, vector: str, weight: str, query: list[float] | None, k: int = 12) -> DataFrame:
    """key, score of the themes nearest to a query, else the weightiest."""
    score = F.col(weight) if not query else F.round(vc.dot(F.col(vector), F.array(*(F.lit(float(x)) for x in query))), 6)
    return themes.select(key, score.cast("double").alias("score"), weight).orderBy(F.desc("score"), F.desc(weight), key).limit(k).select(key, "score")


def granularity(slugs: DataFrame, history: DataFrame, collapse: int = 3, agree: float = 0.25) -> DataFrame:
    """action, slug: scopes to merge under one wildcard, and those to take out of one that is too coarse.

    ``slugs``: slug; ``history``: slug, drift. At least ``collapse`` scopes of a
    domain whose known drifts all stay below ``agree`` merge; where the drifts
    are that far apart, the low ones stand by themselves.
    """
    host = F.substring_index("slug", "/", 1)
    parts = F.split(host, r"\.")
    two = F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, -2), F.lit("."), F.element_at(parts, -1))).otherwise(host)
    wild = host.startswith("*.")
    m = slugs.distinct().filter(~wild).withColumn("domain", two).join(history.select("slug", "drift"), "slug", "left")
    d = m.groupBy("domain").agg(F.count("*").alias("members"), F.max("drift").alias("high"), F.min("drift").alias("low"))
    merge = (F.col("members") >= collapse) & (F.col("high") < agree)
    apart = ~F.coalesce(merge, F.lit(False)) & (F.col("high") - F.col("low") >= agree)
    reduce_ = d.filter(merge).select(F.lit("reduce").alias("action"), F.concat(F.lit("*."), "domain").alias("slug"))
    # A scope without history drifts by nothing.
    expand = m.join(d.filter(apart).select("domain"), "domain").filter(F.coalesce("drift", F.lit(0.0)) < agree).select(F.lit("expand").alias("action"), "slug")
    return reduce_.union(expand)


def blast_radius(findings: DataFrame, metrics: DataFrame, target: str) -> DataFrame:
    """findings with the reach of what they are about, 0 where it is unknown."""
    return findings.join(metrics.select(F.col("id").alias(target), F.col("betweenness").alias("blast_radius")), target, "left").withColumn("blast_radius", F.coalesce("blast_radius", F.lit(0.0)))


def unreferenced(definitions: DataFrame, references: DataFrame, name: str) -> DataFrame:
    """Definitions nothing refers to."""
    return definitions.join(references.select(name).distinct(), name, "left_anti")


def defining_files(calls: DataFrame, definitions: DataFrame, name: str, file: str) -> DataFrame:
    """src, dst, name: calls led to the files that define the name, the caller's own left out."""
    d = definitions.select(name, F.col(file).alias("dst")).distinct()
    return calls.select(name, F.col(file).alias("src")).distinct().join(d, name).filter("src <> dst").select("src", "dst", name)


def path_shares(items: DataFrame, path: str, names: list[str]) -> DataFrame:
    """total and the share of each way a result came about."""
    return items.agg(F.count("*").alias("total"), *(F.round(F.count_if(F.col(path) == n) / F.greatest(F.count("*"), F.lit(1)), 4).alias(f"{n}_ratio") for n in names))
