"""Signals of single records: labels, gates, slugs, keyword scores, token streams, limits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.operators import text as tx


def title_relevance(query: str, title: Column, floor: float = 0.25) -> tuple[Column, Column]:
    """(share of the query's longer words that stand in the title, label), as P19: a record below the floor is not called relevant."""
    words = [w for w in query.lower().split() if len(w) > 2]
    low = F.lower(F.coalesce(title, F.lit("")))
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    score = F.round(hits / len(words), 2) if words else F.lit(0.0)
    return score, F.when(score < floor, "citation-canon, not relevance").otherwise("relevance-verified")


def slug(text: Column, limit: int | None = None, fallback: str = "item", allow: str = "._-", strip_scheme: bool = False) -> Column:
    """A name fit for files (P24): lower case, runs of other characters as one hyphen, none at the ends."""
    s = F.lower(F.coalesce(text, F.lit("")))
    if strip_scheme:
        s = F.regexp_replace(s, "https?://", "")
    kept = "".join("\\" + c if c in "-.]^\\" else c for c in allow)
    s = F.regexp_replace(s, f"[^a-z0-9{kept}]+", "-")
    ends = "-." if "." in allow else "-"
    s = F.regexp_replace(F.regexp_replace(s, f"^[{ends}]+", ""), f"[{ends}]+$", "")
    s = F.when(s == "", fallback).otherwise(s)
    return s if limit is None else F.substring(s, 1, limit)


def scope_slug(url: Column) -> Column:
    """Host and path of an address as a scope's name."""
    base = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)", 0)
    bare = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)", ""), "^//", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(bare), "/+$", ""), r"[^a-z0-9._/\-]+", "-")
    return F.when(s == "", F.lower(url)).otherwise(s)


def login_gate(title: Column, text: Column, url: Column) -> Column:
    """Whether a page is a login page (P25): by its address, title, beginning, or several weak signs."""
    low = F.lower(F.coalesce(url, F.lit("")))
    by_url = F.greatest(*(low.contains(a) for a in fixed.GATE_ADDRESSES))
    sample = F.substring(F.coalesce(text, F.lit("")), 1, fixed.GATE_SAMPLE)
    weak = (F.regexp_count(sample, F.lit(fixed.GATE_WEAK)) >= 2) & sample.rlike(fixed.GATE_FORM)
    return by_url | F.coalesce(title, F.lit("")).rlike(fixed.GATE_TITLE) | sample.rlike(fixed.GATE_BODY) | weak


def type_scores(toks: Column) -> Column:
    """Share of each semantic type's anchors that stand among the tokens (P47), as a struct."""
    return F.struct(*(F.round(F.size(F.array_intersect(tx.lit_array(a), toks)) / len(a), 4).alias(k) for k, a in fixed.SEMANTIC_TYPES.items()))


def keyword_score(title: Column, text: Column, keywords: list[str]) -> Column:
    """How often keywords stand in a page, as substrings that do not overlap (P48); 1 without keywords."""
    if not keywords:
        return F.lit(1.0)
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return sum(((F.length(hay) - F.length(F.replace(hay, F.lit(k.lower()), F.lit("")))) / len(k) for k in keywords), F.lit(0.0))


def distinct_strings(items: Column) -> Column:
    """Strings that are not blank, each at its first place."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")))


def merged_links(*groups: Column) -> Column:
    """Addresses of several lists in canonical form, each at its first place."""
    every = F.concat(*(F.coalesce(g, F.array().cast("array<string>")) for g in groups))
    return F.array_distinct(F.filter(F.transform(F.filter(every, lambda u: u.isNotNull()), tx.canonical_url), lambda u: u != ""))


def worker_cap(ram: Column, cpus: Column, roles: Column, reserves: dict[str, float]) -> tuple[Column, Column, Column]:
    """(cap by memory, cap by cores, cap) of a host (Z2): between 1 and the roles there are.

    ``reserves``: memory kept back (``ram``), memory a worker, cores kept back (``cpus``), cores a worker.
    """
    memory = F.greatest(F.lit(0), F.floor((ram - reserves["ram"]) / reserves["ram_each"]))
    cores = F.greatest(F.lit(0), F.floor((cpus - reserves["cpus"]) / reserves["cpus_each"]))
    return memory, cores, F.greatest(F.lit(1), F.least(memory, cores, roles))


def trajectory_tokens(turns: DataFrame, key: str, content: str, entities: str) -> DataFrame:
    """key, tokens of a turn (P41): a transition mark, a number per entity, the content's bytes between marks.

    Bytes are the tokens below 256, marks follow them, entity numbers are far
    above both, so that no two kinds collide. At most ``TRAJECTORY_CHARS`` characters of the
    content are taken, as the stream is defined. Null content is empty.
    """
    begin, end, turn = (256 + i for i in range(3))
    kind = dict(turns.dtypes)[key]

    def run(batches):
        for pdf in batches:
            out = []
            for c, es in zip(pdf[content], pdf[entities], strict=True):
                row = [turn]
                for e in [] if es is None else es:
                    h = hashlib.blake2b(str(e).encode("utf-8"), digest_size=fixed.ENTITY_BYTES).digest()
                    row.append(fixed.ENTITY_BASE + int.from_bytes(h, "little"))
                out.append([*row, begin, *(c or "")[: fixed.TRAJECTORY_CHARS].encode("utf-8"), end])
            yield pd.DataFrame({key: pdf[key], "tokens": out})

    return turns.select(key, content, entities).mapInPandas(run, f"{key} {kind}, tokens array<long>")


def trajectory_text(tokens: Column) -> Column:
    """The content of a token stream: its bytes read as UTF-8."""
    hexes = F.transform(F.filter(tokens, lambda t: t < 256), lambda t: F.lpad(F.hex(t), 2, "0"))
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8")
