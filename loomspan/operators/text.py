"""Row-level text operators: scores, mentions, redaction, risk. Built-in columns only."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import fixed


def lit_array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def words_of(text: Column) -> Column:
    """White-space separated words, none for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column, profile: str = fixed.WORD, min_len: int = 1, stop=(), unique: bool = False) -> Column:
    """Lower-case tokens of a profile (P1). Null text has none."""
    out = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(profile), F.lit(0))
    if min_len > 1 or stop:
        stops = lit_array(stop) if stop else F.array().cast("array<string>")
        out = F.filter(out, lambda t: (F.length(t) >= min_len) & ~F.array_contains(stops, t))
    return F.array_distinct(out) if unique else out


def ngrams(toks: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by a blank."""
    count = F.size(toks) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))
    return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Trimmed sentences, split after a stop with white space and at line breaks."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), fixed.SENTENCE_GAP), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def word_count(text: Column) -> Column:
    """White-space separated words, without building the list of them."""
    return F.regexp_count(text, F.lit(r"\S+"))


def alpha_ratio(text: Column) -> Column:
    """Letters over characters that are not white space; 0 for blank text."""
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.when(solid > 0, F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / solid).otherwise(0.0)


def _hits(low: Column, listed) -> Column:
    """Words that are listed, commas and stops at their end aside."""
    return F.regexp_count(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(r"(?<=\s)(?:" + "|".join(listed) + r")[,.]*(?=\s)"))


def signal(text: Column) -> Column:
    """Whether a number, a reference or a code stands in the text."""
    return text.rlike(fixed.NUMERIC) | text.rlike(fixed.REF) | text.rlike(fixed.CODE)


def fact_score(text: Column) -> Column:
    """Procedure words over narrative ones, plus signals, minus markup (P5); 0 for blank text.

    Patterns instead of lists of words: the whole score stays in generated code.
    """
    low = F.lower(text)
    n = word_count(text)
    one = lambda p: text.rlike(p).cast("double")
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    # Substring tests keep the costly patterns for the few texts that can match them.
    holds = lambda ws: F.greatest(*(text.contains(w) for w in ws))
    markup = F.when(holds(fixed.MARKUP_HINTS), F.regexp_count(text, F.lit(fixed.MARKUP))).otherwise(0)
    markup = markup + F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit(fixed.MATH))).otherwise(0)
    markup = markup + F.when((pipes >= 4) | ((pipes > 0) & text.rlike(fixed.TABLE_ROW)), 4).otherwise(0) + F.when(holds(fixed.TEMPLATE_MARKS), 6).otherwise(0)
    score = _hits(low, fixed.PROCEDURE) / n * 2.0 - _hits(low, fixed.NARRATIVE) / n * 1.5 + one(fixed.NUMERIC) + one(fixed.CODE) + one(fixed.REF)
    score = score - F.least(markup, F.lit(8)) * 0.5 - F.when(alpha_ratio(text) < 0.55, 3.0).otherwise(0.0)
    return F.when(text.isNull() | (n == 0), 0.0).otherwise(score)


def chunk_kind(score: Column) -> Column:
    return F.when(score >= 1.0, "rule").when(score >= 0.6, "fact").otherwise("narrative")


def kept_sentences(text: Column, threshold: float = 0.6) -> Column:
    """Sentences that score or carry a signal; Spark evaluates the same expression of several outputs once."""
    return F.filter(sentences(text), lambda s: (fact_score(s) >= threshold) | signal(s))


def stem_text(text: Column, threshold: float = 0.6) -> Column:
    """Sentences that score or carry a signal, joined by a blank."""
    return F.array_join(kept_sentences(text, threshold), " ")


def fact_sentences(text: Column, threshold: float = 0.6) -> Column:
    """The same sentences, each once in order of first sight."""
    return F.array_distinct(kept_sentences(text, threshold))


def version_bucket(text: Column, as_of: date) -> Column:
    """Current, Upcoming or Previous; the first cue decides."""
    low = F.lower(text)
    has = lambda ws: F.greatest(*(low.contains(w) for w in ws))
    return (
        F.when(low.contains("v36"), "Upcoming" if as_of < fixed.UPCOMING_DATE else "Current")
        .when(has(fixed.UPCOMING_WORDS), "Upcoming")
        .when(has(fixed.PREVIOUS_WORDS) | text.rlike(fixed.PREVIOUS_VERSION), "Previous")
        .otherwise("Current")
    )


def bucket_top(facts: DataFrame, as_of: date, limit: int) -> DataFrame:
    """Best ``limit`` facts of each version bucket, by score then id, both descending."""
    b = facts.filter(F.trim("fact_text") != "").withColumn("bucket", version_bucket(F.col("fact_text"), as_of))
    w = Window.partitionBy("bucket").orderBy(F.desc("fact_score"), F.desc("fact_id"))
    return b.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def _any_word(text: Column, words) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(words) + r")\b"))


def fact_density(text: Column) -> Column:
    """Procedure minus half the narrative words per ten words, within 0 and 1 (P10)."""
    proc = _any_word(text, fixed.PROCEDURE)
    narr = _any_word(text, fixed.NARRATIVE + fixed.NARRATIVE_MORE)
    n = F.greatest(word_count(text), F.lit(1))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (proc - 0.5 * narr) / n * 10)), 4)


def noise_score(text: Column, score: Column) -> Column:
    """Noise from 0 to 1 (P11); a positive fact score counts for 60 %."""
    n = word_count(text)
    boiler = _any_word(text, fixed.BOILERPLATE)
    shouting = F.regexp_count(text, F.lit(r"[!?]{2,}|[A-Z]{4,}"))
    links = F.regexp_count(text, F.lit(r"\[.*?\]\(https?://[^\)]+\)")) / F.greatest(n, F.lit(1))
    one = F.lit(1.0)
    h = 0.30 * F.least(one, boiler / 3) + 0.20 * F.least(one, shouting / 5) + 0.20 * F.least(one, links * 10) + 0.30 * (1.0 - fact_density(text))
    mixed = F.when(score > 0, 0.60 * (1.0 - F.least(score, one)) + 0.40 * h).otherwise(h)
    return F.when(n == 0, 1.0).when(n < 8, 0.85).otherwise(F.round(F.least(one, F.greatest(F.lit(0.0), mixed)), 4))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two lists as lower-case sets, 0 if either is empty."""
    x, y = (F.array_distinct(F.transform(c, F.lower)) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(both / F.size(F.array_union(x, y)), 4)).otherwise(0.0)


def mentions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, entity_type, mention, nth of every entity mention (P14); ``nth`` counts within a type."""
    t = F.coalesce(F.col(text), F.lit(""))
    typed = F.array(*(F.struct(F.lit(k).alias("entity_type"), F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)).alias("found")) for k, p in fixed.MENTIONS.items()))
    one = df.select(key, F.explode(typed).alias("m"))
    return one.select(key, "m.entity_type", F.posexplode("m.found").alias("nth", "mention"))


def redact(text: Column) -> Column:
    """Credential values replaced whole."""
    return F.regexp_replace(text, fixed.SECRET, "[REDACTED]")


def injection_risk(text: Column) -> tuple[Column, Column]:
    """(risk from 0 to 1, verdict) of instructions hidden in a text (P16). Null and empty text proceed."""
    t = F.coalesce(text, F.lit(""))
    total = F.when(t.rlike(fixed.OBFUSCATION), fixed.OBFUSCATION_WEIGHT).otherwise(0.0)
    for weight, pattern in fixed.INJECTION.values():
        total = total + F.when(t.rlike(pattern), weight).otherwise(0.0)
    risk = F.least(F.lit(1.0), F.round(total, 3))
    verdict = F.lit("proceed")
    for name, least in reversed(fixed.VERDICTS.items()):
        verdict = F.when(risk >= least, name).otherwise(verdict)
    return risk, verdict


def sanitize(text: Column) -> Column:
    """Without control characters, trimmed, cut to the limit."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")), 1, fixed.SANITIZE_LIMIT)


def source_validity(text: Column, url: Column) -> Column:
    """Null for a usable page, else the first layer that refuses it and its marker."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bag = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z]+://", "")
    bag = F.regexp_replace(bag, r"#.*$", "")
    toks = F.filter(F.split(bag, r"[^a-z0-9]+"), lambda t: t != "")
    out = F.when(F.length(F.regexp_replace(low, r"\s+", "")) < 20, F.lit("empty"))
    for layer, markers in (("captcha", fixed.CAPTCHA_MARKERS), ("login", fixed.LOGIN_MARKERS), ("denied", fixed.DENIED_MARKERS)):
        for m in markers:
            out = out.when(low.contains(m), F.lit(f"{layer}:{m}"))
    for frag in fixed.CHALLENGE_FRAGMENTS:
        parts = frag.split("-")
        out = out.when(bag.contains(frag) | (F.size(F.array_intersect(toks, lit_array(parts))) == len(parts)), F.lit(f"url:{frag}"))
    scripts = F.regexp_count(low, F.lit(r"<script\b"))
    visible = F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")))
    out = out.when(low.rlike(r"<input[^>]*type=[\"']?password"), F.lit("password field"))
    return out.when((scripts > 3) & (visible < 200), F.lit("scripts")).otherwise(F.lit(None).cast("string"))


def canonical_url(url: Column) -> Column:
    """Fragment off, scheme and host in lower case, default ports off, empty path ``/`` (P20)."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    scheme = F.lower(F.regexp_extract(u, r"^([^:]+)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[^:]+://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    rest = F.regexp_extract(u, r"^[^:]+://[^/?]*(.*)$", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.concat(scheme, F.lit("://"), host, rest))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def private_host(host: Column) -> Column:
    """Loopback, private, link-local and local-only hosts."""
    h = F.regexp_replace(F.lower(F.trim(host)), r"^\[|\](:\d+)?$|:\d+$", "")
    return h.rlike(r"^(127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|0\.0\.0\.0$|255\.255\.255\.255$|localhost$|::1$|::$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)|\.(local|internal|localhost)$")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits (P23); 0 for empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)), F.lit(0.0))


def url_risk(url: Column) -> tuple[Column, Column]:
    """(lexical risk from 0 to 100, decision) of an address (P22); feed matches are a join for the caller."""
    host = host_of(url)
    name = F.regexp_replace(host, r":.*$", "")
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    digits = F.length(F.regexp_replace(name, r"\D", ""))
    both = F.concat(host, path)
    hits = sum((both.contains(t).cast("int") for t in fixed.RISKY_TOKENS), F.lit(0))
    add = lambda c, v: F.when(c, v).otherwise(0)
    score = (
        add(name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), 35)
        + add(name.contains("xn--"), 25)
        + add((dots > 0) & F.regexp_extract(name, r"([^.]*)$", 1).isin(fixed.RISKY_TLDS), 20)
        + add(dots >= 4, 15)
        + add(entropy(name) > 3.5, 20)
        + add((F.length(name) > 0) & (digits / F.length(name) > 0.3), 10)
        + add(F.length(url) > 120, 10)
        + F.least(F.lit(20), 7 * hits)
        + add((host != "") & host.contains("@"), 30)
    )
    risk = F.least(F.lit(100), score)
    return risk, F.when(risk > fixed.RISK_REVIEW_MAX, "block").when(risk > fixed.RISK_ALLOW_MAX, "review").otherwise("allow")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def intent(text: Column) -> tuple[Column, Column]:
    """(class by keyword count, share of all hits) (P36); ties go to the class declared first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [(name, sum((low.contains(k).cast("int") for k in keys), F.lit(0))) for name, keys in fixed.INTENTS.items()]
    best = F.greatest(*(c for _, c in counts))
    total = sum((c for _, c in counts), F.lit(0))
    name = F.lit("unknown")
    for n, c in reversed(counts):
        name = F.when((best > 0) & (c == best), n).otherwise(name)
    return name, F.when(best > 0, F.round(best / total, 2)).otherwise(0.0)


def specificity(text: Column) -> Column:
    """Whether a request says enough: length, names and numbers, minus vague words."""
    t = F.coalesce(text, F.lit(""))
    toks = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9.+/_-]+)"), F.lit(1))
    n = F.size(toks)
    vague = F.size(F.filter(toks, lambda w: F.lower(w).isin(fixed.VAGUE)))
    named = t.rlike(r"[A-Z][a-zA-Z]+") | t.rlike(r"\d")
    score = F.least(F.lit(1.0), n / 14.0) * 0.6 + F.when(named, 0.3).otherwise(0.0) - F.least(F.lit(0.4), vague * 0.15) + 0.1
    return F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2))


def turn_intent(text: Column) -> Column:
    """Kind of work a turn asks for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("research") | low.contains("find"), "research_orchestration").when(low.contains("test"), "quality_assurance").when(low.contains("fix") | low.contains("refactor"), "code_mutation").otherwise("unknown")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, 0 for two empty texts."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest > 0, F.round(F.levenshtein(x, y) / longest, 6)).otherwise(0.0)


def repeated_short_lines(df: DataFrame, key: str, text: str = "text", most: int = 48) -> DataFrame:
    """key, text without second and later copies of short lines (P33); blank lines stay.

    Which lines were seen is a set that grows along a text, linear only outside
    of column expressions: an Arrow function over batches.
    """

    @F.pandas_udf("string")
    def run(col):
        import pandas as pd

        out = []
        for t in col:
            seen, kept = set(), []
            for line in (t or "").split("\n"):
                bare = line.strip(" ")
                if bare and len(bare) <= most:
                    if bare in seen:
                        continue
                    seen.add(bare)
                kept.append(line)
            out.append(None if t is None else "\n".join(kept))
        return pd.Series(out)

    return df.select(key, run(F.col(text)).alias(text))


def brace_product(axes: dict[str, list[str]], spark) -> DataFrame:
    """Every combination of the axes' values (P49): a few literals, no table."""
    df = spark.range(1).select(F.lit(0).alias("_"))
    for name, values in axes.items():
        df = df.select("*", F.explode(lit_array(dict.fromkeys(values))).alias(name))
    return df.drop("_").distinct()


def year_span(df: DataFrame, query: str, low: str, high: str) -> DataFrame:
    """A query per year, newest first, at most 26 years (P50)."""
    first = F.greatest(F.col(low), F.col(high) - 25)
    return df.select(query, F.explode(F.sequence(F.col(high), first, F.lit(-1))).alias("year")).filter(F.col(high) >= F.col(low))
