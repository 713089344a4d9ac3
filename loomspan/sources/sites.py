"""Posts, threads and paper entries read from the pages of a few sites (P32), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hosts of each kind of site, and the patterns of its fields.
HOSTS = {
    "twitter": ["twitter.com", "x.com", "mobile.twitter.com"],
    "reddit": ["reddit.com", "www.reddit.com", "old.reddit.com"],
    "scholar": ["scholar.google.com"],
}
FIELDS = {
    "twitter": {
        "title": [r'(?i)<meta[^>]*name="twitter:title"[^>]*content="([^"]*)"'],
        "body": [r'(?s)data-testid="tweetText">(.*?)</div>', r'(?i)<meta[^>]*name="twitter:description"[^>]*content="([^"]*)"', r'(?i)<meta[^>]*name="twitter:title"[^>]*content="([^"]*)"'],
        "author": [r'(?i)<meta[^>]*name="twitter:creator"[^>]*content="([^"]*)"'],
    },
    "reddit": {
        "title": [r'(?i)<shreddit-post[^>]*title="([^"]*)"[^>]*>', r'(?i)<a[^>]*class="title"[^>]*>(.*?)</a>', r"(?is)<title>(.*?)</title>"],
        "body": [r'(?is)<div[^>]*class="[^"]*(?:text-neutral-content|md)[^"]*"[^>]*>(.*?)</div>', r'(?is)<div[^>]*class="usertext-body"[^>]*>(.*?)</div>'],
        "author": [],
    },
    "scholar": {
        "title": [r'(?is)class="gs_rt"[^>]*>.*?<a[^>]*>(.*?)</a>', r'(?is)class="gs_rt"[^>]*><span[^>]*>.*?</span>\s*(.*?)</', r'(?is)<div[^>]*class="gsc_oci_title"[^>]*>(.*?)</div>'],
        "body": [r'(?is)class="gs_rs"[^>]*>(.*?)</div>'],
        "author": [r'(?is)class="gs_a"[^>]*>(.*?)</div>'],
    },
}
COUNTS = {
    "twitter": {"shares": r"(?i)(\d+)\s*(?:reposts?|retweets?)", "likes": r"(?i)(\d+)\s*(?:likes?)", "replies": r"(?i)(\d+)\s*(?:replies?)"},
    "reddit": {"likes": r'(?i)<faceplate-number[^>]*number="([^"]*)"[^>]*>'},
    "scholar": {"citations": r"(?i)Cited by\s+(\d+)"},
}
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


def _plain(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _first(html: Column, patterns: list[str]) -> Column:
    """The first pattern's first group that is not empty."""
    found = (F.regexp_extract(html, p, 1) for p in patterns)
    return _plain(F.coalesce(*(F.when(f != "", f) for f in found), F.lit("")))


def posts(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, site, title, body, author, shares, likes, replies, citations of pages of known sites; others give no row.

    Null pages have empty fields. A page counts as read (``ok``) if it has what its site is about.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    site = F.coalesce(*(F.when(host.isin([h.removeprefix("www.") for h in hs]), F.lit(s)) for s, hs in HOSTS.items()))
    p = pages.select(key, site.alias("site"), F.coalesce(F.col(html), F.lit("")).alias("h")).filter("site is not null")
    of = lambda make: F.coalesce(*(F.when(F.col("site") == s, make(s)) for s in HOSTS))
    p = p.select(key, "site", *(of(lambda s, f=f: _first(F.col("h"), FIELDS[s][f])).alias(f) for f in ("title", "body", "author")), *(of(lambda s, c=c: F.try_to_number(F.regexp_extract("h", COUNTS[s][c], 1), F.lit("999999999999")).cast("long") if c in COUNTS[s] else F.lit(None).cast("long")).alias(c) for c in ("shares", "likes", "replies", "citations")))
    about = F.when(F.col("site") == "twitter", F.length("body") > 10).when(F.col("site") == "reddit", (F.col("title") != "") | (F.col("body") != "")).otherwise(F.col("title") != "")
    return p.withColumn("ok", about)
