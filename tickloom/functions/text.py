"""Text of news items: cleaning, addresses, tokens, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING = ("fbclid", "gclid", "spm", "from", "share_token")
#: Block tags that end a line, and tags whose content isn't text.
BLOCKS = "p|div|br|li|ul|ol|tr|table|section|article|header|footer|h[1-6]|blockquote|pre"
HIDDEN = "script|style|noscript|template"
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "with", "by", "at", "from", "as", "it", "that")


def collapse(c: Column) -> Column:
    """White space in a line as single spaces, no blank lines."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _nfkc(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(run, "string")(c)


def normalize(c: Column) -> Column:
    """NFKC (which Spark has no function for), then ``collapse``; ASCII needs no NFKC and stays in the JVM."""
    return collapse(F.when(c.rlike(r"[^\x00-\x7f]"), _nfkc(c)).otherwise(c))


def clean_html(c: Column) -> Column:
    """Text of a page: hidden elements and comments gone, block tags end lines, common entities resolved."""
    x = F.regexp_replace(c, rf"(?is)<({HIDDEN})\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
    return collapse(x)


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, single slashes, no slash at the end, no tracking keys, no fragment."""
    u = F.trim(c)
    scheme, host, port = (F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?", k)) for k in (1, 2, 3))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), "/+", "/")
    path = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "(?<=.)/$", ""))
    pairs = F.filter(F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.lower(F.split(p, "=")[0]).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    keep_port = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    made = F.concat(scheme, F.lit("://"), host, F.when(keep_port, F.concat(F.lit(":"), port)).otherwise(""), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(u == "", None).when(scheme == "", u).otherwise(made)


def tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words without stop words, and pairs of neighbouring CJK signs."""
    low = F.lower(c)
    words = F.array_except(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))
    runs = F.regexp_extract_all(low, F.lit("[㐀-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(words, pairs))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def key_of(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
