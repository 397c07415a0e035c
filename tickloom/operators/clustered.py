"""One event per cluster of news items, and leads per symbol of such events.

Terms are looked for in each item; what a cluster holds is the union of its items' bits, which partial aggregation adds up before the
shuffle. So texts are never joined, and a cluster may hold a third of all items.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text as T
from tickloom.operators.discovery import clamp
from tickloom.operators.news import EVENT_TYPES, bounded

#: Share codes in free text, and the horizons of event types (others are MEDIUM).
SHARE_CODE = r"(?<![0-9])([0368][0-9]{5})(?![0-9])"
INTRADAY = ("RISK", "BLACK_SWAN", "PRICE_CHANGE", "MARKET")
LONG = ("POLICY", "MONETARY_POLICY", "MACRO", "GEOPOLITICAL")
PRICED = ("MARKET", "PRICE_CHANGE")
#: Name space of addresses, for identifiers of version 5.
ADDRESSES = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: Bits of one aggregated word.
BITS = 63


@dataclass(frozen=True)
class Rules:
    """Terms an event is judged by: per event type (ties: the type named first), per theme, and those of good and bad news and of capital."""

    kinds: dict[str, Sequence[str]]
    themes: dict[str, Sequence[str]] = field(default_factory=dict)
    good: Sequence[str] = ()
    bad: Sequence[str] = ()
    capital: Sequence[str] = ()

    def terms(self) -> list[str]:
        named = [w for group in (*self.kinds.values(), *self.themes.values(), self.good, self.bad, self.capital) for w in group]
        return list(dict.fromkeys(w.lower() for w in named))


def _masks(text: Column, terms: list[str]) -> list[Column]:
    """Words of ``BITS`` bits that say which terms a text holds."""
    low = F.lower(text)
    bit = [F.when(low.contains(w), F.lit(1 << (k % BITS))).otherwise(F.lit(0)).cast("long") for k, w in enumerate(terms)]
    return [sum(bit[k + 1 : k + BITS], bit[k]) for k in range(0, len(bit), BITS)]


def cluster_events(items: DataFrame, rules: Rules, prefix: str = "news:", shares: Column | None = None) -> DataFrame:
    """``items`` (cluster, id, title, content, source, url, publish_time, event_time) as one event a cluster.

    Title and summary are those of the item with the longest content (ties: longest title, latest, smallest id). An empty title gives
    way to the content's first 80 signs. Nulls count as empty texts; an item without event_time doesn't set the event's, and a cluster without
    any takes its first publication. Items' ids stay in ``items``; ``n_items`` counts them. Share codes are read in title and content, or
    only in ``shares`` where a feed names them apart: any six digits of a free text would pass for one.
    """
    terms = rules.terms()
    place = {w: k for k, w in enumerate(terms)}
    t = items.withColumns({"title": F.coalesce("title", F.lit("")), "content": F.coalesce("content", F.lit(""))})
    both = F.concat_ws("\n", "title", "content")
    masks = _masks(both, terms)
    best = F.struct(F.length("content").alias("c"), F.length("title").alias("t"), F.col("publish_time").alias("p"), (-F.col("id")).alias("i"))
    a = t.groupBy("cluster").agg(
        F.count("*").alias("n_items"), F.max_by(F.struct("title", "content"), best).alias("_best"), F.count_distinct(F.struct("source", "url")).alias("sources"),
        F.coalesce(F.min("event_time"), F.min("publish_time")).alias("event_time"), F.min("publish_time").alias("first_publish_time"), F.max("publish_time").alias("last_update_time"), F.bool_or(both.rlike("[㐀-鿿]")).alias("cjk"),
        *[F.bit_or(m).alias(f"_m{k}") for k, m in enumerate(masks)],
    )
    has = lambda w: F.shiftright(F.col(f"_m{place[w.lower()] // BITS}"), place[w.lower()] % BITS).bitwiseAND(F.lit(1)).cast("int")
    hits = lambda words: sum((has(w) for w in words), F.lit(0))
    kinds = []
    for k, (kind, words) in enumerate(rules.kinds.items()):
        priority, weight = EVENT_TYPES[kind]
        kinds.append(F.struct(F.when(hits(words) > 0, hits(words) * 10 + priority).otherwise(-1).alias("rank"), F.lit(-k).alias("first"), hits(words).alias("hits"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight")))
    kinds.append(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("first"), F.lit(0).alias("hits"), F.lit("OTHER").alias("kind"), F.lit(EVENT_TYPES["OTHER"][1]).alias("weight")))
    themes = [F.when(hits(words) > 0, F.lit(name)) for name, words in rules.themes.items()]

    # a cluster's codes: distinct ones only are gathered, in the order they come in
    named = both if shares is None else F.coalesce(shares, F.lit(""))
    found = t.select("cluster", "id", F.posexplode(F.regexp_extract_all(named, F.lit(SHARE_CODE), F.lit(1))).alias("at", "code"))
    each = found.groupBy("cluster", "code").agg(F.min(F.struct("id", "at")).alias("at"))
    codes = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"))

    e = a.join(codes, "cluster", "left").withColumns({
        "_kind": F.array_max(F.array(*kinds)), "codes": F.coalesce("codes", F.array().cast("array<string>")), "themes": F.array_compact(F.array(*themes)) if themes else F.array().cast("array<string>"),
        "good": hits(rules.good), "bad": hits(rules.bad), "_s": F.least("sources", F.lit(5)), "_full": F.col("_best.content"), "title": F.when(F.col("_best.title") != "", F.col("_best.title")).otherwise(F.substring("_best.content", 1, 80)),
    })
    kind, told = F.col("_kind.kind"), F.col("good") + F.col("bad")
    brief = T.normalize(F.when(F.col("_full") != "", F.col("_full")).otherwise(F.col("_best.title")))
    e = e.withColumns({
        "event_type": kind, "hits": F.col("_kind.hits"), "_brief": brief,
        "direction": F.when(told == 0, "NEUTRAL").when((F.col("good") > 0) & (F.col("bad") > 0), "MIXED").when(F.col("good") > 0, "POSITIVE").otherwise("NEGATIVE"),
        "sentiment": F.when(told == 0, 0.0).otherwise((F.col("good") - F.col("bad")) / F.greatest(told, F.lit(1))),
        "confidence": bounded(0.42 + F.least(F.col("_kind.hits"), F.lit(5)) * 0.07 + F.col("_s") * 0.04, 0.35, 0.96), "novelty": bounded(0.92 - (F.col("sources") - 1) * 0.07, 0.25, 1.0), "magnitude": bounded(25.0 + told * 7 + F.col("_s") * 5),
        "capital": F.least(F.lit(100.0), hits(rules.capital) * 18.0 + F.size("codes") * 4.0), "priced_in": F.when(kind.isin(*PRICED), 0.55).otherwise(0.25), "horizon": F.when(kind.isin(*INTRADAY), "INTRADAY").when(kind.isin(*LONG), "LONG").otherwise("MEDIUM"),
    })
    e = e.withColumn("importance", bounded(F.col("_kind.weight") + F.col("magnitude") * 0.35 + F.col("_s") * 3)).withColumn("heat", bounded(35 + F.col("importance") * 0.4 + F.col("_s") * 4 + F.col("novelty") * 8))
    key = F.concat(F.lit(prefix), F.lower(T.normalize(F.col("title"))), F.lit("|"), F.date_format("event_time", "yyyy-MM-dd"))
    summary = F.when(F.length("_brief") <= 360, F.col("_brief")).otherwise(F.concat(F.rtrim(F.substring("_brief", 1, 360)), F.lit("...")))
    kept = ("n_items", "sources", "event_type", "hits", "title", "direction", "sentiment", "confidence", "novelty", "magnitude", "capital", "priced_in", "horizon", "importance", "heat", "themes", "codes", "cjk", "event_time", "first_publish_time", "last_update_time")
    return e.select("cluster", T.uuid5(ADDRESSES, key).alias("event_id"), summary.alias("summary"), *kept)


def lead_score(direction: Column, importance: Column, magnitude: Column) -> Column:
    """An event's score for a symbol it names. The weights of each direction."""
    strength, d = importance * magnitude / 100, F.upper(direction)
    return F.when(d == "POSITIVE", clamp(50 + strength * 0.4)).when(d == "NEGATIVE", clamp(50 - strength * 0.5)).when(d == "MIXED", clamp(50 + strength * 0.1)).otherwise(clamp(50 + strength * 0.15))


def symbol_leads(events: DataFrame, themes: DataFrame, least: float = 50.0) -> DataFrame:
    """Leads of score ``least`` or more: ``events`` (symbols, theme_ids, direction, importance, magnitude) by symbol, with the heat of their
    ``themes`` (theme_id, name, heat). Each naming counts, null symbols don't; a theme counts once a symbol, and one without heat not at
    all. ``labels`` name the first three themes, where any has a heat; ``review`` tells of a negative event."""
    named = events.select(F.explode("symbols").alias("symbol"), "theme_ids", F.upper("direction").alias("d"), lead_score(F.col("direction"), F.col("importance"), F.col("magnitude")).alias("s")).where("symbol is not null")
    by_events = named.groupBy("symbol").agg(F.count("*").alias("n_events"), F.avg("s").alias("event_score"), F.coalesce(F.bool_or(F.col("d") == "NEGATIVE"), F.lit(False)).alias("review"))
    tied = named.select("symbol", F.explode("theme_ids").alias("theme_id")).distinct().join(themes.select("theme_id", "name", "heat"), "theme_id", "left")
    label = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("theme_id").cast("string"))
    by_themes = tied.groupBy("symbol").agg(F.avg("heat").alias("_heat"), F.slice(F.array_sort(F.collect_list(F.struct(F.col("theme_id").cast("string").alias("t"), label.alias("label")))), 1, 3)["label"].alias("_labels"))
    j = by_events.join(by_themes, "symbol", "left").withColumn("theme_heat", F.coalesce("_heat", F.lit(50.0)))
    j = j.withColumn("score", clamp(F.col("event_score") * 0.6 + (50.0 + (F.col("theme_heat") - 50.0) * 0.5) * 0.4))
    labels = F.when(F.col("_heat").isNotNull(), F.col("_labels")).otherwise(F.array().cast("array<string>"))
    return j.where(F.col("score") >= least).select("symbol", "score", "n_events", "event_score", "theme_heat", labels.alias("labels"), "review")
