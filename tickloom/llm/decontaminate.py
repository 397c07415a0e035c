"""Operator 4: benchmark decontamination by template canonicalisation.

Texts become templates: a number with its unit, and a run of capitalised words, at a
sentence's start too, are replaced by typed placeholders that keep the value beside
them; other words are lowered. A capitalised word of an item that also stands there in
lower case, or that begins it, may be a plain word: its placeholder has no value to check. Five-word windows of the templates (fewer words are
one window) are hash-joined with the benchmark's. For each document, item and
offset between the two, the values in the matched windows must be consistent: a
value of the item stands for one value of the document throughout and the other
way round, as where a question's numbers and names were exchanged. A document is
contaminated by an item when the item's windows matched at consistent offsets are
``SHARE`` of all its windows.

DataFrame functions only, one plan at every size: a map of bounded size of the
benchmark's window hashes goes to all executors, and only windows that it lets
through are shuffled and joined. Documents are first read for hashes alone; values
are kept only of those that share a window with an item.

Defined results: null and empty texts have no windows; items without words are
ignored; windows of a repeated item or a repeated passage all count; rows with one
id are one document; a null id is an id; an empty table on either side gives no
matches; extra columns, of whatever name, are kept by ``decontaminate`` and don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import cut, let, likely, without

WINDOW, SHARE = 5, 0.75
#: Units that belong to a number.
UNITS = ("km", "cm", "mm", "m", "kg", "mg", "g", "lb", "lbs", "oz", "km/h", "mph", "l", "ml", "%", "percent", "h", "hours", "hour", "min", "minutes", "s", "seconds", "days", "years", "dollars", "euros", "€", "$", "£", "°C", "°F")
NAME = r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}++)(?![\p{L}\p{N}])"
# possessive: a list of a million numbers is one match without a stack
NUMBER = r"(?<![\p{L}\p{N}])([$€£]?)([0-9]++(?:[.,][0-9]++)*+)\x20?((?:%s)(?![\p{L}\p{N}]))?(?![\p{N}])" % "|".join(u.replace("$", r"\$").replace("°", "°") for u in sorted(UNITS, key=len, reverse=True))
#: Placeholders hold their value behind this sign.
HOLDS = "\u0001"
#: Ends a name while names beside each other are not joined yet.
ENDS = "\u0002"
TOKEN = rf"[@#~]{HOLDS}[^\s]*|[\p{{L}}\p{{N}}]+"


def template(text: Column, values: bool = True) -> Column:
    """Words of a text, with placeholders: ``@`` name, ``#`` number, ``~`` unit, each with its value or without it."""
    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), HOLDS + ENDS, "  ")
    name, number, joint = (f"@{HOLDS}$1{ENDS}", f" #{HOLDS}$2 ~{HOLDS}$1$3 ", "_") if values else (f"@{HOLDS}{ENDS}", f" #{HOLDS} ~{HOLDS} ", "")
    marked = F.regexp_replace(clean, NAME, name)
    named = F.replace(F.replace(marked, F.lit(f"{ENDS} @{HOLDS}"), F.lit(joint)), F.lit(ENDS), F.lit(" "))
    counted = F.when(named.rlike("[0-9]"), F.regexp_replace(named, NUMBER, number)).otherwise(named)
    return F.regexp_extract_all(F.lower(counted), F.lit(TOKEN), F.lit(0))


def unsure(words: Column) -> Column:
    """An item's words, with ``ENDS`` as the value of names that may be plain words."""
    name = f"@{HOLDS}"

    def of(ws: Column) -> Column:
        plain = F.filter(ws, lambda w: ~w.contains(HOLDS))
        return let(plain, lambda p: F.transform(ws, lambda w, i: F.when(w.startswith(name) & ((i == 0) | F.array_contains(p, F.substring_index(w, HOLDS, -1))), name + ENDS).otherwise(w)))

    return let(words, of)


def slots(window: Column) -> Column:
    """The values of a window's placeholders, joined."""
    return F.array_join(F.transform(F.filter(window, lambda w: w.contains(HOLDS)), lambda w: F.substring_index(w, HOLDS, -1)), HOLDS)


def windows(words: Column, sizes: list[int]) -> Column:
    """array<struct<hash,place,own>>: every window of each size, hashed without its values; own are its words where the text holds a value."""
    bare = lambda w: F.when(w.contains(HOLDS), F.concat(F.substring_index(w, HOLDS, 1), F.lit(HOLDS))).otherwise(w)

    def of(some: Column) -> Column:
        def sized(size: int) -> Column:
            def one(i: Column) -> Column:
                own = F.when(some["held"], F.slice(some["words"], i, F.lit(size)))
                return F.struct(F.xxhash64(F.lit(size), F.slice(some["bare"], i, F.lit(size))).alias("hash"), i.alias("place"), own.alias("own"))

            n = F.size(some["words"])
            return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), one)).otherwise(F.array().cast("array<struct<hash:bigint,place:int,own:array<string>>>"))

        return F.concat(*map(sized, sizes))

    held = lambda ws: F.exists(ws, lambda w: w.contains(HOLDS))
    return let(words, lambda ws: let(F.struct(ws.alias("words"), F.when(held(ws), F.transform(ws, bare)).otherwise(ws).alias("bare"), held(ws).alias("held")), of))


def hashes(words: Column, sizes: list[int]) -> Column:
    """The hashes of ``windows`` alone, of words without values."""

    def sized(ws: Column, size: int) -> Column:
        n = F.size(ws)
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.lit(size), F.slice(ws, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))

    return let(words, lambda ws: F.concat(*[sized(ws, size) for size in sizes]))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """Rows (key, item, found): the share of an item's windows that a document holds consistently, where it is ``share`` at least."""
    own = benchmark.select(F.col(item).alias("_item"), template(F.col(item_text)).alias("_words")).where(F.size("_words") > 0)
    sizes = sorted({r[0] for r in own.select(F.least(F.size("_words"), F.lit(WINDOW))).distinct().collect()}) or [WINDOW]
    by_size = None
    for size in sizes:
        some = own.where(F.least(F.size("_words"), F.lit(WINDOW)) == size).select("_item", F.explode(windows(unsure(F.col("_words")), [size])).alias("w"))
        by_size = some if by_size is None else by_size.unionByName(some)
    items = cut(by_size.select("_item", F.col("w.hash").alias("hash"), F.col("w.place").alias("q"), F.coalesce(slots(F.col("w.own")), F.lit("")).alias("item_slots")))
    n_windows = items.groupBy("_item").agg(F.count_distinct("q").alias("n_windows"))
    # documents that share a window with the benchmark; only these, few, are looked at with their values
    light = docs.select(F.col(key).alias("_key"), F.explode(hashes(template(F.col(text), False), sizes)).alias("hash"))
    ids = cut(likely(light, F.col("hash"), items, F.col("hash")).join(items.select("hash").hint("merge"), "hash", "left_semi").select("_key").distinct())
    near = likely(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), F.col("_key"), ids, F.col("_key"))
    placed = near.select("_key", F.explode(windows(template(F.col("_text")), sizes)).alias("w")).select("_key", F.col("w.hash").alias("hash"), F.col("w.place").alias("p"), F.col("w.own").alias("own"))
    # values are taken out only of windows that the map lets through
    some = likely(placed, F.col("hash"), items, F.col("hash")).select("_key", "hash", "p", slots(F.col("own")).alias("doc_slots"))
    hits = some.join(items.hint("merge"), "hash")
    split = lambda c: F.split(c, HOLDS)
    pairs = F.when(F.col("item_slots") == "", F.array().cast("array<struct<a:string,b:string>>")).otherwise(F.zip_with(split(F.col("item_slots")), split(F.coalesce("doc_slots", F.lit(""))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    runs = hits.groupBy("_key", "_item", (F.col("p") - F.col("q")).alias("offset")).agg(F.collect_set("q").alias("qs"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    sure = F.filter("pairs", lambda x: x["a"] != ENDS)
    one = lambda side: F.size(F.array_distinct(F.transform(sure, lambda x: x[side]))) == F.size(sure)
    consistent = one("a") & one("b")
    found = runs.where(consistent).select("_key", "_item", F.explode("qs").alias("q")).groupBy("_key", "_item").agg(F.count_distinct("q").alias("n"))
    rated = found.join(n_windows, "_item").withColumn("found", F.col("n") / F.col("n_windows"))
    return rated.where(F.col("found") >= share).select(F.col("_key").alias(key), F.col("_item").alias(item), "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """``docs`` without the contaminated documents; all other rows and columns stay as they are."""
    return without(docs, key, cut(matches(docs, benchmark, key, **names).select(key).distinct()), key)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("found").alias("found"), F.count("*").alias("n_items"))
