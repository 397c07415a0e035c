"""JSON objects in free text, and probabilities in them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that stand for a percentage, and the keys of labels and numbers, in the order they are looked up.
WORDS = {
    "very high": 90.0, "very_high": 90.0, "很高": 90.0, "极高": 90.0, "high": 80.0, "较高": 80.0, "高": 80.0, "medium": 60.0, "moderate": 60.0, "中等": 60.0, "一般": 60.0, "中": 60.0,
    "low": 35.0, "较低": 35.0, "低": 35.0, "very low": 20.0, "very_low": 20.0, "很低": 20.0, "极低": 20.0,
}
LABELS = ("label", "name", "scenario", "key", "title", "outcome", "case", "direction")
NUMBERS = ("probability", "prob", "p", "value", "weight", "likelihood", "chance")
UNNAMED = "情景 "

_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))'
)


def _scan(text: str, at: int, ends: dict[int, int | None]) -> None:
    """Follows the object at ``at`` up to its end or its first fault, and notes in ``ends`` where each object met on the way ends:
    None for those still open at a fault, which fail as well. So nested objects are read once, and no depth is too deep."""
    opened, pos, wanted = [("{", at)], at + 1, "key or end"
    while opened and (m := _TOKEN.match(text, pos)):
        sign, plain, pos = m[1], m[2], m.end()
        kind = opened[-1][0]
        if sign and sign in "}]":
            if sign != ("}" if kind == "{" else "]") or not wanted.endswith("end"):
                break
            _, start = opened.pop()
            if kind == "{":
                ends[start] = pos
            wanted = "comma or end"
        elif wanted.startswith("comma"):
            if sign != ",":
                break
            wanted = "key" if kind == "{" else "value"
        elif wanted == "colon":
            if sign != ":":
                break
            wanted = "value"
        elif wanted.startswith("key"):
            if not plain or plain[0] != '"':
                break
            wanted = "colon"
        elif plain:
            wanted = "comma or end"
        elif sign == "[":
            opened.append(("[", m.start(1)))
            wanted = "value or end"
        elif sign == "{" and (start := m.start(1)) in ends:
            if (end := ends[start]) is None:
                break
            pos, wanted = end, "comma or end"
        elif sign == "{":
            opened.append(("{", start))
            wanted = "key or end"
        else:
            break
    ends.update({start: None for kind, start in opened if kind == "{"})


def _first_object(text: str | None) -> str | None:
    ends: dict[int, int | None] = {}
    at = text.find("{") if isinstance(text, str) else -1
    while at >= 0:
        if at not in ends:
            _scan(text, at, ends)
        if (end := ends[at]) is not None:
            return text[at:end]
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def _first_objects(texts: pd.Series) -> pd.Series:
    return pd.Series([_first_object(t) for t in texts], dtype=object)


def first_object(text: Column | str) -> Column:
    """The first JSON object in each text, as it is written there; null where there is none, and for null texts. Only what lies from
    the first opening brace to the last closing one goes to Python: no object reaches beyond."""
    text = F.col(text) if isinstance(text, str) else text
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    held = (first > 0) & (last > first) & F.contains(text, F.lit("}"))
    return _first_objects(F.when(held, text.substr(first, last - first + 1)))


def _text(v: Column) -> Column:
    """A string or number of a variant, trimmed; empty for what is neither, and for words for nothing."""
    t = F.trim(F.try_variant_get(v, "$", "string"))
    plain = ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|BOOLEAN|VOID)")
    return F.when(plain & ~F.lower(t).isin("none", "null", "nan"), t).otherwise("")


def number(v: Column) -> Column:
    """A finite number of a variant: also "60%" and the words above; null for all else."""
    t = F.lower(F.trim(F.regexp_replace(_text(v), r"[%\s]+$", "")))
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    read = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), t.try_cast("double"))
    found = F.coalesce(F.try_element_at(words, t), read)
    return F.when(F.abs(found) < float("inf"), found)


def _first(v: Column, keys: tuple[str, ...], held) -> Column:
    """Of ``keys`` of an object the first one for which ``held`` gives something."""
    return F.coalesce(*[held(F.try_variant_get(v, f"$.{k}", "variant")) for k in keys])


def probabilities(v: Column) -> Column:
    """A map of labels to percentages of a variant: an object of them, or a list of objects with a label and a number, or of numbers.

    Fractions that sum to 1.05 at most become percentages; what has no number goes; of equal labels the last counts; a list's entry
    without a label is called by its place. Anything else, and null, gives an empty map.
    """
    none = F.array().cast("array<struct<label: string, n: double>>")
    pairs = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("label"), number(e["value"]).alias("n")))

    def entry(x: Column, i: Column) -> Column:
        is_object = F.schema_of_variant(x).startswith("OBJECT")
        label = F.when(is_object, _first(x, LABELS, lambda y: F.nullif(_text(y), F.lit(""))))
        # the first number that is written counts, even if it can't be read
        written = _first(x, NUMBERS, lambda y: F.when(~F.schema_of_variant(y).isin("VOID") & (F.try_variant_get(y, "$", "string") != ""), y))
        return F.struct(F.coalesce(label, F.concat(F.lit(UNNAMED), (i + 1).cast("string"))).alias("label"), F.when(is_object, number(written)).otherwise(number(x)).alias("n"))

    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), entry)
    kind = F.schema_of_variant(v)
    items = F.filter(F.coalesce(F.when(kind.startswith("OBJECT"), pairs).when(kind.startswith("ARRAY"), listed), none), lambda e: e["n"].isNotNull())
    sum_ = F.aggregate(items, F.lit(0.0), lambda s, e: s + e["n"])
    small = F.forall(items, lambda e: (e["n"] >= 0) & (e["n"] <= 1)) & (sum_ > 0) & (sum_ <= 1.05)
    last = F.filter(items, lambda e, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda later: later["label"] == e["label"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["label"], F.round(e["n"] * F.when(small, 100.0).otherwise(1.0), 2).alias("n"))))
