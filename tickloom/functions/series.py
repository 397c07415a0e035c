"""Columns over bars, written once as SQL expressions and staged by window depth.

``Program`` collects named expressions. Those that use the same earlier columns share a
stage, a repeated expression is one column, and only what a result needs enters the plan.
``run`` applies the stages to a DataFrame; ``sql`` gives the same stages as a query for another
engine, with that engine's own window and list functions (see ``dialect``).

Windows start from zeros: the first n - 1 rows see zeros before them, not nulls.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from tickloom.functions.recurrence import ema

AXIS = "partition by symbol order by bar_idx"


def number(v: float) -> str:
    return f"{v!r}e0" if "e" not in repr(v) else repr(v)


class X:
    """An expression's text with arithmetic."""

    def __init__(self, text: str) -> None:
        self.text = text

    def __str__(self) -> str:
        return self.text

    def _two(self, other, sign: str, swap: bool = False) -> X:
        a, b = str(self), other.text if isinstance(other, X) else number(float(other))
        return X(f"({b} {sign} {a})" if swap else f"({a} {sign} {b})")

    __add__ = lambda s, o: s._two(o, "+")
    __radd__ = lambda s, o: s._two(o, "+", True)
    __sub__ = lambda s, o: s._two(o, "-")
    __rsub__ = lambda s, o: s._two(o, "-", True)
    __mul__ = lambda s, o: s._two(o, "*")
    __rmul__ = lambda s, o: s._two(o, "*", True)
    __truediv__ = lambda s, o: s._two(o, "/")
    __gt__ = lambda s, o: s._two(o, ">")
    __lt__ = lambda s, o: s._two(o, "<")
    __ge__ = lambda s, o: s._two(o, ">=")
    __le__ = lambda s, o: s._two(o, "<=")
    __and__ = lambda s, o: s._two(o, "and")
    __neg__ = lambda s: X(f"(-{s})")


def call(name: str, *args) -> X:
    return X(f"{name}({', '.join(a.text if isinstance(a, X) else number(float(a)) for a in args)})")


def when(condition: X, a, b) -> X:
    a, b = (v if isinstance(v, X) else X(number(float(v))) for v in (a, b))
    return X(f"(case when {condition} then {a} else {b} end)")


def clip(x: X, lo: float, hi: float) -> X:
    return call("least", call("greatest", x, lo), hi)


def sign(x: X) -> X:
    return X(f"cast(sign({x}) as double)")


class Spark:
    """List functions of Spark SQL."""

    listed, size = "collect_list", "size"

    def fold(self, items: str, body: str) -> str:
        """Sum of ``body`` over v in a list."""
        return f"aggregate({items}, 0e0, (a, v) -> a + {body})"

    def fold_product(self, items: str) -> str:
        return f"aggregate({items}, 1e0, (a, v) -> a * v)"

    def fold_two(self, a: str, b: str, body: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (v, u) -> {body}), 0e0, (s, v) -> s + v)"

    def places(self, lo: str, hi: str) -> str:
        return f"sequence({lo}, {hi})"

    def padded(self, items: str, n: int) -> str:
        return f"concat(array_repeat(0e0, {n} - size({items})), {items})"

    def count_if(self, items: str, body: str) -> str:
        return f"size(filter({items}, v -> {body}))"

    def log_ratio(self, x: str, y: str) -> str:
        """Logarithm of a ratio as floating point has it: infinite where one side is 0, not a number where both are or the signs differ."""
        zero = f"case when {x} > 0e0 then double('Infinity') when {x} <= 0e0 then double('NaN') end"
        return f"(case when {y} = 0e0 then {zero} when {x} = 0e0 then double('-Infinity') when ({x} < 0e0) != ({y} < 0e0) then double('NaN') else ln({x} / {y}) end)"

    sort, position, top, bottom = "array_sort({0})", "array_position({0}, {1})", "array_max({0})", "array_min({0})"


class Duck(Spark):
    """The same of DuckDB."""

    listed, size = "list", "len"
    sort, position, top, bottom = "list_sort({0})", "list_position({0}, {1})", "list_max({0})", "list_min({0})"

    def fold(self, items: str, body: str) -> str:
        return f"list_sum(list_transform({items}, lambda v: {body}))"

    def fold_product(self, items: str) -> str:
        return f"list_product({items})"

    def fold_two(self, a: str, b: str, body: str) -> str:
        body = re.sub(r"\bu\b", "z[2]", re.sub(r"\bv\b", "z[1]", body))
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {body}))"

    def places(self, lo: str, hi: str) -> str:
        return f"range({lo}, {hi} + 1)"

    def padded(self, items: str, n: int) -> str:
        return f"list_concat(list_transform(range({n} - len({items})), lambda z: 0e0), {items})"

    def count_if(self, items: str, body: str) -> str:
        return f"len(list_filter({items}, lambda v: {body}))"

    def log_ratio(self, x: str, y: str) -> str:
        return f"ln(({x} / {y}))"


class Program:
    def __init__(self, dialect: Spark | None = None) -> None:
        self.d = dialect or Spark()
        self.known: dict[str, str] = {}
        self.level: dict[str, int] = {}
        self.text: dict[str, str] = {}
        self.recursive: dict[str, tuple[str, int]] = {}

    # ------------------------------------------------------------------ stages

    def _depth(self, text: str) -> int:
        return max([self.level[w] for w in re.findall(r"\bc\d+\b", text)], default=0)

    def let(self, text: str | X) -> X:
        text = str(text)
        if re.fullmatch(r"\w+", text):
            return X(text)
        if text not in self.known:
            name = f"c{len(self.known)}"
            self.level[name], self.text[name] = self._depth(text) + 1, text
            self.known[text] = name
        return X(self.known[text])

    def ema(self, x: X, span: int) -> X:
        """Recursive average with weight 2 / (span + 1), from the first value on."""
        x = self.let(x)
        text = f"ema({x}, {span})"
        if text not in self.known:
            name = f"c{len(self.known)}"
            self.level[name], self.recursive[name] = self._depth(text) + 1, (x.text, span)
            self.known[text] = name
        return X(self.known[text])

    def run(self, bars: DataFrame, results: dict[str, X], keep: Iterable[str] = ("symbol", "bar_idx")) -> DataFrame:
        df = bars
        for depth in range(1, max(self.level.values(), default=0) + 1):
            own = [n for n, k in self.level.items() if k == depth]
            plain = [f"{self.text[n]} as {n}" for n in own if n in self.text]
            if plain:
                df = df.selectExpr("*", *plain)
            if averaged := {n: self.recursive[n] for n in own if n in self.recursive}:
                df = ema(df, averaged)
        return df.selectExpr(*keep, *[f"{x} as {n}" for n, x in results.items()])

    def sql(self, bars: str, results: dict[str, X], keep: Iterable[str] = ("symbol", "bar_idx")) -> str:
        stages, last = [f"s0 as ({bars})"], "s0"
        for depth in range(1, max(self.level.values(), default=0) + 1):
            own = [n for n, k in self.level.items() if k == depth]
            made = []
            for n in own:
                if n in self.text:
                    made.append(f"{self.text[n]} as {n}")
                else:
                    x, span = self.recursive[n]
                    a = number(2.0 / (span + 1.0))
                    made.append(f"list_reduce(list({x}) over ({AXIS} rows unbounded preceding), lambda a, v: {a} * v + (1e0 - {a}) * a) as {n}")
            stages.append(f"s{depth} as (select *, {', '.join(made)} from {last})")
            last = f"s{depth}"
        return f"with {', '.join(stages)} select {', '.join([*keep, *[f'{x} as {n}' for n, x in results.items()]])} from {last}"

    # ------------------------------------------------------------- along time

    def over(self, call_: str, frame: str = "") -> X:
        return self.let(f"{call_} over ({AXIS}{' ' + frame if frame else ''})")

    def lag0(self, x: X, k: int) -> X:
        return self.let(f"coalesce(lag({self.let(x)}, {k}) over ({AXIS}), 0e0)")

    def previous(self, x: X, first: X | None = None) -> X:
        x = self.let(x)
        return self.let(f"coalesce(lag({x}) over ({AXIS}), {first or x})")

    def diff(self, x: X) -> X:
        x = self.let(x)
        return self.let(f"coalesce({x} - lag({x}) over ({AXIS}), 0e0)")

    def returns(self, x: X) -> X:
        return self.diff(X(f"ln({call('greatest', x, 1e-12)})"))

    def _frame(self, n: int) -> str:
        return f"rows between {n - 1} preceding and current row"

    def sum0(self, x: X, n: int) -> X:
        return self.over(f"sum({self.let(x)})", self._frame(n))

    def mean0(self, x: X, n: int) -> X:
        return self.sum0(x, n) / n

    def min0(self, x: X, n: int) -> X:
        low = self.over(f"min({self.let(x)})", self._frame(n))
        return X(f"(case when bar_idx < {n - 1} then least({low}, 0e0) else {low} end)")

    def max0(self, x: X, n: int) -> X:
        high = self.over(f"max({self.let(x)})", self._frame(n))
        return X(f"(case when bar_idx < {n - 1} then greatest({high}, 0e0) else {high} end)")

    def running(self, x: X) -> X:
        return self.over(f"sum({self.let(x)})", "rows between unbounded preceding and current row")

    def whole(self, x: X) -> X:
        """Sum over the whole series, also of what is still to come."""
        return self.let(f"sum({self.let(x)}) over (partition by symbol)")

    def items(self, x: X, n: int) -> X:
        """The window's own values, oldest first; shorter at the start."""
        return self.over(f"{self.d.listed}({self.let(x)})", self._frame(n))

    def padded(self, x: X, n: int) -> X:
        return self.let(self.d.padded(str(self.items(x, n)), n))

    def power_sum(self, x: X, n: int, k: int) -> tuple[X, X]:
        """(mean, sum of (v - mean)^k) of the window with its zeros."""
        m, items = self.let(self.mean0(x, n)), self.items(x, n)
        each = " * ".join([f"(v - {m})"] * k)
        zeros = " * ".join([f"(-{m})"] * k)
        return m, self.let(f"({self.d.fold(str(items), each)} + ({n} - {self.d.size}({items})) * ({zeros}))")

    def deviation(self, x: X, n: int) -> X:
        return X(f"sqrt({self.power_sum(x, n, 2)[1]} / {number(float(n))})")

    def std0(self, x: X, n: int) -> X:
        return self.let(self.deviation(x, n) + 1e-9)

    def standard_moment(self, x: X, n: int, k: int) -> X:
        s = self.std0(x, n)
        return self.power_sum(x, n, k)[1] / n / X("(" + " * ".join([str(s)] * k) + ")")

    def corr0(self, x: X, y: X, n: int, eps: float) -> X:
        x, y = self.let(x), self.let(y)
        mx, my = self.let(self.mean0(x, n)), self.let(self.mean0(y, n))
        a, b = self.items(x, n), self.items(y, n)
        cov = self.let(f"(({self.d.fold_two(str(a), str(b), f'(v - {mx}) * (u - {my})')} + ({n} - {self.d.size}({a})) * {mx} * {my}) / {number(float(n))})")
        return finite(sdiv(cov, self.let(self.deviation(x, n) * self.deviation(y, n) + 1e-8), eps))

    def slope(self, x: X, n: int) -> X:
        """Slope over the window, relative to the size of its mean."""
        items, m = self.items(x, n), self.let(self.mean0(x, n))
        c = (n - 1) / 2
        places = self.d.places(f"{n} - {self.d.size}({items})", str(n - 1))
        top = self.let(self.d.fold_two(str(items), places, f"v * (u - {number(c)})"))
        return sdiv(top / (sum((i - c) ** 2 for i in range(n)) + 1e-9), call("abs", m) + 1e-9)

    def quantile(self, x: X, n: int, q: float) -> X:
        ordered = self.let(self.d.sort.format(self.padded(x, n)))
        at = (n - 1) * q
        lo = int(at)
        a, b = (X(f"element_at({ordered}, {k})") if type(self.d) is Spark else X(f"{ordered}[{k}]") for k in (lo + 1, min(lo + 2, n)))
        return self.let(a + (b - a) * (at - lo))

    def first_at(self, x: X, n: int, top: bool) -> X:
        """Place, from 0, of the first greatest or least value of the window."""
        p = self.padded(x, n)
        best = (self.d.top if top else self.d.bottom).format(p)
        return self.let(f"cast({self.d.position.format(p, best)} - 1 as double)")

    def entropy(self, x: X, n: int, bins: int = 8) -> X:
        p = self.padded(x, n)
        lo, hi = self.let(self.d.bottom.format(p)), self.let(self.d.top.format(p))
        out = X("0e0")
        for b in range(bins):
            at = f"least(floor((v - {lo}) / greatest({hi} - {lo}, 1e-300) * {bins}e0), {bins - 1})"
            share = self.let(f"{self.d.count_if(str(p), f'{at} = {b}')} / {number(float(n))}")
            out = out - when(share > 0, share * call("ln", share + 1e-12), 0)
        return when(X(f"({lo} = {hi})"), X(number(0.0)), out) / X("ln(8e0)")

    # ------------------------------------------------------- across symbols

    def across(self, what: str, x: X) -> X:
        return self.let(f"{what}({self.let(x)}) over (partition by bar_ts)")

    def cross_rank(self, x: X) -> X:
        x = self.let(x)
        place = self.let(f"row_number() over (partition by bar_ts order by {x}, symbol)")
        n = self.let("count(*) over (partition by bar_ts)")
        return X(f"(case when {n} = 1 then 0.5e0 else ({place} - 1) / (({n} - 1) * 1e0) end)")

    def cross_demean(self, x: X) -> X:
        x = self.let(x)
        return x - self.across("avg", x)

    def cross_scale(self, x: X, eps: float) -> X:
        x = self.let(x)
        lo, hi, n = self.across("min", x), self.across("max", x), self.let("count(*) over (partition by bar_ts)")
        return when(X(f"({n} = 1)"), X("0.5e0"), sdiv(x - lo, hi - lo, eps))


def sdiv(a: X, b, eps: float = 1e-9) -> X:
    b = b if isinstance(b, X) else X(number(float(b)))
    return a / X(f"(case when abs({b}) < {eps!r} then (case when {b} < 0e0 then -{eps!r} else {eps!r} end) else {b} end)")


def finite(x: X) -> X:
    """0 in place of what isn't a finite number."""
    return X(f"(case when abs({x}) <= 1.7976931348623157e308 then {x} else 0e0 end)")


def shown(x: X) -> dict[str, X]:
    """A value as six decimals of its size and the size's power of ten, for comparison between engines."""
    size = f"(case when abs({x}) < 1000e0 then 0 else cast(floor(log10(abs({x}))) as int) end)"
    return {"value": X(f"round({x} / power(10e0, {size}), 6) + 0e0"), "exponent": X(size)}
