"""Links among documents that share a group: which pairs are confirmed, and what they connect.

Groups come from an operator's signatures; a group of any size is never expanded into
its pairs. Its members are verified against one of them; of what then still lies in
different components each is verified against another member of its group; what lies apart
after ``STARS`` rounds meets by the rarest shingles of its sets, which is exact, and small groups
are paired at once. Components are kept between rounds: a round only connects the components
that its new links join, and only groups that still lie apart go on. Every link is confirmed on
whole sets of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tickloom.llm.graph import components
from tickloom.llm.shared import cut, drop, likely
from tickloom.llm.shingles import U, pieces, set_hash, shingles

WORDS = 5
PARITIES = 1024
PARITY_WORDS = [f"p{i}" for i in range(PARITIES // 64)]
#: Rounds in which a group meets one of its members, before what lies apart meets by its rarest shingles.
STARS = 2
#: Groups whose pairs are so many times their rows at most are paired at once: the links are the same.
PAIRED = 8


@dataclass(frozen=True)
class Kind:
    """texts (_id, _text); heads (node, head, n, words): a document of each distinct set, its size and sketch;
    ``may(p, q)``: whether sketches with these prefixes allow a link."""

    texts: DataFrame
    heads: DataFrame
    words: list[str]
    percent: int
    may: Callable[[str, str], Column]

    def allows(self, p: str, q: str) -> Column:
        like = 100 * F.least(f"{p}n", f"{q}n") >= self.percent * F.greatest(f"{p}n", f"{q}n")
        return like & self.may(p, q)


def parities(tokens: np.ndarray) -> np.ndarray:
    """``PARITIES`` bits as 64-bit integers: whether an odd number of tokens falls on each."""
    odd = np.bincount((tokens & U(PARITIES - 1)).astype(np.intp), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parities_allow(percent: int) -> Callable[[str, str], Column]:
    """Whether two sets' sizes and parities allow a link: bits that differ are no more than shingles that differ."""

    def allow(p: str, q: str) -> Column:
        apart = sum((F.bit_count(F.col(f"{p}{w}").bitwiseXOR(F.col(f"{q}{w}"))) for w in PARITY_WORDS), F.lit(0))
        return (100 + percent) * apart <= (F.col(f"{p}n") + F.col(f"{q}n")) * (100 - percent)

    return allow


def _sets(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                made = [s for s in shingles(batch.column(text), WORDS) if len(s)]
                if made:
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in made])]).astype(np.int32)
                    flat = pa.array(np.concatenate(made).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in made], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "tokens"])

    return run


def sets_of(wanted: DataFrame, texts: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (node, tokens) of the wanted nodes, made anew from the texts of their heads."""
    ids = heads.join(wanted, "node", "left_semi").select(F.col("head").alias("_head"))
    rows = likely(texts, F.col("_id"), ids, F.col("_head")).select("_text")
    sets = rows.mapInArrow(_sets("_text"), "node long, tokens array<long>").join(wanted, "node", "left_semi")
    return sets.dropDuplicates(["node"])


def sketched(pairs: DataFrame, kind: Kind) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sizes and sketches allow a link."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: kind.heads.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), *[F.col(w).alias(f"{c}{w}") for w in kind.words])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(kind.allows("a", "b")).select("a", "b")


def verified(pairs: DataFrame, kind: Kind) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are linked; a written table."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = cut(sets_of(wanted, kind.texts, kind.heads))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - shared
    found = cut(both.where(100 * shared >= kind.percent * union).select("a", "b"))
    drop(pairs, wanted, sets)
    return found


def connected(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` (node, component) of the linked nodes, with the components that ``edges`` join made one; a written table."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    lifted = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
    new = cut(components(lifted))
    moved = classes.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    made = cut(moved.unionByName(new.join(classes, "node", "left_anti").select("node", "component")))
    drop(new, classes, edges)
    return made


def _apart(used: DataFrame, classes: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (sig, node, probe, component) of the groups whose members lie in several components, how many
    they are, and how many ordered pairs their groups have."""
    known = used.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = F.xxhash64("node", "probe").cast("decimal(38,0)")
    groups = known.groupBy("sig").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("node").alias("centre"), F.max("probe").alias("any"), F.sum(member).alias("members"), F.count("*").alias("size")).where("c != d and any")
    # groups of the same members are one
    groups = groups.groupBy("members", "size", "centre").agg(F.min("sig").alias("sig")).select("sig", "centre", "size")
    seen = Observation()
    made = cut(known.join(groups, "sig").observe(seen, F.count("*").alias("rows"), F.sum("size").alias("pairs")))
    return made, seen.get["rows"], seen.get["pairs"] or 0


def _by_rarest(rows: DataFrame, kind: Kind) -> DataFrame:
    """Candidate pairs (a, b) among the nodes of ``rows`` in different components: linked sets share one of
    their rarest n - ceil(n * percent / 100) + 1 shingles. Passages that many sets hold come last and so
    bring no candidates."""
    nodes = cut(rows.select("node", "component", "n", *kind.words).dropDuplicates(["node"]))
    sets = cut(sets_of(nodes.select("node"), kind.texts, kind.heads))
    flat = sets.select("node", F.explode("tokens").alias("t"))
    often = cut(flat.groupBy("t").agg(F.count("*").alias("f")).where("f > 1"))
    own = Window.partitionBy("node")
    ranked = flat.join(often, "t").withColumns({"rank": F.row_number().over(own.orderBy("f", "t")), "all": F.count("*").over(own)})
    # shingles of no other set are the rarest, but nothing meets by them
    head = cut(ranked.join(nodes, "node").where(f"n - all + rank <= n - ceil(n * {kind.percent} / 100.0) + 1").drop("f", "rank", "all"))
    p, q = head.alias("p"), head.alias("q")
    fits = (F.col("p.node") < F.col("q.node")) & (F.col("p.component") != F.col("q.component")) & kind.allows("p.", "q.")
    pairs = cut(p.join(q, (F.col("p.t") == F.col("q.t")) & fits).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")))
    drop(nodes, sets, often, head)
    return pairs


def link_groups(used: DataFrame, kind: Kind) -> DataFrame:
    """(node, component) of all nodes that links connect with another one; a written table.

    used: rows (sig, node, probe), a written table, which is removed once its groups that lie apart are known; two
    members of a group are candidates where one of them probes.
    """
    groups = used.groupBy("sig").agg(F.min("node").alias("centre"), F.max("probe").alias("any"), F.min_by("probe", "node").alias("centre_probe")).where("any")
    star = used.join(groups, "sig").where("node != centre and (probe or centre_probe)").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    edges = verified(sketched(star, kind), kind)
    classes = cut(components(edges))
    drop(edges)

    # what still lies apart, with another member of each group, and once more: linear in a group, and near copies
    # that are far from one member are joined by the next
    apart, n, pairs = _apart(used.select("sig", "node", "probe"), classes)
    drop(used)
    sketch = kind.heads.select("node", "n", *kind.words)
    for turn in range(1, STARS + 1):
        if not n:
            break
        last = turn == STARS or pairs <= PAIRED * n
        rows = cut(apart.join(sketch, "node"))
        if last and pairs > PAIRED * n:
            met = _by_rarest(rows, kind)
        elif last:  # the rest pair by pair: signed alike, in different components, alike by size and sketch
            p, q = rows.where("probe").alias("p"), rows.alias("q")
            fits = (F.col("p.component") != F.col("q.component")) & (F.col("p.node") != F.col("p.centre")) & (F.col("q.node") != F.col("q.centre")) & kind.allows("p.", "q.")
            met = p.join(q, (F.col("p.sig") == F.col("q.sig")) & fits).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
        else:
            picked = rows.groupBy("sig").agg(F.min_by(F.struct("node", "component", "probe", "n", *kind.words), F.xxhash64("node", "sig", F.lit(turn))).alias("c"))
            fits = (F.col("component") != F.col("c.component")) & (F.col("probe") | F.col("c.probe")) & kind.allows("", "c.")
            met = rows.join(picked, "sig").where(fits).select(F.col("c.node").alias("a"), F.col("node").alias("b"))
        classes = connected(classes, verified(met, kind))
        drop(rows)
        if last:
            break
        before = apart
        apart, n, pairs = _apart(before.select("sig", "node", "probe"), classes)
        drop(before)
    drop(apart)
    return classes


def named(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """key, n_shingles, component_id of every row (_id, node, n_shingles): the smallest key reachable by links."""
    ids = rows.where("node is not null").groupBy("node").agg(F.min("_id").alias("head"), F.count("*").alias("copies"))
    known = ids.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("head").alias("component_id"), F.sum("copies").alias("members"))
    # only nodes that share their component with another row need a look-up
    shared = cut(known.select("node", "component").join(least.where("members > 1"), "component").select("node", "component_id"))
    found = rows.select("_id", "node", "n_shingles").join(shared, "node", "left")
    return found.select(F.col("_id").alias(key), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"))
