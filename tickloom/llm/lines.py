"""Operator 1: line de-duplication by a segment-partition edit join.

A line is dropped where an earlier line of the corpus (by doc_id, then place) is
equal to it, or, for lines of ``LEAST`` code points or more, differs from it by
``EDITS`` edits at most; that the earlier line may itself be dropped changes
nothing. So the first line of every group always stays.

Lines of length l are cut in EDITS + 1 segments, of which a line within the edits
must hold one unchanged, near its place. Each line probes, for every shorter or
equal length within the edits, the few places that the length and the edits on
either side allow. Signatures that only one line has end there. In the group of a
signature every line is first compared with the earliest one; a line that is not
dropped so meets the other earlier ones. Before two lines meet, their lengths and
counts of common letters must allow it; then common ends are cut off and the rest
is compared by a banded bit-parallel edit distance.

DataFrame functions only, one plan at every size. Lines that are a ``HOT``-th of all or more (so ``HOT``
of them at most) are signed at their first occurrence alone, and so a line that stands everywhere makes no
hot group. Tables of wanted lines are met in merge joins behind a map of bounded size. Equal lines are told
by a 63-bit hash.

Defined results: null and empty texts have no lines; a blank line (white space
alone) always stays; rows that share an id count as one document and keep alike; null ids come
first; a document whose every line of ink is dropped goes, one that had none stays; an empty
table gives no rows; other columns are kept as they are but for those named like the results, n_chars is counted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import cut, drop, free, let, likely, look_up

EDITS, LEAST = 2, 20
#: Lines of at least this share of all are sent to all executors: 20,000 rows of 16 bytes at most.
HOT = 20_000
LETTERS = "etaoinshrdlcumfg"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc, place, line, line_id) of all lines with ink."""
    split = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)).alias("place", "line"))
    return split.where(F.col("line").rlike(r"\S")).withColumn("line_id", _line_id(F.col("line")))


def _line_id(line: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(line, F.length(line)), 1)


def _spot(doc: str = "doc", place: str = "place") -> Column:
    """An occurrence of a line, as a hash of its document and place."""
    return F.xxhash64(doc, place)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, how much shorter the other line is, how far the segment moves) of all that a line of so many edits must try."""
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            out += [(i, shorter, move) for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)]
    return out


def segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """(start from 1, size) of a line's segment ``i`` of edits + 1: the last ones are one longer where the length asks for it."""
    size, rest = (length / (edits + 1)).cast("int"), length % (edits + 1)
    longer = i + rest - (edits + 1)  # so many segments before this one are longer
    return 1 + i * size + F.greatest(F.lit(0), longer), size + F.when(longer >= 0, 1).otherwise(0)


def _signed(rows: DataFrame, edits: int, least: int) -> DataFrame:
    """Rows (sig, tag): tag is the line's id doubled, odd where the signature is one of the line's own segments.

    A line is first repeated for each of its probes, and then one short expression signs them all: a list of a dozen long ones is
    more than the compiler of the virtual machine takes.
    """
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(shorter).alias("shorter"), F.lit(move).alias("move")) for i, shorter, move in probes(edits)])
    sized = rows.select("line", "line_id", F.length("line").alias("n")).where(F.col("n") >= least)
    each = sized.select("line", "line_id", "n", F.explode(tries).alias("p")).where(F.col("n") - F.col("p.shorter") >= least)
    length = F.col("n") - F.col("p.shorter")
    start, size = segment(length, F.col("p.i"), edits)
    own = F.when((F.col("p.shorter") == 0) & (F.col("p.move") == 0), 1).otherwise(0)
    placed = each.select("line", "line_id", F.col("p.i").alias("i"), length.alias("length"), (start + F.col("p.move")).alias("start"), size.alias("size"), own.alias("own")).where("start >= 1")
    return placed.select(F.xxhash64("i", "length", F.col("line").substr(F.col("start"), F.col("size"))).alias("sig"), (F.shiftleft("line_id", 1) + F.col("own")).alias("tag"))


def _trimmed(a: Column, b: Column, body) -> Column:
    """``body`` of the two strings without their common ends, found by halving steps."""

    def common(a: Column, b: Column, most: Column, back: bool) -> Column:
        part = (lambda s, at, k: F.substring(s, F.length(s) - at - k + 1, k)) if back else (lambda s, at, k: F.substring(s, at + 1, k))
        steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        return F.aggregate(steps, F.lit(0), lambda at, k: at + F.when((at + k <= most) & (part(a, at, k) == part(b, at, k)), k).otherwise(0))

    def front(p: Column) -> Column:
        rest = F.struct(F.substring(a, p + 1, F.length(a) - p).alias("a"), F.substring(b, p + 1, F.length(b) - p).alias("b"))

        def behind(r: Column) -> Column:
            most = F.least(F.length(r["a"]), F.length(r["b"]))
            return let(common(r["a"], r["b"], most, True), lambda q: body(F.substring(r["a"], F.lit(1), F.length(r["a"]) - q), F.substring(r["b"], F.lit(1), F.length(r["b"]) - q)))

        return let(rest, behind)

    return let(common(a, b, F.least(F.length(a), F.length(b)), False), front)


def banded(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings where it is ``edits`` at most, else a greater number.

    A word of 2 * edits + 2 bits holds the vertical differences of the cells around the diagonal
    and moves down by one row a column, after Hyyrö's bit-vector algorithm.
    """
    w = 2 * edits + 2
    full = (1 << w) - 1

    def run(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)

        def step(s: Column, j: Column) -> Column:
            # bit k: does row j + edits + 2 - w + k of x hold column j's sign
            hit = sum((F.when(F.get(x, j + (edits + 1 - w + k)) == F.get(y, j), 1 << k).otherwise(0) for k in range(w)), F.lit(0))
            vp, vn = s["vp"], s["vn"]
            d0 = lambda h: (h.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full)).bitwiseXOR(vp).bitwiseOR(h).bitwiseOR(vn)
            return let(hit, lambda h: let(d0(h), lambda d: follow(s, d, j)))

        def follow(s: Column, d0: Column, j: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            hp = vn.bitwiseOR(F.lit(full) - d0.bitwiseOR(vp))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            # rows below the band's last cell don't exist from column m - edits on: the last row is followed instead
            last = m - edits - 2 + w - j
            bit = lambda v, k: v.bitwiseAND(F.pow(F.lit(2.0), k).cast("int"))
            below = F.when(d0.bitwiseAND(F.lit(1 << (w - 1))) == 0, 1).otherwise(0)
            along = F.when(bit(hp, last) != 0, 1).otherwise(0) - F.when(bit(hn, last) != 0, 1).otherwise(0)
            at = s["d"] + F.when(j < m - edits, below).otherwise(along)
            return F.struct(hn.bitwiseOR(F.lit(full) - down.bitwiseOR(hp)).alias("vp"), down.bitwiseAND(hp).alias("vn"), at.alias("d"))

        start = F.struct(F.lit(((1 << (edits + 1)) - 1) << (w - edits - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(edits)).alias("d"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["d"])

    chars = lambda c: F.split(c, "")
    return let(F.struct(chars(a).alias("x"), chars(b).alias("y")), lambda v: run(v["x"], v["y"]))


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings differ by ``edits`` edits at most."""

    def rest(x: Column, y: Column) -> Column:
        short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
        apart = long_ - short
        return F.when(apart > edits, False).when(short == 0, long_ <= edits).when(long_ <= edits, True).otherwise(banded(x, y, edits) <= edits)

    return _trimmed(a, b, rest)


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Ids of lines that are within the edits of an earlier line: pairs (early, late) that hold; a written table."""
    side = lambda c: texts.select(F.col("line_id").alias(c), F.col("line").alias(f"{c}_line"))
    both = pairs.distinct().join(side("early"), "early").join(side("late"), "late")
    return cut(both.where(within(F.col("early_line"), F.col("late_line"), edits)).select("early", "late"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """Lines to drop: rows (line_id, spot) where only the occurrence at ``spot``, if any, stays; a written table."""
    at = F.struct(F.col("doc").alias("doc"), F.col("place").alias("place"))
    rows = lines(docs, key, text).withColumn("spot", _spot())
    seen = cut(rows.groupBy("line_id").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.max(F.length("line")).alias("length")).withColumn("spot", _spot("at.doc", "at.place")))

    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = seen.where((F.col("n") > 1) & (F.col("n") * HOT >= total)).select("line_id", F.col("spot").alias("first_spot"))
    named = rows.join(F.broadcast(hot), "line_id", "left")
    signed = _signed(named.where(F.col("first_spot").isNull() | (F.col("first_spot") == F.col("spot"))).select("line", "line_id"), edits, max(least, edits + 1))
    w = Window.partitionBy("sig")
    node = F.shiftrightunsigned("tag", 1)
    own = F.max(F.col("tag").bitwiseAND(F.lit(1)))
    counted = signed.withColumns({"least": F.min(node).over(w), "most": F.max(node).over(w), "own": own.over(w)})
    # one row a line: a signature may be its own segment and a moved one as well
    hits = cut(counted.where("least != most and own = 1").groupBy("sig", node.alias("line_id")).agg((own == 1).alias("own")))

    # one occurrence of each line that takes part, with what the pairs need
    wanted = cut(hits.select("line_id").distinct().join(seen, "line_id").select("line_id", "at", "length", "spot"))
    spots = wanted.select("line_id", "spot")
    some = likely(rows, F.col("spot"), spots, F.col("spot")).join(spots.hint("merge"), ["line_id", "spot"])
    letters = F.array(*[F.length("line") - F.length(F.replace(F.col("line"), F.lit(c))) for c in LETTERS])
    texts = cut(some.dropDuplicates(["line_id"]).select("line_id", "line", letters.alias("letters")))
    placed = cut(hits.join(wanted, "line_id").select("sig", "own", F.struct("at.doc", "at.place", "line_id").alias("at"), "line_id", "length"))
    drop(hits, wanted)

    # every line of a group with the earliest one
    centre = placed.groupBy("sig").agg(F.min(F.struct("at", "own", "length")).alias("c"))
    near = (F.col("own") | F.col("c.own")) & (F.abs(F.col("length") - F.col("c.length")) <= edits) & (F.col("line_id") != F.col("c.at.line_id"))
    first = placed.join(centre, "sig").where(near).select(F.col("c.at.line_id").alias("early"), F.col("line_id").alias("late"))
    dropped = _verified(first, texts, edits)

    # lines that stay so far meet the others that come before them
    left = cut(placed.join(texts.select("line_id", "letters"), "line_id").join(centre.select("sig", F.col("c.at.line_id").alias("centre")), "sig").where(F.col("line_id") != F.col("centre")))
    late, early = left.join(dropped.select(F.col("late").alias("line_id")).distinct(), "line_id", "left_anti").alias("q"), left.alias("p")
    differ = F.aggregate(F.zip_with("p.letters", "q.letters", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    may = (F.col("p.at") < F.col("q.at")) & (F.col("p.own") | F.col("q.own")) & (F.abs(F.col("p.length") - F.col("q.length")) <= edits) & (differ <= 2 * edits)
    rest = late.join(early, (F.col("p.sig") == F.col("q.sig")) & may).select(F.col("p.line_id").alias("early"), F.col("q.line_id").alias("late"))
    near_lines = dropped.unionByName(_verified(rest, texts, edits)).select(F.col("late").alias("line_id")).distinct()

    repeated = seen.where("n > 1").select("line_id", "spot")
    both = repeated.join(near_lines.withColumn("all", F.lit(True)), "line_id", "full")
    # of lines near an earlier one no occurrence stays
    found = cut(both.select("line_id", F.when(F.col("all").isNull(), F.col("spot")).alias("stays")))
    drop(seen, texts, placed, left)
    return found


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` with the kept lines as text, and ``_lines``, ``_dropped``: counts of all lines and of dropped ones."""
    gone = find(docs, key, text, edits, least)
    rows = lines(docs, key, text).withColumn("spot", _spot()).select("doc", "place", "line_id", "spot")
    some = likely(rows, F.col("line_id"), gone, F.col("line_id"))
    out = some.join(gone.hint("merge"), "line_id").where(F.col("stays").isNull() | (F.col("stays") != F.col("spot")))
    own, at = free(docs, "_doc"), free(docs, "_places")
    places = cut(out.groupBy(F.col("doc").alias(own)).agg(F.collect_set("place").alias(at)))
    found = look_up(docs, docs[key], places, own).drop(own)
    every = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col(at).isNull(), F.col(text)).otherwise(F.array_join(F.filter(every, lambda x, i: ~F.array_contains(at, i)), "\n"))
    counts = {"_lines": F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(F.size(every)).cast("long"), "_dropped": F.coalesce(F.size(at), F.lit(0)).cast("long")}
    return found.withColumns({**counts, text: kept}).drop(at)


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with their kept lines; documents of which no line of ink is left go."""
    made = dedup_lines(docs, key, text).where((F.col("_dropped") == 0) | F.col(text).rlike(r"\S"))
    own = {n_chars: F.when(F.col("_dropped") == 0, F.col(n_chars)).otherwise(F.length(text).cast(docs.schema[n_chars].dataType))} if n_chars in docs.columns else {}
    return made.withColumns(own).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
