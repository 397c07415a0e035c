"""Operator 9: SentencePiece encoding and decoding with seeded merge-dropout.

Ids come from a public BPE model file. Encoding works the agenda of merges: the
candidate of the best score (leftmost on ties) is taken from the agenda, and
dropped where a keyed hash of (seed, row key, unit number, turn) falls below the
dropout rate; a merge puts the pairs with its neighbours on the agenda. Turn t is
the t-th candidate taken. With dropout 0 the ids are those of the model's own encoder.

Merges never cross into a run of spaces or a line end (no piece of the model holds
a space behind another sign), so a text is encoded unit by unit. Every occurrence
of a unit draws on its own. What a unit becomes depends on its letters and the
turns that are dropped, so each such case is worked once and remembered: a task
draws for all units of a batch as arrays, turn by turn, and only cases not met yet
go through the agenda, as arrays of units of one length. Units longer than ``LONG``
go through a heap one by one, in time near their length. Signs outside the
vocabulary, and a literal U+2581, become byte pieces, so decoding gives back every
text exactly.

Defined results: null text gives null ids and decodes to null; empty text gives no
ids; rows repeated stay and get equal ids; a null key is the key ""; an empty table
gives no rows; input columns that are named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.shared import small_batches
from tickloom.llm.shingles import mix

SPACE = "\u2581"
DROPOUT, SEED = 0.1, 17
#: Units of more signs are worked by a heap and not remembered.
LONG = 40
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
FAR = np.int32(2**31 - 1)
_BYTE = [bytes([b]) for b in range(256)]


class Pieces:
    """A model's pieces, encoder with merge-dropout, and decoder."""

    #: Cases remembered at most (some 300 MB); then the memory starts anew.
    MOST = 1_500_000

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = sp.id_to_piece(list(range(n)))
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {names[i]: i for i in range(n) if plain[i]}
        self.n, self.ids, self.seed = n, ids, seed
        self.limit = np.uint64(round(dropout * 2**32))
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        self.bytes_at = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.shown = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() if plain[i] else b"" for i in range(n)]
        order = sorted(ids.values(), key=lambda i: (-sp.get_score(i), i))
        rank = np.full(n, FAR, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.by_rank = np.array(order, np.int64)
        keys, ranks = [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank[i])
        self._index(np.array(keys, np.int64), np.array(ranks, np.int32))
        #: Id of each code point, or the code point behind the vocabulary where it has no piece.
        self.single = np.arange(0x110000, dtype=np.int64) + n
        for piece, i in ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        # ranks of two common signs in a plain table, in which -1 stands for all others
        common = np.array([*range(0x250), ord(SPACE)])
        self.common, m = np.full(0x110000, len(common), np.int32), len(common)
        self.common[common] = np.arange(m)
        self.first = np.full((m + 1, m + 1), -1, np.int32)
        self.first[:m, :m] = self._pair(np.repeat(self.single[common], m), np.tile(self.single[common], m)).reshape(m, m)
        self.rank_of = dict(zip(keys, map(int, ranks), strict=True))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a unit's case without a drop
        self.child: dict[int, int] = {}  # case << 8 | turn dropped next: case
        self.unit: list[str] = []
        self.drops: list[bytes] = []  # turns that a case drops
        self.out: list[bytes] = []
        self.turns = np.zeros(1 << 16, np.int32)  # candidates taken, by case
        self._learn([""], [b""])
        self.known[""] = 0

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table of pairs of neighbours with the rank of the piece that they make."""
        bits = (2 * len(keys) + 64).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.slot_ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, FAR, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[free]
            mine = self.slots[at] == keys
            self.slot_ranks[at[mine]] = ranks[mine]
            keys, ranks, at = keys[~mine], ranks[~mine], (at[~mine] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two neighbours make, or FAR."""
        key = left << 32 | right
        at = self._slot(key)
        held, ranks = self.slots[at], self.slot_ranks[at]
        other = np.flatnonzero(held != key)
        ranks[other] = FAR
        other = other[held[other] != -1]
        while len(other):
            at[other] = (at[other] + 1) & self.last
            held = self.slots[at[other]]
            found = held == key[other]
            ranks[other[found]] = self.slot_ranks[at[other[found]]]
            other = other[~found & (held != -1)]
        return ranks

    def _agenda(self, units: list[str], drops: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units of one length where the given turns are dropped, how many each has, and how many turns each took."""
        size, w = len(units[0]), len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, turns = self.single[codes], np.zeros(w, np.int32)
        if size < 2:
            return sym, np.ones(w, np.int64), turns
        skipped = None
        if dropped := b"".join(drops):
            skipped = np.zeros((w, 3 * size), bool)
            skipped[np.repeat(np.arange(w), np.fromiter(map(len, drops), np.int64, w)), np.frombuffer(dropped, np.uint8)] = True
        # places run over all units; a unit ends where the next one starts
        gone = np.zeros(w * size, bool)  # symbols that are part of the one before
        after = np.arange(1, w * size + 1)  # where the next symbol starts
        before = np.arange(-1, w * size - 1)
        table = np.full((w, size), FAR, np.int32)  # rank of a symbol with its next one
        best = table.ravel()
        signs = self.common[codes]
        best[:-1] = self.first.ravel()[signs[:-1] * np.int32(len(self.first)) + signs[1:]]
        rare = np.flatnonzero(best[:-1] < 0)
        best[rare] = self._pair(sym[rare], sym[rare + 1])
        table[:, -1] = FAR
        live, turn = np.arange(w), 0
        while True:
            i = live * size + table[live].argmin(1)
            rank = best[i]
            open_ = rank != FAR
            live, i, rank = live[open_], i[open_], rank[open_]
            if not len(live):
                break
            end = (live + 1) * size
            if skipped is not None:
                skip = skipped[live, turn]
                best[i[skip]] = FAR
                i, rank, end = i[~skip], rank[~skip], end[~skip]
            turn += 1
            turns[live] = turn
            j = after[i]
            e = after[j]
            sym[i] = self.by_rank[rank]
            gone[j] = True
            best[j] = best[i] = FAR
            after[i] = e
            inner, p = e < end, before[i]
            back = p >= end - size
            right, left = e[inner], p[back]
            own, mine = i[inner], i[back]
            before[right] = own
            ranks = self._pair(sym[np.concatenate([own, left])], sym[np.concatenate([right, mine])])
            best[own], best[left] = ranks[: len(own)], ranks[len(own) :]
        kept = ~gone
        return sym[kept], kept.reshape(w, size).sum(1), turns

    def _heap(self, unit: str, base: np.uint64) -> np.ndarray:
        """Ids of one unit of any length."""
        sym = self.single[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n, known = len(sym), self.rank_of
        dropped = self._drawn(np.full(3 * n, base), np.arange(3 * n, dtype=np.uint64)).tolist()
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        agenda = [(r, i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (r := known.get(a << 32 | b)) is not None]
        heapq.heapify(agenda)
        turn = 0
        while agenda:
            rank, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            turn += 1
            if dropped[turn - 1]:
                continue
            sym[i] = int(self.by_rank[rank])
            gone[j], e = True, after[j]
            after[i] = e
            if e < n:
                before[e] = i
                if (r := known.get(sym[i] << 32 | sym[e])) is not None:
                    heapq.heappush(agenda, (r, i, sym[i], sym[e]))
            if (p := before[i]) >= 0 and (r := known.get(sym[p] << 32 | sym[i])) is not None:
                heapq.heappush(agenda, (r, p, sym[p], sym[i]))
        return np.array([x for x, g in zip(sym, gone, strict=True) if not g], np.int64)

    def _as_bytes(self, ids: np.ndarray) -> bytes:
        if (ids >= self.n).any():
            parts = [[i] if i < self.n else self.bytes_at[list(chr(i - self.n).encode("utf-8", "surrogatepass"))] for i in ids.tolist()]
            ids = np.concatenate(parts)
        return ids.astype(self.kind).tobytes()

    def _learn(self, units: list[str], drops: list[bytes]) -> range:
        """Works cases of units and dropped turns; their numbers."""
        first, wide = len(self.out), np.dtype(self.kind).itemsize
        while first + len(units) > len(self.turns):
            self.turns = np.concatenate([self.turns, np.zeros_like(self.turns)])
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        edges, sizes = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(units)], sizes[order]
        made: list[bytes] = []  # by size
        for lo, hi in zip(edges, edges[1:], strict=False):
            size = int(sizes[lo]) if hi > lo else 0
            if not size:
                made += [b""] * (hi - lo)
                continue
            step = max(1, 400_000 // size)
            for at in range(lo, hi, step):
                some = order[at : min(at + step, hi)]
                own = some.tolist()
                ids, counts, turns = self._agenda(list(map(units.__getitem__, own)), list(map(drops.__getitem__, own)))
                self.turns[first + some] = turns
                data, ends = ids.astype(self.kind).tobytes(), np.cumsum(counts)
                cuts = (ends * wide).tolist()
                base = len(made)
                made += map(data.__getitem__, map(slice, [0, *cuts], cuts))
                # units with signs outside the vocabulary
                for i in np.unique(np.repeat(np.arange(len(own)), counts)[ids >= self.n]).tolist():
                    made[base + i] = self._as_bytes(ids[ends[i] - counts[i] : ends[i]])
        self.out += map(made.__getitem__, place.tolist())
        self.unit += units
        self.drops += drops
        return range(first, len(self.out))

    def _drawn(self, base: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Whether a unit drops a turn."""
        return mix(base + turn * np.uint64(0x9E3779B97F4A7C15), 31) >> np.uint64(32) < self.limit

    def _next_drop(self, base: np.ndarray, turn: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first turn from ``turn`` on, before ``end``, that a unit drops; else -1."""
        found, turn = np.full(len(base), -1, np.int64), turn.copy()
        at = np.flatnonzero(turn < end)
        while len(at):
            hit = self._drawn(base[at], turn[at].astype(np.uint64))
            found[at[hit]] = turn[at[hit]]
            at = at[~hit]
            turn[at] += 1
            at = at[turn[at] < end[at]]
        return found

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """Cases that follow where a case drops one more turn; keys are case << 8 | turn."""
        some, back = np.unique(keys, return_inverse=True)
        new = [k for k in some.tolist() if k not in self.child]
        units, drops = [self.unit[k >> 8] for k in new], [self.drops[k >> 8] + _BYTE[k & 255] for k in new]
        self.child.update(zip(new, self._learn(units, drops), strict=True))
        return np.fromiter(map(self.child.__getitem__, some.tolist()), np.int64, len(some))[back]

    def encode(self, texts: list[str], keys: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        if len(self.out) > self.MOST:
            self._forget()
        units: list[str] = []
        ends, fixed = [], {}
        mark = self.bytes_at[list(SPACE.encode())].astype(self.kind).tobytes()
        for text in texts:
            for k, part in enumerate(text.split(SPACE)):
                if k:
                    fixed[len(units)] = mark  # a literal U+2581
                    units.append("")
                part = part.replace(" ", SPACE)
                units += UNIT.findall(SPACE + part if k == 0 and text else part)
            ends.append(len(units))
        counts = np.diff([0, *ends])
        rows = np.array([int.from_bytes(hashlib.blake2b(f"{self.seed}:{k}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for k in keys], np.uint64)
        number = np.arange(len(units)) - np.repeat(np.array(ends, np.int64) - counts, counts)
        base = mix(np.repeat(rows, counts) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 30)
        case = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        unmet = np.flatnonzero(case < 0).tolist()
        for i in unmet:  # long units are never remembered
            if len(units[i]) > LONG:
                fixed[i] = self._as_bytes(self._heap(units[i], base[i]))
                units[i] = ""
        if unmet:
            new = [u for u in dict.fromkeys(map(units.__getitem__, unmet)) if u]
            self.known.update(zip(new, self._learn(new, [b""] * len(new)), strict=True))
            case[unmet] = [self.known[units[i]] for i in unmet]
        active, turn = np.arange(len(units) if self.limit else 0), np.zeros(len(units), np.int64)
        while len(active):
            at = self._next_drop(base[active], turn[active], self.turns[case[active]])
            active, at = active[at >= 0], at[at >= 0]
            case[active] = self._children(case[active] << 8 | at)
            turn[active] = at + 1
        got = list(map(self.out.__getitem__, case.tolist()))
        for i, x in fixed.items():
            got[i] = x
        return [b"".join(got[end - n : end]) for end, n in zip(ends, counts.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts in front goes."""
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[tuple, Pieces] = {}


def pieces(*args) -> Pieces:
    if args not in _LOADED:
        _LOADED[args] = Pieces(*args)
    return _LOADED[args]


RESULTS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED, digest: bool = False) -> DataFrame:
    """``docs`` with ids; rows don't move.

    With ``digest`` the texts and ids are replaced by n_pieces, ids_crc32 (of the ids as
    unsigned 32-bit integers), text_sha256 (of the decoded text) and lossless.
    """
    small_batches(docs.sparkSession)
    drop = {"ids", text} if digest else {"ids"}
    names = ["n_pieces", "ids_crc32", "text_sha256", "lossless"] if digest else ["ids"]
    kept = [f for f in docs.schema if f.name not in drop | set(names)]
    added = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())] if digest else RESULTS[:1]
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path, dropout, seed)
        for batch in batches:
            size = np.cumsum([0 if n is None else n for n in pc.utf8_length(batch.column(text)).to_pylist()]) // 4_000_000
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    yield of(p, batch.slice(lo, hi - lo))

    def of(p: Pieces, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text).to_pylist()
        keys = ["" if k is None else str(k) for k in batch.column(key).to_pylist()]
        made = p.encode([t or "" for t in texts], keys)
        null = np.array([t is None for t in texts])
        if not digest:
            ids = [np.frombuffer(m, p.kind) for m in made]
            ends = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, p.kind), *ids]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.concatenate([null, [False]])), flat)]
        else:
            ids = [np.frombuffer(m, p.kind) for m in made]
            back = [None if t is None else p.decode(i) for t, i in zip(texts, ids, strict=True)]
            columns = [
                pa.array([None if t is None else len(i) for t, i in zip(texts, ids, strict=True)], pa.int64()),
                pa.array([None if t is None else zlib.crc32(i.astype("<u4").tobytes()) for t, i in zip(texts, ids, strict=True)], pa.int64()),
                pa.array([None if b is None else hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back], pa.string()),
                pa.array([b == t for b, t in zip(back, texts, strict=True)], pa.bool_()),
            ]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def detokenize(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``."""
    kept = [f for f in rows.schema if f.name != "decoded"]
    schema = T.StructType([*kept, RESULTS[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            text = [None if x is None else p.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(text, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text"))
    return tokenize(docs, path or model_path(), digest=True)
