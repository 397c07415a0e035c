"""Operator 5: token ids in length-delimited binary records.

Texts are encoded, dealt out in ascending id order by ranges of the id, and each
range is written as a file of framed records, or several of about ``FILE_BYTES``:

    uint64 length | uint32 masked CRC-32C of the length | payload | uint32 masked CRC-32C of the payload

(all little-endian; the public record framing of TensorFlow). A payload is the
signed 64-bit id and then the token ids as unsigned 16-bit integers, or 32-bit ones
where the vocabulary is larger. Beside ``shard-N-K.records`` lies ``shard-N-K.index``:
an unsigned 64-bit offset per record, so that a reader may take records in any
order with one seek each.

A task writes under a name of its own attempt and renames it when done, so a
repeated or speculative task leaves the same whole file. Ranges keep equal ids
together; no key but the id is dealt on, so no source or group is a hot task.

Defined results: null text is empty (only the end id); rows repeated with one id
stay, ordered by text; null ids come first and read back as null; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import new_folder, parts, small_batches

NULL_ID = -(2**63)
#: Text of so many bytes goes in a range of ids, as a mean; a file that grows past ``FILE_BYTES`` is followed by another.
RANGE_BYTES, FILE_BYTES = 128 << 20, 256 << 20
CHUNK = 1024
_TABLES: dict[str, np.ndarray] = {}


# ------------------------------------------------------------- checksums


def _table() -> np.ndarray:
    if "byte" not in _TABLES:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, t >> 1 ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
        _TABLES["byte"] = t
        # what two zero bytes do to the register's lower half
        x = np.arange(1 << 16, dtype=np.uint32)
        for _ in range(2):
            x = t[x & 255] ^ x >> 8
        _TABLES["pair"] = x
        # what CHUNK zero bytes do to each byte of the register
        step = np.zeros((4, 256), np.uint32)
        for place in range(4):
            x = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
            for _ in range(CHUNK):
                x = t[x & 255] ^ x >> 8
            step[place] = x
        _TABLES["chunk"] = step
    return _TABLES["byte"]


def crc32c(data: list[bytes]) -> np.ndarray:
    """CRC-32C of every item; all items and their chunks advance together, two bytes at a time.

    A register over zero bytes that starts at zero stays zero, so items are padded
    in front; the usual start value is the first four bytes complemented.
    """
    t = _table()
    n = np.fromiter(map(len, data), np.int64, len(data))
    out = np.zeros(len(data), np.uint32)
    for i in np.flatnonzero(n < 4):
        x = 0xFFFFFFFF
        for b in data[i]:
            x = int(t[(x ^ b) & 255]) ^ x >> 8
        out[i] = x ^ 0xFFFFFFFF
    big = np.flatnonzero(n >= 4)
    if not len(big):
        return out
    size = min(CHUNK, int(n.max()) + 1 & ~1)
    chunks = -(-n[big] // size)
    ends = np.cumsum(chunks) * size
    flat = np.zeros(int(ends[-1]), np.uint8)
    for i, end in zip(big, ends, strict=True):
        flat[end - n[i] : end] = np.frombuffer(data[i], np.uint8)
    heads = (ends - n[big])[:, None] + np.arange(4)
    flat[heads] ^= 255
    grid, pair = flat.view("<u2").reshape(-1, size // 2).T, _TABLES["pair"]
    x = np.zeros(grid.shape[1], np.uint32)
    for row in np.ascontiguousarray(grid):
        x = pair[(x ^ row) & 65535] ^ x >> np.uint32(16)
    # items of several chunks: those are of CHUNK bytes
    step, first = _TABLES["chunk"], ends // size - chunks
    total = x[first]
    for k in range(1, int(chunks.max())):
        at = np.flatnonzero(chunks > k)
        r = total[at]
        total[at] = step[0][r & 255] ^ step[1][r >> 8 & 255] ^ step[2][r >> 16 & 255] ^ step[3][r >> 24] ^ x[first[at] + k]
    out[big] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)).astype(np.uint32)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [h + x.tobytes() + p + y.tobytes() for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def unframe(data: bytes) -> list[bytes]:
    """The payloads of a file of records; raises where a checksum or a length doesn't hold."""
    at, heads, out, sums = 0, [], [], []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        heads.append(data[at : at + 8])
        out.append(data[at + 12 : at + 12 + n])
        sums.append((data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]))
        at += 16 + n
    for k, want in enumerate((masked(crc32c(heads)), masked(crc32c(out)))):
        got = np.frombuffer(b"".join(s[k] for s in sums), "<u4")
        if (got != want).any():
            raise ValueError(f"checksum of record {int(np.flatnonzero(got != want)[0])} doesn't hold")
    return out


def read_at(path: str, k: int) -> bytes:
    """Payload ``k`` of a shard, by its offset index."""
    fs, own = filesystem(path)
    with fs.open_input_file(own.removesuffix(".records") + ".index") as f:
        (at,) = struct.unpack("<Q", f.read_at(8, 8 * k))
    with fs.open_input_file(own) as f:
        (n,) = struct.unpack("<Q", f.read_at(8, at))
        return unframe(f.read_at(16 + n, at))[0]


def filesystem(path: str):
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ------------------------------------------------------------- encoding


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, remembered by word.

    White space separates words of this vocabulary for good (the file's own
    normaliser and pre-tokeniser drop it), as do a letter and a sign beside it, and
    letters are lowered. So a text's ids are its words' ids in order, and a stop or
    comma between a letter and white space is a word of its own. Words not seen yet
    go through the library together in one call; a word of letters alone ends at
    the one piece that ends a word. A word of plain letters, digits and signs is the
    runs that the file's pattern parts it into.
    """

    #: Words remembered at most (some 150 MB); then the memory starts anew.
    MOST = 1_000_000
    #: A stop or comma behind another sign, or a letter that normalisation may part, belongs to that sign's run.
    RUN = re.compile(r"[.,](?=\s|$)(?:(?<=[^\w\s].)|(?<=[_\u0130].)|(?<=[^\x00-\u02ff].))")
    #: Signs that Python takes for white space and the library doesn't; words of a text that has them.
    SEPARATORS, WORD = "\x1c\x1d\x1e\x1f", re.compile(r"(?:\S|[\x1c-\x1f])+")
    #: Letters from U+0130 on, which are not lowered alike by all.
    WIDE = re.compile("[\u0130-\U0010ffff]")
    #: Words of plain letters, digits and signs (no apostrophe, which may draw letters to it), and their runs.
    MIXED = re.compile(r"[a-z\xdf-\xf6\xf8-\xff0-9!-&(-/:-@\[-`{-~]+")
    PART = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lower-case letters alone, which need no normaliser and no pattern
        self.lean = Tokenizer(self.tokenizer.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, words: set[str]) -> None:
        letters = lambda words: [w for w in words if w.isalpha() and w.islower() and max(w) < "\u0130"]
        rest = words.difference(plain := letters(words))
        parted = {w: runs for w in rest if self.MIXED.fullmatch(w) and len(runs := self.PART.findall(w)) > 1}
        runs = set().union(*parted.values()).difference(self.known, words)
        plain += (more := letters(runs))
        for w in rest.difference(parted) | runs.difference(more):
            self.known[w] = self._ids(w).tobytes()
        for lo in range(0, len(plain), 1000):
            some = plain[lo : lo + 1000]
            ids = np.array(self.lean.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # a word that the library parts after all
                self.known.update((w, self._ids(w).tobytes()) for w in some)
                continue
            size, data = ids.itemsize, ids.tobytes()
            ends = (cuts * size).tolist()
            self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        for w, runs in parted.items():
            self.known[w] = b"".join([self.known[r] for r in runs])

    def words(self, text: str) -> list[str]:
        if any(sign in text for sign in self.SEPARATORS):
            return self.WORD.findall(text)
        if self.RUN.search(text) is None:
            for sign in ".,":
                for space in " \n":
                    text = text.replace(sign + space, f" {sign} ")
            if text[-1:] in (".", ","):
                text = f"{text[:-1]} {text[-1]}"
        # letters below U+0130 are lowered alike by all; others are left to the library
        return (text.lower() if text.isascii() or self.WIDE.search(text) is None else text).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.known) > self.MOST:
            self.known = {}
        # a word is looked up once for all its places
        held = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        if not len(held):
            return [b""] * len(texts)
        distinct = held.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, distinct))
        if new := {w for w, x in zip(distinct, ids, strict=True) if x is None}:
            self.learn(new)
            ids = [self.known[w] if x is None else x for w, x in zip(distinct, ids, strict=True)]
        ids = pa.array(ids, pa.large_binary()).take(held.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, split)])].tolist()
        data = data.to_pybytes()
        return [data[a:b] for a, b in pairwise(ends)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------- files


def _pieces(pdf: pd.DataFrame, chars: int = 3_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows of bounded text, so that memory is bounded whatever a batch holds."""
    if len(pdf):
        run = np.cumsum(pdf["text"].str.len().fillna(0).to_numpy()) // chars
        for _, part in pdf.groupby(run, sort=True):
            yield part


def _write(folder: str, vocabulary: str, end_id: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, own = filesystem(folder)
        shard, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.kind).tobytes()
        parts = (part for pdf in batches for part in _pieces(pdf))
        following, part = 0, next(parts, None)
        while part is not None or not following:
            name, tmp = f"{own}/shard-{shard:06d}-{following:04d}", f"{own}/_attempt-{shard:06d}-{following:04d}-{tag}"
            offsets, at, tokens = [], 0, 0
            with fs.open_output_stream(tmp + ".records") as out:
                while part is not None and at < most:
                    ids = enc.encode(part["text"].fillna("").tolist())
                    keys = part["id"].fillna(NULL_ID).astype("int64")
                    payloads = [struct.pack("<q", k) + x + end for k, x in zip(keys, ids, strict=True)]
                    framed = frames(payloads)
                    offsets += (at + np.concatenate([[0], np.cumsum([len(f) for f in framed])[:-1]])).astype(int).tolist()
                    at += sum(map(len, framed))
                    tokens += sum(len(p) - 8 for p in payloads) // len(end)
                    out.write(b"".join(framed))
                    part = next(parts, None)
            with fs.open_output_stream(tmp + ".index") as out:
                out.write(np.array(offsets, "<u8").tobytes())
            for kind in (".index", ".records"):
                fs.move(tmp + kind, name + kind)
            yield pd.DataFrame({"shard": [shard], "file": [following], "n_records": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})
            following += 1

    return run


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns a row per file: shard, file, n_records, n_tokens, n_bytes (a written table)."""
    spark = docs.sparkSession
    small_batches(spark)
    fs, own = filesystem(folder)
    fs.create_dir(own, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # ranges of the id, whatever else the rows hold
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards or max(parts(spark), -(-size // RANGE_BYTES))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("text"))
    made = ordered.mapInPandas(_write(folder, vocabulary, end_id, file_bytes), "shard int, file int, n_records long, n_tokens long, n_bytes long")
    made.write.parquet(table := f"{folder}/_shards")
    return spark.read.schema(made.schema).parquet(table)


def _read(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                payloads = unframe(content)
                keys = np.array([struct.unpack_from("<q", p)[0] for p in payloads], np.int64)
                n = np.array([(len(p) - 8) // int(kind[2]) for p in payloads], np.int64)
                sums = [zlib.crc32(np.frombuffer(p, kind, offset=8).astype("<u4").tobytes()) for p in payloads]
                known = pd.array(keys, "Int64")
                known[keys == NULL_ID] = pd.NA
                shard, file = map(int, path.rpartition("shard-")[2].removesuffix(".records").split("-"))
                yield pd.DataFrame({"shard": shard, "file": file, "doc_id": known, "before": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(sums, np.int64)})

    return run


def read_records(spark: SparkSession, folder: str, kind: str = "<u2") -> DataFrame:
    """A row per record in any order: shard, file, doc_id, before (ids of the file before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.records").load(folder).select("path", "content")
    return files.mapInPandas(_read(kind), "shard int, file int, doc_id long, before long, n_tokens long, ids_crc32 long")


def op5_token_records(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_folder(spark, "records")
    shards = write_records(docs, folder, vocabulary, end_id=1)
    # one row a file: the running total of a short table
    base = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "file", "base")
    return read_records(spark, folder).join(base, ["shard", "file"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "file")
