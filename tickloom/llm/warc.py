"""Operator 2: legacy ARC archives converted to WARC.

ARC files start with a version block (``filedesc://``) whose second line names
the version; version 1 headers have five fields, version 2 headers ten. A
record's body follows by its declared length, so bodies may hold any bytes. The
converter parses both, then synthesises what WARC asks for: record ids,
timestamps, record types (warcinfo, response, revisit) and SHA-1 digests.

Everything is done per archive: Spark's readers give whole archives (one per
write task, so bounded by the input split), Spark's text writer writes them and
commits task by task, so a lost executor only costs its tasks. Records never
pass through the driver. Which record is the response of a group of equal
payloads is decided on (digest, id) rows only; payloads are not shuffled for it.

Defined results: null html is an empty payload; empty payloads form one group of
equal payloads like any other; rows repeated with one id give one response, at
the first place in the archives, and revisits that refer to the same id; a null
id is the smallest id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import new_folder

CRLF = b"\r\n"
#: Fixed value: every synthesised timestamp of the generated legacy archives.
CAPTURED = "20240101000000"
#: Field names of ARC header lines by version.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
PARSED = (
    "archive string, ordinal int, version string, uri string, captured string, mime string, "
    "key long, payload_bytes long, payload_digest string"
)
READ = (
    "archive string, ordinal int, record_type string, record_id string, uri string, key long, payload_bytes long, "
    "payload_digest string, refers_to long, digest_ok boolean"
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(key: int | None, place: str) -> str:
    """A version-8 UUID: a name hash over 58 bits, then the 64 bits of ``key`` (or of ``place``'s hash)."""
    name = int.from_bytes(hashlib.sha256(b"key" if key is not None else b"place").digest()[:8], "big") >> 6
    low = key % 2**64 if key is not None else int.from_bytes(hashlib.sha256(place.encode()).digest()[:8], "big")
    bits = name << 64 | low
    a, b, c = bits >> 74, bits >> 62 & 0xFFF, bits & (1 << 62) - 1
    x = f"{a << 80 | 8 << 76 | b << 64 | 2 << 62 | c:032x}"
    return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


def uuid_key(uuid: str) -> int:
    """The key of ``record_uuid``."""
    x = int(uuid.replace("-", ""), 16)
    low = (x >> 64 & 3) << 62 | x & (1 << 62) - 1
    return low - 2**64 if low >= 2**63 else low


def _http(key: int | None, mime: str, body: bytes) -> bytes:
    own = b"" if key is None else b"X-Record-Key: %d\r\n" % key
    return b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\n%sContent-Length: %d\r\n\r\n" % (mime.encode(), own, len(body))


def _http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


# ---------------------------------------------------------------- legacy ARC


def _arc_lines(version: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = {"1": "URL IP-address Archive-date Content-type Archive-length",
                  "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
        first = True
        for pdf in batches:
            out = []
            if first:
                v = version if version != "both" else str(1 + int(pdf["part"].iloc[0]) % 2) if len(pdf) else "1"
                block = f"{v} 0 tickloom\n{fields[v]}\n".encode()
                head = f"filedesc://part.arc 0.0.0.0 {CAPTURED} text/plain " + ("" if v == "1" else "200 - - 0 part.arc ")
                out.append(head.encode() + b"%d\n" % len(block) + block)
                first = False
            for key, url, html in zip(pdf["key"], pdf["url"], pdf["html"], strict=True):
                body = (html or "").encode()
                body = _http(None if pd.isna(key) else int(key), "text/html", body) + body
                uri = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"
                head = f"{uri} 0.0.0.0 {CAPTURED} text/html "
                if v == "2":
                    head += f"200 {hashlib.md5(body).hexdigest()} - 0 part.arc "
                out.append(head.encode() + b"%d\n" % len(body) + body)
            yield pd.DataFrame({"value": out})

    return run


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", version: str = "both") -> None:
    """One ARC file per task; ``version`` is "1", "2" or "both" (by task)."""
    rows = pages.select(
        F.col(key).cast("long").cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), F.spark_partition_id().alias("part")
    )
    lines = rows.mapInPandas(_arc_lines(version), "value binary")
    # cast() keeps the bytes as they are; the writer ends each record with the newline that ARC asks for
    lines.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def arc_records(data: bytes) -> Iterator[tuple[int, str, dict[str, str], bytes]]:
    """(ordinal, version, header fields, body) of one archive; the version block is ordinal 0."""
    at, ordinal, version = 0, 0, "1"
    while at < len(data):
        end = data.index(b"\n", at)
        words = data[at:end].decode("utf-8", "replace").split(" ")
        if ordinal == 0:
            version = "2" if len(words) == len(ARC_FIELDS["2"]) else "1"
        names = ARC_FIELDS[version]
        if len(words) < len(names):
            raise ValueError(f"ARC header of {len(words)} fields at byte {at}: {words[:3]}")
        tail = words[-(len(names) - 1):]  # a URL of old crawls may hold spaces
        fields = dict(zip(names, [" ".join(words[: len(words) - len(tail)]), *tail], strict=True))
        body = data[end + 1 : end + 1 + int(fields["length"])]
        if len(body) != int(fields["length"]):
            raise ValueError(f"ARC record at byte {at} is shorter than declared")
        if ordinal == 0:
            version = body.split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r}")
        yield ordinal, version, fields, body
        at, ordinal = end + 1 + len(body) + 1, ordinal + 1


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole archives by Spark's reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("archive"), "content")


def _unzip(data: bytes) -> bytes:
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out) if out else data


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    head, gap, payload = body.partition(b"\r\n\r\n")
    return (head + gap, payload) if head.startswith(b"HTTP/") and gap else (b"", body)


def _parse_arc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PARSED.split(", ")]
    for pdf in batches:
        for archive, content in zip(pdf["archive"], pdf["content"], strict=True):
            out = []
            for ordinal, version, f, body in arc_records(_unzip(content)):
                if ordinal:
                    head, payload = _split_http(body)
                    key = _http_fields(head).get("x-record-key")
                    out.append((archive, ordinal, version, f["url"], f["date"], f["mime"], int(key) if key else None, len(payload), digest(payload)))
            out = pd.DataFrame(out, columns=names)
            yield out.assign(key=out["key"].astype("Int64"))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row per ARC record with what its header lines and HTTP headers say."""
    return _archives(spark, path).mapInPandas(_parse_arc, PARSED)


# ---------------------------------------------------------------------- WARC


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


def _stamp(date: str) -> str:
    d = (date + "00000101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for archive, content, revisits in zip(pdf["archive"], pdf["content"], pdf["revisits"], strict=True):
            refers = {} if revisits is None else {r["ordinal"]: (r["to"], r["place"]) for r in revisits}
            out, size = [], 0
            for ordinal, version, f, body in arc_records(_unzip(content)):
                place = f"{archive.rpartition('/')[2]}#{ordinal}"
                when = _stamp(f["date"])
                if ordinal == 0:
                    info = b"software: tickloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/%s\r\n" % version.encode()
                    record = _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{record_uuid(None, place)}>"), ("WARC-Date", when), ("Content-Type", "application/warc-fields")], info)
                else:
                    head, payload = _split_http(body)
                    key = _http_fields(head).get("x-record-key")
                    kind = "revisit" if ordinal in refers else "response"
                    block = head if kind == "revisit" else body
                    fields = [
                        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_uuid(int(key) if key else None, place)}>"), ("WARC-Date", when), ("WARC-Target-URI", f["url"]),
                        ("WARC-IP-Address", f["ip"]), ("WARC-Block-Digest", "sha1:" + digest(block)), ("WARC-Payload-Digest", "sha1:" + digest(payload)),
                    ]
                    if kind == "revisit":
                        to, where = refers[ordinal]
                        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{record_uuid(None if pd.isna(to) else int(to), where)}>")]
                    record = _warc([*fields, ("Content-Type", "application/http; msgtype=response" if head else f["mime"])], block)
                out.append(record)
                size += len(record)
                if size > 8_000_000:
                    yield pd.DataFrame({"value": out})
                    out, size = [], 0
            yield pd.DataFrame({"value": out})


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Writes a WARC file for the archives of each task; equal payloads become one response and revisits."""
    index = new_folder(spark, "arc-index")
    read_arc(spark, arc).write.parquet(index)
    rows = spark.read.schema(PARSED).parquet(index)
    # the response of equal payloads: the largest key, then the first place; map-side maxima, so one hot payload is no hot task
    first = F.struct(F.coalesce("key", F.lit(-(2**63))).alias("k"), F.col("key"), (-F.xxhash64("archive")).alias("a"), (-F.col("ordinal")).alias("o"), "archive", "ordinal")
    groups = rows.groupBy("payload_digest", "payload_bytes").agg(F.max(first).alias("head"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "payload_bytes", "head")
    chosen = new_folder(spark, "arc-responses")
    groups.write.parquet(chosen)
    heads = spark.read.schema(groups.schema).parquet(chosen)
    revisits = (
        rows.join(heads, ["payload_digest", "payload_bytes"])
        .where((F.col("head.archive") != F.col("archive")) | (F.col("head.ordinal") != F.col("ordinal")))
        .groupBy("archive")
        .agg(F.collect_list(F.struct("ordinal", F.col("head.key").alias("to"), F.concat_ws("#", F.element_at(F.split("head.archive", "/"), -1), F.col("head.ordinal")).alias("place"))).alias("revisits"))
    )
    records = _archives(spark, arc).join(revisits, "archive", "left").select("archive", "content", "revisits").mapInPandas(_convert, "value binary")
    # each WARC record ends with two line ends, which the writer adds
    records.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of one archive, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC version at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = data[end + 4 : end + 4 + int(fields["content-length"])]
        yield fields, block
        at = end + 4 + len(block) + 4


def _read_warc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ.split(", ")]
    for pdf in batches:
        for archive, content in zip(pdf["archive"], pdf["content"], strict=True):
            out = []
            for ordinal, (f, block) in enumerate(warc_records(_unzip(content))):
                if f["warc-type"] == "warcinfo":
                    continue
                head, payload = _split_http(block)
                http = _http_fields(head)
                key = http.get("x-record-key")
                said = f["warc-payload-digest"].removeprefix("sha1:")
                revisit = f["warc-type"] == "revisit"
                known = "warc-refers-to" in f and http.get("x-record-key") is not None
                refers = uuid_key(f["warc-refers-to"][10:-1]) if revisit and known else None
                out.append((archive, ordinal, f["warc-type"], f["warc-record-id"][10:-1], f["warc-target-uri"], int(key) if key else None, int(http["content-length"]) if revisit else len(payload), said, refers,
                            f["warc-block-digest"] == "sha1:" + digest(block) and (revisit or said == digest(payload))))
            out = pd.DataFrame(out, columns=names)
            yield out.assign(key=out["key"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record; ``digest_ok`` says whether digests hold for what was read."""
    return _archives(spark, path).mapInPandas(_read_warc, READ)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "record_id", "digest_ok")
