"""Legacy archives (ARC versions 1 and 2) and their conversion to WARC.

An ARC file begins with a version block (``filedesc://``) whose second line names the version; every record is one header
line, with the fields of that version, and as many bytes as the line declares.  The converter reads these lengths,
splits the HTTP head from the payload, and synthesises what WARC asks for and ARC lacks: record ids, ISO timestamps,
record types and digests.  A payload of ``least`` bytes or more that has been stored already becomes a revisit.

Files are written by Spark's text sink (gzip; a record per row, the line separator closes it) and read as whole binary
files, one task a file, unpacked as a stream; ``archive_bytes`` bounds a file, so no task holds more than one file's
bytes.  Everything between is rows.

Nulls: a null payload is an empty one, a null url is ``-``, a null date the epoch, and a record without key keeps a null
key.  Equal keys are told apart by their place in the archive, so repeated rows give one response and revisits.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.llm.common import cut_lineage, pick, scratch_path, table

KEY_HEADER = "X-Record-Key"
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_EPOCH = "19700101000000"
_ENDS = "\r\n\r\n"


# ---------------------------------------------------------------- ARC


def _head(key: Column, payload: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(key.isNotNull(), F.concat(F.lit(f"{KEY_HEADER}: "), key.cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit(_ENDS),
    )


def _archives(df: DataFrame, size: Column, archive_bytes: int) -> DataFrame:
    """Deal rows at random over as many files as their bytes need."""
    return df.repartition(_file_count(df.agg(F.sum(size).alias("n")), archive_bytes))


def _file_count(total: DataFrame, archive_bytes: int) -> int:
    return max(1, -(-(total.first()["n"] or 0) // archive_bytes))


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None, archive_bytes: int = 16 << 20) -> None:
    """Archive the rows as ARC files; half of the files are of version 1, half of version 2."""
    day = F.lit(_EPOCH) if date is None else F.coalesce(F.date_format(F.col(date), "yyyyMMddHHmmss"), F.lit(_EPOCH))
    rows = pages.select(
        F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.nullif(F.trim(F.col(url)), F.lit("")), F.lit("-")), r"\s", "%20").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"), day.alias("day"),
    )
    dealt = _archives(rows, F.octet_length("payload") + 300, archive_bytes).withColumns({"second": F.spark_partition_id() % 2 == 1, "first": F.monotonically_increasing_id() % (1 << 33) == 0, "head": _head(F.col("key"), F.col("payload"))})
    length = (F.octet_length("head") + F.octet_length("payload")).cast("string")
    line = F.when(F.col("second"), F.concat_ws(" ", "url", F.lit("0.0.0.0"), "day", F.lit("text/html 200 - - 0 -"), length)).otherwise(F.concat_ws(" ", "url", F.lit("0.0.0.0"), "day", F.lit("text/html"), length))
    blocks = {v: f"{v} 0 Legacy\n{fields}\n" for v, fields in _FIELDS.items()}
    version = {v: f"filedesc://archive.arc 0.0.0.0 {_EPOCH} text/plain {'200 - - 0 - ' if v == 2 else ''}{len(b)}\n{b}\n" for v, b in blocks.items()}
    opening = F.when(~F.col("first"), F.lit("")).when(F.col("second"), F.lit(version[2])).otherwise(F.lit(version[1]))
    dealt.select(F.concat(opening, line, F.lit("\n"), "head", "payload").alias("value")).write.option("compression", "gzip").text(path, lineSep="\n")


class _Stream(io.RawIOBase):
    """Unpacks gzip (one or more members) while it is read; plain bytes pass through."""

    def __init__(self, data: bytes):
        self.rest, self.zipped = memoryview(data), data[:2] == b"\x1f\x8b"
        self.at, self.unpack, self.ready = 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.zipped and not self.ready and self.at < len(self.rest):
            piece = self.rest[self.at : self.at + 65536]
            self.at += len(piece)
            self.ready = self.unpack.decompress(piece)
            if self.unpack.eof:
                self.at -= len(self.unpack.unused_data)
                self.unpack = zlib.decompressobj(31)
        if not self.zipped and not self.ready:
            self.ready = bytes(self.rest[self.at : self.at + 65536])
            self.at += len(self.ready)
        n = min(len(into), len(self.ready))
        into[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def parse_arc(data: bytes) -> Iterator[tuple[int, int, str, str, str, bytes]]:
    """(place, version, url, date, content type, content) of each record after the version block."""
    f, version, place = io.BufferedReader(_Stream(data), 1 << 16), 0, 0
    while line := f.readline():
        line = line.strip(b"\r\n")
        if not line:
            continue  # the newline that ends a record
        fields = line.decode("utf-8", "replace").split(" ")
        if len(fields) != (5 if version == 1 else 10 if version == 2 else len(fields)) or not fields[-1].isdigit():
            raise ValueError(f"record {place}: header line does not fit ARC version {version}: {line[:200]!r}")
        content = f.read(int(fields[-1]))
        if len(content) != int(fields[-1]):
            raise ValueError(f"record {place}: the file ends within the declared length")
        if fields[0].startswith("filedesc:"):
            version = int(content.split(b" ", 1)[0])
            if version not in _FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        if not version:
            raise ValueError("the archive does not begin with a version block")
        yield place, version, fields[0], fields[2], fields[3], content
        place += 1


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    head, found, body = content.partition(b"\r\n\r\n")
    return (head, body) if found and head.startswith(b"HTTP/") else (b"", content)


def _http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        n, _, v = line.partition(b":")
        if n.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


_ARC_ROWS = "archive string, place bigint, version int, key bigint, url string, date string, content_type string, head binary, payload binary, payload_bytes bigint, payload_digest string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """One task a file at a time; rows leave in batches of some MB."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for row, size in parse(path.as_py(), content.as_py()):
                    rows.append(row)
                    held += size
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the ARC files below the path, with its payload digest (SHA-256)."""

    def parse(name: str, data: bytes):
        for place, version, url, date, kind, content in parse_arc(data):
            head, body = _split_http(content)
            key = _http_field(head, KEY_HEADER)
            yield (name, place, version, int(key) if key else None, url, date, kind, head, body, len(body), hashlib.sha256(body).hexdigest()), len(content)

    return _parsed(_files(spark, path), parse, _ARC_ROWS)


# ---------------------------------------------------------------- WARC


def _record_id(key: Column, *parts: Column) -> Column:
    """A name-based id: an RFC 9562 version-8 uuid that carries the 64 bits of the key and a hash of the record."""
    name = F.md5(F.concat_ws("\n", *parts))
    number = F.coalesce(key, F.lit(0))
    high = F.lower(F.lpad(F.hex(F.shiftrightunsigned(number, 32)), 8, "0"))
    low = F.lower(F.lpad(F.hex(number.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    keyed = F.when(key.isNull(), F.lit("0")).otherwise(F.lit("1"))
    return F.concat(high, F.lit("-"), name.substr(1, 4), F.lit("-8"), name.substr(5, 3), F.lit("-8"), keyed, name.substr(8, 2), F.lit("-"), name.substr(10, 4), low)


def key_of_record_id(uuid: str) -> int | None:
    h = uuid.strip("<>").rpartition(":")[2].split("-")
    if h[3][1] == "0":
        return None
    n = int(h[0] + h[4][4:], 16)
    return n - (1 << 64) if n >> 63 else n


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 100, archive_bytes: int = 16 << 20) -> None:
    """Convert the ARC files to WARC files; of equal payloads of ``least`` bytes or more the smallest key is the response."""
    records = read_arc(spark, arc_path)
    slim = cut_lineage(records.select("archive", "place", "key", "url", "date", "payload_digest", "payload_bytes"))
    long = slim.filter(F.col("payload_bytes") >= least)
    # a missing key comes after every key; the place decides between equal keys
    order = F.struct(F.col("key").isNull().alias("keyless"), "key", "archive", "place")
    firsts = long.groupBy("payload_digest").agg(F.min(F.struct(order.alias("at"), "url", "date")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = cut_lineage(firsts.select("payload_digest", "first.at", F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")))
    # equal payloads are as many as they like: this join is of two plain shuffles, so that a large group can be split
    joined = long.join(firsts, "payload_digest")
    again = cut_lineage(joined.filter(~((F.col("archive") == F.col("at.archive")) & (F.col("place") == F.col("at.place")))).select("archive", "place", "at", "first_url", "first_date"))
    # one shuffle of the payloads serves the join and deals the records over files of bounded size
    files = _file_count(slim.agg(F.sum(F.col("payload_bytes") + 700).alias("n")), archive_bytes)
    place = ["archive", "place"]
    all_ = records.repartition(files, *place).join(again.repartition(files, *place), place, "left")
    iso = lambda d: F.regexp_replace(d, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3T$4:$5:$6Z")
    first_id = _record_id(F.col("at.key"), F.col("first_url"), F.col("first_date"), F.col("payload_digest"), F.col("at.archive"), F.col("at.place").cast("string"))
    own_id = _record_id(F.col("key"), F.col("url"), F.col("date"), F.col("payload_digest"), F.col("archive"), F.col("place").cast("string"))
    revisit, http = F.col("at").isNotNull(), F.octet_length("head") > 0
    empty = F.lit("").cast("binary")
    block = F.concat(F.when(http, F.concat("head", F.lit(_ENDS).cast("binary"))).otherwise(empty), F.when(revisit, empty).otherwise(F.col("payload")))
    rows = all_.withColumns({"__block": block, "__id": own_id, "__first": first_id})
    fields = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), "__id", F.lit(">\r\nWARC-Date: "), iso(F.col("date")), F.lit("\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nWARC-Payload-Digest: sha256:"), "payload_digest", F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2("__block", 256),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:uuid:"), "__first",
            F.lit(">\r\nWARC-Refers-To-Target-URI: "), "first_url", F.lit("\r\nWARC-Refers-To-Date: "), iso(F.col("first_date")),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: "), F.when(http, F.lit("application/http; msgtype=response")).otherwise(F.col("content_type")),
        F.lit("\r\nContent-Length: "), F.octet_length("__block").cast("string"), F.lit(_ENDS),
    )
    rows.select(F.concat(fields.cast("binary"), "__block").cast("string").alias("value")).write.option("compression", "gzip").text(warc_path, lineSep=_ENDS)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by the declared content length."""
    f = io.BufferedReader(_Stream(data), 1 << 16)
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = f.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("the file ends within a record")
        yield fields, block


_WARC_ROWS = "record_id string, key bigint, record_type string, refers_to bigint, url string, date string, payload_bytes bigint, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the WARC files below the path; a stored payload and block must have the digests that their record states.

    Of a revisit the size comes from its HTTP head and the digest from its field, as its payload is stored elsewhere.
    """

    def parse(name: str, data: bytes):
        for fields, block in parse_warc(data):
            head, body = _split_http(block)
            kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
            if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
                raise ValueError(f"{name}: block digest of {fields['warc-record-id']} differs")
            if kind == "response":
                size = len(body)
                if hashlib.sha256(body).hexdigest() != stated:
                    raise ValueError(f"{name}: payload digest of {fields['warc-record-id']} differs")
            else:
                size = int(_http_field(head, "Content-Length") or 0)
            to = fields.get("warc-refers-to")
            yield (fields["warc-record-id"], key_of_record_id(fields["warc-record-id"]), kind, key_of_record_id(to) if to else None, fields["warc-target-uri"], fields["warc-date"], size, stated, body if payloads else None), len(body)

    return _parsed(_files(spark, path), parse, _WARC_ROWS)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    back = read_warc(spark, warc, payloads=False)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_arc_to_warc": op1_arc_to_warc}
ORACLES = {
    "op1_arc_to_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN first_id END AS refers_to
FROM r
"""
}
