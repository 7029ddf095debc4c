"""WARC archives whose repeated payloads are revisit records.

1. headers(): a pass over the pages gives each payload's length and SHA-1; payloads stay behind.
2. resolved(): headers are shuffled by digest. Of records with equal payloads of at least `least` bytes the one with the
   smallest identifier is the response; the others are joined to it and become revisits. The group-by combines before
   the shuffle and the join's hot digests can be split, so a payload that most pages share costs no more than others.
3. write_archives(): the pages meet their resolved headers and each task writes gzipped WARC/1.1 records with fresh
   headers; a revisit has the HTTP header of its response but no payload.
4. read_archives(): the archives are parsed again, record by record; with_bodies() joins revisits to their responses.

Very long payloads are read whole. Null payloads and addresses are empty ones. Rows that repeat an identifier and a payload have the same record type; a
missing identifier sorts after all others, and its revisit target is missing too. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_width, slices
from .files import new_file, new_folder, opened

#: Revisit profile of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive that are read at a time.
BLOCK = 1 << 20


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base32(hashlib.sha1(payload).digest())


def headers(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, payload_bytes and payload_sha1 (hexadecimal) of every row."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(key).cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_sha1"))


def resolved(found: DataFrame, least: int = 0) -> DataFrame:
    """headers() with record_type and refers_to (the response's page_id); one row for equal rows."""
    first = found.groupBy("payload_sha1", "payload_bytes").agg(F.min("page_id").alias("first_id"))
    joined = found.distinct().join(first, ["payload_sha1", "payload_bytes"], "left")
    repeats = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "payload_bytes", "payload_sha1", F.when(repeats, "revisit").otherwise("response").alias("record_type"), F.when(repeats, F.col("first_id")).alias("refers_to")
    )


def record_uri(page_id: int | None, payload_digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{payload_digest}"


def _record(page_id: int | None, url: str, date: str, payload: bytes, size: int, sha1: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uri(page_id, sha1)}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_uri(refers_to, sha1)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, records: DataFrame, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a gzipped record for each page; returns path, n_records and bytes of each archive."""
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    address = F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"[\r\n]+", " "), F.lit("")) if url in pages.columns else F.lit("")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), address.alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).alias("p")
    both = rows.join(records.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("sha1") == F.col("payload_sha1")))
    both = both.select("p.page_id", "url", F.when(F.col("record_type") == "response", F.col("html")).alias("html"), "payload_bytes", "payload_sha1", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, None, 0, 0
        for batch in slices(batches, "html"):
            if out is None:
                path = new_file(folder, ".warc.gz")
                where, inner = opened(path)
                out = where.open_output_stream(inner)
                info = b"software: frameloom\r\nformat: WARC File Format 1.1\r\n"
                out.write(_gzip(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{path.rpartition('/')[2]}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
            for x in batch.to_pylist():
                html = (x["html"] or "").encode()
                data = _gzip(_record(x["page_id"], x["url"], date, html, x["payload_bytes"], base32(bytes.fromhex(x["payload_sha1"])), x["record_type"], x["refers_to"]))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "bytes": [size]})

    return saved(both.mapInArrow(run, "path string, n_records long, bytes long"), "archive-manifest")


RECORDS = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, body string"
_ID = re.compile(r"<urn:page:(-?\d*):")


def parse_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a gzipped archive, read a member at a time."""
    raw, member = b"", None
    while True:
        if not raw:
            raw = stream.read(BLOCK)
            if not raw:
                return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            parts.append(unpack.decompress(raw))
            raw = unpack.unused_data if unpack.eof else stream.read(BLOCK)
            if not raw and not unpack.eof:
                raise ValueError("the archive ends within a record")
        member = b"".join(parts)
        head, _, rest = member.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, rest[: int(fields["content-length"])]


def read_archives(archives: DataFrame, bodies: bool = True) -> DataFrame:
    """Every response and revisit record of the archives in column path; body is null for revisits, or if not asked for.

    payload_bytes and payload_digest are those of the full payload: a response's are taken from what was read.
    """
    spark = archives.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(a, pa.int64() if b == "long" else pa.string()) for a, b in (x.split(" ") for x in RECORDS.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, inner = opened(path)
                rows, size = [], 0
                with where.open_input_stream(inner) as stream:
                    for fields, block in parse_records(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        number = _ID.match(fields["warc-record-id"])[1]
                        refers = _ID.match(fields["warc-refers-to"])[1] if kind == "revisit" else ""
                        if kind == "response":
                            told = (len(payload), digest(payload))
                        else:
                            told = (int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["warc-payload-digest"].removeprefix("sha1:"))
                        body = payload.decode() if bodies and kind == "response" else None
                        rows.append((int(number) if number else None, kind, fields.get("warc-target-uri", ""), *told, int(refers) if refers else None, body))
                        size += len(block)
                        if size >= BLOCK << 3:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return archives.select("path").repartition(shuffle_width(spark)).mapInArrow(run, RECORDS)


def with_bodies(records: DataFrame) -> DataFrame:
    """read_archives() with the body of every record: a revisit has that of the response that it refers to.

    Responses are one row for each identifier and digest, so a response that most revisits refer to may be split from the
    other side. A revisit whose response is in none of the archives keeps a null body.
    """
    same = ["payload_digest", "payload_bytes"]
    first = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), *same).agg(F.min("body").alias("found"))
    told = records.where("record_type = 'revisit'").alias("r").join(first.alias("f"), [*(F.col(f"r.{c}") == F.col(f"f.{c}") for c in same), F.col("refers_to").eqNullSafe(F.col("of"))], "left")
    told = told.select("page_id", "record_type", "url", *[F.col(f"r.{c}").alias(c) for c in same], "refers_to", F.col("found").alias("body"))
    return records.where("record_type <> 'revisit'").unionByName(told)
