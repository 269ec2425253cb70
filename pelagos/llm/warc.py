"""WARC archives: one gzip member for each record, written by Spark and read back by a sequential reader.

Archives are written through Spark's text writer, so they can go to any store that Spark writes to and a lost task is
written again in full: a row is a gzip member, and the writer's separator is the zero byte that ends it. (A member ends
with its length's high byte, which is zero below 16 MiB; longer ones are followed by an empty member.) The reader takes
whole archives from Spark's binary source, decompresses them bit by bit, frames records by Content-Length and verifies
their digests. See the WARC 1.1 specification, section 6.7 for revisit records and annex D for the members.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.llm.common import fresh_path, joined_by_copies, saved, text_bytes

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(record_id: str, url: str | None, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """A response record, or, if it refers to another, a revisit record: the same HTTP headers without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + BREAK
    block = head if refers_to else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BREAK + block + BREAK


def row(data: bytes, level: int = 6) -> bytes:
    """The gzip member of a record, without its last byte, which is zero."""
    out = _member(data, level)
    return (out if out[-1] == 0 else out + _member(b"", level))[:-1]


def inflated(content: bytes, step: int = 1 << 16) -> Iterator[Iterator[bytes]]:
    """The members of an archive, each as an iterator over its decompressed parts. Empty members are among them."""
    at, data = 0, memoryview(content)
    while at < len(data):
        inflate = zlib.decompressobj(31)

        def parts() -> Iterator[bytes]:
            nonlocal at
            while not inflate.eof:
                if at >= len(data):
                    raise ValueError("an archive ends within a member")
                read = data[at : at + step]
                out = inflate.decompress(read)
                at += len(read) - len(inflate.unused_data)
                if out:
                    yield out

        this = parts()
        yield this
        for _ in this:  # what the caller hasn't read of it
            pass


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, in the archive's order. Raises ValueError where framing or a SHA-1 digest is wrong; digests
    of other kinds, and records without any, are taken as they are."""
    for member in inflated(content):
        held = bytearray()
        for part in member:
            held += part
            if (end := held.find(BREAK)) >= 0:
                break
        else:
            if held:
                raise ValueError("a record without an end of its headers")
            continue
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        del held[: end + len(BREAK)]
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"{headers.get('warc-record-id')}: no length")
        size = int(headers["content-length"])
        for part in member:
            held += part
        if held[size:] != BREAK:
            raise ValueError(f"{headers.get('warc-record-id')}: its block is not of the {size} bytes it should have")
        block = bytes(held[:size])
        if not _agrees(headers.get("warc-block-digest"), block):
            raise ValueError(f"{headers.get('warc-record-id')}: wrong block digest")
        yield headers, block


def _agrees(said: str | None, data: bytes) -> bool:
    """Whether a digest header, if there is one and it is a SHA-1 in base 32 or hex, is that of the data."""
    kind, _, digest = (said or "").partition(":")
    if kind.lower() != "sha1":
        return True
    return digest.upper() == base32_sha1(data) or digest.lower() == hashlib.sha1(data).hexdigest()


def http(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of an HTTP message. The body is as it was sent: chunked or compressed ones stay so."""
    head, _, body = block.partition(BREAK)
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def dechunked(body: bytes) -> bytes:
    """The content of a body in chunks; as much as there is of one that is cut short."""
    out, at = bytearray(), 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not at else bytes(out)
        if not size:
            break
        out += body[end + 2 : end + 2 + size]
        at = end + 2 + size + 2
    return bytes(out)


def payload_of(headers: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(HTTP headers, payload, what its digest may be of) of a record; records that aren't HTTP are their payload."""
    if not headers.get("content-type", "application/http").lower().startswith("application/http"):
        return {}, block, block
    said, body = http(block)
    return said, dechunked(body) if said.get("transfer-encoding", "").lower() == "chunked" else body, body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> None:
    """Writes a record for each row of ``pages`` to archives in the new folder ``path``.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest id is a response and the others are
    revisits that refer to it; smaller payloads are all responses. A null payload is empty; a null URL has no header; rows
    that repeat an id with its payload are of one kind. Rows with a null id revisit others, or are responses if no row
    with their payload has an id. An empty table gives an empty folder.
    """
    data = text_bytes(html_col)
    seen = saved(pages.select(F.col(id_col).alias("id"), F.sha1(data).alias("digest"), F.octet_length(data).alias("n")), "payloads")
    # counts are combined before they are shuffled: a payload with a third of all rows is one row for each task
    first = seen.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null")
    first = saved(first.withColumnRenamed("digest", "of"), "first")
    again = joined_by_copies(seen, first, "digest", "of", "copies", seen.count()).where("not id <=> first")
    again = saved(again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").cast("string").alias("_first")).distinct(), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [row(record(f"urn:page:{i if i is not None else ''}", url, html, date, f"urn:page:{to}" if to is not None else None), level) for i, url, html, to in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), data.alias("html")).withColumn("digest", F.sha1("html"))
    told = rows.join(again, rows.id.eqNullSafe(again["_id"]) & (rows.digest == again["_digest"]), "left")
    members = told.select(F.col("id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), "html", F.col("_first").alias("to")).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(record_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of all records in a folder.

    ``payload`` is null for revisits; their size and digest are those of the payload they stand for, null where the record
    doesn't give them. Records of other types (warcinfo, request, metadata) are left out. Archives of others are read, too: digests
    may lack or be of another kind (a response's is worked out then), bodies may be chunked, payloads need not be HTTP. A
    damaged archive, a wrong length or a wrong SHA-1 is an error. An archive is one value of Spark's binary source, so it has
    to be below 2 GiB; records are decompressed one after the other.
    """
    schema = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([(n, t) for n, t in zip(("record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")[: 6 + with_payload], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()))])
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for headers, block in records(content.as_py()):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    said, payload, sent = payload_of(headers, block)
                    digest = headers.get("warc-payload-digest")
                    if kind == "response" and not (_agrees(digest, payload) or _agrees(digest, sent)):
                        raise ValueError(f"{headers.get('warc-record-id')}: wrong payload digest")
                    length = int(said["content-length"]) if said.get("content-length", "").isdigit() else None
                    if kind == "response":
                        if digest is not None and length is not None and "transfer-encoding" not in said and length != len(payload):
                            raise ValueError(f"{headers.get('warc-record-id')}: wrong payload length")
                        length, digest = len(payload), base32_sha1(payload)
                    else:
                        digest = digest.partition(":")[2] if digest else None
                    strip = lambda k: headers[k].strip("<>") if k in headers else None
                    out.append((strip("warc-record-id"), headers.get("warc-target-uri"), kind, length, digest, strip("warc-refers-to"), payload if kind == "response" else None))
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def page_id(column: str, kind: str):
    """The id in a record id as :func:`write_archives` writes it; null for a page without one."""
    return F.when(F.col(column) != "urn:page:", F.substring(column, 10, 1 << 30)).cast(kind)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, with_payload: bool = True) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: a row for each record, with its page's id."""
    path, kind = fresh_path(pages.sparkSession, "warc"), pages.schema[id_col].dataType.simpleString()
    write_archives(pages, path, id_col, url_col, html_col, least)
    back = read_archives(pages.sparkSession, path, with_payload)
    columns = ["url", "payload_bytes", "payload_digest", "record_type"]
    return back.select(page_id("record_id", kind).alias(id_col), *columns, page_id("refers_to", kind).alias("refers_to"), *["payload"] * with_payload)
