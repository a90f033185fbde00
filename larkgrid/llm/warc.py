"""WARC 1.1 archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an identical payload) and a metadata record, tied together by
WARC-Concurrent-To. The writer makes each record a string and lets Spark's text writer put the record separator, two CRLF,
between them, so archives go to any store that Spark writes to and are committed task by task. The reader parses archives by
Content-Length while it decompresses them, so it holds one record at a time beside the compressed file. The assembler joins
records through concurrent-to identifiers, one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkgrid.llm.common import all_salts, bounded_batches, broadcast_if_small, delete_path, materialize, new_path, released, salt_of

MIN_REVISIT_BYTES = 1000
#: Archives are rolled by size: (payload bytes below which a page belongs to the class, records of a file), so that none has
#: much over half a gigabyte before compression, but for payloads that are larger by themselves.
CLASSES = ((1 << 16, 6000), (1 << 20, 600), (None, 30))
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "warc_type string, record_id string, concurrent_to array<string>, target_uri string, warc_date string, refers_to string, payload_digest string, payload_sha1 string, headers map<string,string>, http_status int, http_headers string, payload binary, payload_bytes long, fields map<string,string>"


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[F.concat(F.lit(x) if isinstance(x, str) else x, F.lit("\r\n")) for x in lines])


def _uuid(*parts: Column | str) -> Column:
    """A URN from a hash of what names the record: a repeated run writes the same identifiers."""
    h = F.md5(F.concat_ws("|", *[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, content_type: str, block: Column, *more: Column) -> Column:
    head = _lines(
        "WARC/1.1", f"WARC-Type: {kind}", F.concat(F.lit("WARC-Record-ID: "), record_id), f"WARC-Date: {DATE}", F.concat(F.lit("WARC-Target-URI: "), uri), *more,
        f"Content-Type: {content_type}", F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, classes: tuple = CLASSES, compression: str = "gzip") -> None:
    """Archives of pages (page_id, url, html) under path: per row a request, a response or revisit, and a metadata record.

    Of rows with equal payloads (html in UTF-8; null is empty) of at least min_revisit_bytes, the one with the largest page_id
    is the response; rows that repeat that page_id are told apart by an occurrence number and only the first is referred to,
    the other being a revisit. A group that has no page_id at all has no revisits. A null url becomes urn:page:<page_id>; line breaks
    and blanks in an url are percent-encoded. Pages of each class of sizes are written to files of their own, a folder a class,
    of as many records as the class allows. An empty table writes empty folders.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    rows = pages.select("page_id", url.alias("url"), html.alias("html")).withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html").cast("long")})
    ids = materialize(rows.select("page_id", "digest", "bytes"), "page-ids")
    repeated = materialize(ids.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("again")), "repeated-ids")
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    again = broadcast_if_small(repeated)
    on = F.col("page_id").eqNullSafe(F.col("again"))
    rows = rows.join(again, on, "left_anti").withColumn("nth", F.lit(1)).unionByName(rows.join(again, on, "left_semi").withColumn("nth", nth))
    same = ids.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = materialize(same.select("digest", "first_id", all_salts("salt")), "same-payloads")
    rows = rows.withColumn("salt", salt_of("page_id", "nth")).join(broadcast_if_small(same), ["digest", "salt"], "left")
    who = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    first = F.coalesce(F.col("first_id").cast("string"), F.lit("null"))
    is_revisit = F.col("first_id").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("nth") == 1))
    response_id = _uuid("response", who, F.col("digest"), F.col("nth").cast("string"))
    refers_to = _uuid("response", first, F.col("digest"), "1")
    request_id = _uuid("request", who, F.col("digest"), F.col("nth").cast("string"))
    metadata_id = _uuid("metadata", who, F.col("digest"), F.col("nth").cast("string"))
    uri = F.col("url")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.upper(F.col("digest")))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")), "")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    request = _record("request", request_id, uri, "application/http; msgtype=request", _lines(F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(" HTTP/1.1")), F.concat(F.lit("Host: "), host), ""), concurrent)
    response = _record("response", response_id, uri, "application/http; msgtype=response", F.concat(http, F.col("html")), digest)
    revisit = _record("revisit", response_id, uri, "application/http; msgtype=response", http, digest, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), refers_to))
    fields = _lines(F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")), F.concat(F.lit("refers-to-page-id: "), F.when(is_revisit, first).otherwise("")))
    metadata = _record("metadata", metadata_id, uri, "application/warc-fields", fields, concurrent)
    number = F.lit(len(classes) - 1)
    for i in range(len(classes) - 2, -1, -1):
        number = F.when(F.col("bytes") < classes[i][0], i).otherwise(number)
    for i in sorted(r.i for r in ids.select(number.alias("i")).distinct().collect()) or [0]:  # classes in use
        records = rows.where(number == i).select(F.explode(F.array(request, F.when(is_revisit, revisit).otherwise(response), metadata)).alias("value"))
        records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", classes[i][1]).option("compression", compression).text(f"{path}/class-{i}")


def decompressed(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of an archive in pieces of at most `step` bytes; a gzipped one may have one member, one a record, or a cut end."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield data[at : at + step]
        return
    rest = memoryview(data)
    while len(rest):
        member, fed = zlib.decompressobj(31), 0
        pending = b""
        while not member.eof and (pending or fed < len(rest)):
            if not pending:
                pending = bytes(rest[fed : fed + step])
                fed += len(pending)
            try:
                piece = member.decompress(pending, step)
            except zlib.error:  # what follows the last member is no archive
                return
            pending = member.unconsumed_tail
            if piece:
                yield piece
        rest = rest[fed - len(member.unused_data) :] if member.eof else rest[len(rest) :]


class _Window:
    """A sliding piece of a stream: what was read and not yet passed."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.ended = pieces, bytearray(), 0, False

    def more(self) -> bool:
        """Reads a piece; whether there was one."""
        piece = next(self.pieces, None)
        if piece is None:
            self.ended = True
            return False
        del self.held[: self.at]
        self.at = 0
        self.held += piece
        return True

    def find(self, what: bytes) -> int:
        """Bytes from here to the next `what`, or -1."""
        begin = 0
        while True:
            found = self.held.find(what, self.at + begin)
            if found >= 0:
                return found - self.at
            begin = max(0, len(self.held) - self.at - len(what) + 1)
            if not self.more():
                return -1

    def has(self, n: int) -> bool:
        while len(self.held) - self.at < n and self.more():
            pass
        return len(self.held) - self.at >= n

    def take(self, n: int) -> bytes:
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, in order. A truncated last record and bytes between records are skipped."""
    w = _Window(decompressed(data))
    while w.has(5):
        if w.held[w.at : w.at + 5] != b"WARC/":
            skip = w.find(b"\nWARC/")
            if skip < 0:
                return
            w.take(skip + 1)
        end = w.find(b"\r\n\r\n")
        if end < 0:
            return
        headers: dict[str, str] = {}
        concurrent = []
        for line in w.take(end + 4).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name:
                headers[name] = value
            if name == "warc-concurrent-to":
                concurrent.append(value)
        stated = headers.get("content-length", "0")
        length = int(stated) if stated.isdigit() else 0
        if not w.has(length):
            return
        yield record_row(headers, concurrent, w.take(length))
        while w.has(2) and w.held[w.at : w.at + 2] == b"\r\n":
            w.take(2)


def record_row(headers: dict[str, str], concurrent: list[str], block: bytes) -> dict:
    kind, status, http, payload, fields = headers.get("warc-type"), None, None, None, {}
    if "application/http" in headers.get("content-type", ""):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        first = http.split("\r\n", 1)[0].split(" ")
        status = int(first[1]) if kind != "request" and len(first) > 1 and first[1].isdigit() else None
    elif headers.get("content-type", "").startswith("application/warc-fields"):
        for line in block.decode("utf-8", "replace").split("\r\n"):
            name, sep, value = line.partition(":")
            if sep:
                fields[name.strip().lower()] = value.strip()
    elif block:
        payload = block
    return {
        "warc_type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": concurrent, "target_uri": headers.get("warc-target-uri"), "warc_date": headers.get("warc-date"),
        "refers_to": headers.get("warc-refers-to"), "payload_digest": headers.get("warc-payload-digest"), "payload_sha1": hashlib.sha1(payload).hexdigest() if payload is not None else None, "headers": list(headers.items()), "http_status": status, "http_headers": http,
        "payload": payload, "payload_bytes": len(payload) if payload is not None else None, "fields": list(fields.items()),
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, in the columns RECORD, no archives giving none. A task holds one compressed archive and
    streams its records."""
    kind = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("warc_date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_sha1", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_headers", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse_archive(content.as_py() or b""):
                    rows.append(row)
                    size += row["payload_bytes"] or 0
                    if len(rows) == 512 or size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(released(parse), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response (or revisit), requests and metadata as nested records.

    A record belongs to the response or revisit that it names in concurrent-to, that names it, or that a record which it names
    belongs to (metadata -> request -> response). Records that reach none are left out; a capture without request or metadata
    has empty arrays. Only identifiers are joined to find captures; payloads move once, or never where records come without
    them. No records give no captures.
    """
    heads = records.where(F.col("warc_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"))
    links = records.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = links.union(links.select("b", "a")).distinct()
    one = links.join(heads, links.b == heads.capture_id).select(F.col("a").alias("record_id"), "capture_id")
    two = links.join(one.select(F.col("record_id").alias("b"), "capture_id"), "b").select(F.col("a").alias("record_id"), "capture_id")
    reached = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))
    belongs = reached.groupBy("record_id").agg(F.min(F.struct("hops", "capture_id")).alias("m")).select("record_id", F.col("m.capture_id").alias("capture_id"))
    nested = F.struct(*[c for c in records.columns if c not in ("concurrent_to", "headers")])
    head = records.where(F.col("warc_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), nested.alias("response"))
    side = records.where(F.col("warc_type").isin("request", "metadata")).join(belongs, "record_id").select("capture_id", "warc_type", nested.alias("r"))
    side = side.groupBy("capture_id").agg(F.collect_list(F.when(F.col("warc_type") == "request", F.col("r"))).alias("requests"), F.collect_list(F.when(F.col("warc_type") == "metadata", F.col("r"))).alias("metadata"))
    empty = F.array().cast(side.schema["requests"].dataType)
    return head.join(side, "capture_id", "left").select("capture_id", "response", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def captures(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, classes: tuple = CLASSES, payloads: bool = True) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and assemble: see write_archives, read_archives, assemble.
    payloads: whether captures carry their payloads, besides the sizes and digests of these. The archives are deleted once they
    are parsed; write_archives keeps them. An empty table gives no captures; a payload is held whole, twice at most."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = new_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes, classes)
    records = read_archives(spark, path).drop("headers", *([] if payloads else ["payload", "http_headers"]))
    parsed = materialize(records, "warc-records", compression="zstd")
    delete_path(spark, path)
    return assemble(parsed)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """captures with `original`: (capture_id, page_id, payload_bytes, payload_sha1) of the response that a revisit's
    WARC-Refers-To names, null for all others and where no such response is found."""
    page_id = F.get("metadata", F.lit(0))["fields"]["page-id"]
    of = F.struct("capture_id", page_id.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha1").alias("payload_sha1"))
    wanted = found.where(F.col("response.warc_type") == "revisit").select(F.col("response.refers_to").alias("capture_id")).distinct()
    originals = found.where(F.col("response.warc_type") == "response").select("capture_id", of.alias("original")).join(wanted, "capture_id", "left_semi")
    originals = materialize(originals.select("original", all_salts("__salt")), "originals")
    on = (F.col("__refers") == F.col("original.capture_id")) & (F.col("__at") == F.col("__salt"))
    refers = F.when(F.col("response.warc_type") == "revisit", F.col("response.refers_to"))
    return found.withColumns({"__refers": refers, "__at": salt_of("capture_id")}).join(broadcast_if_small(originals), on, "left").drop("__refers", "__at", "__salt")
