"""WARC archives: writing captures as records, reading records back, and assembling transactions.

Writing is DataFrame expressions only. A capture becomes a response record, or a revisit record if an
earlier one has the same payload, with a request and a metadata record that name it in
WARC-Concurrent-To. A record ends with two line ends, which is the separator of the text writer, so
the files are archives as they are; Spark sizes them as it sizes the parts of a shuffle.

Reading streams files from any store Spark reads, and cuts records by Content-Length. Assembly
joins requests, responses and metadata through their concurrent-to identifiers, in either direction
and over several hops, and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.session import fresh_dir
from signalbox.sources.store import materialize

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT_BYTES = 0

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAIN = ("response", "revisit", "resource", "conversion")


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1 of a column: five hex digits are four base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(*parts):
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) if not isinstance(p, str) else F.lit(p) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def _record(kind, record_id, uri, block, *headers):
    lines = [F.lit(f"WARC/1.1{_END}WARC-Type: "), kind, F.lit(f"{_END}WARC-Record-ID: "), record_id,
             F.lit(f"{_END}WARC-Date: 2024-01-01T00:00:00Z{_END}WARC-Target-URI: "), uri]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{_END}{name}: "), value), F.lit("")))
    return F.concat(*lines, F.lit(f"{_END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(2 * _END), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``id, url, html, bytes, digest, record_id, revisit, refers_to, copies``: the different rows of ``pages``.

    ``copies`` tells how many rows are equal in id, url and payload. Of rows with equal payloads of
    ``least_bytes`` or more one is the response, that of the smallest id, and of the smallest url among
    those; a row without an id only if no row with an id has its payload. ``revisit`` marks the others,
    and ``refers_to`` is the record of that response.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.withColumns({
        "bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html"))})
    keyed = keyed.withColumn("record_id", _record_id(F.lit("main"), F.col("id"), F.col("url"), F.col("digest")))
    # All decisions are made on a narrow table; payloads are shuffled once, one of each set of equal rows.
    narrow = materialize(
        keyed.groupBy("record_id", "digest", "bytes", "id", "url").agg(F.count("*").alias("copies")), "captures")
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "url", "record_id")
    repeated = narrow.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.min(place)["record_id"].alias("refers_to"), F.sum("copies").alias("held")).where("held > 1").drop("held")
    decided = narrow.join(repeated, ["digest", "bytes"], "left").select(
        "record_id", "copies", "refers_to", F.coalesce(F.col("refers_to") != F.col("record_id"), F.lit(False)).alias("revisit"))
    return keyed.dropDuplicates(["record_id"]).join(decided.hint("merge"), "record_id")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = LEAST_REVISIT_BYTES, compression: str = "gzip") -> None:
    """Archive files below ``path``: three records for each row of ``pages``, equal rows included.

    The request is a plain GET; the metadata record carries the id of the page. A null url or payload
    is empty. Line breaks in a url are escaped, since a header is one line.
    """
    found = captures(pages, id_col, url_col, html_col, least_bytes)
    # Equal rows are captures of their own: the first keeps the record's name, and further ones revisit it.
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    further = F.col("copy") > 1
    found = found.withColumn("revisit", F.col("revisit") | further & F.col("refers_to").isNotNull()).withColumn(
        "record_id", F.when(further, _record_id(F.lit("copy"), F.col("record_id"), F.col("copy"))).otherwise(F.col("record_id")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    main, first = F.col("record_id"), ~F.col("revisit")

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(2 * _END))
    digest = F.concat(F.lit("sha1:"), "digest")
    host = F.regexp_extract(uri, r"^[a-z]+://([^/?#]*)", 1)
    target = F.coalesce(F.nullif(F.regexp_replace(uri, r"^[a-z]+://[^/?#]*|#.*$", ""), F.lit("")), F.lit("/"))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(_END))
    records = F.array(
        _record(F.lit("request"), _record_id("request", main), uri,
                F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{_END}Host: "), host, F.lit(2 * _END)),
                ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))),
        _record(F.when(first, "response").otherwise("revisit"), main, uri,
                F.concat(http, F.when(first, F.col("html")).otherwise("")),
                ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(~first, F.col("refers_to"))),
                ("WARC-Profile", F.when(~first, F.lit(_PROFILE))), ("Content-Type", F.lit("application/http; msgtype=response"))),
        _record(F.lit("metadata"), _record_id("metadata", main), uri, fields,
                ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))))
    (
        found.select(F.explode(records).alias("value"))
        .write.option("lineSep", 2 * _END).option("compression", compression).text(path)
    )


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
#: What stands before every record of a file but the first.
_SEPARATOR = b"\r\n\r\nWARC/1."
_FIELDS = [("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.list_(pa.string())),
           ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
           ("payload", pa.binary()), ("complete", pa.bool_())]
_READ = ("record_id string, type string, uri string, concurrent_to array<string>, refers_to string, payload_digest string, "
         "payload_bytes bigint, fields map<string,string>, payload binary, complete boolean")


def _plain(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _header(data: bytes, at: int, head: int) -> tuple[dict[bytes, list[bytes]], int | None]:
    """Headers of the record that begins at ``at``, and its Content-Length, or None."""
    headers: dict[bytes, list[bytes]] = {}
    for name, value in _HEADER.findall(data[data.find(b"\r\n", at) + 2:head + 2]):
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    size = headers.get(b"content-length", [b""])[0]
    return headers, int(size) if size.isdigit() else None


def _record_row(headers: dict[bytes, list[bytes]], block: bytes, complete: bool, with_payload: bool) -> dict:
    one = lambda name: _plain(headers.get(name, [None])[0])
    kind = _plain(headers.get(b"warc-type", [b""])[0])
    payload, length, digest, fields = block, len(block), one(b"warc-payload-digest"), None
    if kind in ("response", "revisit", "request") and block.startswith((b"HTTP/", b"GET ", b"POST ", b"HEAD ", b"PUT ")):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        if kind == "revisit" and stated:
            length = int(stated[1])
    if kind == "response":
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() if complete else None
    if kind == "metadata":
        fields = [(_plain(k), _plain(v)) for k, v in dict(_HEADER.findall(block)).items()]
    return {
        "record_id": one(b"warc-record-id"), "type": kind, "uri": one(b"warc-target-uri"),
        "concurrent_to": [_plain(v) for v in headers.get(b"warc-concurrent-to", [])], "refers_to": one(b"warc-refers-to"),
        "payload_digest": digest, "payload_bytes": length, "fields": fields, "payload": payload if with_payload else None,
        "complete": complete}


def parse_records(pieces: Iterable[bytes], with_payload: bool) -> Iterator[dict]:
    """Records of one archive, given in pieces; no more than a record and a piece is held.

    Bytes between records that start none are skipped up to the next line, and so is a record without a
    length. A record that the archive cuts off has ``complete`` false, the part there is, and no digest.
    """
    parts: list[bytes] = []
    size, needed, begun = 0, 0, False

    def cut(data: bytes, last: bool) -> Iterator[dict]:
        """The records that are whole; leaves what follows in ``parts``."""
        nonlocal parts, size, needed, begun
        # A record may begin in the last bytes: at a line, or where the archive does.
        line = data.rfind(b"\n", max(0, len(data) - 8))
        at, rest, needed = 0, line if line >= 0 else len(data) if begun or len(data) > 7 else 0, 0
        while (at := data.find(b"WARC/1.", at)) >= 0:
            if at and data[at - 1] != 10:
                at += 1
                continue
            head = data.find(b"\r\n\r\n", at)
            if head < 0:
                rest = at
                break
            headers, length = _header(data, at, head)
            if length is None:
                at = head
                continue
            end = head + 4 + length
            if end > len(data) and not last:
                rest, needed = at, end - at
                break
            yield _record_row(headers, data[head + 4:end], end <= len(data), with_payload)
            at, begun = end, True
            rest = max(rest, end)
        begun = begun or rest > 0
        parts = [data[rest:]]
        size = len(parts[0])

    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size >= needed:
            yield from cut(b"".join(parts), False)
    yield from cut(b"".join(parts), True)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, skip_damaged: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``, plain, or gzip if named ``.gz``.

    Files are read as a stream of records, so a record has to fit in a task and a file does not. The
    digest and length of a response are worked out from its payload; those of a revisit are the ones it
    states. A record without a length is skipped. A record that the end of the file cuts off has
    ``complete`` false and no digest. A damaged gzip file ends the job; with ``skip_damaged`` its records
    up to the damage are kept. A plain file of more than ``spark.sql.files.maxPartitionBytes`` is read in
    parts, cut where a record starts; there, a payload that itself holds a record start may be cut.
    """
    schema = pa.schema(_FIELDS)

    def run(batches):
        def pieces():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield (batch.column("path")[i].as_py(), batch.column("start")[i].as_py()), batch.column("value")[i].as_py()

        held, size = [], 0
        for (_, start), part in groupby(pieces(), key=lambda piece: piece[0]):
            # The reader drops the separators; only the first piece of a file has none before it.
            stream = (value if n == 0 and start == 0 else _SEPARATOR + value for n, (_, value) in enumerate(part))
            for record in parse_records(stream, with_payload):
                held.append(record)
                size += len(record["payload"] or b"") + 500
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    lines = (
        spark.read.format("text").option("lineSep", _SEPARATOR.decode()).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "[!_.]*").option("ignoreCorruptFiles", str(skip_damaged).lower()).load(path)
    )
    found = lines.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return found.mapInArrow(run, _READ)


def assemble(records: DataFrame, carried: tuple[str, ...] = ("uri", "refers_to", "payload_digest", "payload_bytes")) -> DataFrame:
    """``capture_id, main, requests, metadata``: one nested row per capture.

    A response, revisit, resource or conversion record is a capture's main record. Another record joins
    the capture that its concurrent-to identifiers reach: a main record, one that names it, or a record
    that reaches one. With several, it joins the least identifier. Records that reach none are captures
    of their own, with a null main. ``carried`` are the columns kept of main records. Identifiers are
    unique: repeated records are taken once.
    """
    records = records.where("record_id is not null").dropDuplicates(["record_id"])
    is_main = F.col("type").isin(*_MAIN)
    main = records.where(is_main)
    rest = records.where(~is_main)
    links = rest.select("record_id", F.explode("concurrent_to").alias("target"))
    named = main.select(F.col("record_id").alias("root"), F.explode("concurrent_to").alias("record_id"))
    known = main.select(F.col("record_id").alias("target"), F.col("record_id").alias("root"))
    reached = links.join(known, "target").select("record_id", "root").union(
        named.join(rest.select("record_id"), "record_id", "left_semi").select("record_id", "root"))
    reached = materialize(reached.groupBy("record_id").agg(F.min("root").alias("root")), "reached")
    while (pending := links.join(reached, "record_id", "left_anti")).limit(1).count():
        more = materialize(
            pending.join(reached.withColumnRenamed("record_id", "target"), "target")
            .groupBy("record_id").agg(F.min("root").alias("root")), "reached")
        if not more.limit(1).count():
            break
        reached = reached.union(more)
    placed = rest.join(reached, "record_id", "left").select(F.coalesce("root", "record_id").alias("capture_id"), "record_id", "type", "uri", "fields")
    beside = placed.groupBy("capture_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "uri")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") != "request", F.struct("record_id", "type", "fields"))),
                     lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias("metadata"))
    kept = main.select(F.col("record_id").alias("capture_id"), F.struct("type", *carried).alias("main"))
    return kept.join(beside, "capture_id", "full").select(
        "capture_id", "main", F.coalesce("requests", F.array().cast("array<struct<record_id:string,uri:string>>")).alias("requests"),
        F.coalesce("metadata", F.array().cast("array<struct<record_id:string,type:string,fields:map<string,string>>>")).alias("metadata"))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and assemble: one row per row of ``pages``.

    The archives are read once, into a table of the records without their payloads.
    """
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return assemble(materialize(read_archives(spark, path, with_payload=False), "records"))
