"""WARC archives: writing, turning whole-file gzip into one member per record, reading by offset."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from oddline.llm.common import columns, hot_lookup
from oddline.session import durable, scratch_path

# Fixed values of the archive format.
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # of the capture, where the caller has none
CHUNK = 1 << 20
LEVEL = 6  # of the members' compression


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every page.

    Of equal payloads of at least ``min_bytes`` the largest ``page_id`` is the
    response and the others revisit it.  Digests are counted before pages move, and
    a payload that a third of all pages share is dealt to many tasks.
    """
    payload = F.coalesce("html", F.lit(""))
    base = columns(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"))
    keyed = base.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn(
        "payload_digest", base32_sha1(F.encode("payload", "UTF-8"))
    )
    groups = durable(
        keyed.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows")),
        "payloads",
    )
    total = groups.agg(F.sum("_rows")).first()[0] or 0
    found = hot_lookup(keyed, groups, ["payload_digest"], "_rows", total, ["page_id", "url"])
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def record_text(date: str = DATE) -> Column:
    """The record of a page without its closing line ends."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(http, "payload")).otherwise(http)

    def name(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))

    line = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20]", "%20")
    refers = F.when(response, "").otherwise(
        F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name("refers_to"), F.lit("\r\n"))
    )
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), line,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "payload_digest", F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write_archives(records: DataFrame, folder: str, records_per_file: int = 50_000) -> None:
    """Archives of which each is one gzip stream, as careless tools write them."""
    rows = records.select(record_text().alias("value"))
    writer = rows.write.option("compression", "gzip").option("lineSep", RECORD_END)
    writer.option("maxRecordsPerFile", records_per_file).text(folder)


# --- normalising -----------------------------------------------------------------


def inflated(data: bytes):
    """The plain bytes of one or more gzip members, piece by piece."""
    view, at = memoryview(data), 0
    inflate = zlib.decompressobj(31)
    while at < len(view) or inflate.unconsumed_tail:
        piece = inflate.unconsumed_tail or view[at : at + CHUNK]
        if not inflate.unconsumed_tail:
            at += len(piece)
        yield inflate.decompress(piece, CHUNK)
        if inflate.eof:
            at -= len(inflate.unused_data)
            if at >= len(view):
                return
            inflate = zlib.decompressobj(31)
    yield inflate.flush()
    if not inflate.eof:
        raise ValueError("archive ends within its gzip stream")


def records_of(pieces):
    """``(header, block)`` of every record of a stream; holds one record at a time."""
    held, source, closed = bytearray(), iter(pieces), False

    def more() -> bool:
        nonlocal closed
        piece = next(source, None)
        closed = closed or piece is None
        held.extend(piece or b"")
        return not closed

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("archive ends within a record")
            return
        head = bytes(held[:end])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {head[:40]!r}")
        size = int(fields(head)["content-length"])
        while len(held) < end + 4 + size + 4 and more():
            pass
        if len(held) < end + 4 + size:
            raise ValueError("archive ends within a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if ":" in line)}


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if number in ("", "none") else int(number)


INDEX = [("archive", pa.string()), ("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
         ("record_type", pa.string()), ("record_id", pa.string()), ("digest", pa.string())]
INDEX_DDL = "archive string, record long, offset long, length long, record_type string, record_id string, digest string"


def _normalise(folder: str):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                name = os.path.basename(path).split(".")[0] + f"-{zlib.crc32(path.encode()):08x}"
                context = TaskContext.get()
                own = f"{root}/.{name}-{context.stageId()}-{context.taskAttemptId()}"
                rows, at = {n: [] for n, _ in INDEX}, 0
                with store.open_output_stream(own + ".warc.gz", compression=None) as out:
                    for i, (head, block) in enumerate(records_of(inflated(content))):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = packer.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()
                        out.write(member)
                        known = fields(head)
                        row = (f"{folder}/{name}.warc.gz", i, at, len(member), known["warc-type"],
                               known.get("warc-record-id"), known.get("warc-payload-digest"))
                        for (n, _), value in zip(INDEX, row):
                            rows[n].append(value)
                        at += len(member)
                with store.open_output_stream(own + ".cdx", compression=None) as out:
                    for row in zip(*(rows[n] for n, _ in INDEX)):
                        out.write(("\t".join(map(str, row[1:])) + "\n").encode())
                # A task that runs twice replaces its files by equal ones.
                for kind in (".warc.gz", ".cdx"):
                    store.move(own + kind, f"{root}/{name}{kind}")
                yield pa.RecordBatch.from_pydict(rows, pa.schema(INDEX))

    return run


def normalise(spark, source: str, folder: str) -> DataFrame:
    """Rewrite every archive of ``source`` with one gzip member per record.

    Each archive is inflated once, as a stream; its records go to
    ``folder/<name>.warc.gz`` and their places to ``folder/<name>.cdx``.  Returns
    the same index as a table.  ``folder`` is one that all executors reach; an
    archive that ends too early or holds something else raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    return durable(files.mapInArrow(_normalise(folder), INDEX_DDL), "index")


def _read(batches):
    names = ("archive", "offset", "length")
    for batch in batches:
        rows = {n: [] for n, _ in RECORDS}
        handles = {}
        for archive, offset, length in zip(*(batch.column(n).to_pylist() for n in names)):
            if archive not in handles:
                handles = {archive: None}  # one open archive at a time; the index is in its order
                store, path = fs.FileSystem.from_uri(archive)
                handles[archive] = store.open_input_file(path)
            (head, block), = records_of(inflated(handles[archive].read_at(length, offset)))
            known = fields(head)
            http, _, payload = block.partition(b"\r\n\r\n")
            response = known["warc-type"] == "response"
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else None
            rows["page_id"].append(_page(known.get("warc-record-id")))
            rows["payload"].append(payload.decode("utf-8") if response else None)
            rows["payload_bytes"].append(len(payload) if response else int(fields(http)["content-length"]))
            rows["payload_digest"].append(digest or known["warc-payload-digest"].removeprefix("sha1:"))
            rows["record_type"].append(known["warc-type"])
            rows["refers_to"].append(_page(known.get("warc-refers-to")))
        yield pa.RecordBatch.from_pydict(rows, pa.schema(RECORDS))


RECORDS = [("page_id", pa.int64()), ("payload", pa.string()), ("payload_bytes", pa.int64()),
           ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def read_archives(index: DataFrame) -> DataFrame:
    """The records at the places of an index; digests of responses are computed from what is read."""
    ddl = "page_id long, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.select("archive", "offset", "length").mapInArrow(_read, ddl)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as whole-file gzip archives, normalise these, and read the records back.

    Takes ``page_id, url, html``; a null html is an empty payload.  Rows repeated
    with the largest id of their payload are all responses.  A null ``page_id`` is
    lower than any other and comes back as null.
    """
    spark = pages.sparkSession
    raw, tidy = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archives(page_records(pages, min_bytes), raw)
    return read_archives(normalise(spark, raw, tidy))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload")


SQL = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, hex(unhex(sha1(coalesce(html, '')))) AS digest FROM pages
        ), g AS (SELECT body, max(page_id) AS first_id FROM p GROUP BY body)
        SELECT page_id, strlen(p.body) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                   list_sum(list_transform(range(5), lambda j: (
                       ((strpos('0123456789ABCDEF', substr(digest, 1 + (5 * i + j) // 4, 1)) - 1)
                           >> (3 - (5 * i + j) % 4)) & 1) << (4 - j))))::INTEGER, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN g ON p.body = g.body
    """
}
