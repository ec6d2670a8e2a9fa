"""Web archives: writing captures as WARC 1.1 records, reading them back, assembling transactions.

Every page becomes three records, a request, a response (or revisit) and a metadata record; the request and the
metadata name the response in WARC-Concurrent-To. Equal payloads of at least MIN_REVISIT bytes are stored once: the
capture with the smallest page_id is the response, the others are revisits. ``captures`` joins the records of a
transaction through these identifiers into one nested row.

The archives are written by Spark's text writer, whose line separator is the empty line that ends a WARC record,
gzipped, some FILE_BYTES of payload a file. Readers take files whole and stream through the decompressed records.

Edge cases: a null html is an empty payload; a null or empty url has no WARC-Target-URI; line ends in a url are
percent-coded; a null page_id is kept as null; repeated rows get records of their own (those that share the smallest
page_id are all responses); an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.llm.common import sized_join

MIN_REVISIT = 100
FILE_BYTES = 12_000_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_BATCH_BYTES = 8_000_000


def _uuid(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("page_id"), F.col("digest"), F.col("row")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, record_id: Column, block: Column, content_type: str, *more: Column) -> Column:
    """One record without its final empty line; null header lines are left out."""
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"),
        *more,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(lines, F.lit(_END), block)


def write_archive(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files below ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.nullif(F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("")).alias("url"),
        html.alias("html"),
    ).withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html")})
    seen = base.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = seen.where("n > 1 and first is not null").select("digest", "first")
    size = base.agg(F.avg("bytes")).first()[0] or 0.0
    marked = sized_join(base, repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = marked.withColumns({"row": F.monotonically_increasing_id(), "revisit": revisit})
    response_id = _uuid("response")
    target = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    request = _record(
        F.lit("request"), _uuid("request"), F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
        "application/http; msgtype=request", target, concurrent,
    )
    response = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        response_id,
        F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))),
        "application/http; msgtype=response",
        target,
        digest,
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
    )
    fields = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n")
    )
    metadata = _record(F.lit("metadata"), _uuid("metadata"), fields, "application/warc-fields", target, concurrent)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    per_file = max(3, int(3 * FILE_BYTES / (size + 1000)))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of a gzipped archive, by Content-Length."""
    unzip = zlib.decompressobj(wbits=31)
    buffer = bytearray()
    at = 0

    def more() -> bool:
        nonlocal at, content, unzip
        if not content:
            return False
        if at:
            del buffer[:at]
            at = 0
        buffer.extend(unzip.decompress(content, 1 << 20))
        content = unzip.unconsumed_tail
        if unzip.eof:
            content = unzip.unused_data
            unzip = zlib.decompressobj(wbits=31)
        return True

    while True:
        end = buffer.find(b"\r\n\r\n", at)
        while end < 0:
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("the archive ends inside a record")
                return
            end = buffer.find(b"\r\n\r\n", at)
        lines = bytes(buffer[at:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts here: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        start = end + 4 - at
        while len(buffer) - at < start + size + 4:
            if not more():
                raise ValueError("the archive ends inside a block")
        yield headers, bytes(buffer[at + start : at + start + size])
        at += start + size + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, concurrent_to, target_uri, refers_to, payload_digest, block for every record."""
    names = ["warc-record-id", "warc-type", "warc-concurrent-to", "warc-target-uri", "warc-refers-to", "warc-payload-digest"]
    columns = ["record_id", "record_type", "concurrent_to", "target_uri", "refers_to", "digest_header"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows, blocks):
            arrays = [pa.array([r.get(n) for r in rows], pa.string()) for n in names]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(blocks, pa.binary())], [*columns, "block"])

        rows, blocks, size = [], [], 0
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse_records(content.as_py()):
                    rows.append(headers)
                    blocks.append(block)
                    size += len(block) + 400
                    if size > _BATCH_BYTES:
                        yield out(rows, blocks)
                        rows, blocks, size = [], [], 0
        if rows:
            yield out(rows, blocks)

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    files = files.option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{c} string" for c in columns) + ", block binary")


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: response (with payload), request and metadata joined through WARC-Concurrent-To.

    A response without a request or metadata record is kept, with nulls there.
    """
    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id",
        F.struct(
            "record_id", "record_type", "target_uri", "refers_to", "digest_header",
            F.expr("substring(block, instr(decode(block, 'ISO-8859-1'), decode(unhex('0D0A0D0A'), 'ISO-8859-1')) + 4)").alias("payload"),
        ).alias("response"),
    )
    request = records.where("record_type = 'request'").select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", F.col("block").cast("string").alias("head")).alias("request")
    )
    fields = F.str_to_map(F.rtrim(F.col("block").cast("string")), F.lit("\r\n"), F.lit(": "))
    metadata = records.where("record_type = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", fields.alias("fields")).alias("metadata")
    )
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left").select("response", "request", "metadata")


def digest_rows(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures; digests of what was read back.

    A revisit holds no payload: its size and digest are those its records state.
    """
    kind = F.col("response.record_type")
    stored = kind == "response"
    return rows.select(
        F.nullif(F.trim(F.col("metadata.fields")["page-id"]), F.lit("")).cast("long").alias("page_id"),
        F.when(stored, F.octet_length("response.payload").cast("long")).otherwise(F.col("metadata.fields")["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.when(stored, F.sha2("response.payload", 256)).otherwise(F.regexp_extract("response.digest_header", "^sha256:([0-9a-f]{64})$", 1)).alias("payload_digest"),
        kind.alias("record_type"),
        F.regexp_extract("response.refers_to", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long").alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
    )
