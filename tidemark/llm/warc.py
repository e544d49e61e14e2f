"""A content-addressed WARC archive as two tables.

Payload bytes stand once in ``payloads``, under a SHA-256 digest; ``headers`` holds
the exact header of every record and the digest of its payload. A join gives the
records back. Only DataFrame functions are used.
"""

from pyspark.sql import functions as F

from ..session import scratch
from .common import col

SMALLEST_REVISIT = 100
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value):
    """A header value stays on its line."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(page):
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _header(kind, page, url, digest, length, refers_to, date):
    """The lines of a record's header, its closing empty line included."""
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    revisit = kind == "revisit"
    return F.concat(F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), field("WARC-Type", kind), field("WARC-Record-ID", _urn(page)),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", _line(url)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        field("WARC-Refers-To", _urn(refers_to)), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(~revisit, F.lit("Content-Type: text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
    ), F.lit("\r\n\r\n"))


def write(pages, folder=None, id_col="page_id", url_col="url", payload_col="html", smallest=SMALLEST_REVISIT, date=EPOCH):
    """Write the archive of a page table; returns its folder.

    Of equal payloads of at least ``smallest`` bytes the least page id is the
    response and the others revisit it; smaller payloads are all responses, though
    their bytes are stored once too. A null payload is empty, a null url leaves its
    line out, rows without an id stand after all others, and rows that repeat the
    least id are responses alike. If payloads of one digest ever differ, the
    job fails instead of losing one.
    """
    folder = folder or scratch(pages.sparkSession, "archive")
    rows = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
        F.coalesce(col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    index = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length"), F.xxhash64("payload").alias("check"))
    # A row for each digest: the response's id, and a second look at the bytes behind it.
    heads = index.groupBy("digest").agg(
        F.min("page_id").alias("head"), F.min("check").alias("low"), F.max("check").alias("high"),
        F.min("length").alias("short"), F.max("length").alias("long"),
    ).select("digest", F.when((F.col("low") == F.col("high")) & (F.col("short") == F.col("long")), F.col("head"))
             .otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), F.col("digest")))).alias("head"))
    joined = index.join(heads, "digest")
    revisit = (F.col("length") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("head"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    joined.select(
        "page_id", "digest",
        _header(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("length"), F.when(revisit, F.col("head")), date).alias("header"),
    ).write.option("compression", "zstd").parquet(f"{folder}/headers")
    payloads = rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads.select("digest", F.col("payload").cast("binary").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def read(spark, folder):
    """Every page's header, full payload, its size and digest, and record bytes, through a join on the digest.

    A record of a revisit ends after its header, as its payload is another
    record's. Each payload's size and digest are computed again when it is read, before
    the join, so that payloads move only if the payload or the record is asked for;
    bytes that don't fit their digest fail the job.
    """
    headers = spark.read.schema("page_id long, digest string, header string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    found = F.sha2("payload", 256)
    fault = F.raise_error(F.concat(F.lit("payload doesn't fit digest "), F.col("digest")))
    sound = payloads.select(
        "digest", F.when(found == F.col("digest"), F.col("payload")).otherwise(fault.cast("binary")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(found == F.col("digest"), found).otherwise(fault.cast("string")).alias("payload_digest"),
    )
    body = F.when(F.col("header").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(sound, "digest").select(
        "page_id", "header", "payload", "payload_bytes", "payload_digest",
        F.concat(F.encode("header", "utf-8"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def fields(records):
    """What the headers say, beside size and digest of the payload that was read back; takes the rows of ``read``."""
    of = lambda pattern: F.nullif(F.regexp_extract("header", pattern, 1), F.lit(""))
    return records.select(
        "page_id", "payload_bytes", "payload_digest",
        of("\r\nWARC-Type: ([a-z]+)\r\n").alias("record_type"),
        of("\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n").cast("long").alias("refers_to"),
    )
