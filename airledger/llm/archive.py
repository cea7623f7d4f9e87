"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by a join."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: The base-32 alphabet of RFC 4648 beside the digits that conv() writes. Fixed values.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The date that headers carry: the archive is a function of its input.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32, without a prefix."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _CONV_DIGITS, _BASE32)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page: str, row: str) -> Column:
    """A record's own name: its page's id (null if it has none) and its row's number, as ids may repeat."""
    return F.concat(F.lit("<urn:airledger:page:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))


_ID = r"<urn:airledger:page:(-?[0-9]+|null):([0-9]+)>"


def _headers() -> Column:
    """All of a record before its payload, as bytes: its header block, and a response's HTTP head."""
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    revisit = F.col("record_type") == "revisit"
    size = F.col("bytes").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id("page_id", "row")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id("first.page_id", "first.row")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise((F.length(head) + F.col("bytes")).cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(head),
    ).cast("binary")


def _table(path: str) -> str:
    """The name under which a session knows the payloads of an archive as a bucketed table."""
    return f"airledger_payloads_{hashlib.sha1(path.encode()).hexdigest()}"


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Writes pages (page_id, url, html) as an archive of two Parquet tables under path, and returns path.

    headers: page_id, row, sha256, record_type, refers_to, header (the exact bytes of a record before its payload).
    payloads: sha256, payload, each distinct payload once, in buckets of sha256.

    The payload is html in UTF-8; null counts as empty. Of records with equal payloads of at least min_bytes bytes the
    one with the largest page_id is the response and the others revisit it; smaller payloads are stored once too, but
    each record is a response. Equality is that of SHA-256 and length. Rows with null page_id revisit if another row
    has an id and else are responses; repeated rows are records of their own, those with the largest page_id all
    responses. An empty table gives an empty archive; other columns may have any names.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # Digests are made once; what follows reads these narrow rows.
    slim = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    slim = stored(slim.withColumn("row", F.monotonically_increasing_id()), "pages")
    chosen = slim.groupBy("sha256", "bytes").agg(F.max(F.struct("page_id", "row")).alias("first"))
    response = (F.col("bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("first.page_id"))
    records = slim.join(chosen, ["sha256", "bytes"]).withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    records = records.withColumn("refers_to", F.when(~response, F.col("first.page_id")))
    records.select("page_id", "row", "sha256", "record_type", "refers_to", _headers().alias("header")).write.parquet(f"{path}/headers")
    # Copies of a payload are one row for each task before they are dealt out. As many buckets as parts: each is one file.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.first("payload").alias("payload"))
    kept.write.bucketBy(buckets, "sha256").option("compression", "zstd").option("path", f"{path}/payloads").saveAsTable(_table(path))
    return path


def stored_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and payload of each stored payload, verified: bytes that don't match their digest raise.

    In the session that wrote the archive they lie in buckets, so that a join by sha256 doesn't deal them out again.
    """
    name = _table(path)
    read = spark.table(name) if spark.catalog.tableExists(name) else spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    intact = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest: "), F.col("sha256"))))
    return read.select("sha256", intact.alias("payload"))


def stored_headers(spark: SparkSession, path: str) -> DataFrame:
    """The archive's header table."""
    return spark.read.schema("page_id long, row long, sha256 string, record_type string, refers_to long, header binary").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and record: every record as its exact bytes, responses rebuilt by joining both tables.

    A revisit record has an empty block, as its header says, and needs no payload.
    """
    heads, end = stored_headers(spark, path), F.lit(b"\r\n\r\n")
    # Headers are the small side: they are what is hashed.
    responses = heads.where("record_type = 'response'").hint("shuffle_hash").join(stored_payloads(spark, path), "sha256")
    revisits = heads.where("record_type = 'revisit'")
    return responses.select("page_id", F.concat("header", "payload", end).alias("record")).unionByName(revisits.select("page_id", F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """page (text), row, record_type, digest, refers_page, refers_row, payload_bytes and payload_digest of record bytes.

    Everything is read from the bytes. A response's length and digest are those of the payload behind its HTTP head; a
    record that is not as long as its header says, or whose payload doesn't have the digest there, raises.
    """
    text = F.col("record").cast("string")
    cut = records.select("record", F.substring_index(text, "\r\n\r\n", 1).alias("head"))
    field = lambda pattern, group=1: F.regexp_extract("head", pattern, group)
    fields = cut.select(
        field(f"WARC-Record-ID: {_ID}").alias("page"),
        field(f"WARC-Record-ID: {_ID}", 2).cast("long").alias("row"),
        field(r"WARC-Type: ([a-z]+)").alias("record_type"),
        field(r"WARC-Payload-Digest: sha1:([A-Z2-7]+)").alias("digest"),
        field(f"WARC-Refers-To: {_ID}").alias("refers_page"),
        field(f"WARC-Refers-To: {_ID}", 2).alias("refers_row"),
        F.expr("substring(record, octet_length(head) + 5)").alias("rest"),
        field(r"Content-Length: ([0-9]+)").cast("int").alias("size"),
    )
    whole = fields.withColumn("rest", F.when(F.octet_length("rest") == F.col("size") + 4, F.col("rest")).otherwise(F.raise_error(F.lit("a record isn't as long as its header says"))))
    is_response = F.col("record_type") == "response"
    body = F.expr("substring(rest, octet_length(substring_index(cast(rest AS string), '\r\n\r\n', 1)) + 5, size - octet_length(substring_index(cast(rest AS string), '\r\n\r\n', 1)) - 4)")
    read = whole.withColumn("payload", F.when(is_response, body))
    read = read.select("page", "row", "record_type", "digest", "refers_page", "refers_row", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    right = F.col("record_type").isin("response", "revisit") & (~is_response | (F.col("payload_digest") == F.col("digest")))
    return read.withColumn("digest", F.when(right, F.col("digest")).otherwise(F.raise_error(F.lit("a payload doesn't have its header's digest"))))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, read from rebuilt records.

    A revisit's payload is that of the record it refers to, whose digest must be the same.
    """
    records = stored(parsed(read_records(spark, path)), "records")
    number = lambda c: F.when(~F.col(c).isin("", "null"), F.col(c).cast("long"))
    own = records.where("record_type = 'response'")
    facts = own.select(F.col("page").alias("refers_page"), F.col("row").cast("string").alias("refers_row"), "digest", "payload_bytes", "payload_digest")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(facts, ["refers_page", "refers_row", "digest"])
    both = own.select(*records.columns).unionByName(revisits.select(*records.columns))
    return both.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_page").alias("refers_to"))


def new_path(spark: SparkSession) -> str:
    """A new folder for an archive among those that driver and executors share."""
    return f"{shared_dir(spark)}/airledger-llm/warc-{uuid.uuid4().hex}"
