"""Content-addressed archive of WARC records.

The bytes of each payload are stored once under their SHA-256, exact record heads (WARC and HTTP header lines) apart from
them. Of large equal payloads the record with the largest id is the response, the others are revisits of it. Reading joins
heads with payloads, checks the stored bytes against their digest and gives back the original records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.store import written

#: Bytes from which an equal payload is stored as a revisit.
LEAST_REVISIT = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks inside a value are escaped."""
    plain = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit(CRLF)), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def heads_of(rows: DataFrame, date: str) -> DataFrame:
    """(page, type, sha256, large, head) of rows (page, url, sha256, sha1, n, responder)."""
    revisit = (F.col("n") >= LEAST_REVISIT) & ~F.col("page").eqNullSafe(F.col("responder"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("responder")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )
    head = F.concat(warc, http).cast("binary")
    return rows.select("page", "sha256", (F.col("n") >= LEAST_REVISIT).alias("large"), revisit.alias("revisit"), head.alias("head"))


def write_archive(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record for each row of pages to a new folder.

    A null payload is empty; a null url gives a record without a target. Rows that share id and payload are equal records.
    Equal payloads under LEAST_REVISIT bytes are all responses, though their bytes too are stored once.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), body.alias("content"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("content", 256)))
    digests = rows.select("page", "url", "sha256", F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("n"))
    digests = written(digests, "digests")
    # A join with an aggregate could not split a payload that very many pages share, so the aggregate is written first.
    owners = written(digests.groupBy("sha256").agg(F.max("page").alias("responder")), "owners")
    heads_of(digests.join(owners, "sha256"), date).write.parquet(f"{folder}/heads")
    # The first copy of each payload is found before anything is shuffled.
    once = rows.groupBy("sha256").agg(F.any_value("content").alias("content"))
    size = F.octet_length("content")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"payloads_{uuid.uuid4().hex}"
    once.withColumn("large", size >= LEAST_REVISIT).write.bucketBy(buckets, "sha256").sortBy("sha256").option("path", f"{folder}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/layout")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads as a bucketed table, so that joining heads with it moves heads only."""
    buckets = spark.read.parquet(f"{folder}/layout").first()["buckets"]
    name = f"payloads_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (sha256 BINARY, content BINARY, large BOOLEAN) USING parquet "
        f"CLUSTERED BY (sha256) SORTED BY (sha256) INTO {buckets} BUCKETS LOCATION '{folder}/payloads'"
    )
    return spark.table(name)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1)


def _page(identifier: Column) -> Column:
    return F.regexp_extract(identifier, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, digest, record, payload) of every record, all taken from the archived bytes.

    record holds the whole original record. payload is cut out of it and null for a revisit, whose block has none. Stored
    bytes that do not have their digest, or not the length a head states, are an error.
    """
    heads = spark.read.parquet(f"{folder}/heads")
    store = _payloads(spark, folder)
    checked = F.when(F.sha2("content", 256) == F.lower(F.hex("sha256")), F.col("content")).otherwise(F.raise_error(F.lit("a stored payload is damaged")))
    responses = heads.where("NOT revisit")
    # Large payloads have one response each and stay where they are; small ones may have any number and are dealt anew.
    large = responses.where("large").join(store.where("large"), "sha256", "left").withColumn("content", checked)
    small_store = written(store.where("NOT large").withColumn("content", checked).drop("large"), "small")
    small = responses.where("NOT large").join(small_store, "sha256", "left")
    columns = ["head", "content"]
    whole = large.select(*columns).union(small.select(*columns)).union(heads.where("revisit").select("head", F.lit(None).cast("binary").alias("content")))
    end = F.lit(2 * CRLF).cast("binary")
    whole = whole.select("content", F.concat("head", F.coalesce("content", F.lit("").cast("binary")), end).alias("record"), F.col("head").cast("string").alias("head"))
    kind = _field(F.col("head"), "WARC-Type")
    http = F.octet_length(F.substring_index("head", 2 * CRLF, -2))
    block = F.octet_length("record") - F.octet_length(F.substring_index("head", 2 * CRLF, 1)) - 8
    right = block == _field(F.col("head"), "Content-Length").cast("long")
    payload = F.expr("substring(record, octet_length(head) + 1, octet_length(record) - octet_length(head) - 4)")
    good = F.when(right, payload).otherwise(F.raise_error(F.lit("a record does not have the length its head states")))
    return whole.select(
        _page(_field(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        kind.alias("record_type"),
        _page(_field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        F.substring_index(_field(F.col("head"), "WARC-Payload-Digest"), ":", -1).alias("digest"),
        "record",
        F.when(kind == "response", good).alias("payload"),
    )


def payload_facts(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a revisit has its response's.

    Digests are taken from the bytes that were read; one that differs from what the head states is an error.
    """
    stated = F.when(F.sha1("payload") == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.lit("a payload does not have the stated digest")))
    facts = records.select(
        "page_id", "record_type", "refers_to", "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), stated).alias("payload_digest"),
    )
    facts = written(facts, "facts")
    responses = facts.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest"), "payload_bytes", "payload_digest")
    originals = written(responses.dropDuplicates(["refers_to", "digest"]), "originals")
    revisits = facts.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest").join(originals, ["refers_to", "digest"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return facts.where("record_type = 'response'").select(*names).union(revisits.select(*names))
