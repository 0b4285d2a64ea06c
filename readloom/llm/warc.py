"""Content-addressed WARC archive.

Two tables make an archive. ``blobs`` has each distinct payload once, under its SHA-256 and length;
``records`` has one row per record with the exact bytes of its header block and the address of its payload.
The original record is ``header + payload + CRLF CRLF`` and comes back through a join of the two.

Rules: a null payload is empty; of records with equal payloads of at least ``min_revisit`` bytes the one with
the largest id is the response and the others revisit it; repeated rows with that same id are all responses;
a null id makes a response, as nothing can refer to it; null urls are written as ``about:blank``; line breaks
in a url are percent-encoded. Header fields are read by whole lines, so a url that quotes one changes nothing.
Other columns of the input are ignored.

A payload that very many records share is no skewed key. When records are written, those of the few hot addresses are
dealt over several keys, to each of which the short entry of the payload goes; when they are read, a payload is repeated
once for every ``HOT`` of its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import new_path

CRLF = "\r\n"
#: Records of one payload that a reading task meets; at least so many (or 1 / MAX_HOT of all) make an address hot.
HOT, MAX_HOT = 1000, 4096


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes ``path/blobs`` and ``path/records``; returns path.

    Payload bytes are shuffled once, after equal ones have met inside each map task. Headers need only
    addresses, so the second job moves no payload; at most ``MAX_HOT`` hot addresses are broadcast.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    address = [F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes")]
    blobs = rows.select(*address, "id", "payload").groupBy("digest", "n_bytes").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n_records"), F.first("payload").alias("payload"))
    blobs.select("digest", "n_bytes", "owner", "n_records", F.sha1("payload").alias("sha1"), "payload").write.option("compression", "zstd").parquet(f"{path}/blobs")

    owners = spark.read.parquet(f"{path}/blobs").select("digest", "n_bytes", "owner", "n_records", "sha1")
    total = owners.agg(F.sum("n_records")).first()[0] or 0
    least = max(HOT, -(-total // MAX_HOT))
    keys = F.floor(F.col("n_records") / least).cast("int")
    hot = owners.filter(F.col("n_records") >= least).select("digest", "n_bytes", keys.alias("keys"))
    rows = rows.select("id", "url", *address).join(F.broadcast(hot), ["digest", "n_bytes"], "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "url"), F.col("keys") + 1), F.lit(0)).cast("int"))
    named = rows.join(owners.withColumn("salt", F.explode(F.sequence(F.lit(0), keys))), ["digest", "n_bytes", "salt"])
    revisit = (F.col("n_bytes") >= min_revisit) & (F.col("id") != F.col("owner"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "\r", "%0D"), "\n", "%0A")
    uri = lambda key: F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("n_bytes").cast("string")), F.lit(CRLF))
    is_revisit = F.coalesce(revisit, F.lit(False))
    named = named.withColumn("is_revisit", is_revisit).withColumn("http", http)
    block = F.octet_length("http") + F.when(F.col("is_revisit"), F.lit(0)).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(F.col("is_revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", uri(F.col("id"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("is_revisit"), F.concat(_line("WARC-Refers-To", uri(F.col("owner"))), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        F.col("http"),
    )
    named.select("id", "digest", "n_bytes", "n_records", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, record_type, target_uri, payload_bytes, payload_digest, refers_to, header, payload, record.

    Every stored payload is hashed again before the join and a wrong one stops the job. A reader who selects
    no payload column moves none: Catalyst prunes it below the join. ``record`` has the original bytes; a
    revisit's record ends after its header block.
    """
    blobs = spark.read.parquet(f"{path}/blobs")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes"))
    copies = F.floor(F.col("n_records") / HOT).cast("int")
    blobs = blobs.select("digest", "n_bytes", F.explode(F.sequence(F.lit(0), copies)).alias("salt"), F.when(sound, F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    page = lambda name: F.regexp_extract(text, rf"\r\n{name}: <urn:page:([^>\r]*)>\r\n", 1).try_cast("long")
    parsed = spark.read.parquet(f"{path}/records").select(
        page("WARC-Record-ID").alias("id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest").alias("stated"),
        page("WARC-Refers-To").alias("refers_to"),
        "header", "digest", "n_bytes", F.pmod(F.xxhash64("id", "header"), copies + 1).cast("int").alias("salt"),
    )
    whole = parsed.join(blobs, ["digest", "n_bytes", "salt"])
    digest = F.when(F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("stated"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header states another digest")))
    record = F.when(F.col("record_type") == "revisit", F.concat("header", F.lit(CRLF * 2).cast("binary"))).otherwise(F.concat("header", "payload", F.lit(CRLF * 2).cast("binary")))
    return whole.select("id", "record_type", "target_uri", "payload_bytes", digest.alias("payload_digest"), "refers_to", "header", "payload", record.alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Plain .warc text files for other tools: Spark's text writer ends each record with CRLF CRLF."""
    body = F.when(F.col("record_type") == "revisit", F.col("header")).otherwise(F.concat("header", "payload"))
    records.select(body.cast("string").alias("value")).write.option("lineSep", CRLF * 2).text(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_archive(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op1_warc": """
    SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> owner THEN owner END AS refers_to
    FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS owner FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
    """
}
