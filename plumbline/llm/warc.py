"""Content-addressed web archive.

``write_archive`` makes two tables in one folder: ``payloads`` (each payload's bytes once, by
SHA-256) and ``records`` (the exact header block of every record, with the digest it points to).
``read_archive`` joins them again, verifies the stored bytes against their digest and gives back
each record: header block, payload, and the fields parsed from the header block.
``export_warc`` writes the reconstructed records as gzipped WARC 1.1 text files.

Digests are verified twice: as the archive is written, payloads of one digest must agree in length and in a second, 64-bit hash (their
bytes are not compared one by one); as it is read, every stored payload must hash to its digest.

Defined cases: a null payload is empty; payloads under ``min_revisit`` bytes are all responses;
where the smallest id of equal payloads repeats, all rows that carry it are responses; control
characters and spaces in a URL are percent-encoded in its header, a null URL has an empty one; an
empty table gives empty tables; a very long payload is one row; a record whose payload is missing fails the read; other columns of the input are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shuffle_partitions

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A digest is hot from 1/(HOT_PARTS * partitions) of all rows on.
HOT_PARTS = 4


def _record_urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def _safe_url(url: Column) -> Column:
    u = F.coalesce(url.cast("string"), F.lit(""))
    for ch in ("%0D", "%0A", "%09", "%20"):
        u = F.replace(u, F.lit(bytes.fromhex(ch[1:]).decode()), F.lit(ch))
    return u


def write_archive(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = 100,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write the two tables of the archive under ``path``."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.unhex(F.sha2("payload", 256))
    )
    slim = rows.select("id", "url", "digest", F.octet_length("payload").alias("n"))
    # Equal digests with unequal length or second hash would be a collision: such a row fails the write.
    firsts = rows.groupBy("digest").agg(
        F.min("id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        (
            (F.min(F.xxhash64("payload")) == F.max(F.xxhash64("payload")))
            & (F.min(F.octet_length("payload")) == F.max(F.octet_length("payload")))
        ).alias("same"),
    )

    # Few digests can hold so large a share of the rows: they are broadcast, the others shuffled.
    limit = max(64, df.count() // (HOT_PARTS * shuffle_partitions(spark)))
    hot = firsts.filter(F.col("copies") > limit)
    cold = firsts.filter(F.col("copies") <= limit)
    keyed = slim.join(F.broadcast(hot.select(F.col("digest").alias("h"), F.col("first_id").alias("hot_id"), F.col("same").alias("hot_same"))), F.col("digest") == F.col("h"), "left").drop("h")
    plain = keyed.filter(F.col("hot_same").isNull()).drop("hot_id", "hot_same").join(cold.select("digest", "first_id", "same"), "digest")
    heavy = keyed.filter(F.col("hot_same").isNotNull()).withColumnsRenamed({"hot_id": "first_id", "hot_same": "same"})
    known = plain.unionByName(heavy)

    revisit = (F.col("n") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_urn(F.col("id"))),
        line("WARC-Target-URI", _safe_url(F.col("url"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(
            revisit,
            F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _record_urn(F.col("first_id")))),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
    )
    known.select(
        F.when(~F.col("same"), F.raise_error("two payloads share a SHA-256 digest")).otherwise(F.col("id")).alias("id"),
        header.alias("header"),
        "digest",
    ).write.parquet(f"{path}/records")

    # Copies of a payload meet in each task already, before the shuffle.
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: id, header, payload, record_type, refers_to, payload_bytes, payload_digest.

    ``payload`` is the full one for revisits too, found through the digest in the header block.
    Stored bytes that don't hash to their digest, and records without stored bytes, fail the read.
    """
    records = spark.read.parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/payloads")
    real = F.sha2("payload", 256)
    stored = stored.select(
        F.when(real == F.lower(F.hex("digest")), real).otherwise(F.raise_error("stored payload is damaged")).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "payload",
    )
    field = lambda name: F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    parsed = records.select(
        "id",
        "header",
        field("WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(field("WARC-Refers-To"), "<urn:record:(.*)>", 1), F.lit("")).alias("refers_to"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")).alias("payload_digest"),
    )
    joined = parsed.join(stored, "payload_digest", "left")
    return joined.withColumn("payload", F.coalesce("payload", F.raise_error("a record's payload is missing").cast("binary")))


def export_warc(records: DataFrame, path: str) -> None:
    """Reconstructed records as WARC files: header block, empty line, block, and two line ends after each."""
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    text = F.concat(F.col("header"), F.lit(CRLF), block)
    records.select(text).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
