"""Content-addressed WARC archive.

``write_archive`` stores every payload once, under its verified SHA-256, and
every record's exact header bytes apart from it; ``read_archive`` joins the
two and gives the records back.  SHA-1, which WARC names, is no safe key
(collisions are known), so it is only carried: a group of equal SHA-256 must
agree on SHA-1 and length, and the reader hashes the stored bytes again;
both raise otherwise.

The payload side is one aggregation whose map side keeps one payload per
digest and task, so a payload shared by a third of all rows moves once per
task.  Headers join the store's small columns; the skew join splits a hot
digest.

Records have the named fields of WARC/1.1: ids are URIs (``<urn:x-page:7>``),
the date is a parameter or a column, a revisit names the profile of identical
payload digests.  A url that cannot stand in a header line as it is (with CR
or LF, or empty) is percent-encoded there and kept exactly beside the header,
so that it comes back as it was.

Defined cases: a null payload is empty; a null id is written as ``-`` and a
null date as ``date``; a null url has no target field and comes back null; of
equal payloads of ``min_revisit`` bytes or more the largest id is the
response and other ids revisit it (rows that repeat that id are responses
too; where all ids are null all are responses); shorter payloads are always
responses.  Empty input gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"

# FIXED VALUES: the profile URI of revisits of equal payloads, and the page ids' URI form
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "<urn:x-page:%s>"
DEFINED = ("page_id", "url", "payload")


def _line(name: str, value) -> list:
    return [F.lit(f"{name}: "), value, F.lit(CRLF)]


def _page_uri(value):
    before, after = URN.split("%s")
    return F.concat(F.lit(before), value, F.lit(after))


def records(df: DataFrame, id_col: str, url_col: str, payload_col: str, date: str, date_col: str | None = None) -> DataFrame:
    """``page_id, url, date, payload BINARY, sha256, sha1, n_bytes`` of each row."""
    when = F.lit(date)
    if date_col is not None:
        when = F.coalesce(F.date_format(F.to_utc_timestamp(F.col(f"`{date_col}`"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), when)
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), when.alias("date"),
                      payload.alias("payload"))
            .withColumn("sha256", F.sha2("payload", 256))
            .withColumn("sha1", F.sha1("payload"))
            .withColumn("n_bytes", F.octet_length("payload").cast("long")))


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit: int = 1000, date: str = "1970-01-01T00:00:00Z",
                  date_col: str | None = None, content_type: str = "text/html; charset=utf-8") -> None:
    """Write ``payloads`` and ``headers`` under ``path``.  ``date`` stands in every
    record unless ``date_col`` names a column of timestamps; it is fixed, so a
    second run writes the same bytes."""
    spark = df.sparkSession
    recs = records(df, id_col, url_col, payload_col, date, date_col)
    store = recs.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.max("page_id").alias("keeper"),
        F.min("sha1").alias("sha1"), F.max("sha1").alias("sha1_hi"),
        F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("n_hi"))
    same = (F.col("sha1") == F.col("sha1_hi")) & (F.col("n_bytes") == F.col("n_hi"))
    store.select("sha256", "keeper", "n_bytes",
                 F.when(same, F.col("sha1")).otherwise(F.raise_error(F.lit("digest collision"))).alias("sha1"),
                 "payload").write.mode("overwrite").parquet(f"{path}/payloads")
    index = spark.read.parquet(f"{path}/payloads").select("sha256", "keeper")
    rows = recs.select("page_id", "url", "date", "sha256", "sha1", "n_bytes").join(index, "sha256")
    revisit = (F.col("n_bytes") >= min_revisit) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    odd = F.col("url").rlike(r"[\r\n]") | (F.col("url") == "")
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.concat(*_line("WARC-Refers-To", _page_uri(F.col("keeper").cast("string"))), *_line("WARC-Profile", F.lit(PROFILE)))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        *_line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        *_line("WARC-Record-ID", _page_uri(name)), *_line("WARC-Date", F.col("date")),
        F.coalesce(F.concat(*_line("WARC-Target-URI", uri)), F.lit("")),
        *_line("WARC-Payload-Digest", digest),
        F.when(revisit, again).otherwise(F.concat(*_line("Content-Type", F.lit(content_type)))),
        *_line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF))
    rows.select("sha256", F.encode(header, "UTF-8").alias("header"), F.when(odd, F.col("url")).alias("odd_url")) \
        .write.mode("overwrite").parquet(f"{path}/headers")


def _field(text, name: str):
    found = F.regexp_extract(text, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _page(text, name: str):
    before, after = URN.split("%s")
    found = F.regexp_extract(text, rf"\n{name}: {before}(-?[0-9]+){after}\r\n", 1)
    return F.when(found != "", found).cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: the parsed header, the facts of the stored payload
    (hashed again here) and the bytes, ``record``, as a WARC file has them.
    Columns that the caller does not select are not read or moved."""
    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    good = F.sha2("payload", 256) == F.col("sha256")
    stored = stored.select("sha256", "payload",
                           F.when(good, F.octet_length("payload").cast("long"))
                           .otherwise(F.raise_error(F.lit("stored payload does not match its digest")).cast("long"))
                           .alias("payload_bytes"),
                           F.sha1("payload").alias("payload_sha1"))
    text = F.decode("header", "UTF-8")
    kind = _field(text, "WARC-Type")
    heads = spark.read.parquet(f"{path}/headers").select(
        "sha256", "header", _page(text, "WARC-Record-ID").alias("page_id"), kind.alias("record_type"),
        F.coalesce("odd_url", _field(text, "WARC-Target-URI")).alias("url"),
        F.regexp_extract(text, r"\nWARC-Payload-Digest: sha1:([0-9a-f]*)\r\n", 1).alias("payload_digest"),
        _page(text, "WARC-Refers-To").alias("refers_to"))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    joined = heads.join(stored, "sha256")
    digest = F.when(F.col("payload_digest") == F.col("payload_sha1"), F.col("payload_digest")) \
        .otherwise(F.raise_error(F.lit("header digest does not match the payload")))
    return joined.select("page_id", "url", "record_type", "refers_to", "payload_bytes",
                         digest.alias("payload_digest"), "payload",
                         F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))
