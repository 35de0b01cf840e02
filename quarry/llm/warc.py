"""WARC archives of pages, in which repeated payloads are revisits of one response.

Records are rows of text that Spark's own writer puts into gzip files on any store, parted by the blank lines that end a
record. Each record names the archive's warcinfo record first, by an id made when the archive is written. No payload can
hold that id, so a reader that parts files at ``WARC/1.1`` with it finds the borders of all records, whatever pages hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import attach, materialize, or_empty, shared_dir, table

VERSION, GAP = "WARC/1.1", "\r\n\r\n"
#: What says that a record's payload is that of another one (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are stored every time, and records of one file.
LEAST_BYTES, FILE_RECORDS = 1000, 5000
#: Groups of copies up to which they are broadcast, some 20 MB; beyond, rows are shuffled by digest.
FEW_GROUPS = 100_000


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends inside a value are escaped."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\r\n")), F.lit(""))


def _urn(value: Column) -> Column:
    """The 32 hexadecimal digits of value as a record id."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(value, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(archive: str, rows: DataFrame) -> DataFrame:
    """(value): records of rows (id, page_id, url, digest, bytes, html, original); those with an original are revisits."""
    revisit = F.col("original").isNotNull()
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(GAP), F.when(revisit, "").otherwise(F.col("html")))
    fields = [
        _field("WARC-Warcinfo-ID", F.lit(archive)), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _field("WARC-Record-ID", F.col("id")), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), _field("WARC-Page-ID", F.col("page_id").cast("string")),
        _field("WARC-Profile", F.when(revisit, PROFILE)), _field("WARC-Refers-To", F.col("original")), _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", F.octet_length(block).cast("string")),
    ]
    return rows.select(F.concat(F.lit(f"{VERSION}\r\n"), *fields, F.lit("\r\n"), block).alias("value"))


def copies(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, rows, page_id, url, times): payloads of at least ``least`` bytes that several rows of pages hold.

    page_id and url are those of the row that stays, the largest page_id (null is the smallest), then the largest url;
    ``times`` rows are like it. Only digests and headers shuffle, summed up in every task first.
    """
    html = or_empty(F.col("html"))
    heads = pages.filter(F.octet_length(html) >= least).groupBy(F.sha1(html).alias("digest"), "page_id", "url").agg(F.count("*").alias("times"))
    top = F.max(F.struct("page_id", "url", "times"))
    return heads.groupBy("digest").agg(F.sum("times").alias("rows"), top.alias("top")).filter("rows > 1").select("digest", "rows", "top.*")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> str:
    """Write one record for each row of pages (page_id, url, html) into folder; the id of its warcinfo record.

    Of rows with equal payloads (html in UTF-8, null is empty) of at least ``least`` bytes one is a response, see
    copies(), and the others are revisits that refer to it; of rows that are alike in all three columns one counts as
    the first. All shorter payloads are responses. Null page_ids and urls have no header line. Payloads move only where
    more than FEW_GROUPS groups of copies meet them, and then those of large groups stay. Without rows, the archive
    holds its warcinfo record only. Other columns are not stored.
    """
    archive, spark = f"<urn:uuid:{uuid.uuid4()}>", pages.sparkSession
    pages = pages.select("page_id", "url", or_empty(F.col("html")).alias("html")).withColumns({"bytes": F.octet_length("html"), "digest": F.sha1("html")})
    groups = materialize(copies(pages, least).withColumn("first_id", _urn(F.md5(F.concat(F.lit(archive), "digest")))))
    kept = groups.select("digest", "rows", F.col("page_id").alias("top_id"), F.col("url").alias("top_url"), "times", "first_id")
    long, few = F.col("bytes") >= least, groups.count() <= FEW_GROUPS
    if few:
        met = pages.withColumn("key", F.when(long, F.col("digest"))).join(F.broadcast(kept.withColumnRenamed("digest", "key")), "key", "left")
    else:
        met = attach(pages.filter(long), kept, ["digest"], "rows", pages.count())
        alone = pages.filter(long).join(kept, "digest", "left_anti").unionByName(pages.filter(~long))
        met = met.unionByName(alone, allowMissingColumns=True)
    first = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    names = ["page_id", "url", "digest", "bytes", "html"]

    def named(df: DataFrame, id_: Column, original: Column) -> DataFrame:
        """With ids of their own for all rows that id_ leaves null; each call draws from another seed."""
        return df.select(F.coalesce(id_, _urn(F.replace(F.uuid(), F.lit("-")))).alias("id"), *names, original.alias("original"))

    none, known = F.lit(None).cast("string"), F.col("rows").isNotNull()
    plain = met.filter(~known | ~first | (F.col("times") == 1))
    rows = named(plain, F.when(known & first, F.col("first_id")), F.when(known & ~first, F.col("first_id")))
    again = kept.filter("times > 1")
    if not again.isEmpty():
        # Rows that are alike in all columns: one of them stays, and the header of the others is written so many times.
        alike = met.filter(known & first & (F.col("times") > 1)).dropDuplicates(["digest"])
        more = alike.withColumn("html", F.lit("")).withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("times"))))
        rows = rows.unionByName(named(alike, F.col("first_id"), none)).unionByName(named(more, none, F.col("first_id")))
    info = "software: quarry\r\nformat: WARC File Format 1.1\r\n"
    head = [f"{VERSION}\r\nWARC-Warcinfo-ID: {archive}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {archive}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}{GAP}{info}"]
    out = {"lineSep": GAP, "compression": "gzip", "maxRecordsPerFile": FILE_RECORDS}
    _record(archive, rows).write.options(**out).text(folder)
    spark.createDataFrame([head], "value string").coalesce(1).write.mode("append").options(**out).text(folder)
    return archive


def read_archives(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """(id, type, page_id, url, original, stated_digest, stated_bytes, payload): the records of an archive.

    archive is the id of its warcinfo record; without it, the archive's first record is asked. Revisits have no payload,
    but the length that their response stated. A record that is shorter than it states raises an error.
    """
    if archive is None:
        first = spark.read.option("lineSep", "\r\n").text(folder).filter(F.col("value").startswith("WARC-Warcinfo-ID: ")).first()
        archive = first[0].removeprefix("WARC-Warcinfo-ID: ")
    lead = f"{VERSION}\r\nWARC-Warcinfo-ID: {archive}\r\n"
    # Each row is a record without its first two lines, and with the gap behind it; a file's first row is empty. A
    # separator that no beginning of itself ends with is found wherever a reader's buffer ends.
    text = spark.read.option("lineSep", lead).text(folder)
    parted = text.filter("value <> ''").select(F.substring_index("value", GAP, 1).alias("head"), F.col("value").cast("binary").alias("whole"))

    def of(name: str, source: str = "head") -> Column:
        return F.nullif(F.regexp_extract(source, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))

    length = of("Content-Length").cast("long")
    parted = parted.withColumn("length", length).withColumn("block", F.expr(f"substr(whole, octet_length(head) + {len(GAP) + 1})"))
    parted = parted.withColumn("block", F.when(F.octet_length("block") < F.col("length"), F.raise_error(F.concat(F.lit("cut off record: "), "head")).cast("binary")).otherwise(F.expr("substr(block, 1, int(length))")))
    # The answer's own header, which is short, and what follows it.
    answer = F.substring_index(F.expr("decode(substr(block, 1, 1000), 'ISO-8859-1')"), GAP, 1)
    parted = parted.filter(of("WARC-Type") != "warcinfo").withColumn("answer", answer)
    return parted.select(
        of("WARC-Record-ID").alias("id"), of("WARC-Type").alias("type"), of("WARC-Page-ID").cast("long").alias("page_id"), of("WARC-Target-URI").alias("url"), of("WARC-Refers-To").alias("original"),
        F.regexp_replace(of("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"), of("Content-Length", "answer").cast("long").alias("stated_bytes"),
        F.when(of("WARC-Type") == "response", F.expr(f"substr(block, length(answer) + {len(GAP) + 1})")).alias("payload"),
    )


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, type, payload_bytes, payload_digest, refers_to), one row per record, without payloads.

    Bytes and digest are taken from the payload itself, for revisits from that of the record they refer to, whose page_id
    is refers_to; a revisit of no known record keeps nulls. A response may have any number of revisits.
    """
    measured = records.select("id", "type", "page_id", "original", "stated_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    heads = materialize(measured)
    responses, revisits = heads.filter("type = 'response'"), heads.filter("type = 'revisit'")
    meant = revisits.filter("original is not null").groupBy("original").agg(F.count("*").alias("times"))
    found = meant.join(responses.select(F.col("id").alias("original"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"), "original")
    found = materialize(found)
    bare = revisits.select("page_id", "type", "original", "stated_digest")
    known = attach(bare, found, ["original"], "times", heads.count()).filter(F.col("payload_digest") == F.col("stated_digest"))
    lost = bare.filter("original is null").unionByName(bare.join(found, (bare["original"] == found["original"]) & (bare["stated_digest"] == found["payload_digest"]), "left_anti").filter("original is not null"))
    names = ["page_id", "type", "payload_bytes", "payload_digest", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(known.select(*names)).unionByName(lost.select("page_id", "type"), allowMissingColumns=True)


def op11_warc(spark, sf_dir):
    """All pages written, read back and resolved."""
    folder = f"{shared_dir(spark)}/quarry/warc-{uuid.uuid4().hex}"
    archive = write_archives(table(spark, sf_dir, "pages"), folder)
    return resolve(read_archives(spark, folder, archive)).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), t AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_BYTES} AND page_id <> top THEN top END AS refers_to FROM t"""
