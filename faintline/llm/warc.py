"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart, joins to rebuild.

``write`` lays an archive down as two Parquet tables below one folder: ``headers`` (the exact bytes of each
record up to its payload: WARC header and HTTP header) and ``payloads`` (SHA-256 digest and bytes, once).
``records`` rebuilds the whole WARC records, byte for byte, by a join in which digests of many records are spread;
``read`` rebuilds them, parses them, and checks every payload against its digest. Everything is DataFrame functions;
nothing passes through the driver.

Defined results: a null payload is empty; of equal payloads of at least ``least`` bytes the record with the
smallest id (null ids last) is the response and the others revisit it; shorter ones are all responses; rows
equal in id and payload are the same kind of record; an empty table gives an empty archive; a null address
leaves its header out; line breaks in an address are percent-encoded, all other characters stay as they are; other
columns are not archived. A payload that differs from its digest fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.llm.common import keep, spread_join

_CRLF = "\r\n"


def _record_id(c: Column) -> Column:
    h = F.md5(F.coalesce(c.cast("string"), F.lit("null")))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * bool(k) + [F.substring(h, a, n)])], F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_CRLF)), F.lit(""))


def plan_records(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, digest, header): one WARC record per row, its payload named by digest."""
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    slim = pages.select(F.col(ident).cast("string").alias("id"), F.col(ident).alias("order"), F.col(url).alias("url"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("n"))
    first = slim.filter(F.col("n") >= least).groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n_rows"))
    of = spread_join(slim, first.filter("n_rows > 1"), "digest")
    revisit = F.col("first").isNotNull() & ~F.col("order").eqNullSafe(F.col("first"))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"), _line("Content-Length", F.col("n")), F.lit(_CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("X-Source-ID", F.col("id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _record_id(F.col("first"))), _line("X-Refers-To-Source-ID", F.col("first")))).otherwise(""),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        _line("Content-Length", F.octet_length(http) + length),
        F.lit(_CRLF),
        http,
    )
    return of.select("digest", F.encode(header, "UTF-8").alias("header"))


def write(pages: DataFrame, path: str, **columns) -> None:
    """Write the archive of ``pages`` to the folder ``path``."""
    payload = columns.get("payload", "html")
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    store = pages.select(F.sha2(raw, 256).alias("digest"), raw.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    plan_records(pages, **columns).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(text: Column, name: str) -> Column:
    """The value of a header line. Lines end with CR LF alone: other line separators are part of a value."""
    return F.regexp_extract(text, f"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record): the original WARC records, each ready to be written one after the other."""
    headers = spark.read.parquet(f"{path}/headers").withColumn("record_type", _field(F.decode("header", "UTF-8"), "WARC-Type"))
    full = headers.filter("record_type = 'response'")
    # only short payloads are shared by responses: these few bytes may be sent to every task; all others are joined once
    stored = spark.read.parquet(f"{path}/payloads")
    used = full.groupBy("digest").agg(F.count("*").alias("n_rows"))
    counted = spread_join(full, used.withColumn("held", F.col("n_rows")), "digest")
    alone = counted.filter("held = 1").join(stored, "digest", "left").select(*full.columns, "payload")
    shared = spread_join(counted.filter("held > 1").drop("held"), stored.join(used.filter("n_rows > 1"), "digest"), "digest")
    both = alone.unionByName(shared)
    lost = F.raise_error(F.concat(F.lit("no payload stored for "), F.col("digest")))
    end = F.lit((_CRLF * 2).encode())
    whole = both.select("record_type", F.concat("header", F.coalesce(F.col("payload"), lost.cast("binary")), end).alias("record"))
    return whole.unionByName(headers.filter("record_type <> 'response'").select("record_type", F.concat("header", end).alias("record")))


def parse(archive: DataFrame) -> DataFrame:
    """The fields of each record and its payload, from its bytes alone."""
    latin = F.decode("record", "ISO-8859-1")  # one character a byte
    at = F.instr(latin, _CRLF * 2)
    cut = archive.withColumn("__head", F.decode(F.substring("record", F.lit(1), at - 1), "UTF-8")).withColumn("__at", at)
    n = _field(F.col("__head"), "Content-Length").cast("int")
    block = cut.withColumn("__block", F.substring("record", F.col("__at") + 4, n))
    payload = F.substring("__block", F.instr(F.decode("__block", "ISO-8859-1"), _CRLF * 2) + 4, F.octet_length("__block"))
    head = F.col("__head")
    odd = F.raise_error(F.concat(F.lit("length of a record differs from its header: "), head)).cast("binary")
    payload = F.when(F.octet_length("record") == F.col("__at") + 3 + n + 4, payload).otherwise(odd)
    return block.select(
        _some(_field(head, "X-Source-ID")).alias("id"),
        _field(head, "WARC-Type").alias("record_type"),
        _some(_field(head, "X-Refers-To-Source-ID")).alias("refers_to"),
        F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        _some(_field(head, "WARC-Target-URI")).alias("url"),
        payload.alias("payload"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, record_type, refers_to, url, digest and size of the payload that its rebuilt bytes give."""
    parsed = parse(records(spark, path))
    bad = F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.col("digest")))
    size = F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long")).otherwise(bad.cast("long"))
    columns = ["id", "record_type", "refers_to", "digest", "url"]
    full = keep(parsed.filter("record_type = 'response'").select(*columns, size.alias("payload_bytes")), "responses")
    # a revisit's payload is that of the response with its digest
    again = parsed.filter("record_type = 'revisit'").select(*columns)
    sizes = full.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes")).join(again.groupBy("digest").agg(F.count("*").alias("n_rows")), "digest")
    both = full.unionByName(spread_join(again, sizes, "digest"))
    return both.select("id", "record_type", "refers_to", F.col("digest").alias("payload_digest"), "payload_bytes", "url")


#: The same rows by SQL, for op2.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
