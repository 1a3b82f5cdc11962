"""WARC archives without repeated payloads, by revisit records.

Writing takes two passes over the pages. The first makes headers only (page, address, payload digest and length), which are grouped by digest with
map-side combining; a digest that occurs more than once has an original, the copy of the largest page id. The second joins the pages with these groups:
the original becomes a response record with its payload, all other copies become revisit records without payload that refer to it.
Groups of repeated digests are usually few, so the planner may broadcast them at run time; else their large partitions are split.
Records go out through Spark's text writer: a record is a line whose separator is the blank line that ends each WARC record, so
archives are written and committed as any table is. They are compressed with gzip, as archives usually are.

Reading takes each archive as a stream of chunks between blank lines, in one task, and cuts records by their Content-Length alone; a task holds one record at a time. Any
archive can be read that way, also one whose payloads hold blank lines or look like headers. ``resolved`` joins revisit records to the responses
they refer to, by record id, so each page has the length and digest of its whole payload.

Pages are equal to others if SHA-1 and length of their payloads are. Payloads shorter than ``least`` bytes are all responses. A null html is an empty
payload, and empty payloads are payloads like others (``least`` = 0). A null page id counts as smaller than any other; a null url is written as ``urn:page:<id>``.
Of pages with the same id and payload the one with the greatest url is the original; of repeated rows one is, and the others refer to it. Line breaks in urls are
percent-encoded. Texts of any length are written; a record must fit a string (2 GB). Empty tables give an empty archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.common import text_or_empty
from ostinato.session import cut

LINE = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of Spark's number conversion to base 32, and those of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows that one array may stand for.
SPREAD = 4096
RECORD = "archive string, record_id string, record_type string, page_id long, uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def uuid_of(text: Column) -> Column:
    """A record id that the text decides (version 8 of RFC 9562)."""
    h = F.md5(text)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def headers(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns page, uri, payload, digest, bytes."""
    uri = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = pages.select(F.col(page).cast("long").alias("page"), uri.alias("uri"), text_or_empty(html).alias("payload"))
    unnamed = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page").cast("string"), F.lit("")))
    return named.select("page", F.coalesce("uri", unnamed).alias("uri"), "payload",
                        base32_sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))


def originals(heads: DataFrame, least: int) -> DataFrame:
    """Payloads that occur more than once: digest, bytes, page and uri of the original, number of rows equal to it."""
    rows = heads.where(F.col("bytes") >= least).groupBy("digest", "bytes", "page", "uri").agg(F.count(F.lit(1)).alias("same"))
    top = rows.groupBy("digest", "bytes").agg(F.max(F.struct("page", "uri", "same")).alias("o"), F.sum("same").alias("n")).where("n > 1")
    return cut(top.select(F.col("digest").alias("o_digest"), F.col("bytes").alias("o_bytes"), F.col("o.page").alias("o_page"), F.col("o.uri").alias("o_uri"), "o.same"), "originals")


def original_id() -> Column:
    page = F.coalesce(F.col("o_page").cast("string"), F.lit(""))
    return uuid_of(F.concat_ws("\n", F.col("o_digest"), F.col("o_bytes").cast("string"), page, F.col("o_uri")))


def record(kind: str, block: Column, record_id: Column, date: str, refers: Column | None = None) -> Column:
    """The text of one record without the blank line at its end."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit(f"WARC-Date: {date}"),
             F.concat(F.lit("WARC-Target-URI: "), F.col("uri")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Page-ID: "), F.col("page").cast("string")),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    if refers is not None:
        lines += [F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: <"), refers, F.lit(">")), F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("o_uri")),
                  F.lit(f"WARC-Refers-To-Date: {date}")]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(END), block)


def http(payload: Column | None = None) -> Column:
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    return head if payload is None else F.concat(head, payload)


def write(pages: DataFrame, path: str, least: int = 0, date: str | None = None, page: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = 1 << 14) -> None:
    """Write ``pages`` as archives below ``path``; repeated payloads of at least ``least`` bytes become revisit records."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = headers(pages, page, url, html)
    tops = originals(heads.drop("payload"), least)
    met = heads.join(tops, (F.col("digest") == F.col("o_digest")) & (F.col("bytes") == F.col("o_bytes")), "left")
    is_top = F.col("page").eqNullSafe(F.col("o_page")) & (F.col("uri") == F.col("o_uri"))
    own, fresh = original_id(), F.concat(F.lit("urn:uuid:"), F.uuid())
    response = record("response", http(F.col("payload")), F.when(F.col("o_digest").isNotNull(), own).otherwise(fresh), date)
    revisit = record("revisit", http(), fresh, date, own)
    parts = [met.where(~F.coalesce(is_top & (F.col("same") > 1), F.lit(False))).select(F.when(F.col("o_digest").isNull() | is_top, response).otherwise(revisit).alias("value"))]
    repeated = tops.where("same > 1")
    if not repeated.isEmpty():
        # rows that equal an original: one of them, and as many revisits as there are others
        once = met.where(is_top & (F.col("same") > 1)).groupBy("digest", "bytes", "page", "uri", *tops.columns).agg(F.any_value("payload").alias("payload"))
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 2, F.lit(SPREAD).cast("long")))
        others = repeated.withColumn("at", steps).repartition("o_digest", "at").withColumn("i", F.explode(F.sequence("at", F.least(F.col("at") + SPREAD - 1, F.col("same") - 2))))
        others = others.select("*", F.col("o_digest").alias("digest"), F.col("o_bytes").alias("bytes"), F.col("o_page").alias("page"), F.col("o_uri").alias("uri"))
        parts += [once.select(response.alias("value")), others.select(revisit.alias("value"))]
    for k, part in enumerate(parts):
        part.write.mode("append" if k else "errorifexists").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class Records:
    """Cuts a stream of bytes into records, as (header fields, block)."""

    def __init__(self):
        self.held, self.have, self.need, self.fields = [], 0, None, {}

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held.append(data)
        self.have += len(data)
        while self.need is None or self.have >= self.need:
            if self.need is None:
                if len(self.held) > 1:
                    self.held = [b"".join(self.held)]
                at = self.held[0].find(END.encode()) if self.held else -1
                if at < 0:
                    return
                lines = self.held[0][:at].decode("utf-8", "replace").split(LINE)
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.held, self.have = [self.held[0][at + 4:]], self.have - at - 4
                self.need = int(self.fields.get("content-length", 0)) + 4
            else:
                whole = b"".join(self.held)
                yield self.fields, whole[:self.need - 4]
                self.held, self.have, self.need = [whole[self.need:]], self.have - self.need, None


def parsed(fields: dict[str, str], block: bytes, archive: str, with_payload: bool) -> tuple:
    """One row of ``RECORD``; digest and length are those of the payload that the record itself holds."""
    kind, payload = fields.get("warc-type", ""), block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(END.encode())[2]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    page = fields.get("page-id", "")
    return (archive, fields.get("warc-record-id", "").strip("<>"), kind, int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None,
            digest, None if kind == "revisit" else len(payload), payload if with_payload and kind != "revisit" else None)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = spark.createDataFrame([], RECORD).schema
    chunks = spark.read.schema("value string").option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_path").alias("archive"))

    def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, now, records, rows, size = to_arrow_schema(target), None, Records(), [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), shape)], schema=shape)

        for batch in batches:
            for chunk, archive in zip(batch.column("chunk"), batch.column("archive").to_pylist()):
                if archive != now:
                    now, records = archive, Records()
                data = chunk.as_py()
                for piece in (data, END.encode()):
                    for fields, block in records.feed(piece):
                        rows.append(parsed(fields, block, archive, with_payload))
                        size += len(block) if with_payload else 200
                        if size > 1 << 22:
                            yield made()
                            rows, size = [], 0
        if rows:
            yield made()

    return chunks.mapInArrow(cut_records, target)


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record; revisits have the length of their response and refer to its page."""
    kept = cut(records.select("record_id", "record_type", "page_id", "refers_to_id", "payload_digest", "payload_bytes"), "records")
    responses = kept.where("record_type = 'response'")
    plain = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    target = responses.select(F.col("record_id").alias("r_id"), F.col("page_id").alias("r_page"), F.col("payload_bytes").alias("r_bytes"))
    joined = kept.where("record_type = 'revisit'").join(target, F.col("refers_to_id") == F.col("r_id"), "left")
    return plain.unionByName(joined.select("page_id", F.col("r_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("r_page").alias("refers_to")))


#: The same without archives.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC) AS k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC) AS top FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE k WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM n"""
