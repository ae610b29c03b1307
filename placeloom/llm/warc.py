"""WARC archives in which equal payloads are stored once.

Headers (id, digest, length) are shuffled by payload digest and joined to the
original of their digest; the archives then hold each original as a response
and each copy as a revisit that refers to it, all with fresh headers. Spark's
own writer makes the files, so a lost executor leaves no half of an archive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import cut, scratch, shared_dir, table

#: Payloads of fewer bytes are always stored.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def resolved(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to) of each row; refers_to: null for originals.

    Of the rows of one payload the one of the largest id is the original. Null payloads are empty
    ones. Rows with a null id are originals, as nothing can refer to them. Rows that repeat an id go each by
    its own payload; those of the original's id and payload are all originals. An empty table gives no rows.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    heads = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    heads = cut(heads, "warc-heads")
    large = heads.where(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = heads.join(cut(first, "warc-originals"), ["payload_digest", "payload_bytes"], "left")
    return named.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("page_id") != F.col("original"), F.col("original")).alias("refers_to"))


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    return F.concat(*(x for name, value in pairs for x in (F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))))


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(record): one whole WARC record of each row, but for the two line ends after it.

    A null id is written as an empty one and a null url as an empty one.
    """
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    key = ["page_id", "payload_bytes", "payload_digest"]
    copies = cut(resolved(df, id_col, payload_col, least).where("refers_to is not null").select(*key, "refers_to").distinct(), "warc-copies")
    pages = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    rows = pages.join(copies, key, "left").withColumn("url", F.regexp_replace("url", "[\\r\\n]+", " "))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", _record_id(own)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Page-ID", own),
        ),
        F.when(revisit, _lines(("WARC-Refers-To", _record_id(F.col("refers_to"))), ("WARC-Profile", PROFILE))).otherwise(F.lit("")),
        _lines(("Content-Type", "application/http; msgtype=response"), ("Content-Length", F.octet_length("block").cast("string"))),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("record"))


def write_archives(rows: DataFrame, path: str, per_file: int = 5000, compression: str = "none") -> None:
    """Records as WARC files below path, each record with its two line ends; gzip: each file as a whole."""
    rows.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an archive. A cut off record ends it with ValueError."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            raise ValueError("a WARC record is cut off")
        yield fields, bytes(view[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, record_id, refers_to_id, digest, payload_bytes, payload_sha1) of each record of the archives.

    payload_bytes and payload_sha1 are those of the payload in the archive: null for revisits.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        names = ["page_id", "record_type", "record_id", "refers_to_id", "digest", "payload_bytes", "payload_sha1"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in it:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = zlib.decompress(data, 31)
                out = []
                for fields, block in parse(data):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    own = fields["warc-type"] == "response"
                    page = fields.get("warc-page-id") or None
                    out.append((page and int(page), fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-payload-digest"].partition(":")[2], len(payload) if own else None, hashlib.sha1(payload).hexdigest() if own else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, record_id string, refers_to_id string, digest string, payload_bytes long, payload_sha1 string")


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives written.

    A revisit takes length and digest from the response that it refers to. path: where the archives
    go and stay; else a scratch folder in the shared one. An empty table writes no records.
    """
    spark = df.sparkSession
    shared_dir(spark)
    path = path or scratch(spark, "warc")
    write_archives(records(df, id_col, url_col, payload_col, least), path)
    rows = cut(read_archives(spark, path), "warc-read")
    own = rows.where("record_type = 'response'").select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    originals = rows.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), "payload_sha1", F.col("payload_sha1").alias("digest")).dropDuplicates(["refers_to_id", "digest"])
    again = rows.where("record_type = 'revisit'").drop("payload_sha1", "payload_bytes").join(originals.join(rows.where("record_type = 'revisit'").select("refers_to_id").distinct(), "refers_to_id", "left_semi"), ["refers_to_id", "digest"], "left")
    return own.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""
