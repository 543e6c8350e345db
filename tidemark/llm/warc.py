"""WARC archives through Spark's text source and sink, read back by boundary-chain verification.

Writing: a record is one string, and the sink's line separator is the blank line that ends a record. Spark's commit
protocol makes the files whole whatever executors are lost, in any store.

Reading: the text source cuts every file at the magic "WARC/1.0" + CRLF; each piece is a candidate record. Pieces keep
their order, so their lengths give the byte offset of each candidate, and its header gives the offset of its successor.
Per file, pointer jumping over these pairs of offsets, from the file's start, finds the candidates that the chain
reaches; magic inside a payload is not reached. A record whose payload holds magic is put together again from the
pieces up to its successor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

MAGIC = "WARC/1.0\r\n"
#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 1000
#: Bounds what the reader holds of one file: some 50 bytes a candidate.
RECORDS_PER_FILE = 10_000
#: A table of repeated payloads of at most so many rows (about 10 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
DATE = "2000-01-01T00:00:00Z"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def records(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The column `value` of one record for each row of pages(page_id, url, html)."""
    body = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    body = body.withColumn("size", F.octet_length("body")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    groups = body.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("origin"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    groups = scratch.keep(groups, "repeats")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    rows = body.join(groups, ["digest", "size"], "left")
    again = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), _text(c), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("origin"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, F.when(again, "").otherwise(F.col("body"))).alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip", least_bytes: int = LEAST_BYTES) -> None:
    """Write pages(page_id, url, html) as WARC files under path.

    A null html is an empty payload, a null url an empty target, a null page_id is written as `null`. Of equal payloads
    of at least least_bytes, the record of the largest page_id is a response and the others revisit it; rows that
    repeat that page_id are responses too. An empty table leaves a folder without records.
    """
    spark = pages.sparkSession
    out = records(pages.select("page_id", "url", "html"), Scratch(spark, "warc"), least_bytes)
    out.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): what stands between occurrences of the magic, in order of (block, at) within a file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _offsets(pieces: DataFrame) -> DataFrame:
    """pieces with begin, the byte at which the magic before each stands in its file: another scan may cut files elsewhere and count otherwise."""
    sizes = F.octet_length("value").cast("long")
    before = F.sum(sizes + len(MAGIC)).over(Window.partitionBy("file").orderBy("block", "at"))
    return pieces.withColumn("begin", before - sizes - 2 * len(MAGIC))


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def _begins(sizes: np.ndarray) -> np.ndarray:
    """The byte at which the magic before each piece stands; the first piece has none."""
    return np.cumsum(sizes + len(MAGIC)) - sizes - 2 * len(MAGIC)


def chain(sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reached, pieces of each, whether it ends with its pieces) for the pieces of one file.

    sizes: bytes of each piece after its magic; lengths: bytes that a record claims after its magic, -1 if its header
    can't be read. The first piece stands before the first magic.
    """
    magic, n = len(MAGIC), len(sizes)
    begin = _begins(sizes)
    end_of_file = begin[-1] + magic + sizes[-1]
    successor = np.where(lengths >= 0, begin + magic + lengths, -1)
    at = np.searchsorted(begin, successor)
    known = (lengths >= 0) & (at < n)
    known[known] = begin[at[known]] == successor[known]
    whole = known | (successor == end_of_file)
    jump = np.where(known, at, np.arange(n))
    reached = (begin == 0) & (np.arange(n) > 0)
    if n > 1 and sizes[0] != 0:
        reached[:] = False
    for _ in range(int(n).bit_length()):
        reached[jump[reached]] = True
        jump = jump[jump]
    following = np.where(known, at, n)
    return reached & (lengths >= 0), following - np.arange(n), whole


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["block", "at"], kind="stable")
    reached, pieces, whole = chain(pdf["size"].to_numpy(np.int64), pdf["claims"].to_numpy(np.int64))
    at, keep = pdf["at"].to_numpy(), np.flatnonzero(reached)
    single = pieces[keep] == 1
    first = np.repeat(keep, pieces[keep])
    offset = np.arange(len(first)) - np.repeat(np.cumsum(pieces[keep]) - pieces[keep], pieces[keep])
    begin = _begins(pdf["size"].to_numpy(np.int64))
    return pd.DataFrame({"file": pdf["file"].iloc[0], "at": at[first + offset], "begin": begin[first + offset], "record": at[first], "single": np.repeat(single, pieces[keep]), "complete": whole[first]})


def read(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """The records that the chains of the files under path reach.

    file, record_id, record_type, target_uri, refers_to, digest (as the header has it), full_length (X-Payload-Length),
    block_bytes and block_digest (of the block as read), complete (false for a record cut off by the end of its file).
    A file that doesn't start with a record gives none.
    A file's offsets (some dozen bytes a piece) are chained in one task, and records whose payload holds the magic are put
    together from the pieces of their file there; `write` bounds a file to RECORDS_PER_FILE records, foreign ones bound it by
    their own size.
    """
    scratch = scratch or Scratch(spark, "warc")
    pieces = _pieces(spark, path)
    head = pieces.withColumn("head", F.substring_index("value", "\r\n\r\n", 1)).withColumn("raw", F.col("value").cast("binary"))
    head = head.withColumn("h", F.octet_length("head") + 4).withColumn("size", F.octet_length("value"))
    claimed = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d{1,15})[ \t]*\r?$", 1)
    head = head.withColumn("claims", F.when((F.col("h") <= F.col("size")) & (claimed != ""), F.col("h") + claimed.try_cast("long") + 4).otherwise(F.lit(-1).cast("long")))
    body = F.substring("raw", F.col("h") + 1, (F.col("size") - F.col("h") - 4).cast("int"))
    fits = F.col("claims") == F.col("size")
    fields = [_field("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("record_type"), _field("WARC-Target-URI").alias("target_uri"), _field("WARC-Refers-To").alias("refers_to"), _field("WARC-Payload-Digest").alias("digest"), _field("X-Payload-Length").alias("full_length")]
    meta = head.select("file", "block", "at", "size", "claims", "h", *fields, F.when(fits, F.col("size") - F.col("h") - 4).alias("block_bytes"), F.when(fits, F.sha1(body)).alias("block_digest"))
    meta = scratch.keep(meta, "candidates")
    spans = meta.select("file", "block", "at", "size", "claims").groupBy("file").applyInPandas(_chains, "file string, at long, begin long, record long, single boolean, complete boolean")
    spans = scratch.keep(spans, "chains")
    names = ["file", "record_id", "record_type", "target_uri", "refers_to", "digest", "full_length", "block_bytes", "block_digest", "complete"]
    plain = meta.join(spans.where("single").select("file", "at", "complete"), ["file", "at"])
    plain = plain.withColumn("complete", F.col("complete") & F.col("block_bytes").isNotNull()).select(*names)
    parts = spans.where("not single").select("file", "begin", "record", "complete")
    if not parts.take(1):
        return plain
    # the second scan of the files with such records goes by bytes, whatever its splits
    again = _offsets(pieces.join(parts.select("file").distinct(), "file", "left_semi"))
    joined = again.join(parts, ["file", "begin"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("begin", "value"))).alias("p"), F.first("complete").alias("complete"))
    text = joined.select("file", F.col("record").alias("at"), "complete", F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).cast("binary").alias("raw"))
    mended = text.join(meta.drop("block_bytes", "block_digest"), ["file", "at"])
    size = F.least(F.octet_length("raw").cast("long") - F.col("h"), F.col("claims") - F.col("h") - 4)
    mended = mended.withColumn("block_bytes", size.cast("int")).withColumn("block_digest", F.sha1(F.substring("raw", F.col("h") + 1, F.col("block_bytes"))))
    return plain.unionByName(mended.select(*names))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives, read them back, and report each page as the archives have it."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = path or scratch.path("archive")
    write(pages, path)
    found = read(spark, path, scratch)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(.*)>$", 1), F.lit("null")).cast(pages.schema["page_id"].dataType)
    first = F.col("record_type") == "response"
    return found.where("complete").select(
        page("record_id").alias("page_id"),
        F.when(first, F.col("block_bytes").cast("long")).otherwise(F.col("full_length").cast("long")).alias("payload_bytes"),
        F.when(first, F.col("block_digest")).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.when(~first, page("refers_to")).alias("refers_to"),
    )


ORACLE = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(encode(coalesce(html, ''))) as d from pages),
g as (select d, max(page_id) as origin from p where n >= {LEAST_BYTES} group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when origin is not null and origin <> page_id then 'revisit' else 'response' end as record_type,
       case when origin is not null and origin <> page_id then origin end as refers_to
from p left join g using (d)
"""
