"""Proportional stratified interleaving of rows into shards, with DataFrame functions only.

Rows of each source are put in a seeded random order; row r of n gets the fractional rank (2r - 1) / 2n. Sorting all
rows by fractional rank interleaves the sources in proportion, and equal cuts of that order are the shards: each has
the mixture of the whole, and their row counts differ by one at most (law `rows`).

A source may hold a third of all rows, so no rank is taken over a whole source in one task. The random order is that
of a hex digest, whose leading digits cut every source into slices of equal expected size; a rank is the number of
rows in earlier slices (from a small table of counts) plus the rank in the slice. The global order is cut the same way,
by slices of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
SEED = 17
#: Rows that a slice holds on average; the number of slices follows the input.
SLICE_ROWS = 50_000
#: Most slices of the global order; a table of so many counts is summed in one task.
MOST_SLICES = 1 << 14


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text, source).

    A null text has no bytes (size 8, crc 0); null sources form a stratum of their own. Rows with equal doc_id are
    told apart by source, checksum and size, and identical rows share whatever order they get, so the result is the
    same. An empty table gives no rows. Other columns are ignored. Shard sizes differ by one row at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("v"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("_src"),
        (F.octet_length(text).cast("long") + 8).alias("_size"),
        F.crc32(text).alias("_crc"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key"),
    )
    total = docs.count()
    slices = max(8, min(MOST_SLICES, -(-total // slice_rows)))
    rows = rows.withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 7), 16, 10).cast("long") * slices / (1 << 28)).cast("int"))

    earlier = Window.partitionBy("_src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_src", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_src", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_src")).alias("_in_src"))
    within = Window.partitionBy("_src", "_slice").orderBy("_key", "_id", "_crc", "_size")
    ranked = rows.withColumn("_r", F.row_number().over(within)).join(starts, ["_src", "_slice"])
    ranked = ranked.withColumn("_frac", (2 * (F.col("_before") + F.col("_r")) - 1).cast("double") / (2 * F.col("_in_src")).cast("double"))
    ranked = ranked.withColumn("_cut", F.least(F.floor(F.col("_frac") * slices), F.lit(slices - 1)).cast("int")).drop("_slice", "_before", "_r", "_in_src")

    cuts = ranked.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cuts.select("_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_cut").orderBy("_frac", "_src", "_key", "_id", "_crc", "_size")
    placed = ranked.withColumn("_r", F.row_number().over(order)).join(F.broadcast(offsets), "_cut")
    position = F.col("_before") + F.col("_r") - 1
    placed = placed.withColumn("_pos", position).withColumn("_shard", F.expr(f"cast((_pos * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the rows of docs, with their placement, under path/shard=<n>/ and return the placement.

    Rows are matched by doc_id, which must be unique here; each shard is written by the tasks of its own rows.
    """
    placement = interleave(docs, **options)
    docs.join(placement.select("doc_id", "shard", "slot"), "doc_id").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placement


#: The same placement by two plain global rankings; the checksum is the reflected CRC-32, byte by byte.
ORACLE = f"""
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
bodies as (
  select doc_id, source, coalesce(text, '') as body, row_number() over () as rid from documents),
sums as (
  select rid, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: cast('0x' || h as bigint))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) as crc
  from bodies, crc_table),
rows_ as (
  select b.*, crc, case when source is null then 'n' else 'v' || source end as src,
         octet_length(encode(body)) + 8 as size, md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')) as k
  from bodies b join sums using (rid)),
ranked as (
  select *, cast(2 * row_number() over (partition by src order by k, doc_id, crc, size) - 1 as double)
            / cast(2 * count(*) over (partition by src) as double) as frac from rows_),
placed as (
  select *, row_number() over (order by frac, src, k, doc_id, crc, size) - 1 as pos, count(*) over () as n from ranked)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'rows' as law,
       cast(pos * {SHARDS} // n as integer) as shard,
       cast(pos - ((pos * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} as bigint) as slot,
       cast(null as integer) as grown_shard
from placed
"""
