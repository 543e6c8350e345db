"""The test tables as signals, bridges and subjects, each also as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model

DAYS, QUARTERS = 30, 28
DAY_TIMES, QUARTER_TIMES = [float(t) for t in range(DAYS)], [float(t) for t in range(QUARTERS)]

#: Long signals (id, t, x) with a row for every cell.
EVENTS_SQL = f"""ev as (
  select u.id, d.t, s.x from (select distinct user_id as id from events) u cross join (select unnest(range({DAYS})) as t) d
  left join (select user_id as id, day(ts) - 1 as t, sum(value) as x from events group by all) s on s.id = u.id and s.t = d.t)"""
SUPPLIERS_SQL = f"""sup as (
  select u.id, d.t, s.x from (select distinct l_suppkey as id from lineitem) u cross join (select unnest(range({QUARTERS})) as t) d
  left join (select l_suppkey as id, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 as t, sum(l_quantity) as x from lineitem group by all) s on s.id = u.id and s.t = d.t)"""
#: Cells with zeros and gaps: the quantity of supplier and quarter over the mean, cut at zero, every eleventh cell missing.
SPARSE_SQL = f"""{SUPPLIERS_SQL},
sp as (select id, t, case when (id * 7 + t * 3) % 11 = 0 then null when (id + t) % 5 = 0 or id % 10 = 3 then 0e0 else x % 97 end as x from sup)"""
TYPED_SQL = """typed as (
  select event_type as source, user_id as id, day(ts) - 1 as t, sum(value) as x from events group by all)"""
SUBJECTS_SQL = """subj as (
  select l_returnflag as subject, l_partkey % 50 as id, year(l_shipdate) - 1995 as t, sum(l_quantity) as x from lineitem group by all)"""
BRIDGE_SQL = """bridge as (
  select distinct cast(p_partkey as varchar) as id, term from (
    select p_partkey, p_brand as term from part union all select p_partkey, p_type from part union all select p_partkey, 'size ' || p_size from part))"""
LISTS_SQL = """lists as (
  select distinct c_mktsegment as list_name, cast(l_partkey as varchar) as id
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_quantity = 50)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_signals(spark: SparkSession, sf: str) -> DataFrame:
    """A cell adds its events in the order of event_id, so that it does not depend on how Spark splits and merges the table."""
    e = table(spark, sf, "events")
    events = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))))
    cells = e.groupBy(F.col("user_id").alias("id"), (F.dayofmonth("ts") - 1).alias("t")).agg(events.alias("_e"))
    value = F.when(F.size("_e") > 0, model.total(F.transform("_e", lambda v: v["value"])))
    return model.from_long(cells.select("id", "t", value.alias("x")), DAYS)


def supplier_signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem")
    t = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    cells = e.groupBy(F.col("l_suppkey").alias("id"), t.alias("t")).agg(F.sum("l_quantity").alias("x"))
    return model.from_long(cells, QUARTERS)


def sparse_signals(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda v, t: F.when((F.col("id") * 7 + t * 3) % 11 == 0, None).when(((F.col("id") + t) % 5 == 0) | (F.col("id") % 10 == 3), F.lit(0.0)).otherwise(v % 97)
    return supplier_signals(spark, sf).withColumn("x", F.transform("x", cell))


def typed_signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    cells = e.groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("id"), (F.dayofmonth("ts") - 1).alias("t")).agg(F.sum("value").alias("x"))
    return model.from_long(cells, DAYS, keys=("source", "id"))


def subject_signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem")
    cells = e.groupBy(F.col("l_returnflag").alias("subject"), (F.col("l_partkey") % 50).alias("id"), (F.year("l_shipdate") - 1995).alias("t")).agg(F.sum("l_quantity").alias("x"))
    return model.from_long(cells, 7, keys=("subject", "id"))


def bridge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    terms = F.array("p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.explode(terms).alias("term")).distinct()


def lists(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    rows = li.where("l_quantity = 50").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_mktsegment").alias("list_name"), F.col("l_partkey").cast("string").alias("id"), F.lit(None).cast("string").alias("label")).distinct()
