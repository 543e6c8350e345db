"""Order statistics of large groups: exact quantiles and numbering without a group in one task.

There are few groups (time points, lags) and many rows in each, so neither a window nor a sort by group would spread.
Quantiles come from two passes that aggregate before they shuffle: a sketch brackets each order statistic, and only the
values inside the bracket are counted one by one. Numbers come from one sort over all rows, cut in even slices wherever
groups begin, and the slices' sizes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's ranks are off by a share of 1 / ACCURACY at most; brackets are MARGIN times as wide.
ACCURACY, MARGIN = 10_000, 8
#: Rows of a slice that numbered() aims at, and its most slices.
SLICE, MOST_SLICES = 1_000_000, 100_000


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names, so that it is worked out once and survives lost executors.

    Where that is unset, a folder of our own serves in local mode; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(own)
    return df.checkpoint()


def quantiles(rows: DataFrame, by: str, value: str, wanted: dict[str, Column]) -> DataFrame:
    """(by, n, and each wanted): the values that have the wanted ranks (from 0, expressions of n) in their group.

    Null values don't count, and a group without values has no row. Ranks outside 0..n-1 give the first or last value.
    """
    rows = rows.select(F.col(by), F.col(value).alias("_v")).where("_v is not null")
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.approx_percentile("_v", [i / 1000 for i in range(1001)], ACCURACY).alias("_marks"))
    rank = lambda r: F.least(F.greatest(r.cast("long"), F.lit(0)), F.col("n") - 1)
    width = MARGIN / ACCURACY

    def bracket(name: str, r: Column) -> Column:
        share = rank(r) / F.greatest(F.col("n") - 1, F.lit(1))
        low, high = F.floor((share - width) * 1000).cast("int"), F.ceil((share + width) * 1000).cast("int")
        ends = F.when(low <= 0, F.col("_min")).otherwise(F.get("_marks", low)).alias("low"), F.when(high >= 1000, F.col("_max")).otherwise(F.get("_marks", high)).alias("high")
        return F.struct(F.lit(name).alias("name"), rank(r).alias("rank"), *ends)

    brackets = sizes.select(by, "n", F.array(*[bracket(name, r) for name, r in wanted.items()]).alias("_b"))  # a row for each group
    # what lies below a bracket is one row for each task, what lies above none
    near = rows.join(F.broadcast(brackets), by).select(by, "n", F.explode("_b").alias("_b"), "_v").where("_v <= _b.high")
    counts = near.groupBy(by, "n", "_b", F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by, "_b.name").orderBy(F.asc_nulls_first("_v")))
    found = counts.withColumn("_upto", upto).where("_upto > _b.rank").groupBy(by, "n").agg(*[F.min_by(F.struct("_v"), F.when(F.col("_b.name") == name, F.col("_upto"))).alias(name) for name in wanted])
    missed = F.raise_error(F.lit("a sketch missed its rank"))
    return found.select(by, "n", *[F.when(F.col(f"{name}._v").isNull(), missed).otherwise(F.col(f"{name}._v")).alias(name) for name in wanted])


def lower_quantiles(rows: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """(by, name): the order statistic at floor((n - 1) q) of each group."""
    return quantiles(rows, by, value, {name: F.floor((F.col("n") - 1) * F.lit(q))}).select(by, name)


def medians(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """(by, name): the median of each group, the mean of the two middle values."""
    middle = quantiles(rows, by, value, {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.ceil((F.col("n") - 1) / 2)})
    return middle.select(by, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def numbered(rows: DataFrame, by: str | None, order: list[str], name: str, slices: int | None = None) -> DataFrame:
    """rows with `name`, their number from 0 in the order of the columns `order`, within each `by` if given.

    One shuffle by ranges of (by, order): a slice is an even share of all rows, whatever the groups. A row's number is
    its place in the slice plus the rows of its group before that. The slices' sizes are a row for each slice and group
    in it, as many as slices and groups together; they come from the same checkpoint as the rows, as ranges are sampled.
    """
    keys = [*([by] if by else []), *order]
    if slices is None:
        slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SLICES, -(-rows.count() // SLICE)))
    sorted_ = rows.repartitionByRange(slices, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    sorted_ = settled(sorted_).withColumn("_slice", F.shiftright("_m", 33)).withColumn("_place", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    group = F.col(by) if by else F.lit(0)
    sizes = sorted_.groupBy("_slice", group.alias("_by")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_slice")) - F.col("_n")
    shift = sizes.select(F.col("_slice").alias("_s"), "_by", (before - F.col("_first")).alias("_shift"))
    found = sorted_.join(F.broadcast(shift), (sorted_["_slice"] == shift["_s"]) & group.eqNullSafe(shift["_by"]))
    return found.withColumn(name, F.col("_place") + F.col("_shift")).drop("_m", "_slice", "_place", "_s", "_by", "_shift")
