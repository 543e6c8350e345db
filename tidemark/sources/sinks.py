"""Writers of enrichment reports and of clustered signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich


def write_report(results: DataFrame, path: str, overwrite: bool = True, sheets: tuple[str, ...] = ("list_name",)) -> None:
    """One folder of CSV per sheet, each sorted by q; without overwrite an existing path is an error."""
    sheet = F.concat_ws(" ", *[F.col(c) for c in sheets])
    flat = enrich.report(results).withColumn("sheet", sheet)
    flat.repartition("sheet").sortWithinPartitions("sheet", "q_value", "term").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("sheet").option("header", True).csv(path)


def write_clusters(clustered: DataFrame, signals: DataFrame, path: str) -> None:
    """Signals in reversed leaf order, one folder per group and subgroup; arrays as text."""
    rows = clustered.join(signals, "id")
    flat = rows.select(*[F.to_json(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
    flat.repartition("group", "subgroup").sortWithinPartitions("group", "subgroup", F.desc("leaf_order")).write.mode("overwrite").partitionBy("group", "subgroup").option("header", True).csv(path)
