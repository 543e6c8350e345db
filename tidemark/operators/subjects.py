"""Links between subjects over the identifiers they share, and genes of subject communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .transform import common_distance, correlation

X = F.col


def _pairs(s: DataFrame) -> DataFrame:
    a = s.select(X("subject").alias("a"), "id", X("x").alias("xa"))
    b = s.select(X("subject").alias("b"), "id", X("x").alias("xb"))
    return a.join(b, "id").where("a < b")


def _links(pairs: DataFrame, linked) -> DataFrame:
    return pairs.withColumn("l", F.coalesce(linked, F.lit(False))).groupBy("a", "b").agg(F.count_if("l").alias("linked"), F.count(F.lit(1)).alias("common"), F.array_sort(F.collect_list(F.when(X("l"), X("id")))).alias("ids"))


def _whole(pairs: DataFrame):
    """Whether both signals of a pair have all cells."""
    return ~(F.exists("xa", lambda v: v.isNull()) | F.exists("xb", lambda v: v.isNull()))


def links_by_distance(s: DataFrame, cutoff: float, complete: bool = True) -> DataFrame:
    """(a, b, linked, common, ids) of all subject pairs of s(subject, id, x): common ids closer than the cutoff.

    A signal with a missing cell is linked with none; if not `complete`, the cells that both have are compared.
    """
    pairs = _pairs(s)
    near = common_distance(X("xa"), X("xb")) < cutoff
    return _links(pairs, near & _whole(pairs) if complete else near)


def links_by_correlation(s: DataFrame, cutoff: float, complete: bool = True) -> DataFrame:
    """The same by Pearson's correlation, above the cutoff."""
    pairs = _pairs(s)
    near = correlation(X("xa"), X("xb")) > cutoff
    return _links(pairs, near & _whole(pairs) if complete else near)


def structure(partition: DataFrame) -> DataFrame:
    return partition.groupBy("community").agg(F.array_sort(F.collect_list("subject")).alias("subjects"))


def common_genes(pairs: DataFrame, partition: DataFrame, suffix: str = "") -> DataFrame:
    """(community, gene) of genes(subj_a, subj_b, gene) that every pair inside the community with that suffix has."""
    p = partition.select("subject", "community")
    inside = (
        pairs.where(X("subj_a").endswith(suffix) & X("subj_b").endswith(suffix))
        .join(p.withColumnsRenamed({"subject": "subj_a", "community": "ca"}), "subj_a")
        .join(p.withColumnsRenamed({"subject": "subj_b", "community": "cb"}), "subj_b")
        .where("ca = cb")
        .select(X("ca").alias("community"), F.struct("subj_a", "subj_b").alias("pair"), "gene")
        .distinct()
    )
    every = inside.select("community", "pair").distinct().groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return inside.groupBy("community", "gene").agg(F.count(F.lit(1)).alias("c")).join(every, "community").where("c = n").select("community", "gene")


def top_genes(counts: DataFrame, most: int = 500) -> DataFrame:
    """The genes of the highest counts of each community; ties by name."""
    w = Window.partitionBy("community").orderBy(F.desc("cnt"), "gene")
    return counts.withColumn("rank", F.row_number().over(w)).where(X("rank") <= most)


def frequent_genes(counts: DataFrame, percent: float = 50) -> DataFrame:
    """Genes counted at least the largest count times (1 - percent / 100), rounded half to even."""
    top = F.max("cnt").over(Window.partitionBy("community"))
    return counts.withColumn("_t", top).where(X("cnt") >= F.bround(X("_t") * (1 - percent / 100))).drop("_t")


def split_names(c):
    """What stands before the first plus sign."""
    return F.split_part(c, F.lit("+"), F.lit(1))
