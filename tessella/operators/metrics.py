"""How good results are: recall, distance ratio, degrees, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import METRICS
from tessella.operators.scan import ranked


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the k true neighbours that are among the k found."""
    want = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    hit = want.join(found.where(F.col("rank") <= k).select("qid", "vec_id").distinct(), ["qid", "vec_id"], "left_semi")
    n, hits = want.groupBy("qid").agg(F.count("*").alias("n")), hit.groupBy("qid").agg(F.count("*").alias("hits"))
    return n.join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def distance_ratio(found: DataFrame, truth: DataFrame, k: int, least: float = 1e-5) -> DataFrame:
    """(qid, ratio): mean over ranks of sqrt(found / true distance), times k; true distances up to least are passed over."""
    by = Window.partitionBy("qid").orderBy("distance", "vec_id")
    a = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("qid", "rank", F.col("distance").alias("found"))
    b = truth.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("qid", "rank", F.col("distance").alias("true"))
    both = a.join(b, ["qid", "rank"]).where(F.col("true") > least)
    return both.groupBy("qid").agg((F.avg(F.sqrt(F.greatest(F.col("found"), F.lit(0.0)) / F.col("true"))) * k).alias("ratio"))


def column_means(rounds: DataFrame, *columns: str) -> DataFrame:
    """One row of means: rounds of a measurement averaged."""
    return rounds.agg(*[F.avg(c).alias(c) for c in columns])


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vec_col: str = "embedding") -> DataFrame:
    """(qid, rank, vec_id, distance): candidates (qid, vec_id) by exact distance."""
    met = candidates.select("qid", "vec_id").distinct().join(vectors.select("vec_id", vec_col), "vec_id").join(queries.select("qid", "q"), "qid")
    return ranked(met.select("qid", "vec_id", METRICS[metric](F.col(vec_col), F.col("q")).alias("distance")), k)


def bounded(candidates: DataFrame, k: int, low: str | Column = "low", high: str | Column = "high") -> DataFrame:
    """candidates (qid, ..., low, high) whose lower bound is at most the k-th smallest upper bound of their query: no true neighbour goes while the bounds hold."""
    low, high = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    bars = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(high))).where(F.col("_n") <= k).groupBy("qid").agg(F.max(high).alias("_max"), F.count("*").alias("_count"))
    bar = F.when(F.col("_count") >= k, F.col("_max")).otherwise(F.lit(float("inf")))
    return candidates.join(bars, "qid").where(low <= bar).drop("_max", "_count")


def degrees(edges: DataFrame) -> DataFrame:
    """(nodes, edges, mean_degree, repeated): of a graph (src, dst)."""
    each = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    per = each.groupBy("src").agg(F.sum("n").alias("d"), F.sum(F.col("n") - 1).alias("r"))
    return per.agg(F.count("*").alias("nodes"), F.sum("d").alias("edges"), F.avg("d").alias("mean_degree"), F.sum("r").alias("repeated"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) and their reverses, each once, no loops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").dropDuplicates(["src", "dst"])
