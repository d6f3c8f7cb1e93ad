"""Rank and depth of nodes by repeated joins along the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.operators.graph import DiGraph
from maxentnet.plans import scratch

def normalised(graph: DiGraph, weighted: bool = True) -> DataFrame:
    """(src, dst, w): each row of the adjacency matrix divided by its sum."""
    adj = graph.adjacency_matrix(True, True)
    adj = adj if weighted else adj.withColumn("w", F.lit(1.0))
    total = adj.groupBy("src").agg(F.sum("w").alias("total"))
    return adj.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))


def propagated(edges: DataFrame, values: DataFrame, to: str = "dst", absorb: float = 0.0) -> DataFrame:
    """(vid, sum): of w * (value + absorb) over each node's edges; ``to`` is the end that receives."""
    other = "src" if to == "dst" else "dst"
    return edges.join(values.toDF(other, "value"), other).groupBy(F.col(to).alias("vid")).agg(F.sum(F.col("w") * (F.col("value") + F.lit(absorb))).alias("sum"))


def _iterate(start: DataFrame, step, max_iter: int, tol: float) -> DataFrame:
    """Applies ``step`` until no value changes by ``tol``. A step is written before the next one reads it twice, so that plans stay short."""
    now = start.transform(scratch.kept)
    for _ in range(max_iter):
        new = step(now)
        new = new.transform(scratch.kept)
        change = new.join(now.withColumnRenamed("value", "before"), "vid").agg(F.max(F.abs(F.col("value") - F.col("before")))).first()[0]
        now = new
        if change is None or change < tol:
            break
    return now


def pagerank(graph: DiGraph, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, weighted: bool = True) -> DataFrame:
    """(vid, rank): r <- alpha (P' r + the rank of nodes without links, spread evenly) + (1 - alpha) / N, from 1 / N on, until no rank changes by ``tol``."""
    n = graph.num_vertices
    edges = normalised(graph, weighted).transform(scratch.kept)
    vertices = graph.vertices.select("vid").transform(scratch.kept)
    ends = edges.select(F.col("src").alias("vid")).distinct()
    hanging = vertices.join(ends, "vid", "left_anti").transform(scratch.kept)

    def step(now: DataFrame) -> DataFrame:
        lost = now.join(hanging, "vid").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
        new = vertices.join(propagated(edges, now), "vid", "left")
        return new.select("vid", (F.lit(alpha) * (F.coalesce("sum", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)).alias("value"))

    out = _iterate(vertices.withColumn("value", F.lit(1.0 / n)), step, max_iter, tol)
    return out.withColumnRenamed("value", "rank")


def trophic_depth(graph: DiGraph, final, max_iter: int = 100, tol: float = 1e-3) -> DataFrame:
    """(vid, depth): d_i <- (final_i + sum_j w_ij (d_j + 1)) / (out strength_i + final_i), from ``final`` on; nodes with neither are not divided."""
    ends = graph._property(final).toDF("vid", "final")
    edges = graph.adjacency_matrix(True, True).transform(scratch.kept)
    total = graph.out_strength()
    fixed = graph.vertices.select("vid").join(ends, "vid", "left").join(total, "vid", "left").fillna(0.0).transform(scratch.kept)

    def step(now: DataFrame) -> DataFrame:
        new = fixed.join(propagated(edges, now, "src", 1.0), "vid", "left")
        top = F.col("final") + F.coalesce("sum", F.lit(0.0))
        below = F.col("out_strength") + F.col("final")
        return new.select("vid", F.when(below > 0, top / below).otherwise(top).alias("value"))

    out = _iterate(fixed.select("vid", F.col("final").alias("value")), step, max_iter, tol)
    return out.withColumnRenamed("value", "depth")
