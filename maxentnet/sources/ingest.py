"""From vertex and edge tables to numbered vertices, groups, labels and consolidated edges."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maxentnet.plans import scratch

#: Up to so many keys are numbered in one window; more are numbered in ranges.
WINDOW_KEYS = 1_000_000


def num_bytes(num_items: int) -> int:
    """Bytes of the smallest unsigned whole number (1, 2, 4 or 8 bytes) that numbers the items."""
    return max(2 ** math.ceil(math.log2(math.log2(num_items + 1) / 8)), 1) if num_items > 1 else 1


def as_frame(spark: SparkSession | None, table) -> DataFrame:
    if isinstance(table, DataFrame):
        return table
    if hasattr(table, "iloc"):
        session = spark or SparkSession.active()
        return session.createDataFrame(table)
    raise AssertionError("Only dataframe input supported.")


def columns(spec: str | list[str]) -> list[str]:
    return [spec] if isinstance(spec, str) else list(spec)


def key(spec: str | list[str]) -> Column:
    """A struct of the key's columns, named by place so that keys of both tables compare."""
    return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns(spec))))


def numbered(keys: DataFrame, column: str, number: str, rows: int | None = None) -> DataFrame:
    """Distinct keys with 0, 1, ... in their order. Beyond WINDOW_KEYS keys (``rows``, counted if not given) each range of a sorted table is numbered from where the one before ends."""
    distinct = keys.select(column).distinct()
    if (distinct.count() if rows is None else rows) <= WINDOW_KEYS:
        return distinct.withColumn(number, (F.row_number().over(W.orderBy(column)) - 1).cast("long"))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(parts, column).sortWithinPartitions(column)
    ranged = scratch.written(ranged.withColumn("_id", F.monotonically_increasing_id()), "keys")
    ranged = ranged.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_at")).alias(number))  # a row for each range


@dataclass
class Tables:
    """vertices (vid, node_key[, group_id, group_key]), adj ([label_id,] src, dst, w), groups, labels, and their numbers."""

    vertices: DataFrame
    adj: DataFrame
    groups: DataFrame | None
    labels: DataFrame | None
    num_vertices: int
    num_groups: int | None
    num_labels: int | None
    weighted: bool


def ingest(v, e, v_id, src, dst, weight=None, v_group=None, edge_label=None, spark: SparkSession | None = None) -> Tables:
    """Checks and numbers the tables. Parallel edges (of one label) are summed, or are one if there is no weight."""
    v, e = as_frame(spark, v), as_frame(spark, e)
    if isinstance(src, str) != isinstance(dst, str):
        if not (isinstance(src, list) and len(src) == 1) and not (isinstance(dst, list) and len(dst) == 1):
            raise ValueError("src and dst can be either both lists or str.")
    if len(columns(src)) != len(columns(dst)):
        raise ValueError("src and dst can be either both lists or str.")
    keyed = v.select(key(v_id).alias("node_key"), *([key(v_group).alias("group_key")] if v_group else []))
    found = keyed.groupBy("node_key").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count("*").alias("all")).first()
    if found["most"] > 1:
        raise Exception("There is at least one repeated id in the vertex dataframe.")
    num_vertices = found["all"]
    vertices = numbered(keyed, "node_key", "vid", num_vertices)
    groups = labels = num_groups = num_labels = None
    if v_group:
        groups = numbered(keyed, "group_key", "group_id", num_vertices if num_vertices <= WINDOW_KEYS else None).transform(scratch.kept)
        num_groups = groups.count()
        vertices = vertices.join(keyed, "node_key").join(groups, "group_key").select("vid", "node_key", "group_id", "group_key")
    vertices = vertices.transform(scratch.kept)
    # the edge table is read once: parallel edges are one before they meet the vertices, and what is wrong with them travels along
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    by = ["src_key", "dst_key", *(["label_key"] if edge_label else [])]
    light = F.max((~F.coalesce(F.col("w") > 0, F.lit(False)) | F.isnan("w")).cast("int")).alias("light")
    edges = e.select(key(src).alias("src_key"), key(dst).alias("dst_key"), w.alias("w"), *([key(edge_label).alias("label_key")] if edge_label else []))
    edges = edges.groupBy(*by).agg((F.sum("w") if weight else F.lit(1.0)).alias("w"), light)
    ids = vertices.select("node_key", "vid")
    edges = edges.join(ids.toDF("src_key", "src"), "src_key", "left").join(ids.toDF("dst_key", "dst"), "dst_key", "left")
    edges = edges.select("src", "dst", "w", "light", *by[2:]).transform(scratch.kept)
    bad = edges.agg(F.max((F.col("src").isNull() | F.col("dst").isNull()).cast("int")).alias("lost"), F.max("light").alias("light")).first()
    if bad["lost"]:
        raise AssertionError("Some vertices in e are not in v.")
    if bad["light"]:
        raise AssertionError("Zero or negative edge weights are not supported.")
    if edge_label:
        labels = numbered(edges, "label_key", "label_id").transform(scratch.kept)
        num_labels = labels.count()
        adj = edges.join(labels, "label_key").select("label_id", "src", "dst", "w").transform(scratch.kept)
        scratch.forget(edges)
    else:
        adj = edges.select("src", "dst", "w")
    ends = adj.select(F.col("src").alias("vid")).union(adj.select("dst"))
    alone = vertices.join(ends, "vid", "left_anti")
    names = [r["node_key"] for r in alone.select("node_key").orderBy("node_key").limit(11).collect()]
    if names:
        shown = [str(n[0]) if len(n) == 1 else str(tuple(n)) for n in names]
        if len(shown) == 1:
            warnings.warn(f"{shown[0]} vertex has no edges.", UserWarning, stacklevel=3)
        else:
            warnings.warn(f"[{', '.join(shown[:10])}{', ...' if len(shown) > 10 else ''}] vertices have no edges.", UserWarning, stacklevel=3)
    return Tables(vertices, adj, groups, labels, num_vertices, num_groups, num_labels, weight is not None)
