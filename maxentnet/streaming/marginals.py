"""Edges as a stream: consolidated and summed in event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(edges: DataFrame, time: str, src: str, dst: str, weight: str, window: str, delay: str, slide: str | None = None) -> DataFrame:
    """(start, end, src, dst, w): parallel edges of a window are summed; rows later than ``delay`` are dropped once their window is closed."""
    when = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return edges.withWatermark(time, delay).groupBy(when.alias("t"), F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum(weight).alias("w")).select("t.start", "t.end", "src", "dst", "w")


def windowed_strength(edges: DataFrame, time: str, node: str, weight: str, window: str, delay: str) -> DataFrame:
    """(start, end, vid, strength, links) of one end of the edges in each window."""
    return edges.withWatermark(time, delay).groupBy(F.window(F.col(time), window).alias("t"), F.col(node).alias("vid")).agg(F.sum(weight).alias("strength"), F.count("*").alias("links")).select("t.start", "t.end", "vid", "strength", "links")
