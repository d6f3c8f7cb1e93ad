"""Independent links drawn in time of their number, not of the pairs'.

Targets whose fitness is alike (equal to a factor of e ** 0.5) are a bin. Of a source and a bin, links that come with the chance of
the bin's largest fitness have geometric gaps between them, so only the places of such candidates are made; a candidate stays with its
own chance as a share of that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maxentnet.functions.uniform import uniform
from maxentnet.plans import scratch
from maxentnet.plans.pairs import spread
from maxentnet.sources.ingest import numbered


def drawn(sources: DataFrame, targets: DataFrame, chance: Callable[[Column], Column], seed: int, portable: bool, selfloops: bool, label: bool = False) -> DataFrame:
    """([label_id,] src, dst, p) of links, from sources ([label_id,] src, with what ``chance`` reads) and targets ([label_id,] dst, y), y > 0.

    ``chance`` tells p from the column of a target's fitness, and grows with it. The rows made are those of sources times bins, of
    which there are 2,900 a label at most as y is a double (as a rule some ten), and of links times about 1.3.
    """
    key = ["label_id"] if label else []
    placed = targets.select(F.struct(*key, F.floor(2 * F.log("y")).alias("b"), "dst", "y").alias("place"))
    placed = numbered(placed, "place", "number").select(*(f"place.{k}" for k in key), "place.b", "place.dst", "place.y", "number").transform(scratch.kept)
    bins = placed.groupBy(*key, "b").agg(F.min("number").alias("start"), F.count("*").alias("m"), F.max("y").alias("most")).transform(scratch.kept)
    beside = spread(sources).join(F.broadcast(bins), key) if label else spread(sources).crossJoin(F.broadcast(bins))
    open_ = beside.withColumn("limit", chance(F.col("most"))).filter("limit > 0").withColumns({"k0": F.lit(0), "at": F.lit(-1).cast("long")})
    names = [*key, "src", "b"]
    gap = F.when(F.col("limit") >= 1, 0.0).otherwise(F.least(F.col("m").cast("double"), F.log1p(-uniform(seed, *(["src", "b", "k"] + key), salt="g", portable=portable)) / F.log1p(-F.col("limit"))))
    gap = F.floor(gap).cast("long")
    mean = F.col("m") * F.col("limit")
    last = F.col("k0") + F.least(F.col("m"), F.ceil(mean + 9 * F.sqrt(mean) + 9)).cast("int")  # more are needed once in 10 ** 15 times
    links = None
    while open_ is not None:
        # a source and bin without any candidate are left by their first gap
        some = open_.withColumn("k", F.col("k0") + 1).filter(F.col("at") + 1 + gap < F.col("m")).withColumn("last", last)
        made = some.withColumn("k", F.explode(F.sequence(F.col("k0") + 1, F.col("last"))))
        made = made.withColumn("at", F.col("at") + F.sum(gap + 1).over(W.partitionBy(*names).orderBy("k"))).filter("at < m").transform(scratch.kept)
        links = made if links is None else links.unionByName(made)
        more = made.filter("k = last AND at < m - 1")
        open_ = None if more.isEmpty() else more.withColumn("k0", F.col("last")).drop("k", "last")
    found = links.drop("b", "m", "most").withColumn("number", F.col("start") + F.col("at")).join(placed.select("number", "dst", "y"), "number")
    found = found if selfloops else found.filter("src <> dst")
    found = found.withColumn("p", chance(F.col("y"))).filter(uniform(seed, *(["src", "dst"] + key), portable=portable) * F.col("limit") < F.col("p"))
    return found.select(*key, "src", "dst", "p")
