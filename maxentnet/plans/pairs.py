"""Plans over ordered pairs of nodes.

Nodes with equal fitness are interchangeable, so that sums over pairs are sums over pairs of distinct fitnesses times their numbers,
less the pairs of a node with itself. Catalyst doesn't do this by itself, and it turns N * N rows into those of the distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maxentnet.plans import scratch

#: A side is broadcast if it is counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000


def cross(left: DataFrame, right: DataFrame, rows: int, condition: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``, which has ``rows`` rows.

    A right side of a checked size is broadcast. A larger one, or one for which a number of blocks is asked, is dealt to blocks, and a
    copy of the left side meets each block in a shuffled join, so that no task holds more than a block.
    """
    if rows <= BROADCAST_ROWS and not blocks:
        left = spread(left)
        return left.join(F.broadcast(right), condition) if condition is not None else left.crossJoin(F.broadcast(right))
    blocks = max(blocks or 0, -(-rows // BROADCAST_ROWS) * 4 if rows > BROADCAST_ROWS else 1)
    first = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    second = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    on = F.col("_block") == F.col("_part")
    return first.join(second.hint("shuffle_hash"), on if condition is None else on & condition).drop("_block", "_part")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The streamed side of a nested loop, over all cores: few rows would otherwise lie in one partition. Rows with equal ``by`` stay together."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *by)


class Compressed:
    """Out and in fitnesses of nodes with their numbers, those of 0 left out; with labels, in each label.

    ``nodes`` has x and y (and label_id).
    """

    def __init__(self, nodes: DataFrame, labelled: bool = False, blocks: int | None = None):
        self.blocks = blocks
        key = ["label_id"] if labelled else []
        self.labelled = labelled
        self.nodes = nodes
        self.outs = nodes.filter("x > 0").groupBy(*key, "x").agg(F.count("*").alias("n")).transform(scratch.kept)
        self.ins = nodes.filter("y > 0").groupBy(*([F.col("label_id").alias("label_in")] if labelled else []), "y").agg(F.count("*").alias("m")).transform(scratch.kept)
        self.selves = nodes.filter("x > 0 AND y > 0").groupBy(*key, "x", "y").agg(F.count("*").alias("n")).transform(scratch.kept)
        self.rows = self.ins.count()

    def pairs(self, counts: bool = False) -> DataFrame:
        """(label_id,) x, y and w, the number of ordered pairs, of which a node with itself counts too; or n and m, the numbers of nodes."""
        if self.labelled:
            # labels may be few: the side that streams is dealt by its rows, the other one's copies meet it
            salts = self.nodes.sparkSession.sparkContext.defaultParallelism
            outs = self.outs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int"))
            ins = self.ins.withColumn("salt_in", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            both = outs.join(ins, (F.col("label_id") == F.col("label_in")) & (F.col("salt") == F.col("salt_in"))).drop("label_in", "salt", "salt_in")
        else:
            both = cross(self.outs, self.ins, self.rows, blocks=self.blocks)
        return both if counts else both.withColumn("w", (F.col("n") * F.col("m")).cast("double")).drop("n", "m")

    def sums(self, selfloops: bool, **terms: Callable[[Column, Column], Column]) -> DataFrame:
        """Sums over pairs i, j (and i = j if selfloops) of functions of x_i and y_j; a row, or one for each label."""
        key = ["label_id"] if self.labelled else []
        pairs = self.pairs()
        if not selfloops:
            pairs = pairs.unionByName(self.selves.withColumn("w", -F.col("n").cast("double")).drop("n"))
        made = pairs.select(*key, "w", *(f(F.col("x"), F.col("y")).alias(k) for k, f in terms.items()))
        return made.groupBy(*key).agg(*(F.coalesce(F.sum(F.col("w") * F.col(k)), F.lit(0.0)).alias(k) for k in terms))
