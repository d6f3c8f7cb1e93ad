"""Connected components of a distributed list of links, and of a small one in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work


class Forest:
    """Union-find over whole numbers that are met one by one; the root of a set is its least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while root != parent[root]:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Links (a, b) of long ids to rows (id, component): for each id in a link the least id that it is connected with.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its least neighbour, then every node
    hands its smaller neighbours to the least of these. The list of links never grows, each step is a sum by key and a join, and the
    rounds grow with the logarithm of the longest path. A node with very many links (at most MOST_HOT are so) gets its least
    neighbour by broadcast, so its links are in no one task. Links of a node with itself or null ids are left out; an empty list gives
    none. The result's table can be given to ``forget``.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = _work.written(now, "links")
    before = _mark(now)
    for _ in range(most_rounds):
        # larger neighbours to the least one
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        new = _with_least(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()
        # smaller neighbours to the least of them
        new = _with_least(new.select(F.col("a").alias("u"), F.col("b").alias("v")), before[0])
        new = new.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.*").filter("a > b").distinct()
        new = _work.written(new, "links")
        _work.forget(now)
        now, mark = new, _mark(new)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components did not settle")
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    out.written_at = now.written_at
    return out


def _mark(links: DataFrame) -> tuple[int, int]:
    """Their number, and a sum of hashes by which two lists differ."""
    r = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def _with_least(links: DataFrame, n: int) -> DataFrame:
    """Rows (u, v) with m, the least v of their u."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    if n <= _work.HOT:
        return links.join(least.drop("d"), "u")
    return _work.attached(links, least.drop("d"), "u", least.filter(_work.is_hot(F.col("d"), n)))
