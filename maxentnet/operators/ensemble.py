"""What all models of directed graphs share: arguments, expected measures, likelihoods, confusion counts and samples over profiles of nodes."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maxentnet.functions.uniform import uniform
from maxentnet.operators.graph import DIRECTIONS, DiGraph, Graph, MultiDiGraph, adjacency_of
from maxentnet.plans import scratch

INF = float("inf")


@dataclass
class Confusion:
    """Counts by threshold, as a frame (threshold, tp, fp, tn, fn) and as arrays in the thresholds' order."""

    frame: DataFrame
    thresholds: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = {r["at"]: r for r in self.frame.collect()}  # a row for each threshold
        return tuple(np.array([rows[i][c] for i in range(len(self.thresholds))], np.int64) for c in ("tp", "fp", "tn", "fn"))


def take(kwargs: dict, allowed: Sequence[str]) -> dict:
    for name in kwargs:
        if name not in allowed:
            raise ValueError("Illegal argument passed: " + name)
    return kwargs


def whole(value, what: str) -> int:
    """A positive whole number, or the message of what it should be."""
    if value is None:
        raise ValueError(f"{what} not set.")
    try:
        if value / int(value) != 1:
            raise ValueError
    except ZeroDivisionError:
        raise ValueError(f"{what} must be a positive number.") from None
    except Exception:
        raise ValueError(f"{what} must be an integer.") from None
    if value <= 0:
        raise ValueError(f"{what} must be a positive number.")
    return int(value)


def number(value, what: str) -> float:
    """A number of 0 or more; an array of one counts as its value."""
    if hasattr(value, "__len__") and not isinstance(value, str):
        if len(value) != 1:
            raise ValueError(f"{what} must be a number.")
        value = value[0]
    try:
        value = float(value * 1.0)
    except TypeError:
        raise ValueError(f"{what} must be a number.") from None
    if value < 0:
        raise ValueError(f"{what} must be a positive number.")
    return value


def numeric(values, message: str) -> np.ndarray:
    array = np.atleast_1d(np.asarray(values))
    if not np.issubdtype(array.dtype, np.number):
        raise ValueError(message)
    return array.astype(np.float64)


def _reached(p: Column, held: list[float], low: int, high: int) -> Column:
    """How many of the sorted thresholds p reaches, between low and high of them: comparisons, as expressions of arrays would be interpreted for each pair."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(p < held[middle], _reached(p, held, low, middle)).otherwise(_reached(p, held, middle + 1, high))


class Ensemble:
    """A distribution of directed graphs over num_vertices vertices in which every link is independent.

    A subclass tells the chances of links between profiles, sets of nodes that are alike: ``_profiles`` has (pid, n), ``_members`` (vid,
    pid), and ``_pair_probs(weights)`` rows (a, b, p, q, w) with the chances of a link from a to b and back, and b's weight.
    """

    spark: SparkSession
    num_vertices: int
    selfloops: bool = False
    param: np.ndarray | None = None

    def _start(self, args: tuple, kwargs: dict) -> tuple[list, dict]:
        """Takes the session out of the arguments."""
        args = list(args)
        if args and isinstance(args[0], SparkSession):
            self.spark = args.pop(0)
        elif args and isinstance(args[0], Graph):
            self.spark = args[0].spark
        else:
            self.spark = SparkSession.active()
        blocks = kwargs.pop("p_blocks", None)
        if blocks is not None:
            try:
                if blocks / int(blocks) != 1:
                    raise ValueError
            except Exception:
                raise ValueError("Number of parallel blocks must be an integer.") from None
            if blocks <= 0:
                raise ValueError("Number of parallel blocks must be a positive number.")
        self.p_blocks = None if blocks is None else int(blocks)
        self._kept: dict = {}
        self.vertices = None
        return args, kwargs

    @staticmethod
    def _ignored(args: list, most: int = 1) -> None:
        if len(args) > most:
            warnings.warn("Unnamed arguments other than the Graph have been ignored.", UserWarning, stacklevel=3)

    def _all_vertices(self) -> DataFrame:
        return self.vertices.select("vid") if self.vertices is not None else self.spark.range(self.num_vertices).toDF("vid")

    def _fitted(self, message: str = "Ensemble has to be fitted before.") -> None:
        if self.param is None:
            raise Exception(message)

    def _keep(self, name: str, build, recompute: bool):
        if recompute or name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def _forget(self) -> None:
        self._kept = {}

    # to be told by subclasses

    def _profiles(self) -> DataFrame:
        raise NotImplementedError

    def _members(self) -> DataFrame:
        raise NotImplementedError

    def _pair_probs(self, weights: DataFrame) -> DataFrame:
        raise NotImplementedError

    # expected measures

    def _node_sums(self, weights: DataFrame) -> DataFrame:
        """For each profile sums over all others' weights (pid, w), itself included, of chances out, in and either way, and its own chance."""
        t = self._pair_probs(weights).withColumn("u", F.col("p") + F.col("q") - F.col("p") * F.col("q"))
        own = F.col("a") == F.col("b")
        return t.groupBy("a").agg(*(F.sum(F.col("w") * F.col(c)).alias(n) for n, c in (("out", "p"), ("in", "q"), ("und", "u"))), F.coalesce(F.max(F.when(own, F.col("p"))), F.lit(0.0)).alias("self"))

    def _degrees(self, selfloops: bool) -> DataFrame:
        """(vid, out, in, und): expected degrees of every vertex."""
        own = F.col("self")
        und = F.col("und") - (2 * own - own * own) + (own if selfloops else 0)
        sums = self._node_sums(self._profiles().select("pid", F.col("n").cast("double").alias("w")))
        sums = sums.select(F.col("a").alias("pid"), *((F.col(c) - (0 if selfloops else own)).alias(c) for c in ("out", "in")), und.alias("und"))
        found = self._members().join(sums, "pid").drop("pid")
        zero = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("out", "in", "und")]
        return self._all_vertices().join(found, "vid", "left").select("vid", *zero)

    def _degree(self, which: str, name: str, recompute: bool) -> DataFrame:
        self._fitted()
        return self._degree_table(self.selfloops, recompute).select("vid", F.col(which).alias(name))

    def _degree_table(self, selfloops: bool, recompute: bool = False) -> DataFrame:
        return self._keep("degrees" if selfloops == self.selfloops else "degrees with the other self-loops", lambda: self._degrees(selfloops).transform(scratch.kept), recompute)

    def expected_num_edges(self, recompute: bool = False) -> float:
        self._fitted()
        return self._keep("num_edges", self._num_edges, recompute)

    def expected_degree(self, recompute: bool = False) -> DataFrame:
        """(vid, degree): expected number of vertices linked in either direction."""
        return self._degree("und", "degree", recompute)

    def expected_out_degree(self, recompute: bool = False) -> DataFrame:
        return self._degree("out", "out_degree", recompute)

    def expected_in_degree(self, recompute: bool = False) -> DataFrame:
        return self._degree("in", "in_degree", recompute)

    def expected_av_nn_property(self, prop, ndir: str = "out", selfloops: bool | None = False, deg_recompute: bool = False) -> DataFrame:
        """(vid, av_nn): expected sum of the neighbours' property over the expected degree, 0 where that is 0. ``selfloops`` None takes the model's flag."""
        self._fitted()
        if ndir not in DIRECTIONS:
            raise ValueError("Neighbourhood direction not recognised.")
        selfloops = self.selfloops if selfloops is None else selfloops
        which = {"out": "out", "in": "in", "out-in": "und"}[ndir]
        values = self._property(prop)
        members = self._members()
        weights = members.join(values, "vid").groupBy("pid").agg(F.sum("prop").alias("w"))
        sums = self._node_sums(weights).select(F.col("a").alias("pid"), F.col(which).alias("sum"), "self")
        own = F.col("self") if which != "und" else (F.lit(0.0) + F.col("self") if selfloops else 2 * F.col("self") - F.col("self") * F.col("self"))
        change = 0 if selfloops and which != "und" else (-(2 * F.col("self") - F.col("self") * F.col("self")) + F.col("self")) * F.col("prop") if selfloops else -own * F.col("prop")
        top = members.join(values, "vid").join(sums, "pid").select("vid", (F.col("sum") + change).alias("sum"))
        degree = self._degree_table(selfloops, deg_recompute)
        out = degree.join(top, "vid", "left").select("vid", F.when(F.col(which) > 0, F.coalesce(F.col("sum"), F.lit(0.0)) / F.col(which)).otherwise(0.0).alias("av_nn"))
        return out

    def expected_av_nn_degree(self, *, ddir: str = "out", ndir: str = "out", selfloops: bool | None = False, deg_recompute: bool = False, recompute: bool = False) -> DataFrame:
        """The neighbours' expected degree in direction ``ddir`` (self-loops as in the neighbourhood)."""
        if ddir not in DIRECTIONS:
            raise ValueError("Degree type not recognised.")
        which = {"out": "out", "in": "in", "out-in": "und"}[ddir]
        flag = self.selfloops if selfloops is None else selfloops
        self._fitted()
        return self._keep(f"av_{ndir}_nn_d_{ddir} {flag}", lambda: self.expected_av_nn_property(self._degree_table(flag, deg_recompute).select("vid", which), ndir, flag), recompute)

    def _property(self, prop) -> DataFrame:
        if isinstance(prop, DataFrame):
            name = next(c for c in prop.columns if c != "vid")
            return prop.select("vid", F.col(name).cast("double").alias("prop"))
        if len(prop) != self.num_vertices:
            raise ValueError(f"Property must have one value for each of the {self.num_vertices} vertices.")
        return self.spark.createDataFrame([(i, float(x)) for i, x in enumerate(prop)], "vid long, prop double")

    # comparison with a graph

    def _edges_of(self, g, selfloops: bool) -> DataFrame:
        edges, _ = adjacency_of(g, self.num_vertices, self.spark)
        return edges if selfloops else edges.filter("src <> dst")

    def _edge_values(self, edges: DataFrame) -> DataFrame:
        """Edges with p, logp and log1mp."""
        raise NotImplementedError

    def _no_link_sum(self, selfloops: bool) -> tuple[float, float]:
        """Sum of ln(1 - p) over the pairs with p < 1, and the number of pairs with p = 1."""
        raise NotImplementedError

    def log_likelihood(self, g, selfloops: bool | None = None, log_space: bool = True) -> float:
        """ln of the chance of the graph: the sum of ln(1 - p) over all pairs, corrected at its links. Impossible graphs have -inf."""
        self._fitted()
        selfloops = self.selfloops if selfloops is None else selfloops
        total = self._likelihood(self._edge_values(self._edges_of(g, selfloops)), self._no_link_sum(selfloops))
        return total if log_space else math.exp(total)

    @staticmethod
    def _likelihood(values: DataFrame, without: tuple[float, float]) -> float:
        sure = F.col("log1mp") == -INF
        r = values.agg(
            F.coalesce(F.max((F.col("logp") == -INF).cast("int")), F.lit(0)).alias("never"),
            F.coalesce(F.sum(sure.cast("long")), F.lit(0)).alias("sure"),
            F.coalesce(F.sum(F.when(sure | (F.col("logp") == -INF), 0.0).otherwise(F.col("logp") - F.col("log1mp"))), F.lit(0.0)).alias("more"),
        ).first()
        rest, certain = without
        if r["never"] or certain > r["sure"]:
            return -INF
        return rest + r["more"]

    def _p_counts(self, selfloops: bool) -> DataFrame:
        """(p, w): chances of pairs with their numbers; pairs with p = 0 may be left out."""
        raise NotImplementedError

    def confusion_matrix(self, g, thresholds=None, selfloops: bool | None = None) -> Confusion:
        """Links told by p >= threshold against the graph's. Without thresholds: 20 (or the number given) between the least positive and the largest p, evenly in the logarithm."""
        self._fitted()
        selfloops = self.selfloops if selfloops is None else selfloops
        counts = self._p_counts(selfloops)
        if thresholds is None or isinstance(thresholds, (int, np.integer)):
            r = counts.filter("p > 0 AND w > 0").agg(F.min("p").alias("low"), F.max("p").alias("high")).first()
            many = 20 if thresholds is None else int(thresholds)
            thresholds = np.geomspace(r["low"], r["high"], many) if r["low"] is not None else np.zeros(many)
        elif not isinstance(thresholds, (list, tuple, np.ndarray)):
            raise ValueError("Thresholds must be an array or an integer.")
        thresholds = np.asarray(thresholds, np.float64)
        every = self.num_vertices * (self.num_vertices - (0 if selfloops else 1))
        edges = self._edge_values(self._edges_of(g, selfloops)).select("p")
        order = np.argsort(thresholds, kind="stable")
        held = [float(x) for x in thresholds[order]]
        bucket = lambda p: _reached(p, held, 0, len(held))
        found = counts.groupBy(bucket(F.col("p")).alias("b")).agg(F.sum("w").alias("pairs"))
        linked = edges.groupBy(bucket(F.col("p")).alias("b")).agg(F.count("*").cast("double").alias("links"))
        table = found.select("b", "pairs", F.lit(0.0).alias("links")).unionByName(linked.select("b", F.lit(0.0).alias("pairs"), "links"))
        table = table.transform(scratch.kept)  # a row for each bucket: the pairs are counted once
        listed = table.agg(F.sum("pairs")).first()[0] or 0.0
        zero = int((thresholds <= 0).sum())  # pairs that are not listed have p = 0
        table = table.unionByName(self.spark.createDataFrame([(zero, every - listed, 0.0)], "b int, pairs double, links double"))
        table = table.unionByName(self.spark.createDataFrame([(b, 0.0, 0.0) for b in range(len(thresholds) + 1)], "b int, pairs double, links double"))
        table = table.groupBy("b").agg(F.sum("pairs").alias("pairs"), F.sum("links").alias("links"))
        from_top = W.orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, 0)  # a row for each threshold
        table = table.withColumns({"told": F.sum("pairs").over(from_top), "tp": F.sum("links").over(from_top), "all_links": F.sum("links").over(W.partitionBy())})
        places = self.spark.createDataFrame([(int(k) + 1, int(i), float(thresholds[i])) for k, i in enumerate(order)], "b int, at int, threshold double")
        table = table.join(F.broadcast(places), "b")  # a row for each threshold
        as_long = lambda c: F.round(c).cast("long")
        tp, fp, fn = F.col("tp"), F.col("told") - F.col("tp"), F.col("all_links") - F.col("tp")
        return Confusion(table.select("at", "threshold", as_long(tp).alias("tp"), as_long(fp).alias("fp"), as_long(F.lit(float(every)) - F.col("told") - fn).alias("tn"), as_long(fn).alias("fn")), thresholds)

    # samples

    def _drawn(self, selfloops: bool, seed: int, portable: bool) -> DataFrame:
        """(src, dst, p) of the links of a sample."""
        raise NotImplementedError

    def _ends(self, out_strength, in_strength, label: bool = False) -> tuple[DataFrame, DataFrame]:
        keys = ["vid", "label_id"] if label else ["vid"]
        both = []
        for given, name in ((out_strength, "s_out"), (in_strength, "s_in")):
            if isinstance(given, DataFrame):
                value = next(c for c in given.columns if c not in keys)
                both.append(given.select(*keys, F.col(value).cast("double").alias(name)))
            elif label:
                rows = [(int(i), int(k), float(given[i, k])) for i, k in np.argwhere(np.asarray(given) != 0)]
                both.append(self.spark.createDataFrame(rows, f"vid long, label_id long, {name} double"))
            else:
                both.append(self.spark.createDataFrame([(i, float(x)) for i, x in enumerate(given)], f"vid long, {name} double"))
        return both[0], both[1]

    @staticmethod
    def _same_totals(out: DataFrame, in_: DataFrame) -> float:
        a, b = out.agg(F.sum("s_out")).first()[0] or 0.0, in_.agg(F.sum("s_in")).first()[0] or 0.0
        assert abs(a - b) <= 1e-6 * max(abs(a), abs(b), 1.0), "Sum of in/out strengths not the same."
        return a

    def _strengths(self, out_strength, in_strength):
        if out_strength is None:
            out_strength = self._default_strength("out")
        if in_strength is None:
            in_strength = self._default_strength("in")
        return self._ends(out_strength, in_strength)

    def _default_strength(self, which: str):
        raise ValueError(f"{'Out' if which == 'out' else 'In'} strength must be given.")

    def sample(self, ref_g: Graph | None = None, weights: str | None = None, out_strength=None, in_strength=None, selfloops: bool | None = None, seed: int = 0, portable: bool = False) -> DiGraph:
        """A graph drawn from the ensemble, the same for the same seed however it is computed. ``weights`` 'cremb': exponential with means that keep the expected strengths."""
        self._fitted("Ensemble has to be fitted before sampling.")
        selfloops = self.selfloops if selfloops is None else selfloops
        if weights not in (None, "cremb"):
            raise ValueError("Weights method not recognised or implemented.")
        links = self._drawn(selfloops, seed, portable)
        if weights == "cremb":
            out, in_ = self._strengths(out_strength, in_strength)
            total = self._same_totals(out, in_)
            links = links.join(out.withColumnRenamed("vid", "src"), "src").join(in_.withColumnRenamed("vid", "dst"), "dst")
            mean = F.col("s_out") * F.col("s_in") / (F.lit(total) * F.col("p"))
            links = links.select("src", "dst", (-mean * F.log1p(-uniform(seed, "src", "dst", salt="w", portable=portable))).alias("w"))
        return self._wrapped(links.select("src", "dst", F.col("w") if weights else F.lit(1.0).alias("w")), ref_g, bool(weights))

    def _wrapped(self, adj: DataFrame, ref_g: Graph | None, weighted: bool, labels: DataFrame | None = None):
        """The sample as a graph with the reference's (or else numbers as) keys."""
        vertices, groups = (ref_g.vertices, ref_g.groups) if ref_g is not None else (self.vertices, None)
        if vertices is None:
            vertices = self.spark.range(self.num_vertices).select(F.col("id").alias("vid"), F.struct(F.col("id").alias("k0")).alias("node_key"))
        if ref_g is not None and ref_g.labels is not None and labels is not None:
            labels = ref_g.labels
        kind = DiGraph if labels is None else MultiDiGraph
        return kind.from_edges(vertices, adj.transform(scratch.kept), self.num_vertices, groups, labels, getattr(self, "num_labels", None) if labels is not None else None, weighted)
