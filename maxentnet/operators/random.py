"""The model in which every link has the same chance: all measures in closed form, no pair is ever made but in samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.functions.uniform import uniform
from maxentnet.operators.ensemble import INF, Ensemble, number, numeric, take, whole
from maxentnet.operators.graph import Graph
from maxentnet.plans.draw import drawn


class RandomDiGraph(Ensemble):
    """param is [p, q]: the chance of a link, and the parameter of weights (geometric with success 1 - q on 1, 2, ..., or exponential with rate q)."""

    def __init__(self, *args, **kwargs):
        args, kwargs = self._start(args, dict(kwargs))
        given: dict = {}
        if args:
            g = args[0]
            if not isinstance(g, Graph):
                raise ValueError("First argument passed must be a Graph.")
            given = {"num_vertices": g.num_vertices, "num_edges": g.num_edges(), "total_weight": g.total_weight()}
            self.vertices = g.vertices
            self._ignored(args)
        given |= take(kwargs, ("num_vertices", "num_edges", "param", "selfloops", "total_weight", "discrete_weights"))
        self.num_vertices = whole(given.get("num_vertices"), "Number of vertices")
        self.selfloops = given.get("selfloops", False)
        self.num_edges = number(given["num_edges"], "Number of edges") if "num_edges" in given else None
        self.total_weight = number(given["total_weight"], "Total weight") if "total_weight" in given else None
        self.discrete_weights = given.get("discrete_weights", False)
        if given.get("param") is not None:
            param = numeric(given["param"], "Parameters must be numeric.")
            if np.ndim(given["param"]) == 0:
                param = np.array([param[0], 0.0])
            if len(param) != 2:
                raise ValueError("The model requires two parameters.")
            if (param < 0).any():
                raise ValueError("Parameters must be positive.")
            self.param = param
        if self.num_edges is None and self.param is None:
            raise ValueError("Either num_edges or param must be set.")

    @property
    def _pairs(self) -> float:
        return self.num_vertices * (self.num_vertices - (0 if self.selfloops else 1))

    def fit(self) -> None:
        """p = L / pairs; q = 1 - L / W (whole weights), L / W (others), or 0 without a total weight."""
        if self.num_edges is None:
            raise ValueError("Number of edges must be set for density solver.")
        q = 0.0
        if self.total_weight:
            q = 1 - self.num_edges / self.total_weight if self.discrete_weights else self.num_edges / self.total_weight
        self.param = np.array([self.num_edges / self._pairs, q])
        self._forget()

    def expected_num_edges(self, recompute: bool = False) -> float:
        self._fitted()
        return float(self.param[0] * self._pairs)

    def expected_total_weight(self, recompute: bool = False) -> float:
        self._fitted()
        q = self.param[1]
        return self.expected_num_edges() / (1 - q if self.discrete_weights else q)

    def _degrees(self, selfloops: bool) -> DataFrame:
        p, n = float(self.param[0]), self.num_vertices
        one = p * (n if selfloops else n - 1)
        und = (2 * p - p * p) * (n - 1) + (p if selfloops else 0)
        return self._all_vertices().select("vid", F.lit(one).alias("out"), F.lit(one).alias("in"), F.lit(und).alias("und"))

    def expected_av_nn_property(self, prop, ndir: str = "out", selfloops: bool | None = False, deg_recompute: bool = False) -> DataFrame:
        self._fitted()
        if ndir not in ("out", "in", "out-in"):
            raise ValueError("Neighbourhood direction not recognised.")
        selfloops = self.selfloops if selfloops is None else selfloops
        p = float(self.param[0])
        chance = 2 * p - p * p if ndir == "out-in" else p
        values = self._property(prop)
        total = values.agg(F.sum("prop")).first()[0] or 0.0
        which = {"out": "out", "in": "in", "out-in": "und"}[ndir]
        own = F.col("prop") * (p if selfloops else 0.0)
        top = (F.lit(total) - F.col("prop")) * chance + own
        return self._degrees(selfloops).join(values, "vid", "left").select("vid", F.when(F.col(which) > 0, top / F.col(which)).otherwise(0.0).alias("av_nn"))

    def log_likelihood(self, g, selfloops: bool | None = None, log_space: bool = True) -> float:
        """From the number of links alone; -inf where p = 0 has a link, p = 1 lacks one, or a self-loop is where none can be."""
        self._fitted()
        selfloops = self.selfloops if selfloops is None else selfloops
        edges = self._edges_of(g, True)
        links = edges.count()
        if not selfloops and not edges.filter("src = dst").isEmpty():
            return -INF
        p, every = float(self.param[0]), self.num_vertices * (self.num_vertices - (0 if selfloops else 1))
        if (p == 0 and links) or (p == 1 and links < every):
            return -INF
        total = (links * math.log(p) if links else 0.0) + ((every - links) * math.log1p(-p) if links < every else 0.0)
        return total if log_space else math.exp(total)

    def _edge_values(self, edges: DataFrame) -> DataFrame:
        p = float(self.param[0])
        return edges.select("src", "dst", F.lit(p).alias("p"))

    def _p_counts(self, selfloops: bool) -> DataFrame:
        return self.spark.createDataFrame([(float(self.param[0]), float(self.num_vertices * (self.num_vertices - (0 if selfloops else 1))))], "p double, w double")

    def _drawn(self, selfloops: bool, seed: int, portable: bool) -> DataFrame:
        p = F.lit(float(self.param[0]))
        return drawn(self._all_vertices().toDF("src"), self._all_vertices().select(F.col("vid").alias("dst"), F.lit(1.0).alias("y")), lambda y: p + 0 * y, seed, portable, selfloops)

    def sample(self, ref_g: Graph | None = None, weights: str | None = None, out_strength=None, in_strength=None, selfloops: bool | None = None, seed: int = 0, portable: bool = False):
        """As for other models; ``weights`` 'random' draws from the model's own weights."""
        if weights != "random":
            return super().sample(ref_g, weights, out_strength, in_strength, selfloops, seed, portable)
        self._fitted("Ensemble has to be fitted before sampling.")
        links = self._drawn(self.selfloops if selfloops is None else selfloops, seed, portable)
        u, q = uniform(seed, "src", "dst", salt="w", portable=portable), float(self.param[1])
        if self.discrete_weights:
            w = F.greatest(F.lit(1.0), F.ceil(F.log1p(-u) / F.lit(math.log(q)))) if 0 < q < 1 else F.lit(1.0)
        else:
            w = -F.log1p(-u) / F.lit(q)
        return self._wrapped(links.select("src", "dst", w.cast("double").alias("w")), ref_g, True)
