"""One layer: a link's chance is a function of z times the out fitness of its source, the in fitness of its target and a dyadic factor."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maxentnet.functions.kernels import Exponential, Kernel, Logistic
from maxentnet.functions.uniform import uniform
from maxentnet.operators.ensemble import INF, Ensemble, number, numeric, take, whole
from maxentnet.operators.graph import DiGraph
from maxentnet.operators.solver import Newton, solve
from maxentnet.plans import scratch
from maxentnet.plans.draw import drawn
from maxentnet.plans.pairs import Compressed, cross


def start_of(x0, most: int = 1, many: str = "The model requires one parameter.") -> np.ndarray:
    x0 = numeric(0.0 if x0 is None else x0, "x0 must be numeric.")
    if len(x0) not in (1, most):
        raise ValueError(many)
    if (x0 < 0).any():
        raise ValueError("x0 must be positive.")
    return x0


class FitnessModel(Ensemble):
    """p = t / (1 + t) with t = z x_i y_j; x and y are out and in strengths of a graph, or given (arrays in order of vid, or frames with vid)."""

    kernel: Kernel = Logistic()

    def __init__(self, *args, **kwargs):
        args, kwargs = self._start(args, dict(kwargs))
        self._read(args, kwargs)

    def _read(self, args: list, kwargs: dict, more: tuple[str, ...] = ()) -> dict:
        given: dict = {}
        if args:
            g = args[0]
            if not isinstance(g, DiGraph):
                raise ValueError("First argument passed must be a DiGraph.")
            given = {"num_vertices": g.num_vertices, "num_edges": g.num_edges(), "prop_out": g.out_strength(), "prop_in": g.in_strength()}
            self.vertices = g.vertices
            self._ignored(args, 2 if more else 1)
        given |= take(kwargs, ("num_vertices", "num_edges", "prop_out", "prop_in", "param", "selfloops", *more))
        self.num_vertices = whole(given.get("num_vertices"), "Number of vertices")
        self.selfloops = given.get("selfloops", False)
        for name in ("prop_out", "prop_in"):
            if given.get(name) is None:
                raise ValueError(f"{name} not set.")
        self.prop_out, self.prop_in = given["prop_out"], given["prop_in"]
        self.nodes = self._nodes()
        self.num_edges = number(given["num_edges"], "Number of edges") if given.get("num_edges") is not None else None
        if given.get("param") is not None:
            param = numeric(given["param"], "Parameters must be numeric.")
            if len(param) != 1:
                raise ValueError("The model requires one parameter.")
            if (param < 0).any():
                raise ValueError("Parameters must be positive.")
            self.param = param
        if self.num_edges is None and self.param is None:
            raise ValueError("Either num_edges or param must be set.")
        return given

    def _nodes(self) -> DataFrame:
        """(vid, x, y) of every vertex."""
        both = []
        for prop, side, name in ((self.prop_out, "out", "x"), (self.prop_in, "in", "y")):
            message = f"Node {side} properties must be a numpy array of length {self.num_vertices}"
            if isinstance(prop, DataFrame):
                value = next(c for c in prop.columns if c != "vid")
                frame = prop.select("vid", F.col(value).cast("double").alias(name))
                if not frame.filter(F.col(name) < 0).isEmpty():
                    raise AssertionError(f"Node {side} properties must contain positive values only.")
            else:
                assert isinstance(prop, np.ndarray), message
                assert prop.shape == (self.num_vertices,), message
                assert (prop >= 0).all(), f"Node {side} properties must contain positive values only."
                frame = self.spark.createDataFrame([(i, float(v)) for i, v in enumerate(prop)], f"vid long, {name} double")
            both.append(frame)
        every = self._all_vertices().join(both[0], "vid", "left").join(both[1], "vid", "left")
        return every.select("vid", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "xy")).transform(scratch.kept)

    def prop_dyad(self, i: Column, j: Column) -> Column | None:
        """Factor of the pair of vids i and j; None is 1 for all, and lets nodes with equal fitness be one."""
        return None

    @property
    def _dyadic(self) -> bool:
        return self.prop_dyad(F.lit(0), F.lit(0)) is not None

    def _dyad(self, i: str, j: str):
        return self.prop_dyad(F.col(i), F.col(j)) if self._dyadic else 1.0

    # sums over pairs

    def _compressed(self) -> Compressed:
        return self._keep("compressed", lambda: Compressed(self.nodes, blocks=self.p_blocks), False)

    def _forget(self) -> None:
        self._kept = {k: v for k, v in self._kept.items() if k in ("compressed", "profiles")}

    def _full_pairs(self, selfloops: bool) -> DataFrame:
        """(src, dst, x, y) of nodes with a fitness each."""
        a = self.nodes.filter("x > 0").select(F.col("vid").alias("src"), "x")
        b = self.nodes.filter("y > 0").select(F.col("vid").alias("dst"), "y")
        return cross(a, b, self.num_vertices, None if selfloops else F.col("src") != F.col("dst"), self.p_blocks)

    def _sums(self, selfloops: bool, **terms) -> dict:
        """Sums of functions of (x, y, dyad) over all pairs with fitness."""
        if self._dyadic:
            full = self._full_pairs(selfloops).withColumn("c", self._dyad("src", "dst"))
            frame = full.agg(*(F.coalesce(F.sum(f(F.col("x"), F.col("y"), F.col("c"))), F.lit(0.0)).alias(k) for k, f in terms.items()))
        else:
            frame = self._compressed().sums(selfloops, **{k: (lambda x, y, f=f: f(x, y, 1.0)) for k, f in terms.items()})
        return frame.first().asDict()

    def fit(self, x0=None, method: str = "density", atol: float = 1e-24, rtol: float = 1e-9, maxiter: int = 100, verbose: bool = False) -> None:
        """z such that the expected number of edges is num_edges; a job of two sums for each step."""
        start = start_of(x0)
        if method == "mle":
            raise ValueError("Method not implemented.")
        if method != "density":
            raise ValueError("The selected method is not valid.")
        if self.num_edges is None:
            raise ValueError("Number of edges must be set for density solver.")
        newton = Newton(float(start[0]), self.num_edges, atol, rtol, maxiter, 0.0, INF)
        self.solver_output = solve(lambda z, _: [self._density(z[0])], [newton], verbose)[0]
        self.param = np.array([self.solver_output.x])
        self._forget()
        if not self.solver_output.converged:
            warnings.warn("Fit did not converge", UserWarning, stacklevel=2)

    def _density(self, z: float) -> tuple[float, float]:
        r = self._sums(self.selfloops, p=lambda x, y, c: self.kernel.p(z, x, y, c), d=lambda x, y, c: self.kernel.jac(z, x, y, c))
        return r["p"], r["d"]

    @property
    def _z(self) -> float:
        return float(self.param[0])

    def _num_edges(self) -> float:
        return self._sums(self.selfloops, p=lambda x, y, c: self.kernel.p(self._z, x, y, c))["p"]

    # profiles: nodes with equal fitness, or single nodes if there is a dyadic factor

    def _profile_tables(self) -> tuple[DataFrame, DataFrame, int]:
        def build():
            if self._dyadic:
                profiles = self.nodes.select(F.col("vid").alias("pid"), "x", "y", F.lit(1).cast("long").alias("n"))
                return profiles, self.nodes.select("vid", F.col("vid").alias("pid")), self.num_vertices
            keyed = self.nodes.select("vid", F.struct("x", "y").alias("pid"))
            profiles = keyed.groupBy("pid").agg(F.count("*").alias("n")).select("pid", "pid.x", "pid.y", "n").transform(scratch.kept)
            return profiles, keyed, profiles.count()

        return self._keep("profiles", build, False)

    def _profiles(self) -> DataFrame:
        return self._profile_tables()[0]

    def _members(self) -> DataFrame:
        return self._profile_tables()[1]

    def _pair_probs(self, weights: DataFrame) -> DataFrame:
        profiles, _, rows = self._profile_tables()
        a = profiles.select(F.col("pid").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
        b = profiles.join(weights, "pid", "left").select(F.col("pid").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.coalesce("w", F.lit(0.0)).alias("w"))
        both = cross(a, b, rows, blocks=self.p_blocks)
        return both.select("a", "b", self.kernel.p(self._z, F.col("xa"), F.col("yb"), self._dyad("a", "b")).alias("p"), self.kernel.p(self._z, F.col("xb"), F.col("ya"), self._dyad("b", "a")).alias("q"), "w")

    # comparison and samples

    def _edge_values(self, edges: DataFrame) -> DataFrame:
        t = edges.join(self.nodes.select(F.col("vid").alias("src"), "x"), "src").join(self.nodes.select(F.col("vid").alias("dst"), "y"), "dst")
        args = (self._z, F.col("x"), F.col("y"), self._dyad("src", "dst"))
        return t.select("src", "dst", self.kernel.p(*args).alias("p"), self.kernel.logp(*args).alias("logp"), self.kernel.log1mp(*args).alias("log1mp"))

    def _no_link_sum(self, selfloops: bool) -> tuple[float, float]:
        log1mp = lambda x, y, c: self.kernel.log1mp(self._z, x, y, c)
        r = self._sums(selfloops, rest=lambda x, y, c: F.when(log1mp(x, y, c) > -INF, log1mp(x, y, c)).otherwise(0.0), certain=lambda x, y, c: (log1mp(x, y, c) == -INF).cast("double"))
        return r["rest"], r["certain"]

    def _p_counts(self, selfloops: bool) -> DataFrame:
        if self._dyadic:
            full = self._full_pairs(selfloops)
            return full.select(self.kernel.p(self._z, F.col("x"), F.col("y"), self._dyad("src", "dst")).alias("p"), F.lit(1.0).alias("w"))
        c = self._compressed()
        t = c.pairs()
        if not selfloops:
            t = t.unionByName(c.selves.withColumn("w", -F.col("n").cast("double")).drop("n"))
        return t.select(self.kernel.p(self._z, F.col("x"), F.col("y")).alias("p"), "w")

    def _drawn(self, selfloops: bool, seed: int, portable: bool) -> DataFrame:
        if self._dyadic:  # a factor of one's own need not grow with the fitness: each pair is asked
            t = self._full_pairs(selfloops).withColumn("p", self.kernel.p(self._z, F.col("x"), F.col("y"), self._dyad("src", "dst")))
            return t.filter(uniform(seed, "src", "dst", portable=portable) < F.col("p")).select("src", "dst", "p")
        a = self.nodes.filter("x > 0").select(F.col("vid").alias("src"), "x")
        b = self.nodes.filter("y > 0").select(F.col("vid").alias("dst"), "y")
        return drawn(a, b, lambda y: self.kernel.p(self._z, F.col("x"), y), seed, portable, selfloops)

    def _default_strength(self, which: str):
        return self.nodes.select("vid", F.col("x" if which == "out" else "y").alias("s"))


class ScaleInvariantModel(FitnessModel):
    """p = 1 - exp(-z x_i y_j): groups of nodes are linked by the same law as nodes."""

    kernel: Kernel = Exponential()
