"""Several layers: every label has links of its own, told by the nodes' fitnesses in it; a projected pair is linked if any layer links it."""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maxentnet.functions.kernels import Exponential, Kernel, Logistic, any_layer, log_any_layer
from maxentnet.functions.uniform import uniform
from maxentnet.operators.ensemble import INF, Ensemble, numeric, take, whole
from maxentnet.operators.fitness import start_of
from maxentnet.operators.graph import Graph, MultiDiGraph, adjacency_of
from maxentnet.operators.solver import Newton, solve
from maxentnet.plans import scratch
from maxentnet.plans.draw import drawn
from maxentnet.plans.pairs import BROADCAST_ROWS, Compressed, cross, spread
from maxentnet.sources.ingest import numbered


#: Up to so many layers a profile's fitnesses are arrays with a place for each, and pairs of profiles are made side by side.
DENSE_LABELS = 16
#: Up to so many pairs of distinct out fitnesses have a row of their own for degrees by label.
MADE_ROWS = 200_000_000


def _by_place(value: str, num_labels: int) -> Column:
    """The values of a profile's layers, each at its label's place."""
    return F.array(*(F.aggregate("key", F.lit(0.0), lambda s, e: s + F.when(e["label_id"] == F.lit(k), e[value]).otherwise(0.0)) for k in range(num_labels)))


class MultiFitnessModel(Ensemble):
    """Layer k links i to j with p = t / (1 + t), t = z_k x_ik y_jk; one z for all layers, or one each (``per_label``)."""

    kernel: Kernel = Logistic()

    def __init__(self, *args, **kwargs):
        args, kwargs = self._start(args, dict(kwargs))
        given: dict = {}
        self.labels = None
        per_label = None
        if args:
            g = args[0]
            if not isinstance(g, MultiDiGraph):
                raise ValueError("First argument passed must be a MultiDiGraph.")
            per = {r["label_id"]: r["num_edges"] for r in g.num_edges_label().collect()}  # a row for each label
            given = {
                "num_vertices": g.num_vertices,
                "num_labels": g.num_labels,
                "num_edges": g.num_edges(),
                "num_edges_label": np.array([per[k] for k in range(g.num_labels)], np.float64),
                "prop_out": g.out_strength_by_label(),
                "prop_in": g.in_strength_by_label(),
            }
            self.vertices, self.labels = g.vertices, g.labels
            self._ignored(args)
        given |= take(kwargs, ("num_vertices", "num_edges", "num_edges_label", "num_labels", "prop_out", "prop_in", "param", "selfloops", "per_label"))
        self.num_vertices = whole(given.get("num_vertices"), "Number of vertices")
        self.num_labels = whole(given.get("num_labels"), "Number of labels")
        self.selfloops = given.get("selfloops", False)
        for name in ("prop_out", "prop_in"):
            if given.get(name) is None:
                raise ValueError(f"{name} not set.")
        self.prop_out, self.prop_in = given["prop_out"], given["prop_in"]
        self.nodes = self._nodes()
        edges, each = given.get("num_edges"), given.get("num_edges_label")
        if isinstance(edges, np.ndarray):
            if len(edges) == self.num_labels and len(edges) > 1:
                if each is not None:
                    raise ValueError("num_edges is an array of size num_labels but num_edges_label is already set.")
                edges, each = None, edges
            elif len(edges) == 1:
                edges = edges[0]
            else:
                raise ValueError(f"num_edges must be an array of size one or num_labels, not {len(edges)}.")
        if each is not None:
            per_label = True
            if len(each) != self.num_labels:
                raise ValueError("The length of the num_edges_label array does not match the number of labels.")
            each = numeric(each, "Number of edges per label must be numeric.")
            if (each < 0).any():
                raise ValueError("Number of edges per label must be positive.")
        elif edges is not None:
            per_label = False
        if edges is not None:
            try:
                edges = float(edges * 1.0)
            except TypeError:
                raise ValueError("Number of edges must be a number.") from None
            if edges < 0:
                raise ValueError("Number of edges must be a positive number.")
        self.num_edges, self.num_edges_label = edges, each
        if given.get("param") is not None:
            param = numeric(given["param"], "Parameters must be numeric.")
            if len(param) == 1:
                per_label = False
                param = np.repeat(param, self.num_labels)
            elif len(param) != self.num_labels:
                raise ValueError("The model requires one or num_labels parameter.")
            else:
                per_label = True
            if (param < 0).any():
                raise ValueError("Parameters must be positive in value.")
            self.param = param
        if edges is None and each is None and self.param is None:
            raise ValueError("Either num_edges(_label) or param must be set.")
        self.per_label = given["per_label"] if "per_label" in kwargs else bool(per_label)

    def _nodes(self) -> DataFrame:
        """(vid, label_id, x, y) where one of them is not 0."""
        both = []
        for prop, side, name in ((self.prop_out, "out", "x"), (self.prop_in, "in", "y")):
            message = f"Node {side} properties must be a two dimensional array with shape (num_vertices, num_labels)."
            if isinstance(prop, DataFrame):
                value = next(c for c in prop.columns if c not in ("vid", "label_id"))
                frame = prop.select("vid", "label_id", F.col(value).cast("double").alias(name))
                if not frame.filter(F.col(name) < 0).isEmpty():
                    raise ValueError(f"Node {side} properties must contain positive values only.")
            else:
                assert isinstance(prop, np.ndarray), message
                assert prop.shape == (self.num_vertices, self.num_labels), message
                if (prop < 0).any():
                    raise ValueError(f"Node {side} properties must contain positive values only.")
                frame = self.spark.createDataFrame([(int(i), int(k), float(prop[i, k])) for i, k in np.argwhere(prop != 0)], f"vid long, label_id long, {name} double")
            both.append(frame)
        every = both[0].join(both[1], ["vid", "label_id"], "full")
        return every.select("vid", F.col("label_id").cast("long").alias("label_id"), *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "xy")).filter("x > 0 OR y > 0").transform(scratch.kept)

    # parameters

    def _z_of(self, values, labels=None) -> DataFrame:
        """(label_id, z), a row for each label."""
        rows = [(int(k), float(z)) for k, z in zip(labels if labels is not None else range(self.num_labels), values, strict=True)]
        return self.spark.createDataFrame(rows, "label_id long, z double")

    def _with_z(self, frame: DataFrame, values=None, labels=None) -> DataFrame:
        z = self._z_of(self.param if values is None else values, labels)
        return frame.join(F.broadcast(z) if self.num_labels <= 100_000 else z, "label_id")

    def _layers(self) -> Compressed:
        return self._keep("layers", lambda: Compressed(self.nodes, True), False)

    def _forget(self) -> None:
        self._kept = {k: v for k, v in self._kept.items() if k in ("layers", "profiles")}

    def _layer_sums(self, selfloops: bool, values=None, labels=None, **terms) -> DataFrame:
        """(label_id, sums) of functions of (z, x, y) over the pairs of each layer with fitness."""
        c = self._layers()
        t = c.pairs()
        if not selfloops:
            t = t.unionByName(c.selves.withColumn("w", -F.col("n").cast("double")).drop("n"))
        t = self._with_z(t, values, labels)
        made = t.select("label_id", "w", *(f(F.col("z"), F.col("x"), F.col("y")).alias(k) for k, f in terms.items()))
        return made.groupBy("label_id").agg(*(F.sum(F.col("w") * F.col(k)).alias(k) for k in terms))

    # fit

    def fit(self, x0=None, method: str = "density", atol: float = 1e-24, rtol: float = 1e-9, maxiter: int = 100, verbose: bool = False) -> None:
        """One z to match num_edges of the projected graph, or (per_label) one for each layer's; all layers take their steps in the same jobs."""
        start = start_of(x0, self.num_labels, "The model requires one or num_labels initial conditions.")
        if method == "mle":
            raise ValueError("Method not implemented.")
        if method != "density":
            raise ValueError("The selected method is not valid.")
        if self.per_label:
            if self.num_edges_label is None:
                raise ValueError("Number of edges per label must be set for density solver with per_label option.")
            start = np.repeat(start, self.num_labels) if len(start) == 1 else start
            equations = [Newton(float(a), float(n), atol, rtol, maxiter, 0.0, INF) for a, n in zip(start, self.num_edges_label, strict=True)]

            def layers(z: list[float], which: list[int]) -> list[tuple[float, float]]:
                found = {r["label_id"]: (r["p"], r["d"]) for r in self._layer_sums(self.selfloops, z, which, p=lambda z, x, y: self.kernel.p(z, x, y), d=lambda z, x, y: self.kernel.jac(z, x, y)).collect()}
                return [found.get(k, (0.0, 0.0)) for k in which]

            self.solver_output = solve(layers, equations, verbose)
            self.param = np.array([s.x for s in self.solver_output])
            for i, s in enumerate(self.solver_output):
                if not s.converged:
                    warnings.warn(f"Fit of layer {i} did not converge.", UserWarning, stacklevel=2)
        else:
            if self.num_edges is None:
                raise ValueError("Number of edges must be set for density solver.")
            if len(start) > 1:
                raise ValueError("The model requires one parameter.")
            newton = Newton(float(start[0]), self.num_edges, atol, rtol, maxiter, 0.0, INF)
            self.solver_output = solve(lambda z, _: [self._projected_density(z[0])], [newton], verbose)[0]
            self.param = np.repeat(self.solver_output.x, self.num_labels)
            if not self.solver_output.converged:
                warnings.warn("Fit did not converge", UserWarning, stacklevel=2)
        self._forget()
        if not self.per_label:
            self._kept["num_edges"] = self.solver_output.target + self.solver_output.f_seq[-1]  # what the last step summed over all pairs

    def _projected_density(self, z: float) -> tuple[float, float]:
        t = self._counted(self.selfloops, self._with_slope, [z] * self.num_labels)
        r = t.agg(*(F.coalesce(F.sum(F.col("w") * F.col(c)), F.lit(0.0)).alias(c) for c in "pd")).first()
        return r["p"], r["d"]

    # projected graph: nodes with equal fitness in every layer are one profile

    def _profile_tables(self):
        def build():
            rows = F.sort_array(F.collect_list(F.struct("label_id", "x", "y")))  # a node's layers
            keyed = self.nodes.groupBy("vid").agg(rows.alias("key"))
            empty = F.array().cast("array<struct<label_id:bigint,x:double,y:double>>")
            keyed = self._all_vertices().join(keyed, "vid", "left").select("vid", F.coalesce("key", empty).alias("key"))
            ids = numbered(keyed, "key", "pid").transform(scratch.kept)
            profiles = keyed.groupBy("key").agg(F.count("*").alias("n")).join(ids, "key").select("pid", "key", "n")
            if self.num_labels <= DENSE_LABELS:
                profiles = profiles.withColumns({c: _by_place(c, self.num_labels) for c in "xy"})
            profiles = profiles.transform(scratch.kept)
            return profiles, keyed.join(ids, "key").select("vid", "pid").transform(scratch.kept), profiles.count()

        return self._keep("profiles", build, False)

    def _profiles(self) -> DataFrame:
        return self._profile_tables()[0].select("pid", "n")

    def _members(self) -> DataFrame:
        return self._profile_tables()[1]

    def _sides(self, z, x: str, y: str) -> list[tuple]:
        """Of each layer its z and the columns of two profiles' fitnesses."""
        return [(float(v), F.col(f"{x}{k}"), F.col(f"{y}{k}")) for k, v in enumerate(z)]

    def _places(self, **names: str) -> list[Column]:
        """Arrays of fitnesses as columns of their places: expressions of arrays would be interpreted for each pair, and what may be null asked each time."""
        return [F.coalesce(F.col(c)[k], F.lit(0.0)).alias(f"{n}{k}") for n, c in names.items() for k in range(self.num_labels)]

    def _long(self, values) -> DataFrame:
        """(pid, label_id, z, x, y) of profiles."""
        long = self._profile_tables()[0].select("pid", F.explode("key").alias("k")).select("pid", "k.label_id", "k.x", "k.y")
        return self._with_z(long, values)

    def _terms(self, values, slope: bool = False) -> DataFrame:
        """(a, b, s[, slope]): sums over layers for pairs of profiles that share one; others have 0. For many layers, of which a pair shares few: one side of a layer is salted, so that no task has a whole one."""
        long = self._long(values)
        salts = max(1, self.spark.sparkContext.defaultParallelism)
        a = long.filter("x > 0").select("label_id", F.col("pid").alias("a"), "x", "z", F.pmod(F.xxhash64("pid"), F.lit(salts)).cast("int").alias("salt"))
        b = long.filter("y > 0").select("label_id", F.col("pid").alias("b"), "y", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        t = a.join(b, ["label_id", "salt"])
        args = F.col("z"), F.col("x"), F.col("y")
        made = t.select("a", "b", self.kernel.layer_term(*args).alias("s"), *([self.kernel.layer_slope(*args).alias("slope")] if slope else []))
        return made.groupBy("a", "b").agg(F.sum("s").alias("s"), *([F.sum("slope").alias("slope")] if slope else []))

    def _dense_pairs(self, weights: DataFrame | None = None) -> DataFrame:
        """Pairs of profiles side by side (a, xa0, ..., ya0, ..., na, b, xb0, ..., yb0, ..., nb[, w]): no shuffle of pairs."""
        profiles, _, rows = self._profile_tables()
        some = profiles.filter(F.size("key") > 0)
        a = some.select(F.col("pid").alias("a"), *self._places(xa="x", ya="y"), F.coalesce("n", F.lit(0)).alias("na"))
        b = some if weights is None else some.join(weights, "pid", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        return cross(a, b.select(F.col("pid").alias("b"), *self._places(xb="x", yb="y"), F.coalesce("n", F.lit(0)).alias("nb"), *(["w"] if weights is not None else [])), rows, blocks=self.p_blocks)

    @property
    def _dense(self) -> bool:
        return self.num_labels <= DENSE_LABELS

    def _pair_probs(self, weights: DataFrame) -> DataFrame:
        if self._dense:
            t = self._dense_pairs(weights)
            for name, x, y in (("p", "xa", "yb"), ("q", "xb", "ya")):
                t = self.kernel.gathered(t, name, self._sides(self.param, x, y))
            return t.select("a", "b", *(self.kernel.any_link(F.col(c)).alias(c) for c in "pq"), "w")
        p = self._terms(self.param).select("a", "b", any_layer(F.col("s")).alias("p"))
        both = p.select("a", "b", "p", F.lit(0.0).alias("q")).unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("p"), F.col("p").alias("q")))
        both = both.groupBy("a", "b").agg(F.max("p").alias("p"), F.max("q").alias("q"))
        return both.join(weights.select(F.col("pid").alias("b"), "w"), "b", "left").select("a", "b", "p", "q", F.coalesce("w", F.lit(0.0)).alias("w"))

    def _counted(self, selfloops: bool, made, values=None) -> DataFrame:
        """(a, b, w, ...): pairs of profiles, those that share no layer left out where layers are many, with the number of pairs of nodes. ``made`` tells their columns from (pairs, layers), or from sums (s, slope) where layers are many."""
        values = self.param if values is None else values
        if self._dense:
            t = made(self._dense_pairs(), self._sides(values, "xa", "yb"))
        else:
            n = self._profiles()
            t = made(self._terms(values, True).join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b"), None)
        own = F.lit(0.0) if selfloops else F.when(F.col("a") == F.col("b"), F.col("na").cast("double")).otherwise(0.0)
        return t.withColumn("w", F.col("na").cast("double") * F.col("nb") - own)

    def _with_p(self, t: DataFrame, layers) -> DataFrame:
        if layers is None:
            return t.withColumn("p", any_layer(F.col("s")))
        return self.kernel.gathered(t, "held", layers).withColumn("p", self.kernel.any_link(F.col("held")))

    def _with_s(self, t: DataFrame, layers) -> DataFrame:
        return t if layers is None else self.kernel.log_no_link(t, "s", layers)

    def _with_slope(self, t: DataFrame, layers) -> DataFrame:
        t = self._with_p(t, layers)
        if layers is None:
            return t.withColumn("d", F.when(F.col("s") == INF, 0.0).otherwise(F.exp(-F.col("s")) * F.col("slope")))
        return t.withColumn("d", self.kernel.no_link(F.col("held")) * reduce(lambda a, b: a + b, (self.kernel.layer_slope(*f) for f in layers)))

    def _num_edges(self) -> float:
        return self._counted(self.selfloops, self._with_p).agg(F.coalesce(F.sum(F.col("p") * F.col("w")), F.lit(0.0))).first()[0]

    def _edge_values(self, edges: DataFrame) -> DataFrame:
        if self._dense:
            profiles, members, _ = self._profile_tables()
            wide = members.join(profiles, "pid")
            t = edges.join(wide.select(F.col("vid").alias("src"), *self._places(xa="x")), "src").join(wide.select(F.col("vid").alias("dst"), *self._places(yb="y")), "dst")
            layers = self._sides(self.param, "xa", "yb")
            t = self._with_p(self._with_s(t, layers), layers)  # the p that pairs have, so that both fall on one side of a threshold
            return t.select("src", "dst", "p", log_any_layer(F.col("s")).alias("logp"), (-F.col("s")).alias("log1mp"))
        x = self.nodes.filter("x > 0").select(F.col("vid").alias("src"), "label_id", "x")
        y = self.nodes.filter("y > 0").select(F.col("vid").alias("dst"), "label_id", "y")
        # of an edge the layers that its ends share
        t = self._with_z(edges.join(x, "src").join(y, ["dst", "label_id"]))
        t = t.groupBy("src", "dst").agg(F.sum(self.kernel.layer_term(F.col("z"), F.col("x"), F.col("y"))).alias("s"))
        s = F.coalesce(F.col("s"), F.lit(0.0))
        return edges.join(t, ["src", "dst"], "left").select("src", "dst", any_layer(s).alias("p"), log_any_layer(s).alias("logp"), (-s).alias("log1mp"))

    def _no_link_sum(self, selfloops: bool) -> tuple[float, float]:
        s, w = F.col("s"), F.col("w")
        r = self._counted(selfloops, self._with_s).filter("w > 0").agg(F.coalesce(F.sum(F.when(s < INF, -s * w)), F.lit(0.0)), F.coalesce(F.sum(F.when(s == INF, w)), F.lit(0.0))).first()
        return r[0], r[1]

    def _p_counts(self, selfloops: bool) -> DataFrame:
        return self._counted(selfloops, self._with_p).select("p", "w")

    # layers

    def expected_num_edges_label(self, recompute: bool = False) -> DataFrame:
        """(label_id, num_edges)."""
        self._fitted()

        def build():
            found = self._layer_sums(self.selfloops, num_edges=lambda z, x, y: self.kernel.p(z, x, y))
            return self._z_of(self.param).select("label_id").join(found, "label_id", "left").select("label_id", F.coalesce("num_edges", F.lit(0.0)).alias("num_edges"))

        return self._keep("num_edges_label", build, recompute)

    def _degrees_by_label(self) -> DataFrame:
        """(vid, label_id, out, in, und) of the nodes of each layer; the others have 0."""
        c = self._layers()
        z, p = F.col("z"), self.kernel.p
        pairs = self._with_z(c.pairs(True)).withColumn("p", p(z, F.col("x"), F.col("y")))
        out = pairs.groupBy("label_id", "x").agg(F.sum(F.col("m") * F.col("p")).alias("out"))
        in_ = pairs.groupBy("label_id", "y").agg(F.sum(F.col("n") * F.col("p")).alias("in"))
        own = F.when((F.col("x") > 0) & (F.col("y") > 0), p(z, F.col("x"), F.col("y"))).otherwise(0.0)
        one = F.lit(0.0) if self.selfloops else F.col("own")
        t = self.nodes.join(out, ["label_id", "x"], "left").join(in_, ["label_id", "y"], "left").join(self._both_ways(), ["label_id", "x", "y"], "left").fillna(0.0, ["out", "in", "both"])
        t = self._with_z(t).withColumn("own", own).withColumn("und", F.col("out") + F.col("in") - F.col("both"))
        und = F.col("und") - (2 * F.col("own") - F.col("own") * F.col("own")) + (F.col("own") if self.selfloops else 0)
        return t.select("vid", "label_id", (F.col("out") - one).alias("out"), (F.col("in") - one).alias("in"), und.alias("und"))

    def _both_ways(self) -> DataFrame:
        """(label_id, x, y, both): of fitnesses x and y of one node the sum over all nodes of the chances there times those back."""
        z, p = F.col("z"), self.kernel.p
        some = self._layers().selves.select("label_id", "x", "y", F.col("n").cast("double").alias("n"))
        sizes = some.groupBy("label_id").agg(F.count("*").alias("all"), F.countDistinct("x").alias("xs")).agg(F.sum("all").alias("rows"), F.sum(F.col("xs") * F.col("xs")).alias("made"), F.sum(F.col("xs") * F.col("all")).alias("short"), F.sum(F.col("all") * F.col("all")).alias("long")).first()
        rows = sizes["rows"] or 0
        other = some.select(F.col("label_id").alias("other"), F.col("x").alias("xb"), F.col("y").alias("yb"), "n")
        same = F.col("label_id") == F.col("other")
        if rows > BROADCAST_ROWS or 2 * sizes["short"] >= sizes["long"] or sizes["made"] > MADE_ROWS:
            t = cross(self._with_z(some.drop("n")), other, rows, same)
            return t.groupBy("label_id", "x", "y").agg(F.sum(F.col("n") * p(z, F.col("x"), F.col("yb")) * p(z, F.col("xb"), F.col("y"))).alias("both"))
        # few distinct x: the chances there are added up by the others' x, then met by each y; each x stays in its task
        firsts = spread(self._with_z(some.select("label_id", "x").distinct()), "label_id", "x")
        there = firsts.join(F.broadcast(other), same).groupBy("label_id", "x", "xb").agg(F.sum(F.col("n") * p(z, F.col("x"), F.col("yb"))).alias("there"))
        back = self._with_z(there.join(F.broadcast(some.drop("n")), ["label_id", "x"]))
        return back.groupBy("label_id", "x", "y").agg(F.sum(F.col("there") * p(z, F.col("xb"), F.col("y"))).alias("both"))

    def _degree_by_label(self, which: str, name: str, recompute: bool) -> DataFrame:
        self._fitted()
        return self._keep("degrees_by_label", lambda: self._degrees_by_label().transform(scratch.kept), recompute).select("vid", "label_id", F.col(which).alias(name))

    def expected_degree_by_label(self, recompute: bool = False) -> DataFrame:
        return self._degree_by_label("und", "degree", recompute)

    def expected_out_degree_by_label(self, recompute: bool = False) -> DataFrame:
        return self._degree_by_label("out", "out_degree", recompute)

    def expected_in_degree_by_label(self, recompute: bool = False) -> DataFrame:
        return self._degree_by_label("in", "in_degree", recompute)

    def log_likelihood(self, g, selfloops: bool | None = None, log_space: bool = True) -> float:
        """Of the layers if the graph has them (a MultiDiGraph, edges with label_id, three dimensions), else of the projected graph."""
        self._fitted()
        edges, layered = adjacency_of(g, self.num_vertices, self.spark, self.num_labels)
        if not layered:
            return super().log_likelihood(g, selfloops, log_space)
        selfloops = self.selfloops if selfloops is None else selfloops
        edges = edges if selfloops else edges.filter("src <> dst")
        x = self.nodes.select(F.col("vid").alias("src"), "label_id", "x")
        y = self.nodes.select(F.col("vid").alias("dst"), "label_id", "y")
        t = edges.join(x, ["src", "label_id"], "left").join(y, ["dst", "label_id"], "left").fillna(0.0, ["x", "y"])
        t = self._with_z(t)
        args = (F.col("z"), F.col("x"), F.col("y"))
        log1mp = self.kernel.log1mp
        sums = self._layer_sums(selfloops, rest=lambda *a: F.when(log1mp(*a) > -INF, log1mp(*a)).otherwise(0.0), certain=lambda *a: (log1mp(*a) == -INF).cast("double"))
        r = sums.agg(F.coalesce(F.sum("rest"), F.lit(0.0)), F.coalesce(F.sum("certain"), F.lit(0.0))).first()
        total = self._likelihood(t.select(self.kernel.logp(*args).alias("logp"), log1mp(*args).alias("log1mp")), (r[0], r[1]))
        return total if log_space else float(np.exp(total))

    def sample(self, ref_g: Graph | None = None, weights: str | None = None, out_strength=None, in_strength=None, selfloops: bool | None = None, seed: int = 0, portable: bool = False) -> MultiDiGraph:
        """Each layer drawn by itself; 'cremb' weights keep each layer's expected strengths."""
        self._fitted("Ensemble has to be fitted before sampling.")
        if weights not in (None, "cremb"):
            raise ValueError("Weights method not recognised or implemented.")
        selfloops = self.selfloops if selfloops is None else selfloops
        a = self._with_z(self.nodes.filter("x > 0").select("label_id", F.col("vid").alias("src"), "x"))
        b = self.nodes.filter("y > 0").select("label_id", F.col("vid").alias("dst"), "y")
        links = drawn(a, b, lambda y: self.kernel.p(F.col("z"), F.col("x"), y), seed, portable, selfloops, True)
        if weights == "cremb":
            default = lambda c, n: self.nodes.filter(F.col(c) > 0).select("vid", "label_id", F.col(c).alias(n))
            out, in_ = self._ends(out_strength if out_strength is not None else default("x", "s_out"), in_strength if in_strength is not None else default("y", "s_in"), True)
            self._same_totals(out, in_)
            total = out.groupBy("label_id").agg(F.sum("s_out").alias("total"))
            links = links.join(out.withColumnRenamed("vid", "src"), ["src", "label_id"]).join(in_.withColumnRenamed("vid", "dst"), ["dst", "label_id"]).join(total, "label_id")
            mean = F.col("s_out") * F.col("s_in") / (F.col("total") * F.col("p"))
            links = links.select("label_id", "src", "dst", (-mean * F.log1p(-uniform(seed, "src", "dst", "label_id", salt="w", portable=portable))).alias("w"))
        else:
            links = links.select("label_id", "src", "dst", F.lit(1.0).alias("w"))
        labels = self.labels if self.labels is not None else self.spark.range(self.num_labels).select(F.col("id").alias("label_id"), F.struct(F.col("id").alias("k0")).alias("label_key"))
        return self._wrapped(links, ref_g, bool(weights), labels)


class MultiInvariantModel(MultiFitnessModel):
    """Layer k links i to j with p = 1 - exp(-z_k x_ik y_jk)."""

    kernel: Kernel = Exponential()
