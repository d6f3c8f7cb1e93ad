"""Directed or not, one layer or several: graphs as tables, and their marginals as lazy frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maxentnet.sources import export
from maxentnet.sources.ingest import Tables, ingest, num_bytes

DIRECTIONS = ("out", "in", "out-in")


class Graph:
    """An undirected graph of one layer, and what all graphs share.

    Measures of nodes are frames keyed by vid with a row for every vertex; they are built once and kept (``recompute`` builds anew).
    """

    directed = False

    def __init__(self, v, e, v_id, src, dst, weight=None, v_group=None, spark: SparkSession | None = None):
        self._set(ingest(v, e, v_id, src, dst, weight, v_group, None, spark))

    def _set(self, t: Tables) -> None:
        self.vertices, self.adj, self.groups, self.labels = t.vertices, t.adj, t.groups, t.labels
        self.num_vertices, self.num_groups, self.num_labels, self.weighted = t.num_vertices, t.num_groups, t.num_labels, t.weighted
        self.id_bytes = num_bytes(self.num_vertices)
        self.spark = t.vertices.sparkSession
        self._kept: dict = {}

    @classmethod
    def from_edges(cls, vertices: DataFrame, adj: DataFrame, num_vertices: int, groups: DataFrame | None = None, labels: DataFrame | None = None, num_labels: int | None = None, weighted: bool = True):
        """A graph of numbered edges without further checks, such as a sample."""
        out = cls.__new__(cls)
        out._set(Tables(vertices, adj, groups, labels, num_vertices, groups.count() if groups is not None else None, num_labels, weighted))
        return out

    def _keep(self, name: str, build, recompute: bool = False):
        if recompute or name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    # views

    def _flat(self) -> DataFrame:
        """(src, dst, w) over all layers."""
        return self.adj.select("src", "dst", "w")

    @staticmethod
    def _view(adj: DataFrame, key: list[str], directed: bool, weighted: bool) -> DataFrame:
        if not directed:  # both ways; a self-loop counts once
            turned = adj.filter("src <> dst").select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
            adj = adj.select(*key, "src", "dst", "w").unionByName(turned)
        by = [*key, "src", "dst"]
        return adj.groupBy(*by).agg(F.sum("w").alias("w")) if weighted else adj.select(*by).distinct()

    def adjacency_matrix(self, directed: bool = False, weighted: bool = True) -> DataFrame:
        """(src, dst[, w]); absent pairs are 0. An undirected graph is symmetric whatever ``directed`` says."""
        directed = directed and self.directed
        if directed and self.labels is None:
            return self._flat() if weighted else self.adj.select("src", "dst")
        return self._view(self._flat(), [], directed, weighted)

    def export_edges(self) -> DataFrame:
        return self.adj if self.directed else self.adj.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}).groupBy(*(c for c in self.adj.columns if c != "w")).agg(F.sum("w").alias("w"))

    # whole graph

    def num_edges(self, recompute: bool = False) -> int:
        """Connected pairs, a self-loop being one; of a directed graph, ordered ones."""
        return self._keep("num_edges", lambda: self.adjacency_matrix(self.directed, False).filter("true" if self.directed else "src <= dst").count(), recompute)

    def total_weight(self, recompute: bool = False) -> float:
        return self._keep("total_weight", lambda: float(self.adj.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]), recompute)

    # nodes

    def _all(self, measure: DataFrame, name: str) -> DataFrame:
        kind = "long" if "degree" in name else "double"
        return self.vertices.select("vid").join(measure, "vid", "left").select("vid", F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name))

    def _marginal(self, name: str, directed: bool, end: str, weighted: bool) -> DataFrame:
        view = self.adjacency_matrix(directed, weighted)
        return self._all(view.groupBy(F.col(end).alias("vid")).agg((F.sum("w") if weighted else F.count("*")).alias(name)), name)

    def degree(self, recompute: bool = False) -> DataFrame:
        """Neighbours in either direction; a self-loop counts 1."""
        return self._keep("degree", lambda: self._marginal("degree", False, "src", False), recompute)

    def strength(self, recompute: bool = False) -> DataFrame:
        return self._keep("strength", lambda: self._marginal("strength", False, "src", True), recompute)

    def _by_group(self, name: str, directed: bool, end: str, weighted: bool) -> DataFrame:
        if self.groups is None:
            raise ValueError("The graph has no groups.")
        other = "dst" if end == "src" else "src"
        view = self.adjacency_matrix(directed, weighted)
        return view.join(self.vertices.select(F.col("vid").alias(other), "group_id"), other).groupBy(F.col(end).alias("vid"), "group_id").agg((F.sum("w") if weighted else F.count("*")).alias(name))

    def degree_by_group(self, recompute: bool = False) -> DataFrame:
        """(vid, group_id, degree) of vertices that have neighbours in the group, and how many: the other places of the table are 0."""
        return self._keep("degree_by_group", lambda: self._by_group("degree", False, "src", False), recompute)

    def strength_by_group(self, recompute: bool = False) -> DataFrame:
        return self._keep("strength_by_group", lambda: self._by_group("strength", False, "src", True), recompute)

    # neighbours

    def _property(self, prop) -> DataFrame:
        """(vid, prop) of a frame with vid and one more column, or of an array in order of vid."""
        if isinstance(prop, DataFrame):
            name = next(c for c in prop.columns if c != "vid")
            return prop.select("vid", F.col(name).cast("double").alias("prop"))
        if len(prop) != self.num_vertices:
            raise ValueError(f"Property must have one value for each of the {self.num_vertices} vertices.")
        return self.spark.createDataFrame([(i, float(x)) for i, x in enumerate(prop)], "vid long, prop double")

    def _nn(self, prop, directed: bool, end: str, selfloops: bool | None) -> DataFrame:
        """Mean of the neighbours' property; the numerator leaves a self-loop out unless ``selfloops`` (None is True), the denominator counts it."""
        view = self.adjacency_matrix(directed, False)
        other = "dst" if end == "src" else "src"
        on = F.lit(True) if selfloops or selfloops is None else F.col("src") != F.col("dst")
        sums = view.join(self._property(prop).withColumnRenamed("vid", other), other).groupBy(F.col(end).alias("vid")).agg((F.coalesce(F.sum(F.when(on, F.col("prop"))), F.lit(0.0)) / F.count("*")).alias("av_nn"))
        return self._all(sums, "av_nn")

    def average_nn_property(self, prop, selfloops: bool | None = False) -> DataFrame:
        """(vid, av_nn): mean property of the neighbours, 0 without any."""
        return self._nn(prop, False, "src", selfloops)

    def average_nn_degree(self, selfloops: bool | None = False, recompute: bool = False) -> DataFrame:
        return self._keep(f"av_nn_degree {selfloops}", lambda: self.average_nn_property(self.degree(), selfloops), recompute)

    def to_node_link(self) -> tuple[DataFrame, DataFrame]:
        return export.node_link(self)

    def to_networkx(self):
        return export.to_networkx(self)


class DiGraph(Graph):
    """A directed graph of one layer."""

    directed = True

    def adjacency_matrix(self, directed: bool = True, weighted: bool = True) -> DataFrame:
        return super().adjacency_matrix(directed, weighted)

    def out_degree(self, recompute: bool = False) -> DataFrame:
        return self._keep("out_degree", lambda: self._marginal("out_degree", True, "src", False), recompute)

    def in_degree(self, recompute: bool = False) -> DataFrame:
        return self._keep("in_degree", lambda: self._marginal("in_degree", True, "dst", False), recompute)

    def out_strength(self, recompute: bool = False) -> DataFrame:
        return self._keep("out_strength", lambda: self._marginal("out_strength", True, "src", True), recompute)

    def in_strength(self, recompute: bool = False) -> DataFrame:
        return self._keep("in_strength", lambda: self._marginal("in_strength", True, "dst", True), recompute)

    def out_degree_by_group(self, recompute: bool = False) -> DataFrame:
        return self._keep("out_degree_by_group", lambda: self._by_group("out_degree", True, "src", False), recompute)

    def in_degree_by_group(self, recompute: bool = False) -> DataFrame:
        return self._keep("in_degree_by_group", lambda: self._by_group("in_degree", True, "dst", False), recompute)

    def out_strength_by_group(self, recompute: bool = False) -> DataFrame:
        return self._keep("out_strength_by_group", lambda: self._by_group("out_strength", True, "src", True), recompute)

    def in_strength_by_group(self, recompute: bool = False) -> DataFrame:
        return self._keep("in_strength_by_group", lambda: self._by_group("in_strength", True, "dst", True), recompute)

    def average_nn_property(self, prop, ndir: str = "out", selfloops: bool | None = False) -> DataFrame:
        if ndir not in DIRECTIONS:
            raise ValueError("Neighbourhood direction not recognised.")
        return self._nn(prop, ndir != "out-in", "dst" if ndir == "in" else "src", selfloops)

    def average_nn_degree(self, *, ndir: str = "out", ddir: str = "out", selfloops: bool | None = False, recompute: bool = False) -> DataFrame:
        """Directions of the neighbourhood and of the neighbours' degree."""
        if ddir not in DIRECTIONS:
            raise ValueError("Degree type not recognised.")
        degree = {"out": self.out_degree, "in": self.in_degree, "out-in": self.degree}[ddir]
        return self._keep(f"av_{ndir}_nn_d_{ddir} {selfloops}", lambda: self.average_nn_property(degree(), ndir, selfloops), recompute)


class MultiGraph(Graph):
    """An undirected graph whose edges have labels; a label is a layer."""

    def __init__(self, v, e, v_id, src, dst, edge_label, weight=None, v_group=None, spark: SparkSession | None = None):
        self._set(ingest(v, e, v_id, src, dst, weight, v_group, edge_label, spark))

    def adjacency_tensor(self, directed: bool = False, weighted: bool = True) -> DataFrame:
        """(label_id, src, dst[, w])."""
        directed = directed and self.directed
        if directed:
            return self.adj if weighted else self.adj.select("label_id", "src", "dst")
        return self._view(self.adj, ["label_id"], directed, weighted)

    def _each_label(self, found: DataFrame, name: str, kind: str) -> DataFrame:
        return self.labels.select("label_id").join(found, "label_id", "left").select("label_id", F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name))

    def num_edges_label(self, recompute: bool = False) -> DataFrame:
        """(label_id, num_edges)."""
        view = lambda: self.adjacency_tensor(self.directed, False).filter("true" if self.directed else "src <= dst")
        return self._keep("num_edges_label", lambda: self._each_label(view().groupBy("label_id").agg(F.count("*").alias("num_edges")), "num_edges", "long"), recompute)

    def total_weight_label(self, recompute: bool = False) -> DataFrame:
        return self._keep("total_weight_label", lambda: self._each_label(self.adj.groupBy("label_id").agg(F.sum("w").alias("total_weight")), "total_weight", "double"), recompute)

    def _by_label(self, name: str, directed: bool, end: str, weighted: bool) -> DataFrame:
        """(vid, label_id, measure) of vertices that have edges in the layer: the other places of the table are 0."""
        view = self.adjacency_tensor(directed, weighted)
        return view.groupBy(F.col(end).alias("vid"), "label_id").agg((F.sum("w") if weighted else F.count("*")).alias(name))

    def degree_by_label(self, recompute: bool = False) -> DataFrame:
        return self._keep("degree_by_label", lambda: self._by_label("degree", False, "src", False), recompute)

    def strength_by_label(self, recompute: bool = False) -> DataFrame:
        return self._keep("strength_by_label", lambda: self._by_label("strength", False, "src", True), recompute)


class MultiDiGraph(MultiGraph, DiGraph):
    """A directed graph whose edges have labels."""

    directed = True

    def adjacency_matrix(self, directed: bool = True, weighted: bool = True) -> DataFrame:
        return Graph.adjacency_matrix(self, directed, weighted)

    def adjacency_tensor(self, directed: bool = True, weighted: bool = True) -> DataFrame:
        return super().adjacency_tensor(directed, weighted)

    def out_degree_by_label(self, recompute: bool = False) -> DataFrame:
        return self._keep("out_degree_by_label", lambda: self._by_label("out_degree", True, "src", False), recompute)

    def in_degree_by_label(self, recompute: bool = False) -> DataFrame:
        return self._keep("in_degree_by_label", lambda: self._by_label("in_degree", True, "dst", False), recompute)

    def out_strength_by_label(self, recompute: bool = False) -> DataFrame:
        return self._keep("out_strength_by_label", lambda: self._by_label("out_strength", True, "src", True), recompute)

    def in_strength_by_label(self, recompute: bool = False) -> DataFrame:
        return self._keep("in_strength_by_label", lambda: self._by_label("in_strength", True, "dst", True), recompute)


def adjacency_of(g, num_vertices: int, spark: SparkSession, num_labels: int | None = None) -> tuple[DataFrame, bool]:
    """Edges (src, dst) or (label_id, src, dst) of a graph, a frame of edges, an array or a list of arrays; and whether they have layers."""
    if isinstance(g, MultiDiGraph) and num_labels is not None:
        if g.num_vertices != num_vertices:
            raise ValueError(f"Passed graph adjacency tensor does not have the correct shape: {(g.num_labels, g.num_vertices, g.num_vertices)} instead of {(num_labels, num_vertices, num_vertices)}")
        return g.adjacency_tensor(True, False), True
    if isinstance(g, Graph):
        if g.num_vertices != num_vertices:
            raise ValueError(f"Passed graph adjacency matrix does not have the correct shape: {(g.num_vertices, g.num_vertices)} instead of {(num_vertices, num_vertices)}")
        return g.adjacency_matrix(True, False) if g.directed else g.adjacency_matrix(False, False), False
    if isinstance(g, DataFrame):
        layered = "label_id" in g.columns and num_labels is not None
        return g.select(*(["label_id"] if layered else []), "src", "dst").distinct(), layered
    if hasattr(g, "tocoo") or isinstance(g, list) and g and any(hasattr(x, "tocoo") for x in g):
        return _sparse(g, num_vertices, spark, num_labels)
    if isinstance(g, list) and g and all(getattr(x, "ndim", 0) == 2 for x in g):
        g = np.array([np.asarray(x) for x in g])
    if isinstance(g, np.ndarray) and g.ndim in (2, 3):
        if g.ndim == 3 and num_labels is None:
            raise ValueError("g input not a graph or adjacency matrix.")
        shape = (num_vertices, num_vertices) if g.ndim == 2 else (num_labels, num_vertices, num_vertices)
        if g.shape != shape:
            raise ValueError(f"Passed graph adjacency {'matrix' if g.ndim == 2 else 'tensor'} does not have the correct shape: {g.shape} instead of {shape}")
        names = ("src", "dst") if g.ndim == 2 else ("label_id", "src", "dst")
        rows = [tuple(map(int, r)) for r in np.argwhere(g != 0)]
        return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)), g.ndim == 3
    if isinstance(g, np.ndarray):
        raise ValueError("Adjacency array is neither 2 nor 3 dimensional.")
    raise ValueError("g input not a graph or adjacency matrix.")


def _sparse(g, num_vertices: int, spark: SparkSession, num_labels: int | None) -> tuple[DataFrame, bool]:
    """Of a sparse matrix (with tocoo) or a list of them, one for each layer; only their places are copied."""
    layered = isinstance(g, list)
    if layered and num_labels is None:
        raise ValueError("g input not a graph or adjacency matrix.")
    layers = [x.tocoo() if hasattr(x, "tocoo") else x for x in (g if layered else [g])]
    shape = (len(layers), *layers[0].shape) if layered else layers[0].shape
    wanted = (num_labels, num_vertices, num_vertices) if layered else (num_vertices, num_vertices)
    if shape != wanted or any(x.shape != layers[0].shape for x in layers):
        raise ValueError(f"Passed graph adjacency {'tensor' if layered else 'matrix'} does not have the correct shape: {shape} instead of {wanted}")
    places = []
    for k, x in enumerate(layers):
        src, dst = (x.row[x.data != 0], x.col[x.data != 0]) if hasattr(x, "row") else np.nonzero(np.asarray(x))
        places.append(pa.table({"label_id": np.full(len(src), k, np.int64), "src": np.asarray(src, np.int64), "dst": np.asarray(dst, np.int64)}))
    edges = spark.createDataFrame(pa.concat_tables(places)).distinct()
    return edges if layered else edges.drop("label_id"), layered
