"""Graphs as node and link tables, and as NetworkX objects where that library is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_link(graph) -> tuple[DataFrame, DataFrame]:
    """nodes (id, node_id[, group]) and links (src, dst[, label, key][, weight]); the key of parallel links is their label's number."""
    v, adj = graph.vertices, graph.export_edges()
    nodes = v.select(F.col("vid").alias("id"), F.col("node_key").alias("node_id"), *([F.col("group_key").alias("group")] if graph.groups is not None else []))
    links = adj.select("src", "dst", *([F.col("w").alias("weight")] if graph.weighted else []), *(["label_id"] if "label_id" in adj.columns else []))
    if graph.labels is not None:
        links = links.join(graph.labels, "label_id").withColumnRenamed("label_id", "key").withColumnRenamed("label_key", "label")
    return nodes, links


def to_networkx(graph):
    """A networkx graph of the same kind; for graphs that fit the driver. A link without a weight has the weight True."""
    import networkx as nx

    kind = {(False, False): nx.Graph, (True, False): nx.DiGraph, (False, True): nx.MultiGraph, (True, True): nx.MultiDiGraph}
    out = kind[graph.directed, graph.labels is not None]()
    nodes, links = node_link(graph)

    def plain(key):
        return key[0] if len(key) == 1 else tuple(key)

    for r in nodes.orderBy("id").toLocalIterator():
        out.add_node(r["id"], node_id=plain(r["node_id"]), **({"group": plain(r["group"])} if "group" in nodes.columns else {}))
    for r in links.orderBy("src", "dst", *(["key"] if graph.labels is not None else [])).toLocalIterator():
        data = {"weight": r["weight"] if graph.weighted else True}
        if graph.labels is not None:
            out.add_edge(r["src"], r["dst"], key=r["key"], label=plain(r["label"]), **data)
        else:
            out.add_edge(r["src"], r["dst"], **data)
    return out
