import warnings

import numpy as np
import pandas as pd
import pytest
from data import E3, E4, EM, KEYS, OUT4, OUTM, IN4, INM, V3, V4
from helpers import table, vector

import maxentnet as M
from maxentnet.sources import ingest
from maxentnet.sources.readers import read_table, write_table

ONE = {"v_id": "name", "src": "creditor", "dst": "debtor", "weight": "value", "v_group": "country"}


@pytest.fixture(scope="module")
def directed(spark):
    return M.DiGraph(V3, E3, **ONE)


@pytest.fixture(scope="module")
def undirected(spark):
    return M.Graph(V3, E3, **ONE)


@pytest.fixture(scope="module")
def multi(spark):
    return M.MultiDiGraph(V4, EM, edge_label=["type", "EUR"], **KEYS)


def test_ids_are_in_order_of_keys(directed, multi):
    keys = {r["vid"]: (r["node_key"][0], r["group_id"]) for r in directed.vertices.collect()}
    assert keys == {0: ("ABN", 1), 1: ("BNP", 0), 2: ("ING", 1)}
    assert [tuple(r["label_key"]) for r in multi.labels.orderBy("label_id").collect()] == [("external", False), ("external", True), ("interbank", False), ("interbank", True)]
    assert directed.id_bytes == 1 and ingest.num_bytes(2**8) == 2 and ingest.num_bytes(2**16) == 4


def test_numbers_in_ranges_agree_with_a_window(spark, monkeypatch):
    keys = spark.createDataFrame([(f"k{i % 97:03d}",) for i in range(300)], "key string")
    one = {r["key"]: r["n"] for r in ingest.numbered(keys, "key", "n").collect()}
    monkeypatch.setattr(ingest, "WINDOW_KEYS", 5)
    assert {r["key"]: r["n"] for r in ingest.numbered(keys, "key", "n").collect()} == one == {f"k{i:03d}": i for i in range(97)}


def test_undirected_measures(undirected):
    assert (undirected.num_edges(), undirected.total_weight()) == (3, 1183000.0)
    assert vector(undirected.strength()).tolist() == [1.18e6, 1.83e5, 1.003e6]
    assert table(undirected.degree_by_group(), "degree", (3, 2), col="group_id").tolist() == [[1, 1], [0, 2], [1, 1]]
    assert table(undirected.strength_by_group(), "strength", (3, 2), col="group_id").tolist() == [[1.8e5, 1e6], [0, 1.83e5], [3e3, 1e6]]
    assert vector(undirected.average_nn_property(np.array([0, 1, 2]))).tolist() == [1.5, 1, 0.5]
    assert vector(undirected.average_nn_degree()).tolist() == [2, 2, 2]


def test_directed_measures(directed):
    assert directed.num_edges() == 4
    assert vector(directed.average_nn_property(np.array([0, 1, 2]))).tolist() == [1, 1, 0]
    for ndir, ddir, want in (("out", "out", [2, 1, 1]), ("out", "in", [1, 1.5, 2]), ("in", "out", [1.5, 1, 2]), ("in", "in", [1, 2, 1]), ("out-in", "out-in", [2, 2, 2])):
        got = vector(directed.average_nn_degree(ndir=ndir, ddir=ddir)).tolist()
        assert got == want, (ndir, ddir)
    with pytest.raises(ValueError, match="Neighbourhood direction"):
        directed.average_nn_property(np.zeros(3), "up")
    with pytest.raises(ValueError):
        directed.average_nn_property(np.zeros(2))


def test_composite_keys(spark):
    g = M.DiGraph(V4, E4, **KEYS)
    assert vector(g.out_strength()).tolist() == OUT4.tolist() and vector(g.in_strength()).tolist() == IN4.tolist()


def test_layers(multi):
    assert multi.num_edges() == 5
    assert [r["num_edges"] for r in multi.num_edges_label().orderBy("label_id").collect()] == [1, 1, 3, 1]
    assert table(multi.out_strength_by_label(), "out_strength", (4, 4)).tolist() == OUTM.tolist()
    assert table(multi.in_strength_by_label(), "in_strength", (4, 4)).tolist() == INM.tolist()
    assert table(multi.degree_by_label(), "degree", (4, 4)).tolist() == [[1, 1, 3, 1], [1, 0, 1, 0], [0, 0, 1, 1], [0, 1, 1, 0]]
    assert table(multi.out_degree_by_label(), "out_degree", (4, 4)).tolist() == [[0, 1, 1, 0], [1, 0, 0, 0], [0, 0, 1, 1], [0, 0, 1, 0]]
    assert table(multi.in_degree_by_label(), "in_degree", (4, 4)).tolist() == [[1, 0, 2, 1], [0, 0, 1, 0], [0, 0, 0, 0], [0, 1, 0, 0]]
    assert vector(multi.out_degree()).tolist() == [2, 1, 1, 1] and vector(multi.in_degree()).tolist() == [3, 1, 0, 1]
    assert multi.adjacency_tensor(directed=False, weighted=False).count() == 12


def test_self_loops_and_parallel_edges(spark):
    v = pd.DataFrame({"id": [1, 2, 3]})
    e = pd.DataFrame({"s": [1, 1, 2, 2, 3], "t": [1, 2, 1, 1, 3], "w": [1.0, 2.0, 3.0, 0.25, 0.5]})
    args = {"v_id": "id", "src": "s", "dst": "t", "weight": "w"}
    g, u = M.DiGraph(v, e, **args), M.Graph(v, e, **args)
    assert (g.num_edges(), u.num_edges(), g.total_weight(), u.total_weight()) == (4, 3, 6.75, 6.75)
    assert vector(u.strength()).tolist() == [6.25, 5.25, 0.5] and vector(u.degree()).tolist() == [2, 1, 1]
    plain = M.DiGraph(v, e, v_id="id", src="s", dst="t")
    assert plain.num_edges() == 4 and plain.total_weight() == 4.0


def test_errors(spark):
    with pytest.raises(Exception, match="repeated id"):
        M.DiGraph(pd.concat([V3, V3]), E3, **ONE)
    with pytest.raises(AssertionError, match="not in v"):
        M.DiGraph(V3[:2], E3, **ONE)
    with pytest.raises(AssertionError, match="Zero or negative"):
        M.DiGraph(V3, E3.assign(value=[1.0, 0.0, 1.0, 1.0]), **ONE)
    with pytest.raises(AssertionError, match="Only dataframe"):
        M.DiGraph([1], E3, **ONE)
    with pytest.raises(ValueError, match="both lists or str"):
        M.DiGraph(V4, E4, v_id=["name", "country"], src=["creditor", "c_country"], dst="debtor")


def test_isolated_vertices_warn(spark):
    more = pd.concat([V3, pd.DataFrame([["RAB", "NL", 1.0], ["UBS", "CH", 1.0]], columns=V3.columns)])
    with pytest.warns(UserWarning, match=r"\[RAB, UBS\] vertices have no edges"):
        g = M.Graph(more, E3, **ONE)
    assert vector(g.degree()).tolist() == [2, 2, 2, 0, 0]
    with pytest.warns(UserWarning, match="RAB vertex has no edges"):
        M.Graph(more[:4], E3, **ONE)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        M.Graph(V3, E3, **ONE)


def test_export_and_files(spark, multi, tmp_path):
    nodes, links = multi.to_node_link()
    assert nodes.count() == 4 and links.count() == 6 and set(links.columns) == {"src", "dst", "key", "weight", "label"}
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        write_table(links.select("src", "dst", "weight"), path, fmt)
        back = read_table(spark, path, fmt, "src long, dst long, weight double")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, links.select("src", "dst", "weight").collect()))


def test_bad_weights(spark):
    for bad in (None, float("nan"), -1.0):
        with pytest.raises(AssertionError, match="Zero or negative"):
            M.DiGraph(V3, E3.assign(value=[1.0, bad, 1.0, 1.0]), **ONE)


class _Links(dict):
    """What the export asks of a networkx graph."""

    def __init__(self):
        self.nodes, self.edges = [], []

    def add_node(self, i, **data):
        self.nodes.append((i, data))

    def add_edge(self, a, b, **data):
        self.edges.append((a, b, data))


def test_networkx(spark, multi, monkeypatch):
    import sys
    import types

    monkeypatch.setitem(sys.modules, "networkx", types.SimpleNamespace(**dict.fromkeys(("Graph", "DiGraph", "MultiGraph", "MultiDiGraph"), _Links)))
    ids = {"v_id": "name", "src": "creditor", "dst": "debtor", "v_group": "country"}
    nodes = [(0, {"node_id": "ABN", "group": "NL"}), (1, {"node_id": "BNP", "group": "FR"}), (2, {"node_id": "ING", "group": "NL"})]
    plain = M.Graph(V3, E3, **ids).to_networkx()
    assert plain.nodes == nodes and plain.edges == [(0, 1, {"weight": True}), (0, 2, {"weight": True}), (1, 2, {"weight": True})]
    weighted = M.Graph(V3, E3, weight="value", **ids).to_networkx()
    assert weighted.edges == [(0, 1, {"weight": 1e4 + 1.7e5}), (0, 2, {"weight": 1e6}), (1, 2, {"weight": 3e3})]
    directed = M.DiGraph(V3, E3, weight="value", **ids).to_networkx()
    assert directed.edges == [(0, 1, {"weight": 1e4}), (1, 0, {"weight": 1.7e5}), (1, 2, {"weight": 3e3}), (2, 0, {"weight": 1e6})]
    layers = multi.to_networkx()
    assert sorted((a, b, x["key"], x["label"]) for a, b, x in layers.edges)[0] == (0, 1, 2, ("interbank", False)) and len(layers.edges) == 6


class _Coo:
    """A sparse matrix as scipy's are asked."""

    def __init__(self, a):
        self.shape, (self.row, self.col) = a.shape, np.nonzero(a)
        self.data = a[self.row, self.col]

    def tocoo(self):
        return self


def test_sparse_matrices(spark):
    g = M.DiGraph(V4, E4, **KEYS)
    m = M.FitnessModel(g, param=1e-12)
    a = np.zeros((4, 4))
    for r in g.adj.collect():
        a[r["src"], r["dst"]] = r["w"]
    assert m.log_likelihood(_Coo(a)) == pytest.approx(m.log_likelihood(g))
    with pytest.raises(ValueError, match="correct shape"):
        m.log_likelihood(_Coo(np.ones((3, 3))))
    with pytest.raises(ValueError, match="not a graph"):
        m.log_likelihood([_Coo(a)])


def test_sparse_layers(spark, multi):
    m = M.MultiFitnessModel(multi, param=1e-9)
    a = np.zeros((4, 4, 4))
    for r in multi.adj.collect():
        a[r["label_id"], r["src"], r["dst"]] = r["w"]
    assert m.log_likelihood([_Coo(x) for x in a]) == pytest.approx(m.log_likelihood(multi))
    assert m.log_likelihood([_Coo(a[0]), *a[1:]]) == pytest.approx(m.log_likelihood(a))
