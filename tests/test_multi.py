import numpy as np
import pandas as pd
import pytest
from data import EM, INM, KEYS, OUTM, V4, ZL, ZM
from helpers import chances, either, layers, log_likelihood, table, vector

import maxentnet as M

KINDS = {"fitness": M.MultiFitnessModel, "invariant": M.MultiInvariantModel}


@pytest.fixture(scope="module")
def graph(spark):
    return M.MultiDiGraph(V4, EM, edge_label=["type", "EUR"], **KEYS)


def model(kind, param, selfloops=False):
    return KINDS[kind](num_vertices=4, num_labels=4, prop_out=OUTM, prop_in=INM, param=param, selfloops=selfloops)


@pytest.mark.parametrize("kind", KINDS)
def test_fit_per_label(graph, kind):
    m = KINDS[kind](graph)
    m.fit()
    assert m.per_label and m.param == pytest.approx(np.array(ZL[kind]), rel=1e-6)


@pytest.mark.parametrize(("kind", "selfloops"), list(ZM))
def test_fit_one_parameter(graph, kind, selfloops):
    m = KINDS[kind](graph, per_label=False, selfloops=selfloops)
    m.fit()
    assert m.param == pytest.approx(np.full(4, ZM[kind, selfloops]), rel=1e-6) and m.expected_num_edges() == pytest.approx(5, rel=1e-6)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("selfloops", [False, True])
def test_measures(graph, kind, selfloops):
    z = ZM[kind, selfloops]
    m, p = model(kind, z, selfloops), layers(kind, z, OUTM, INM, selfloops)
    flat = 1 - np.prod(1 - p, axis=0)
    assert m.expected_num_edges() == pytest.approx(flat.sum())
    assert vector(m.expected_degree()) == pytest.approx(either(flat).sum(1))
    assert vector(m.expected_out_degree()) == pytest.approx(flat.sum(1)) and vector(m.expected_in_degree()) == pytest.approx(flat.sum(0))
    assert [r["num_edges"] for r in m.expected_num_edges_label().orderBy("label_id").collect()] == pytest.approx(p.sum((1, 2)).tolist())
    und = np.array([either(q).sum(1) for q in p]).T
    assert table(m.expected_degree_by_label(), "degree", (4, 4)) == pytest.approx(und)
    assert table(m.expected_out_degree_by_label(), "out_degree", (4, 4)) == pytest.approx(p.sum(2).T)
    assert table(m.expected_in_degree_by_label(), "in_degree", (4, 4)) == pytest.approx(p.sum(1).T)
    tensor = np.zeros((4, 4, 4))
    for r in graph.adjacency_tensor().collect():
        tensor[r["label_id"], r["src"], r["dst"]] = 1
    assert m.log_likelihood(graph) == pytest.approx(sum(log_likelihood(p[k], tensor[k], selfloops) for k in range(4)))
    assert m.log_likelihood(list(tensor)) == pytest.approx(m.log_likelihood(graph))
    assert m.log_likelihood(tensor.max(0)) == pytest.approx(log_likelihood(flat, tensor.max(0), selfloops))
    tensor[0, 2, 0] = 1
    assert m.log_likelihood(tensor) == -np.inf
    tp, fp, tn, fn = m.confusion_matrix(graph.adjacency_matrix(), [0.0, 0.5]).arrays()
    assert tp[0] == 5 and tp[0] + fp[0] == (16 if selfloops else 12) and tn[0] == fn[0] == 0
    assert tp[1] + fp[1] == (flat[~np.eye(4, dtype=bool) | selfloops] >= 0.5).sum()


def test_links_both_ways_in_a_layer(spark):
    ones = np.ones((3, 1))
    m = M.MultiFitnessModel(num_vertices=3, num_labels=1, prop_out=ones, prop_in=ones, param=0.5)
    p = 0.5 / 1.5
    assert table(m.expected_degree_by_label(), "degree", (3, 1)) == pytest.approx(np.full((3, 1), 2 * (2 * p - p * p)))
    assert chances("fitness", 0.5, np.ones(3), np.ones(3)).sum() == pytest.approx(m.expected_num_edges())


def test_vertices_and_labels_differ_in_number(spark):
    v = pd.DataFrame({"id": range(5)})
    e = pd.DataFrame({"s": [0, 1, 2, 3, 4, 0], "t": [1, 2, 3, 4, 0, 2], "k": ["a", "b", "a", "b", "a", "b"], "w": [1.0, 2, 3, 4, 5, 6]})
    g = M.MultiDiGraph(v, e, v_id="id", src="s", dst="t", edge_label="k", weight="w")
    m = M.MultiInvariantModel(g)
    m.fit()
    assert [r["num_edges"] for r in m.expected_num_edges_label().orderBy("label_id").collect()] == pytest.approx([3, 3], rel=1e-6)


def test_samples(graph):
    m = model("invariant", np.array(ZL["invariant"]))
    s = m.sample(graph, seed=3, weights="cremb")
    assert sorted(map(tuple, s.adj.collect())) == sorted(map(tuple, m.sample(graph, seed=3, weights="cremb").adj.collect()))
    assert s.labels is graph.labels and s.num_edges() > 0 and s.adj.filter("w <= 0").isEmpty()


def test_errors(spark):
    base = {"num_vertices": 4, "num_labels": 4, "prop_out": OUTM, "prop_in": INM}
    for more, message in (
        ({"num_labels": None}, "Number of labels not set"),
        ({"num_edges": np.array([1, 2])}, "num_edges must be an array"),
        ({"num_edges_label": np.array([1, 2])}, "does not match"),
        ({"param": np.array([1.0, 2.0])}, "one or num_labels parameter"),
        ({"param": -1.0}, "positive in value"),
        ({}, "must be set"),
    ):
        with pytest.raises(ValueError, match=message):
            M.MultiFitnessModel(**(base | more))
    with pytest.raises(AssertionError, match="two dimensional"):
        M.MultiFitnessModel(**(base | {"prop_out": OUTM[:3], "param": 1.0}))


@pytest.mark.parametrize("kind", [M.MultiFitnessModel, M.MultiInvariantModel])
def test_many_layers_take_the_other_plan(spark, graph, monkeypatch, kind):
    from maxentnet.operators import multi as module

    few = kind(graph, param=np.array([1e-9, 2e-9, 1e-10, 3e-9]))
    want = [vector(few.expected_degree()), few.expected_num_edges(), few.log_likelihood(graph.adjacency_matrix())]
    monkeypatch.setattr(module, "DENSE_LABELS", 0)
    many = kind(graph, param=few.param)
    got = [vector(many.expected_degree()), many.expected_num_edges(), many.log_likelihood(graph.adjacency_matrix())]
    assert got[0] == pytest.approx(want[0]) and got[1:] == pytest.approx(want[1:])
