"""What lets larger tables through: pairs asked in compiled plans, samples that keep no pairs."""

import hashlib

import numpy as np
import pytest
from data import EM, KEYS, V4, ZM
from helpers import vector

import maxentnet as M
from maxentnet.functions.kernels import Exponential, Logistic

KINDS = {"fitness": M.MultiFitnessModel, "invariant": M.MultiInvariantModel}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def graph(spark):
    return M.MultiDiGraph(V4, EM, edge_label=["type", "EUR"], **KEYS)


@pytest.mark.parametrize("kind", KINDS)
def test_pairs_of_layers_and_thresholds_are_compiled(graph, kind):
    m = KINDS[kind](graph, param=ZM[kind, False])
    counts = m._p_counts(False)
    pairs = m._pair_probs(m._profiles().selectExpr("pid", "double(n) AS w"))
    values = m._edge_values(graph.adjacency_matrix())
    assert not any("lambda" in plan(t) for t in (counts, pairs, values, m._counted(False, m._with_slope), m._counted(False, m._with_s)))
    assert "lambda" not in plan(m.confusion_matrix(graph, [0.0, 0.5]).frame)


@pytest.mark.parametrize("thresholds", [[0.5], [0.7, 0.0, 0.3], list(np.linspace(0, 1, 13))])
def test_counts_at_thresholds_in_any_order(graph, thresholds):
    m = KINDS["fitness"](graph, param=ZM["fitness", False])
    p = np.array([r["p"] for r in m._p_counts(False).filter("w > 0").selectExpr("explode(array_repeat(p, int(w))) AS p").collect()])
    tp, fp, _, _ = m.confusion_matrix(graph, thresholds).arrays()
    assert [(p >= t).sum() if t > 0 else 12 for t in thresholds] == (tp + fp).tolist()


@pytest.mark.parametrize("kernel", [Logistic(), Exponential()])
@pytest.mark.parametrize(("x", "y"), [([1e-9, 0.0, 2.0], [1e-9, 5.0, 0.25]), ([np.inf, 1.0], [0.0, 1.0]), ([np.inf, 1.0], [1.0, 0.0]), ([1e200, 1e200], [1.0, 1.0]), ([0.0, 1e-12], [1.0, 1e-6])])
def test_layers_side_by_side(spark, kernel, x, y):
    names = [f"{c} double" for k in range(len(x)) for c in (f"x{k}", f"y{k}")]
    row = [v for pair in zip(x, y, strict=True) for v in pair]
    layers = [(1.0, f"x{k}", f"y{k}") for k in range(len(x))]
    from pyspark.sql import functions as F

    layers = [(z, F.col(a), F.col(b)) for z, a, b in layers]
    t = kernel.log_no_link(kernel.gathered(spark.createDataFrame([tuple(row)], ", ".join(names)), "held", layers), "s", layers)
    got = t.select(kernel.any_link(F.col("held")).alias("p"), kernel.no_link(F.col("held")).alias("q"), "s").first()
    rate = [0.0 if a == 0 or b == 0 else a * b for a, b in zip(x, y, strict=True)]
    want = sum(np.log1p(rate)) if isinstance(kernel, Logistic) else sum(rate)
    assert got["s"] == pytest.approx(want, rel=1e-12) and got["p"] == pytest.approx(-np.expm1(-want), rel=1e-12) and got["q"] == pytest.approx(np.exp(-want), abs=1e-300)


def test_degrees_are_made_once_for_neighbours(graph, monkeypatch):
    m = KINDS["fitness"](graph, param=ZM["fitness", False])
    calls, sums = [], type(m)._node_sums
    monkeypatch.setattr(type(m), "_node_sums", lambda self, w: calls.append(1) or sums(self, w))
    vector(m.expected_av_nn_degree(ndir="out", ddir="out"))
    assert len(calls) == 2


def test_leading_bytes_of_md5():
    from maxentnet.plans import hashed

    src, dst = np.array([0, 5, 10, 99, 100, 12345, 10**18]), np.array([3, 77, 1234, 89999, 10**12])
    limits = np.linspace(0, 1, len(src))
    got = {(int(src[a]), int(dst[b])) for i, j in hashed.low_pairs("7w", src, limits, dst) for a, b in zip(i, j, strict=True)}
    number = {(a, b): int(hashlib.md5(f"7w|{a}|{b}".encode()).hexdigest()[:8], 16) for a in src.tolist() for b in dst.tolist()}
    assert got == {(a, b) for (a, b), n in number.items() if n <= min(int(limits[src.tolist().index(a)] * 2**32), 2**32 - 1)}


@pytest.mark.parametrize("selfloops", [False, True])
@pytest.mark.parametrize("seed", [7, 10**15])  # a long seed takes the plan without digests made together
def test_conditional_sample_by_its_definition(spark, selfloops, seed):
    rng = np.random.default_rng(3)
    n = 40
    x, g = rng.integers(0, 5, n).astype(float), rng.integers(0, 4, n)
    g[:4], x[:4] = range(4), 1
    y = np.concatenate([x[:4], rng.permutation(x[4:])])
    macro = np.array([[1, 1, 0, 2], [0, 0, 3, 1], [1, 0, 1, 0], [0, 4, 0, 0]], float)
    z = 0.004
    m = M.ConditionalInvariantModel(spark, num_vertices=n, prop_out=x, prop_in=y, param=z, groups=g, adj=macro, selfloops=selfloops)
    sample = m.sample(seed=seed, portable=True, weights="wagg")
    got = {(r["src"], r["dst"]): r["w"] for r in sample.adj.collect()}
    want = {}
    for a, b in np.argwhere(macro > 0):
        pairs = [(int(i), int(j)) for i in np.where(g == a)[0] for j in np.where(g == b)[0] if x[i] * y[j] > 0 and (selfloops or i != j)]
        rates = np.array([z * x[i] * y[j] for i, j in pairs])
        left = rates[::-1].cumsum()[::-1]
        links = []
        for k, (i, j) in enumerate(pairs):
            u = int(hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            own = -np.expm1(-rates[k])
            if u < (own if links else 1.0 if k == len(pairs) - 1 else own / -np.expm1(-left[k])):
                links.append((i, j))
        total = sum(x[i] * y[j] for i, j in links)
        want |= {(i, j): macro[a, b] * x[i] * y[j] / total for i, j in links}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_conditional_sample_keeps_no_pairs(spark, monkeypatch):
    from maxentnet.plans import scratch

    rows, written = [], scratch.written
    n = 200
    m = M.ConditionalInvariantModel(spark, num_vertices=n, prop_out=np.ones(n), prop_in=np.ones(n), param=1e-5, groups=np.zeros(n, int), adj=np.ones((1, 1)))
    monkeypatch.setattr(scratch, "written", lambda df, name: (out := written(df, name), rows.append((out.count(), plan(df))))[0])
    m.sample(seed=7, portable=True)
    assert max(r for r, _ in rows) < 3 * n and not any("PARTITION BY a, b" in p or "windowspecdefinition(a#" in p for _, p in rows)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("selfloops", [False, True])
@pytest.mark.parametrize("made", [0, 10**6])
def test_degrees_by_label_with_few_and_many_distinct_fitnesses(spark, monkeypatch, kind, selfloops, made):
    from helpers import either, layers, table

    from maxentnet.operators import multi

    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 3, (30, 2)).astype(float), rng.integers(0, 6, (30, 2)).astype(float)
    x[0], y[0] = 1, 1
    monkeypatch.setattr(multi, "MADE_ROWS", made)
    m = KINDS[kind](spark, num_vertices=30, num_labels=2, prop_out=x, prop_in=y, param=np.array([0.03, 0.2]), selfloops=selfloops)
    assert ("there" in plan(m._both_ways())) == bool(made)
    p = layers(kind, np.array([0.03, 0.2]), x, y, selfloops)
    assert table(m.expected_degree_by_label(), "degree", (30, 2)) == pytest.approx(np.array([either(q).sum(1) for q in p]).T)
    assert table(m.expected_out_degree_by_label(), "out_degree", (30, 2)) == pytest.approx(p.sum(2).T)
    assert table(m.expected_in_degree_by_label(), "in_degree", (30, 2)) == pytest.approx(p.sum(1).T)


def test_edges_of_a_fit_are_those_of_its_last_step(graph, monkeypatch):
    m = KINDS["fitness"](graph, per_label=False)
    m.fit()
    want = m.expected_num_edges(recompute=True)
    m.fit()
    monkeypatch.setattr(type(m), "_num_edges", lambda self: pytest.fail("the pairs are summed again"))
    assert m.expected_num_edges() == pytest.approx(want, rel=1e-12)
