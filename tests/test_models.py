import numpy as np
import pytest
from data import ADJ4, E4, IN4, KEYS, OUT4, V4, Z4
from helpers import chances, either, log_likelihood, vector

import maxentnet as M

KINDS = {"fitness": M.FitnessModel, "invariant": M.ScaleInvariantModel}
CASES = [(k, s) for k in KINDS for s in (False, True)]


@pytest.fixture(scope="module")
def graph(spark):
    return M.DiGraph(V4, E4, **KEYS)


def model(kind, selfloops, **more):
    return KINDS[kind](**({"num_vertices": 4, "prop_out": OUT4, "prop_in": IN4, "selfloops": selfloops, "param": Z4[kind, selfloops]} | more))


@pytest.mark.parametrize(("kind", "selfloops"), CASES)
@pytest.mark.parametrize("x0", [None, 1e-14, 1e2])
def test_fit(graph, kind, selfloops, x0):
    m = KINDS[kind](graph, selfloops=selfloops)
    m.fit(x0=x0)
    assert m.param[0] == pytest.approx(Z4[kind, selfloops], rel=1e-6)
    assert m.solver_output.converged and m.expected_num_edges() == pytest.approx(5, rel=1e-7)


@pytest.mark.parametrize(("kind", "selfloops"), CASES)
def test_expected_measures(graph, kind, selfloops):
    m, p = model(kind, selfloops), chances(kind, Z4[kind, selfloops], OUT4, IN4, selfloops)
    assert m.expected_num_edges() == pytest.approx(p.sum())
    assert vector(m.expected_out_degree()) == pytest.approx(p.sum(1))
    assert vector(m.expected_in_degree()) == pytest.approx(p.sum(0))
    assert vector(m.expected_degree()) == pytest.approx(either(p).sum(1))
    prop = np.array([1.0, 2.0, 0.5, 3.0])
    for ndir, q in (("out", p), ("in", p.T), ("out-in", either(p))):
        for flag in (False, True):
            r = chances(kind, Z4[kind, selfloops], OUT4, IN4, flag)
            r = {"out": r, "in": r.T, "out-in": either(r)}[ndir]
            want = np.divide(r @ prop, r.sum(1), out=np.zeros(4), where=r.sum(1) > 0)
            assert vector(m.expected_av_nn_property(prop, ndir, flag)) == pytest.approx(want), (ndir, flag)
        degree = {"out": p.sum(1), "in": p.sum(0), "out-in": either(p).sum(1)}[ndir]
        want = np.divide(q @ degree, q.sum(1), out=np.zeros(4), where=q.sum(1) > 0)
        assert vector(m.expected_av_nn_degree(ndir=ndir, ddir=ndir, selfloops=None)) == pytest.approx(want)


@pytest.mark.parametrize(("kind", "selfloops"), CASES)
def test_likelihood_and_confusion(graph, kind, selfloops):
    m, p = model(kind, selfloops), chances(kind, Z4[kind, selfloops], OUT4, IN4, selfloops)
    want = log_likelihood(p, ADJ4, selfloops)
    assert m.log_likelihood(ADJ4) == pytest.approx(want) and m.log_likelihood(graph) == pytest.approx(want)
    never = ADJ4.copy()
    never[0, 2] = 1
    assert m.log_likelihood(never) == -np.inf
    sure = model(kind, selfloops, param=np.inf)
    assert sure.log_likelihood(np.zeros((4, 4))) == -np.inf
    keep = np.ones((4, 4), bool) if selfloops else ~np.eye(4, dtype=bool)
    ths = np.linspace(0, 1, 11)
    got = m.confusion_matrix(ADJ4, ths).arrays()
    for i, t in enumerate(ths):
        told, on = p[keep] >= t, ADJ4[keep] > 0
        assert [g[i] for g in got] == [(told & on).sum(), (told & ~on).sum(), (~told & ~on).sum(), (~told & on).sum()]
    assert len(m.confusion_matrix(ADJ4).thresholds) == 20


def test_dyadic_factor(spark):
    class Halved(M.FitnessModel):
        def prop_dyad(self, i, j):
            from pyspark.sql import functions as F

            return F.when(i < j, 0.5).otherwise(1.0)

    z = Z4["fitness", False]
    m = Halved(num_vertices=4, prop_out=OUT4, prop_in=IN4, param=z)
    c = np.where(np.arange(4)[:, None] < np.arange(4)[None, :], 0.5, 1.0)
    t = z * np.outer(OUT4, IN4) * c
    p = t / (1 + t)
    np.fill_diagonal(p, 0)
    assert m.expected_num_edges() == pytest.approx(p.sum())
    assert vector(m.expected_out_degree()) == pytest.approx(p.sum(1))
    assert m.log_likelihood(ADJ4) == pytest.approx(log_likelihood(p, ADJ4))


def test_samples(graph):
    m = model("fitness", False)
    a, b = m.sample(graph, seed=5), m.sample(graph, seed=5)
    rows = lambda g: sorted(map(tuple, g.adj.collect()))
    assert rows(a) == rows(b) and a.vertices is graph.vertices
    p = chances("fitness", Z4["fitness", False], OUT4, IN4)
    mean = np.zeros((4, 4))
    for s in range(25):
        for r in m.sample(seed=s).adj.collect():
            mean[r["src"], r["dst"]] += 1 / 25
    assert np.abs(mean - p).max() < 0.4 and (mean[p == 0] == 0).all()
    w = m.sample(weights="cremb", seed=1, selfloops=True)
    assert w.adj.filter("w <= 0").isEmpty()
    with pytest.raises(ValueError, match="Weights method"):
        m.sample(weights="none")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize(
    ("kwargs", "message"),
    [
        ({"num_vertices": None}, "Number of vertices not set."),
        ({"num_vertices": 1.5}, "Number of vertices must be an integer."),
        ({"num_vertices": -1}, "Number of vertices must be a positive number."),
        ({"prop_out": None}, "prop_out not set."),
        ({"num_edges": np.array([1, 2]), "param": None}, "Number of edges must be a number."),
        ({"num_edges": -1, "param": None}, "Number of edges must be a positive number."),
        ({"param": np.array([1.0, 2.0])}, "The model requires one parameter."),
        ({"param": "x"}, "Parameters must be numeric."),
        ({"param": -1}, "Parameters must be positive."),
        ({"param": None}, "Either num_edges or param must be set."),
        ({"other": 1}, "Illegal argument passed: other"),
    ],
)
def test_argument_errors(spark, kind, kwargs, message):
    with pytest.raises(ValueError, match=message.replace(".", r"\.")):
        model(kind, False, **kwargs)


def test_more_errors(spark, graph):
    m = M.FitnessModel(graph)
    for args, message in (({"method": "mle"}, "Method not implemented"), ({"method": "x"}, "selected method"), ({"x0": -1}, "x0 must be positive"), ({"x0": "a"}, "x0 must be numeric")):
        with pytest.raises(ValueError, match=message):
            m.fit(**args)
    with pytest.raises(Exception, match="fitted before"):
        m.expected_degree()
    with pytest.raises(AssertionError, match="positive values"):
        model("fitness", False, prop_out=-OUT4)
    with pytest.raises(ValueError, match="must be a DiGraph"):
        M.FitnessModel("graph")
    with pytest.warns(UserWarning, match="have been ignored"):
        M.FitnessModel(graph, 1)
    with pytest.raises(ValueError, match="correct shape"):
        model("fitness", False).log_likelihood(np.zeros((3, 3)))
    with pytest.raises(ValueError, match="not a graph"):
        model("fitness", False).log_likelihood("x")


def test_constant_chance(graph):
    m = M.RandomDiGraph(graph)
    m.fit()
    assert m.param[0] == pytest.approx(5 / 12)
    assert M.RandomDiGraph(num_vertices=4, num_edges=5, selfloops=True).fit() is None
    p = np.full((4, 4), 5 / 12)
    np.fill_diagonal(p, 0)
    assert m.expected_num_edges() == pytest.approx(5) and vector(m.expected_degree()) == pytest.approx(either(p).sum(1))
    assert m.log_likelihood(ADJ4) == pytest.approx(log_likelihood(p, ADJ4))
    assert m.expected_total_weight() == pytest.approx(graph.total_weight())
    assert m.confusion_matrix(ADJ4, [0.0, 0.5]).arrays()[0].tolist() == [5, 0]
    one = M.RandomDiGraph(num_vertices=4, param=1.0)
    assert one.log_likelihood(np.ones((4, 4)) - np.eye(4)) == 0 and one.log_likelihood(ADJ4) == -np.inf
    w = M.RandomDiGraph(num_vertices=20, param=np.array([0.5, 0.3]), discrete_weights=True).sample(weights="random", seed=1)
    values = [r["w"] for r in w.adj.collect()]
    assert min(values) == 1 and all(v == int(v) for v in values) and 1.1 < np.mean(values) < 1.9


@pytest.mark.parametrize("selfloops", [False, True])
def test_draws_make_no_list_of_pairs(spark, selfloops):
    n = 400
    rng = np.random.default_rng(5)
    x, y = rng.pareto(1.5, n) * (rng.random(n) < 0.8), np.ones(n)
    m = M.FitnessModel(num_vertices=n, prop_out=x, prop_in=y, param=0.01, selfloops=selfloops)
    p = 0.01 * np.outer(x, y) / (1 + 0.01 * np.outer(x, y))
    if not selfloops:
        np.fill_diagonal(p, 0)
    drawn = [m._drawn(selfloops, seed, False) for seed in range(12)]
    made = np.array([d.count() for d in drawn])
    spread = np.sqrt((p * (1 - p)).sum() / len(made))
    assert abs(made.mean() - p.sum()) < 5 * spread
    hub = int(np.argmax(x))
    assert abs(np.mean([d.filter(f"src = {hub}").count() for d in drawn]) - p[hub].sum()) < 5 * np.sqrt((p[hub] * (1 - p[hub])).sum() / len(made))
    plan = drawn[0]._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert drawn[0].filter("src = dst").count() in ((0,) if not selfloops else range(n))


def test_draws_go_on_until_every_place_is_passed(spark, monkeypatch):
    from pyspark.sql import functions as F

    from maxentnet.plans import draw

    whole = sorted(map(tuple, M.RandomDiGraph(num_vertices=60, param=0.5).sample(seed=3).adj.collect()))
    monkeypatch.setattr(draw.F, "ceil", lambda _: F.lit(2))  # two gaps at a time
    assert sorted(map(tuple, M.RandomDiGraph(num_vertices=60, param=0.5).sample(seed=3).adj.collect())) == whole


def test_certain_links_are_drawn(spark):
    assert M.RandomDiGraph(num_vertices=7, param=1.0).sample(seed=1).num_edges() == 42
    assert M.RandomDiGraph(num_vertices=7, param=0.0).sample(seed=1).num_edges() == 0


def test_blocks_of_pairs(graph):
    a, b = M.FitnessModel(graph, param=1e-12), M.FitnessModel(graph, param=1e-12, p_blocks=3)
    assert b.expected_num_edges() == pytest.approx(a.expected_num_edges())
    assert vector(b.expected_degree()) == pytest.approx(vector(a.expected_degree()))
