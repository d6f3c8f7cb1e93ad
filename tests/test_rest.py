import numpy as np
import pandas as pd
import pytest
from data import E4, E5, GROUPS5, IN5, KEYS, OUT5, V4, V5, Z5
from helpers import vector
from hypothesis import given, settings
from hypothesis import strategies as st

import maxentnet as M
from maxentnet.operators.solver import Newton, solve
from maxentnet.plans import pairs
from maxentnet.streaming.marginals import windowed_edges, windowed_strength


@pytest.fixture(scope="module")
def five(spark):
    return M.DiGraph(V5, E5, v_group="country", **KEYS)


def macro_of(rows):
    out = np.zeros((3, 3))
    for r in rows:
        out[GROUPS5[r["src"]], GROUPS5[r["dst"]]] += r["w"]
    return out


def conditional(z, macro, selfloops):
    p = np.zeros((5, 5))
    gx, gy = (np.bincount(GROUPS5, v, 3) for v in (OUT5, IN5))
    gd = np.bincount(GROUPS5, OUT5 * IN5, 3)
    for i in range(5):
        for j in range(5):
            a, b = GROUPS5[i], GROUPS5[j]
            if (i != j or selfloops) and macro[a, b] > 0:
                c = 1 - gd[a] / (gx[a] * gy[b]) if a == b and not selfloops else 1
                p[i, j] = np.expm1(-z * OUT5[i] * IN5[j]) / np.expm1(-z * gx[a] * gy[b] * c)
    return p


@pytest.mark.parametrize("selfloops", [False, True])
def test_conditional(five, selfloops):
    macro = macro_of(five.adj.collect())
    m = M.ConditionalInvariantModel(five, macro, selfloops=selfloops)
    m.fit()
    assert m.param[0] == pytest.approx(Z5[selfloops], rel=1e-6)
    p = conditional(m.param[0], macro, selfloops)
    assert m.expected_num_edges() == pytest.approx(7, rel=1e-6) and p.sum() == pytest.approx(7, rel=1e-6)
    assert vector(m.expected_out_degree()) == pytest.approx(p.sum(1)) and vector(m.expected_in_degree()) == pytest.approx(p.sum(0))
    und = p + p.T - p * p.T
    np.fill_diagonal(und, np.diag(p))
    assert vector(m.expected_degree()) == pytest.approx(und.sum(1))
    assert -50 < m.log_likelihood(five) < 0
    assert m.log_likelihood(np.ones((5, 5))) == -np.inf


def test_conditional_samples(five):
    macro = macro_of(five.adj.collect())
    m = M.ConditionalInvariantModel(num_vertices=5, prop_out=OUT5, prop_in=IN5, groups=GROUPS5, adj=macro, param=Z5[False])
    for seed in range(3):
        got = macro_of(m.sample(five, weights="wagg", seed=seed).adj.collect())
        assert np.abs(got - macro).max() < 1e-6
        plain = macro_of(m.sample(weights="cremb", out_strength=OUT5, in_strength=np.append(IN5[:-1], OUT5.sum() - IN5[:-1].sum()), seed=seed).adj.collect())
        assert ((plain > 0) == (macro > 0)).all()
    with pytest.raises(ValueError, match="must be set"):
        M.ConditionalInvariantModel(num_vertices=5, prop_out=OUT5, prop_in=IN5, param=1.0)


def test_pagerank_and_depth(spark):
    v = pd.DataFrame({"id": range(4)})
    e = pd.DataFrame({"s": [0, 1, 0, 2], "t": [1, 2, 2, 3], "w": [1.0, 2.0, 3.0, 1.0]})
    g = M.DiGraph(v, e, v_id="id", src="s", dst="t", weight="w")
    a = np.zeros((4, 4))
    a[e.s, e.t] = e.w
    for weighted in (True, False):
        b = a if weighted else (a > 0) * 1.0
        n = np.divide(b, b.sum(1, keepdims=True), out=np.zeros((4, 4)), where=b.sum(1, keepdims=True) > 0)
        r = np.full(4, 0.25)
        for _ in range(10):
            r = 0.85 * (n.T @ r + r[3] / 4) + 0.15 / 4
        assert vector(M.pagerank(g, max_iter=10, tol=0.0, weighted=weighted)) == pytest.approx(r, abs=1e-9)
    depth, final = np.array([0, 0, 0, 1.0]), np.array([0, 0, 0, 1.0])
    for _ in range(100):
        depth = (final + a @ (depth + 1) - a.sum(1) * 0) / (a.sum(1) + final)
    assert vector(M.trophic_depth(g, final)) == pytest.approx(depth, abs=1e-2)


@given(st.floats(1e-3, 1e3), st.floats(0.0, 10.0), st.floats(0.05, 0.95))
@settings(max_examples=60, deadline=None)
def test_solver_finds_roots(scale, x0, share):
    fun = lambda x: (scale * x / (1 + scale * x), scale / (1 + scale * x) ** 2 if x < np.inf else 0.0) if x < np.inf else (1.0, 0.0)
    s = M.monotonic_newton_solver(x0, fun, share, x_l=0.0, x_u=np.inf, full_return=True)
    assert s.converged and s.x == pytest.approx(share / (1 - share) / scale, rel=1e-6)


def test_solver_details():
    down = M.monotonic_newton_solver(0.0, lambda x: (np.exp(-x), -np.exp(-x)), 0.25)
    assert down == pytest.approx(np.log(4))
    with pytest.raises(ValueError):
        M.monotonic_newton_solver(-1.0, lambda x: (x, 1.0), 1.0, x_l=0.0)
    few = M.monotonic_newton_solver(0.0, lambda x: (x**3 + x, 3 * x**2 + 1), 1e9, max_iter=2, full_return=True)
    assert few.max_iter_reached and not few.converged
    both = solve(lambda xs, _: [(x * x, 2 * x) for x in xs], [Newton(1.0, 4.0), Newton(5.0, 9.0)])
    assert [s.x for s in both] == pytest.approx([2, 3])


def test_large_sides_are_dealt_to_blocks(spark, monkeypatch):
    a, b = spark.range(30).toDF("i"), spark.range(40).toDF("j")
    want = a.crossJoin(b).filter("i <> j").count()
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 10)
    from pyspark.sql import functions as F

    got = pairs.cross(a, b, 40, F.col("i") != F.col("j"))
    assert got.count() == got.distinct().count() == want
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_result_does_not_depend_on_partitions(spark):
    g = M.DiGraph(V4, E4, **KEYS)
    m = M.FitnessModel(g, param=1e-12)
    before = sorted(map(tuple, m.sample(seed=9).adj.collect()))
    shuffled = M.DiGraph(spark.createDataFrame(V4).repartition(7), spark.createDataFrame(E4).repartition(5), **KEYS)
    assert sorted(map(tuple, M.FitnessModel(shuffled, param=1e-12).sample(seed=9).adj.collect())) == before


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:00", s, t, float(m + 1)) for m, s, t in ((0, 1, 2), (1, 1, 2), (4, 2, 3), (7, 1, 2))]
    spark.createDataFrame(rows, "at string, s long, t long, w double").selectExpr("timestamp(at) as at", "s", "t", "w").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, s long, t long, w double").parquet(str(tmp_path / "in"))
    q = windowed_edges(stream, "at", "s", "t", "w", "5 minutes", "1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["src"], r["dst"], r["w"]) for r in spark.table("windows").collect())
    assert got == [(1, 2, 3.0), (1, 2, 8.0), (2, 3, 5.0)]
    assert windowed_strength(spark.read.parquet(str(tmp_path / "in")), "at", "s", "w", "5 minutes", "1 minute").count() == 3
