"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL for the same rows.

Three graphs: ``gm``, customers to suppliers by quantity (layers by return flag, groups by nation); ``gn``, supplier nations to customer
nations (layers by order priority, groups by region); ``ge``, users to the users of the next event of a day (layers by event type,
groups by id modulo 5). A graph's tables are written once a session and folder, and its queries share them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import maxentnet as M
from maxentnet.plans import scratch

THRESHOLDS = (0.0, 0.2, 0.4, 0.6, 0.8)
#: By then the ranks of these graphs no longer change; the operator stops by its own test.
RANK_STEPS = 40
_GRAPHS: dict = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _shared(build: Callable) -> Callable:
    """The graph of a session and folder, built once while its tables are there."""

    @wraps(build)
    def graph(spark: SparkSession, d: str, *kind, **more):
        key = (build.__name__, spark.sparkContext.applicationId, d, kind, tuple(sorted(more.items())))
        held = _GRAPHS.get(key)
        if held is None or not scratch.exists(held.vertices):
            held = _GRAPHS[key] = build(spark, d, *kind, **more)
        return held

    return graph


def gm_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _read(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = _read(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    lines = _read(spark, d, "lineitem").join(_read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(F.lit("customer").alias("src_kind"), F.col("o_custkey").alias("src_id"), F.lit("supplier").alias("dst_kind"), F.col("l_suppkey").alias("dst_id"), "l_quantity", "l_returnflag")
    return c.unionByName(s), edges


@_shared
def _gm(spark, d, multi=False):
    v, e = gm_tables(spark, d)
    args = {"v_id": ["kind", "id"], "src": ["src_kind", "src_id"], "dst": ["dst_kind", "dst_id"], "weight": "l_quantity", "v_group": "nation"}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        return M.MultiDiGraph(v, e, edge_label="l_returnflag", **args) if multi else M.DiGraph(v, e, **args)


@_shared
def _gn(spark, d, multi=False, directed=True):
    v = _read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    e = _read(spark, d, "lineitem").join(_read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.select("s_nationkey", "c_nationkey", "l_quantity", "o_orderpriority")
    args = {"v_id": "n_nationkey", "src": "s_nationkey", "dst": "c_nationkey", "weight": "l_quantity", "v_group": "n_regionkey"}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        if multi:
            return (M.MultiDiGraph if directed else M.MultiGraph)(v, e, edge_label="o_orderpriority", **args)
        return (M.DiGraph if directed else M.Graph)(v, e, **args)


@_shared
def _ge(spark, d, multi=False, directed=True):
    t = _read(spark, d, "events").filter("value > 0")
    day = W.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    e = t.withColumn("next", F.lead("user_id").over(day)).filter("next IS NOT NULL").select("user_id", "next", F.ceil("value").cast("double").alias("w"), "event_type")
    v = e.select("user_id").union(e.select("next")).distinct().withColumn("g", F.col("user_id") % 5)
    args = {"v_id": "user_id", "src": "user_id", "dst": "next", "weight": "w", "v_group": "g"}
    if multi:
        return (M.MultiDiGraph if directed else M.MultiGraph)(v, e, edge_label="event_type", **args)
    return (M.DiGraph if directed else M.Graph)(v, e, **args)


GM_SQL = """WITH v AS (SELECT row_number() OVER (ORDER BY kind, id) - 1 AS vid, kind, id, dense_rank() OVER (ORDER BY nation) - 1 AS g FROM (SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier)),
le0 AS (SELECT s.vid AS src, t.vid AS dst, l_quantity AS w, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN v s ON s.kind = 'customer' AND s.id = o_custkey JOIN v t ON t.kind = 'supplier' AND t.id = l_suppkey),
"""
GN_SQL = """WITH v AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS vid, n_nationkey AS id, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS g FROM nation),
le0 AS (SELECT s.vid AS src, t.vid AS dst, l_quantity AS w, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN v s ON s.id = s_nationkey JOIN v t ON t.id = c_nationkey),
"""
GE_SQL = """WITH ev AS (SELECT user_id, lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS nxt, ceil(value) AS w, event_type FROM events WHERE value > 0),
pr AS (SELECT * FROM ev WHERE nxt IS NOT NULL),
v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS vid, id, dense_rank() OVER (ORDER BY id % 5) - 1 AS g FROM (SELECT user_id AS id FROM pr UNION SELECT nxt FROM pr)),
le0 AS (SELECT s.vid AS src, t.vid AS dst, w, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM pr JOIN v s ON s.id = user_id JOIN v t ON t.id = nxt),
"""
#: Consolidated layers, projected edges, both ways of them, strengths, degrees.
BASE_SQL = """le AS (SELECT k, src, dst, sum(w) AS w FROM le0 GROUP BY ALL), e AS (SELECT src, dst, sum(w) AS w FROM le GROUP BY ALL),
u AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e WHERE src <> dst) GROUP BY ALL),
n AS (SELECT vid, coalesce((SELECT sum(w) FROM e WHERE src = vid), 0)::DOUBLE AS x, coalesce((SELECT sum(w) FROM e WHERE dst = vid), 0)::DOUBLE AS y FROM v),
o AS (SELECT (SELECT count(*) FROM e)::DOUBLE AS l, (SELECT sum(w) FROM e)::DOUBLE AS tw),
d AS (SELECT vid, (SELECT count(*) FROM e WHERE src = vid) AS d_out, (SELECT count(*) FROM e WHERE dst = vid) AS d_in, (SELECT count(*) FROM u WHERE src = vid) AS d_und FROM v)
"""
GM, GN, GE = (g + BASE_SQL for g in (GM_SQL, GN_SQL, GE_SQL))
#: With z = L / W^2: chances of pairs that may be linked.
LOGISTIC, EXPONENTIAL = "(l / tw / tw * a.x * b.y) / (1 + l / tw / tw * a.x * b.y)", "1 - exp(-(l / tw / tw * a.x * b.y))"


def _pairs(p: str) -> str:
    return f", pp AS (SELECT a.vid AS i, b.vid AS j, {p} AS p FROM n a, n b, o WHERE a.vid <> b.vid), pq AS (SELECT s.i, s.j, s.p, t.p AS q FROM pp s JOIN pp t ON s.i = t.j AND s.j = t.i)\n"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else c for c, t in df.dtypes))


def _one(spark: SparkSession, **values) -> DataFrame:
    """A row of numbers, to six digits of the largest scale that they have."""
    row = {k: float(v) if isinstance(v, (float, np.floating)) else int(v) for k, v in values.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in row.items()))


def _z0(g) -> float:
    return g.num_edges() / g.total_weight() / g.total_weight()


def _model(g, kind):
    return {"fitness": M.FitnessModel, "invariant": M.ScaleInvariantModel}[kind](g, param=_z0(g))


def _multi(g, kind="fitness", **more):
    return {"fitness": M.MultiFitnessModel, "invariant": M.MultiInvariantModel}[kind](g, param=_z0(g), **more)


Q: dict[str, Callable] = {}
S: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        Q[key] = f
        if sql is not None:
            S[key] = sql
        return f

    return add


# ingestion and views


@query(GM + "SELECT vid, kind, id, g AS group_id FROM v")
def ingest_vertices_gm(spark, d):
    return _gm(spark, d).vertices.select("vid", F.col("node_key.k0").alias("kind"), F.col("node_key.k1").alias("id"), "group_id")


@query(GM + "SELECT src, dst, w FROM e")
def edges_consolidated_gm(spark, d):
    return _gm(spark, d).adjacency_matrix()


@query(GE_SQL.split("\nv AS (")[0] + " v AS (SELECT id FROM (SELECT user_id AS id FROM pr UNION SELECT nxt FROM pr UNION SELECT c_custkey FROM customer)) SELECT id FROM v WHERE id NOT IN (SELECT user_id FROM pr UNION SELECT nxt FROM pr)")
def isolated_vertices_ge(spark, d):
    """Customers beside the users: those that have no event are isolated."""
    g = _ge(spark, d)
    users = g.adj.join(g.vertices.select(F.col("vid").alias("src"), F.col("node_key.k0").alias("a")), "src").join(g.vertices.select(F.col("vid").alias("dst"), F.col("node_key.k0").alias("b")), "dst").select("a", "b", "w")
    v = _read(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(g.vertices.select("node_key.k0")).distinct()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        wider = M.DiGraph(v, users, v_id="id", src="a", dst="b", weight="w")
    return wider.vertices.join(wider.degree(), "vid").filter("degree = 0").select(F.col("node_key.k0").alias("id"))


@query(GN + "SELECT k AS label_id, src, dst, w FROM le")
def tensor_gn(spark, d):
    return _gn(spark, d, True).adjacency_tensor()


@query(GN + "SELECT DISTINCT k AS label_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM le")
def tensor_undirected_gn(spark, d):
    return _gn(spark, d, True, False).adjacency_tensor(weighted=False).filter("src <= dst")


@query(GN + "SELECT src, dst, w FROM u")
def adj_undirected_weighted_gn(spark, d):
    return _gn(spark, d).adjacency_matrix(directed=False)


@query(GN + "SELECT src, dst FROM u")
def adj_undirected_binary_gn(spark, d):
    return _gn(spark, d, directed=False).adjacency_matrix(weighted=False)


@query(GN + "SELECT (SELECT count(*) FROM e) AS directed, (SELECT count(*) FROM u WHERE src <= dst) AS undirected, (SELECT sum(w) FROM e) AS weight")
def num_edges_gn(spark, d):
    g, u = _gn(spark, d), _gn(spark, d, directed=False)
    return _one(spark, directed=g.num_edges(), undirected=u.num_edges(), weight=u.total_weight())


@query(GM + "SELECT k AS label_id, count(*) AS num_edges, sum(w) AS total_weight FROM le GROUP BY k")
def measures_label_gm(spark, d):
    g = _gm(spark, d, True)
    return g.num_edges_label().join(g.total_weight_label(), "label_id")


# marginals of observed graphs


@query(GE + "SELECT vid, d_und AS degree, d_out AS out_degree, d_in AS in_degree FROM d")
def degree_ge(spark, d):
    g = _ge(spark, d)
    return g.degree().join(g.out_degree(), "vid").join(g.in_degree(), "vid")


@query(GM + "SELECT vid, x AS out_strength, y AS in_strength, x + y AS strength FROM n")
def strength_gm(spark, d):
    g = _gm(spark, d)
    return g.out_strength().join(g.in_strength(), "vid").join(g.strength(), "vid")


for _name, _view, _end in (("", "u", "src"), ("out_", "e", "src"), ("in_", "e", "dst")):
    _other = "dst" if _end == "src" else "src"
    _sql = GN + f"SELECT {_end} AS vid, t.g AS group_id, count(*) AS degree, sum(w)::DOUBLE AS strength FROM {_view} JOIN v t ON t.vid = {_other} GROUP BY ALL"

    def _f(spark, d, name=_name):
        g = _gn(spark, d)
        deg, strength = getattr(g, f"{name}degree_by_group")(), getattr(g, f"{name}strength_by_group")()
        return deg.join(strength, ["vid", "group_id"]).toDF("vid", "group_id", "degree", "strength")

    query(_sql, f"{_name}by_group_gn")(_f)


@query(GE + "SELECT vid, k AS label_id, count(DISTINCT o) AS degree, sum(w)::DOUBLE AS strength FROM (SELECT k, src AS vid, dst AS o, w FROM le UNION ALL SELECT k, dst, src, w FROM le WHERE src <> dst) GROUP BY ALL")
def by_label_ge(spark, d):
    g = _ge(spark, d, True)
    return g.degree_by_label().join(g.strength_by_label(), ["vid", "label_id"])


@query(GE + "SELECT src AS vid, k AS label_id, count(*) AS out_degree, sum(w)::DOUBLE AS out_strength FROM le GROUP BY ALL")
def out_by_label_ge(spark, d):
    g = _ge(spark, d, True)
    return g.out_degree_by_label().join(g.out_strength_by_label(), ["vid", "label_id"])


@query(GE + "SELECT dst AS vid, k AS label_id, count(*) AS in_degree, sum(w)::DOUBLE AS in_strength FROM le GROUP BY ALL")
def in_by_label_ge(spark, d):
    g = _ge(spark, d, True)
    return g.in_degree_by_label().join(g.in_strength_by_label(), ["vid", "label_id"])


_NN = {"out": ("e", "src", "dst"), "in": ("e", "dst", "src"), "out-in": ("u", "src", "dst")}
_DEG = {"out": "d_out", "in": "d_in", "out-in": "d_und"}
for _nd, (_view, _end, _other) in _NN.items():

    def _f(spark, d, nd=_nd):
        g = _ge(spark, d)
        return _rounded(g.average_nn_property(g.vertices.select("vid", F.col("vid").cast("double").alias("p")), nd))

    _short = _nd.replace("out-in", "und")
    query(GE + f"SELECT v.vid, round(coalesce(s / c, 0), 6) AS av_nn FROM v LEFT JOIN (SELECT {_end} AS i, sum(CASE WHEN src <> dst THEN {_other} ELSE 0 END)::DOUBLE AS s, count(*) AS c FROM {_view} GROUP BY ALL) m ON m.i = v.vid", f"avnn_property_{_short}_ge")(_f)
    for _dd, _col in _DEG.items():

        def _f(spark, d, nd=_nd, dd=_dd):
            return _rounded(_ge(spark, d).average_nn_degree(ndir=nd, ddir=dd))

        query(GE + f"SELECT v.vid, round(coalesce(s / c, 0), 6) AS av_nn FROM v LEFT JOIN (SELECT {_end} AS i, sum(CASE WHEN src <> dst THEN d.{_col} ELSE 0 END)::DOUBLE AS s, count(*) AS c FROM {_view} JOIN d ON d.vid = {_other} GROUP BY ALL) m ON m.i = v.vid", f"avnn_degree_{_short}_{_dd.replace('out-in', 'und')}_ge")(_f)


# constant chance


@query(GE + "SELECT round(l / (c * (c - 1)), 9) AS p, round(l / tw, 9) AS q, round(tw, 6) AS weight, round(l * ln(l / (c * (c - 1))) + (c * (c - 1) - l) * ln(1 - l / (c * (c - 1))), 4) AS loglik FROM (SELECT count(*)::DOUBLE AS c FROM v), (SELECT count(*) FILTER (WHERE src <> dst)::DOUBLE AS l, sum(w)::DOUBLE AS tw FROM e WHERE src <> dst)")
def er_fit_ge(spark, d):
    g = _ge(spark, d)
    edges = g.adjacency_matrix().filter("src <> dst")
    r = edges.agg(F.count("*").alias("l"), F.sum("w").alias("w")).first()
    m = M.RandomDiGraph(spark, num_vertices=g.num_vertices, num_edges=r["l"], total_weight=r["w"])
    m.fit()
    return _rounded(_rounded(_one(spark, p=float(m.param[0]), q=float(m.param[1]), weight=float(m.expected_total_weight()), loglik=m.log_likelihood(edges)), 9).withColumns({"weight": F.round("weight", 6), "loglik": F.round("loglik", 4)}), 9)


@query(GE + "SELECT vid, round(c * 0.01, 6) AS out_degree, round((0.02 - 0.0001) * c, 6) AS degree, round((s - vid) / c, 6) AS av_nn FROM v, (SELECT count(*) - 1 AS c, sum(vid)::DOUBLE AS s FROM v)")
def er_expected_ge(spark, d):
    g = _ge(spark, d)
    m = M.RandomDiGraph(g, param=0.01)
    nn = m.expected_av_nn_property(g.vertices.select("vid", F.col("vid").cast("double").alias("p")))
    return _rounded(m.expected_out_degree().join(m.expected_degree(), "vid").join(nn, "vid"))


# fitness and invariant models

for _kind, _p in (("fitness", LOGISTIC), ("invariant", EXPONENTIAL)):

    def _f(spark, d, kind=_kind):
        return _rounded(_one(spark, edges=_model(_gm(spark, d), kind).expected_num_edges()), 4)

    query(GM + f"SELECT round(sum({_p}), 4) AS edges FROM n a, n b, o WHERE a.vid <> b.vid AND a.x > 0 AND b.y > 0", f"{_kind}_exp_edges_gm")(_f)

    def _f(spark, d, kind=_kind):
        m = _model(_ge(spark, d), kind)
        return _rounded(m.expected_degree().join(m.expected_out_degree(), "vid").join(m.expected_in_degree(), "vid"))

    query(GE + _pairs(_p) + "SELECT i AS vid, round(sum(p + q - p * q), 6) AS degree, round(sum(p), 6) AS out_degree, round(sum(q), 6) AS in_degree FROM pq GROUP BY i", f"{_kind}_exp_degree_ge")(_f)

    for _nd, _chance in (("out", "p"), ("in", "q"), ("out-in", "p + q - p * q")):
        for _dd, _ddc in (("out", "p"), ("in", "q"), ("out-in", "p + q - p * q")):

            def _f(spark, d, kind=_kind, nd=_nd, dd=_dd):
                return _rounded(_model(_ge(spark, d), kind).expected_av_nn_degree(ndir=nd, ddir=dd))

            query(GE + _pairs(_p) + f", k AS (SELECT i, sum({_ddc}) AS k, sum({_chance}) AS c FROM pq GROUP BY i) SELECT pq.i AS vid, round(CASE WHEN any_value(o.c) > 0 THEN sum(({_chance}) * t.k) / any_value(o.c) ELSE 0 END, 6) AS av_nn FROM pq JOIN k t ON t.i = pq.j JOIN k o ON o.i = pq.i GROUP BY pq.i", f"{_kind}_avnn_{_nd.replace('out-in', 'und')}_{_dd.replace('out-in', 'und')}_ge")(_f)

    def _f(spark, d, kind=_kind):
        g = _ge(spark, d)
        return _rounded(_one(spark, loglik=_model(g, kind).log_likelihood(g)), 3)

    query(GE + _pairs(_p) + "SELECT round(sum(CASE WHEN e.src IS NOT NULL THEN ln(p) WHEN p > 0 THEN ln(1 - p) ELSE 0 END), 3) AS loglik FROM pp LEFT JOIN e ON e.src = i AND e.dst = j", f"loglik_{_kind}_ge")(_f)

    def _f(spark, d, kind=_kind):
        g = _ge(spark, d)
        return _model(g, kind).confusion_matrix(g, list(THRESHOLDS)).frame.drop("at")

    query(GE + _pairs(_p) + f", t AS (SELECT unnest({list(THRESHOLDS)})::DOUBLE AS threshold), x AS (SELECT p, e.src IS NOT NULL AS on_ FROM pp LEFT JOIN e ON e.src = i AND e.dst = j) SELECT threshold, count(*) FILTER (WHERE p >= threshold AND on_) AS tp, count(*) FILTER (WHERE p >= threshold AND NOT on_) AS fp, count(*) FILTER (WHERE p < threshold AND NOT on_) AS tn, count(*) FILTER (WHERE p < threshold AND on_) AS fn FROM x, t GROUP BY threshold", f"confusion_{_kind}_ge")(_f)

    def _f(spark, d, kind=_kind):
        g = _gm(spark, d)
        m = {"fitness": M.FitnessModel, "invariant": M.ScaleInvariantModel}[kind](g)
        m.fit()
        return _rounded(_one(spark, log_z=float(np.log(m.param[0])), edges=m.expected_num_edges()), 5)

    _value, _slope = ("z * xy / (1 + z * xy)", "xy / ((1 + z * xy) * (1 + z * xy))") if _kind == "fitness" else ("1 - exp(-z * xy)", "xy * exp(-z * xy)")
    query("WITH RECURSIVE " + GM[5:] + f", xs AS (SELECT x, count(*)::DOUBLE AS c FROM n WHERE x > 0 GROUP BY x), ys AS (SELECT y, count(*)::DOUBLE AS c FROM n WHERE y > 0 GROUP BY y), m AS (SELECT x * y AS xy, xs.c * ys.c AS c FROM xs, ys), nw AS (SELECT 0 AS it, 0.0::DOUBLE AS z, 0.0::DOUBLE AS s UNION ALL SELECT it + 1, z + (l - s1) / d1, s1 FROM (SELECT it, z, any_value(l) AS l, sum(c * ({_value})) AS s1, sum(c * {_slope}) AS d1 FROM nw, m, o WHERE it < 14 GROUP BY it, z)) SELECT round(ln(z), 5) AS log_z, round(s, 5) AS edges FROM nw WHERE it = 14", f"{_kind}_fit_gm")(_f)


# several layers

_ML = ", ln_ AS (SELECT vid, k, coalesce((SELECT sum(w) FROM le WHERE src = vid AND le.k = kk.k), 0)::DOUBLE AS x, coalesce((SELECT sum(w) FROM le WHERE dst = vid AND le.k = kk.k), 0)::DOUBLE AS y FROM v, (SELECT DISTINCT k FROM le) kk)"
_MLG = ", ln_ AS (SELECT vid, k, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM (SELECT src AS vid, k, w AS x, 0 AS y FROM le UNION ALL SELECT dst, k, 0, w FROM le) GROUP BY ALL)"
_LP = ", lp AS (SELECT a.k, a.vid AS i, b.vid AS j, l / tw / tw * a.x * b.y AS t FROM ln_ a JOIN ln_ b ON a.k = b.k AND a.vid <> b.vid, o)"

for _kind, _value, _term in (("fitness", "t / (1 + t)", "ln(1 + t)"), ("invariant", "1 - exp(-t)", "t")):

    def _f(spark, d, kind=_kind):
        return _rounded(_multi(_gm(spark, d, True), kind).expected_num_edges_label(), 4)

    query(GM + _MLG + f", xs AS (SELECT k, x, count(*)::DOUBLE AS c FROM ln_ WHERE x > 0 GROUP BY ALL), ys AS (SELECT k, y, count(*)::DOUBLE AS c FROM ln_ WHERE y > 0 GROUP BY ALL), m AS (SELECT xs.k, l / tw / tw * x * y AS t, xs.c * ys.c AS c FROM xs JOIN ys ON xs.k = ys.k, o) SELECT k AS label_id, round(sum(c * ({_value})), 4) AS num_edges FROM m GROUP BY k", f"multi_{_kind}_exp_edges_label_gm")(_f)

    def _f(spark, d, kind=_kind):
        m = _multi(_ge(spark, d, True), kind)
        keys = ["vid", "label_id"]
        return _rounded(m.expected_degree_by_label().join(m.expected_out_degree_by_label(), keys).join(m.expected_in_degree_by_label(), keys))

    query(GE + _MLG + _LP + f", q AS (SELECT s.k, s.i, {_value.replace('t', 's.t').replace('exs.tp', 'exp')} AS p, {_value.replace('t', 'r.t').replace('exr.tp', 'exp')} AS q FROM lp s JOIN lp r ON s.k = r.k AND s.i = r.j AND s.j = r.i) SELECT i AS vid, k AS label_id, round(sum(p + q - p * q), 6) AS degree, round(sum(p), 6) AS out_degree, round(sum(q), 6) AS in_degree FROM q GROUP BY i, k", f"multi_{_kind}_exp_degree_label_ge")(_f)

    def _f(spark, d, kind=_kind):
        m = _multi(_ge(spark, d, True), kind)
        return _rounded(m.expected_degree().join(m.expected_out_degree(), "vid").join(m.expected_in_degree(), "vid"))

    _proj = GE + _MLG + _LP + f", pp AS (SELECT i, j, 1 - exp(-sum({_term})) AS p FROM lp GROUP BY i, j)"
    query(_proj + ", pz AS (SELECT a.vid AS i, b.vid AS j, coalesce(s.p, 0) AS p, coalesce(t.p, 0) AS q FROM v a JOIN v b ON a.vid <> b.vid LEFT JOIN pp s ON s.i = a.vid AND s.j = b.vid LEFT JOIN pp t ON t.i = b.vid AND t.j = a.vid) SELECT i AS vid, round(sum(p + q - p * q), 6) AS degree, round(sum(p), 6) AS out_degree, round(sum(q), 6) AS in_degree FROM pz GROUP BY i", f"multi_{_kind}_projected_degree_ge")(_f)

    def _f(spark, d, kind=_kind):
        g = _ge(spark, d, True)
        m = _multi(g, kind)
        return _rounded(_one(spark, projected=m.log_likelihood(g.adjacency_matrix()), layers=m.log_likelihood(g)), 3)

    query(_proj + f" SELECT (SELECT round(sum(CASE WHEN e.src IS NOT NULL THEN ln(p) WHEN p > 0 THEN ln(1 - p) ELSE 0 END), 3) FROM pp LEFT JOIN e ON e.src = i AND e.dst = j) AS projected, (SELECT round(sum(CASE WHEN le.src IS NOT NULL THEN ln({_value}) WHEN t > 0 THEN -({_term}) ELSE 0 END), 3) FROM lp LEFT JOIN le ON le.src = i AND le.dst = j AND le.k = lp.k) AS layers", f"multi_{_kind}_loglik_ge")(_f)

    def _f(spark, d, kind=_kind):
        m = {"fitness": M.MultiFitnessModel, "invariant": M.MultiInvariantModel}[kind](_gm(spark, d, True))
        m.fit()
        return _rounded(spark.createDataFrame([(k, float(np.log(z))) for k, z in enumerate(m.param)], "label_id long, log_z double"), 5)

    _v, _s = ("z * xy / (1 + z * xy)", "xy / ((1 + z * xy) * (1 + z * xy))") if _kind == "fitness" else ("1 - exp(-z * xy)", "xy * exp(-z * xy)")
    query("WITH RECURSIVE " + GM[5:] + _MLG + f", xs AS (SELECT k, x, count(*)::DOUBLE AS c FROM ln_ WHERE x > 0 GROUP BY ALL), ys AS (SELECT k, y, count(*)::DOUBLE AS c FROM ln_ WHERE y > 0 GROUP BY ALL), m AS (SELECT xs.k, x * y AS xy, xs.c * ys.c AS c FROM xs JOIN ys ON xs.k = ys.k), lk AS (SELECT k, count(*)::DOUBLE AS l FROM le GROUP BY k), nw AS (SELECT k, 0 AS it, 0.0::DOUBLE AS z FROM lk UNION ALL SELECT k, it + 1, z + (l - s1) / d1 FROM (SELECT nw.k, it, z, any_value(l) AS l, sum(c * ({_v})) AS s1, sum(c * {_s}) AS d1 FROM nw JOIN m ON m.k = nw.k JOIN lk ON lk.k = nw.k WHERE it < 14 GROUP BY nw.k, it, z)) SELECT k AS label_id, round(ln(z), 5) AS log_z FROM nw WHERE it = 14", f"multi_{_kind}_fit_label_gm")(_f)


for _kind, _term, _slope in (("fitness", "ln(1 + z * xy)", "xy / (1 + z * xy)"), ("invariant", "z * xy", "xy")):

    def _f(spark, d, kind=_kind):
        m = {"fitness": M.MultiFitnessModel, "invariant": M.MultiInvariantModel}[kind](_ge(spark, d, True), per_label=False)
        m.fit()
        return _rounded(_one(spark, log_z=float(np.log(m.param[0])), edges=m.expected_num_edges()), 4)

    query("WITH RECURSIVE " + GE[5:] + _MLG + f", lx AS (SELECT a.k, a.vid AS i, b.vid AS j, a.x * b.y AS xy FROM ln_ a JOIN ln_ b ON a.k = b.k AND a.vid <> b.vid AND a.x > 0 AND b.y > 0), nw AS (SELECT 0 AS it, 0.0::DOUBLE AS z, 0.0::DOUBLE AS s UNION ALL SELECT it + 1, z + (l - s1) / d1, s1 FROM (SELECT it, z, any_value(l) AS l, sum(1 - exp(-s)) AS s1, sum(exp(-s) * sl) AS d1 FROM (SELECT it, z, i, j, sum({_term}) AS s, sum({_slope}) AS sl FROM nw, lx WHERE it < 14 GROUP BY it, z, i, j), o GROUP BY it, z)) SELECT round(ln(z), 4) AS log_z, round(s, 4) AS edges FROM nw WHERE it = 14", f"multi_{_kind}_fit_single_ge")(_f)

    _proj = GE + _MLG + _LP + f", pp AS (SELECT i, j, 1 - exp(-sum({'ln(1 + t)' if _kind == 'fitness' else 't'})) AS p FROM lp GROUP BY i, j), pq AS (SELECT a.vid AS i, b.vid AS j, coalesce(s.p, 0) AS p, coalesce(t.p, 0) AS q FROM v a JOIN v b ON a.vid <> b.vid LEFT JOIN pp s ON s.i = a.vid AND s.j = b.vid LEFT JOIN pp t ON t.i = b.vid AND t.j = a.vid)"
    for _nd, _chance in (("out", "p"), ("in", "q"), ("out-in", "p + q - p * q")):

        def _f(spark, d, kind=_kind, nd=_nd):
            return _rounded(_multi(_ge(spark, d, True), kind).expected_av_nn_degree(ndir=nd, ddir="out"))

        query(_proj + f", k AS (SELECT i, sum(p) AS k, sum({_chance}) AS c FROM pq GROUP BY i) SELECT pq.i AS vid, round(CASE WHEN any_value(o.c) > 0 THEN sum(({_chance}) * t.k) / any_value(o.c) ELSE 0 END, 6) AS av_nn FROM pq JOIN k t ON t.i = pq.j JOIN k o ON o.i = pq.i GROUP BY pq.i", f"multi_{_kind}_avnn_{_nd.replace('out-in', 'und')}_out_ge")(_f)

    def _f(spark, d, kind=_kind):
        g = _ge(spark, d, True)
        return _multi(g, kind).confusion_matrix(g, list(THRESHOLDS)).frame.drop("at")

    query(_proj + f", t AS (SELECT unnest({list(THRESHOLDS)})::DOUBLE AS threshold), x AS (SELECT p, e.src IS NOT NULL AS on_ FROM pq LEFT JOIN e ON e.src = i AND e.dst = j) SELECT threshold, count(*) FILTER (WHERE p >= threshold AND on_) AS tp, count(*) FILTER (WHERE p >= threshold AND NOT on_) AS fp, count(*) FILTER (WHERE p < threshold AND NOT on_) AS tn, count(*) FILTER (WHERE p < threshold AND on_) AS fn FROM x, t GROUP BY threshold", f"confusion_multi_{_kind}_ge")(_f)


@query(GE + _pairs(LOGISTIC) + ", h AS (SELECT min(p) FILTER (WHERE p > 0) AS lo, max(p) AS hi FROM pp), t AS (SELECT i AS \"at\", CASE i WHEN 0 THEN lo WHEN 11 THEN hi ELSE lo * (hi / lo) ** (i / 11.0) END AS threshold FROM h, range(12) r(i)), x AS (SELECT p, e.src IS NOT NULL AS on_ FROM pp LEFT JOIN e ON e.src = i AND e.dst = j) SELECT \"at\", round(ln(threshold), 6) AS log_threshold, count(*) FILTER (WHERE p >= threshold AND on_) AS tp, count(*) FILTER (WHERE p >= threshold AND NOT on_) AS fp, count(*) FILTER (WHERE p < threshold AND NOT on_) AS tn, count(*) FILTER (WHERE p < threshold AND on_) AS fn FROM x, t GROUP BY ALL")
def confusion_automatic_ge(spark, d):
    g = _ge(spark, d)
    t = _model(g, "fitness").confusion_matrix(g, 12).frame
    return t.select(F.col("at").cast("long").alias("at"), F.round(F.log("threshold"), 6).alias("log_threshold"), "tp", "fp", "tn", "fn")


@query(GE + _pairs(LOGISTIC).replace(" WHERE a.vid <> b.vid", "") + ", k AS (SELECT i, sum(p) AS d_out, sum(q) AS d_in, sum(CASE WHEN i = j THEN p ELSE p + q - p * q END) AS d_und FROM pq GROUP BY i) SELECT k.i AS vid, round(d_out, 6) AS out_degree, round(d_in, 6) AS in_degree, round(d_und, 6) AS degree, round(CASE WHEN d_out > 0 THEN s / d_out ELSE 0 END, 6) AS av_nn FROM k JOIN (SELECT pq.i, sum(p * t.d_out) AS s FROM pq JOIN k t ON t.i = pq.j GROUP BY pq.i) USING (i)")
def fitness_selfloops_ge(spark, d):
    g = _ge(spark, d)
    m = M.FitnessModel(g, param=_z0(g), selfloops=True)
    nn = m.expected_av_nn_degree(ddir="out", ndir="out", selfloops=True)
    return _rounded(m.expected_out_degree().join(m.expected_in_degree(), "vid").join(m.expected_degree(), "vid").join(nn, "vid"))


# given the links between groups


def _cond(spark, d, **more):
    g = _ge(spark, d)
    adj = g.adj.filter("src <> dst")
    v = g.vertices.select("vid", "group_id")
    macro = adj.join(v.toDF("src", "a"), "src").join(v.toDF("dst", "b"), "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return g, M.ConditionalInvariantModel(g, macro, **({"param": _z0(g)} | more))


_CB = ", m AS (SELECT s.g AS a, t.g AS b, sum(w) AS w FROM e JOIN v s ON s.vid = src JOIN v t ON t.vid = dst WHERE src <> dst GROUP BY ALL), gs AS (SELECT g, sum(x) AS gx, sum(y) AS gy, sum(x * y) AS gd FROM n JOIN v USING (vid) GROUP BY g), bl AS (SELECT a, b, w, s.gx, t.gy, CASE WHEN a = b THEN 1 - s.gd / (s.gx * t.gy) ELSE 1 END AS gc FROM m JOIN gs s ON s.g = a JOIN gs t ON t.g = b), cp AS (SELECT i.vid AS i, j.vid AS j, a, b, w, l / tw / tw * i.x * j.y AS t, (1 - exp(-l / tw / tw * i.x * j.y)) / (1 - exp(-l / tw / tw * gx * gy * gc)) AS p FROM bl JOIN v vi ON vi.g = a JOIN v vj ON vj.g = b AND vi.vid <> vj.vid JOIN n i ON i.vid = vi.vid JOIN n j ON j.vid = vj.vid, o)"


@query(GE + _CB + " SELECT round(sum(p), 5) AS edges FROM cp")
def cond_exp_edges_ge(spark, d):
    return _rounded(_one(spark, edges=_cond(spark, d)[1].expected_num_edges()), 5)


@query(GE + _CB + ", z AS (SELECT s.vid AS i, t.vid AS j, coalesce(f.p, 0) AS p, coalesce(r.p, 0) AS q FROM v s JOIN v t ON s.vid <> t.vid LEFT JOIN cp f ON f.i = s.vid AND f.j = t.vid LEFT JOIN cp r ON r.i = t.vid AND r.j = s.vid) SELECT i AS vid, round(sum(p + q - p * q), 5) AS degree, round(sum(p), 5) AS out_degree, round(sum(q), 5) AS in_degree FROM z GROUP BY i")
def cond_degree_ge(spark, d):
    m = _cond(spark, d)[1]
    return _rounded(m.expected_degree().join(m.expected_out_degree(), "vid").join(m.expected_in_degree(), "vid"), 5)


@query(GE + _CB + ", cg AS (SELECT s.g AS a, t.g AS b, s.gx * t.gy * CASE WHEN s.g = t.g THEN 1 - s.gd / (s.gx * t.gy) ELSE 1 END AS k FROM gs s, gs t), pp AS (SELECT a.vid AS i, b.vid AS j, l / tw / tw * a.x * b.y AS t FROM n a, n b, o WHERE a.vid <> b.vid) SELECT round((SELECT sum(CASE WHEN e.src IS NOT NULL THEN ln(1 - exp(-t)) ELSE -t END) FROM pp LEFT JOIN e ON e.src = i AND e.dst = j) - (SELECT sum(CASE WHEN m.a IS NOT NULL THEN ln(1 - exp(-l / tw / tw * k)) ELSE -l / tw / tw * k END) FROM cg LEFT JOIN m ON m.a = cg.a AND m.b = cg.b, o), 3) AS loglik")
def cond_loglik_ge(spark, d):
    g, m = _cond(spark, d)
    return _rounded(_one(spark, loglik=m.log_likelihood(g)), 3)


@query("WITH RECURSIVE " + GE[5:] + _CB + ", cx AS (SELECT t / (l / tw / tw) AS a, gx * gy * gc AS b FROM cp JOIN bl USING (a, b), o WHERE t > 0), tg AS (SELECT count(*)::DOUBLE AS target FROM e WHERE src <> dst), nw AS (SELECT 0 AS it, 0.0::DOUBLE AS z, 0.0::DOUBLE AS s UNION ALL SELECT it + 1, z + (target - s1) / d1, s1 FROM (SELECT it, z, any_value(target) AS target, sum(CASE WHEN z = 0 THEN a / b ELSE (1 - exp(-z * a)) / (1 - exp(-z * b)) END) AS s1, sum(CASE WHEN z = 0 THEN a * (0.5 - a / b / 2) ELSE (a * exp(-z * a) * (1 - exp(-z * b)) - (1 - exp(-z * a)) * b * exp(-z * b)) / (1 - exp(-z * b)) / (1 - exp(-z * b)) END) AS d1 FROM nw, cx, tg WHERE it < 20 GROUP BY it, z)) SELECT round(ln(z), 4) AS log_z, round(s, 3) AS edges FROM nw WHERE it = 20")
def cond_fit_ge(spark, d):
    g = _ge(spark, d)
    m = _cond(spark, d, num_edges=g.adj.filter("src <> dst").count(), param=None)[1]
    m.fit()
    return _one(spark, log_z=float(np.log(m.param[0])), edges=m.expected_num_edges()).select(F.round("log_z", 4).alias("log_z"), F.round("edges", 3).alias("edges"))


@query(GE + _CB + ", pq AS (SELECT s.vid AS i, t.vid AS j, coalesce(f.p, 0) AS p FROM v s JOIN v t ON s.vid <> t.vid LEFT JOIN cp f ON f.i = s.vid AND f.j = t.vid), k AS (SELECT i, sum(p) AS k FROM pq GROUP BY i) SELECT pq.i AS vid, round(CASE WHEN any_value(o.k) > 0 THEN sum(p * t.k) / any_value(o.k) ELSE 0 END, 5) AS av_nn FROM pq JOIN k t ON t.i = pq.j JOIN k o ON o.i = pq.i GROUP BY pq.i")
def cond_avnn_out_ge(spark, d):
    return _rounded(_cond(spark, d)[1].expected_av_nn_degree(ddir="out", ndir="out"), 5)


# samples: uniform numbers by MD5, so that SQL can draw the same

_U = "(('0x' || substr(md5({t}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_UP, _UW, _UK, _UKW = (_U.format(t=f"concat_ws('|', '{k}', {c})") for k, c in (("7", "i, j"), ("7w", "i, j"), ("7", "i, j, k"), ("7w", "i, j, k")))


def _draws(p: str, sources: str = "n", targets: str = "n", label: bool = False) -> str:
    """Links by gaps between candidates in bins of alike targets: after GE's tables, dr (i, j, p[, k]). ``p`` has the source's a.x and the target's b.y, sources and targets vid, x and vid, y (and k)."""
    k, k_, on, part = ("k, ", ", k", "a.k = b.k", "PARTITION BY k, b") if label else ("", "", "true", "PARTITION BY b")
    gap = "CASE WHEN pm >= 1 THEN 0 ELSE floor(least(m, ln(1 - {u}) / ln(1 - pm))) END::BIGINT"
    first, then = (gap.format(u=_U.format(t=f"concat_ws('|', '7g', i, b, {n}{k_})")) for n in ("1", "g + 1"))
    at_most, own = p.replace("b.y", "b.ym"), p
    return (
        f", yb AS (SELECT *, row_number() OVER ({part} ORDER BY vid) - 1 AS r, count(*) OVER ({part}) AS m, max(y) OVER ({part}) AS ym FROM (SELECT {k}vid, y, floor(2 * ln(y))::BIGINT AS b FROM {targets} WHERE y > 0))"
        f", gn AS (SELECT {'a.k, ' if label else ''}a.vid AS i, a.x, b.b, b.m, {at_most} AS pm FROM {sources} a JOIN (SELECT DISTINCT {k}b, m, ym FROM yb) b ON {on}, o WHERE a.x > 0)"
        f", cd AS (SELECT {k}i, x, b, m, pm, 1 AS g, {first} AS ps FROM gn WHERE pm > 0 UNION ALL SELECT {k}i, x, b, m, pm, g + 1, ps + 1 + {then} FROM cd WHERE ps < m)"
        f", dc AS (SELECT {'a.k, ' if label else ''}a.i, b.vid AS j, a.pm, {own} AS p FROM cd a JOIN yb b ON a.b = b.b AND a.ps = b.r{' AND a.k = b.k' if label else ''}, o WHERE a.ps < a.m AND a.i <> b.vid)"
        f", dr AS (SELECT * FROM dc WHERE {_UK if label else _UP} * pm < p) "
    )


_GER = "WITH RECURSIVE " + GE[5:]
_ONES = ", ones AS (SELECT vid, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y FROM v)"


@query(_GER + _draws(LOGISTIC) + "SELECT i AS src, j AS dst FROM dr")
def sample_binary_ge(spark, d):
    return _model(_ge(spark, d), "fitness").sample(seed=7, portable=True).adj.select("src", "dst")


@query(_GER + _draws(EXPONENTIAL) + f"SELECT i AS src, j AS dst, round(-(a.x * b.y / (tw * p)) * ln(1 - {_UW}), 5) AS w FROM dr JOIN n a ON a.vid = i JOIN n b ON b.vid = j, o")
def sample_cremb_ge(spark, d):
    return _rounded(_model(_ge(spark, d), "invariant").sample(weights="cremb", seed=7, portable=True).adj, 5)


@query(_GER + _MLG + _draws(LOGISTIC, "ln_", "ln_", True) + "SELECT k AS label_id, i AS src, j AS dst FROM dr")
def sample_label_ge(spark, d):
    return _multi(_ge(spark, d, True)).sample(seed=7, portable=True).adj.select("label_id", "src", "dst")


@query(_GER + _MLG + _draws(EXPONENTIAL, "ln_", "ln_", True) + f", tk AS (SELECT k, sum(x) AS tx FROM ln_ GROUP BY k) SELECT dr.k AS label_id, i AS src, j AS dst, round(-(a.x * b.y / (tx * p)) * ln(1 - {_UKW.replace('k)', 'dr.k)')}), 5) AS w FROM dr JOIN ln_ a ON a.vid = i AND a.k = dr.k JOIN ln_ b ON b.vid = j AND b.k = dr.k JOIN tk ON tk.k = dr.k")
def sample_label_cremb_ge(spark, d):
    return _rounded(_multi(_ge(spark, d, True), "invariant").sample(weights="cremb", seed=7, portable=True).adj, 5)


for _name, _discrete, _q, _w in (("weighted", True, 0.25, f"ceil(ln(1 - {_UW}) / ln(0.25))"), ("exponential", False, 0.5, f"round(-ln(1 - {_UW}) / 0.5, 6)")):

    def _f(spark, d, discrete=_discrete, q=_q):
        return _rounded(M.RandomDiGraph(_ge(spark, d), param=np.array([0.05, q]), discrete_weights=discrete).sample(weights="random", seed=7, portable=True).adj)

    query(_GER + _ONES + _draws("(0.05 + 0 * a.x * b.y)", "ones", "ones") + f"SELECT i AS src, j AS dst, {_w} AS w FROM dr", f"sample_er_{_name}_ge")(_f)


@query(_GER + _ONES + _draws("(0.05 + 0 * a.x * b.y)", "ones", "ones") + f"SELECT i AS src, j AS dst, round(-(a.x * b.y / (tw * 0.05)) * ln(1 - {_UW}), 5) AS w FROM dr JOIN n a ON a.vid = i AND a.x > 0 JOIN n b ON b.vid = j AND b.y > 0, o")
def sample_er_cremb_ge(spark, d):
    g = _ge(spark, d)
    s = M.RandomDiGraph(g, param=0.05).sample(weights="cremb", out_strength=g.out_strength(), in_strength=g.in_strength(), seed=7, portable=True)
    return _rounded(s.adj.filter("w > 0"), 5)


_CS = _CB + f", b1 AS (SELECT *, {_UP} AS u, row_number() OVER w AS r, count(*) OVER (PARTITION BY a, b) AS c, sum(t) OVER (PARTITION BY a, b ORDER BY i DESC, j DESC ROWS UNBOUNDED PRECEDING) AS rest FROM cp WHERE t > 0 WINDOW w AS (PARTITION BY a, b ORDER BY i, j)), b2 AS (SELECT *, min(CASE WHEN u < CASE WHEN r = c OR rest <= t THEN 1 ELSE (1 - exp(-t)) / (1 - exp(-rest)) END THEN r END) OVER (PARTITION BY a, b) AS f FROM b1), b3 AS (SELECT b2.*, s.x * d2.y AS xy FROM b2 JOIN n s ON s.vid = i JOIN n d2 ON d2.vid = j WHERE r = f OR (r > f AND u < 1 - exp(-t))) "


@query(GE + _CS + "SELECT i AS src, j AS dst FROM b3")
def sample_cond_binary_ge(spark, d):
    return _cond(spark, d)[1].sample(seed=7, portable=True).adj.select("src", "dst")


@query(GE + _CS + "SELECT i AS src, j AS dst, round(w * xy / sum(xy) OVER (PARTITION BY a, b), 4) AS w FROM b3")
def sample_cond_wagg_ge(spark, d):
    return _rounded(_cond(spark, d)[1].sample(weights="wagg", seed=7, portable=True).adj, 4)


@query(GE + _CS + f"SELECT i AS src, j AS dst, round(-(xy / (tw * p)) * ln(1 - {_UW}), 4) AS w FROM b3, o")
def sample_cond_cremb_ge(spark, d):
    return _rounded(_cond(spark, d)[1].sample(weights="cremb", seed=7, portable=True).adj, 4)


# algorithms and export


@query(
    "WITH RECURSIVE "
    + GE[5:]
    + f", nr AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e), c AS (SELECT count(*)::DOUBLE AS c FROM v), r AS (SELECT 0 AS it, vid, 1 / c AS r FROM v, c UNION ALL (SELECT it + 1, vid, 0.85 * (coalesce(s, 0) + lost / c) + 0.15 / c FROM (SELECT v.vid, any_value(p.it) AS it, (SELECT sum(nr.w * q.r) FROM nr JOIN r q ON q.vid = nr.src WHERE nr.dst = v.vid) AS s, coalesce((SELECT sum(q.r) FROM r q WHERE q.vid NOT IN (SELECT src FROM nr)), 0) AS lost FROM v JOIN r p ON p.vid = v.vid GROUP BY v.vid), c WHERE it < {RANK_STEPS})) SELECT vid, round(r, 9) AS rank FROM r WHERE it = {RANK_STEPS}"
)
def pagerank_ge(spark, d):
    return _rounded(M.pagerank(_ge(spark, d), tol=1e-12), 9)


@query(
    "WITH RECURSIVE "
    + GE[5:]
    + f", f AS (SELECT vid, x + 1 + vid % 7 AS f, x FROM n), r AS (SELECT 0 AS it, vid, f AS r FROM f UNION ALL (SELECT it + 1, vid, CASE WHEN x + f > 0 THEN (f + s) / (x + f) ELSE f + s END FROM (SELECT f.vid, any_value(f) AS f, any_value(x) AS x, any_value(p.it) AS it, coalesce((SELECT sum(e.w * (q.r + 1)) FROM e JOIN r q ON q.vid = e.dst WHERE e.src = f.vid), 0) AS s FROM f JOIN r p ON p.vid = f.vid GROUP BY f.vid) WHERE it < {RANK_STEPS})) SELECT vid, round(r, 4) AS depth FROM r WHERE it = {RANK_STEPS}"
)
def trophic_ge(spark, d):
    g = _ge(spark, d)
    final = g.vertices.join(g.out_strength(), "vid").select("vid", (F.col("out_strength") + 1 + F.col("vid") % 7).alias("f"))
    return _rounded(M.trophic_depth(g, final, tol=1e-9), 4)


@query(GN + "SELECT src, dst, k AS key, (SELECT min(p) FROM (SELECT DISTINCT o_orderpriority AS p, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE r = k) AS label, w AS weight FROM le")
def node_link_export_gn(spark, d):
    links = _gn(spark, d, True).to_node_link()[1]
    return links.select("src", "dst", F.col("key"), F.col("label.k0").alias("label"), "weight")


@query(GM + _pairs(LOGISTIC).replace("a.vid <> b.vid)", "a.vid <> b.vid AND a.x > 0)").split(", pq AS")[0] + " SELECT v.id AS customer, d.d_out AS observed, round(sum(p), 5) AS expected FROM pp JOIN v ON v.vid = i JOIN d ON d.vid = i GROUP BY ALL")
def flagship(spark, d):
    """Customers' numbers of suppliers against what their and the suppliers' volumes tell."""
    return expected_suppliers(spark, d, fitted=False)


def expected_suppliers(spark: SparkSession, d: str, fitted: bool = True) -> DataFrame:
    g = _gm(spark, d)
    m = M.FitnessModel(g) if fitted else _model(g, "fitness")
    if fitted:
        m.fit()
    t = g.vertices.filter("node_key.k0 = 'customer'").join(g.out_degree(), "vid").join(g.out_strength(), "vid").join(m.expected_out_degree().withColumnRenamed("out_degree", "expected"), "vid")
    t = t.filter("out_strength > 0")
    return t.select(F.col("node_key.k1").alias("customer"), F.col("out_degree").alias("observed"), F.round("expected", 5).alias("expected"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)
