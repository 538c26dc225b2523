"""Transport between two populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transport as tr
from .base import R, Tables, query, rounded, with_

_IT, _EPS = 14, 0.3   # rounds after which the SQL has settled far below the digits compared
_POINT_IT = 40


def _xy(t: Tables):
    x = t.emb.where(F.col("cluster") == 0).select("cell_id", "x")
    y = t.emb.where(F.col("cluster") == 1).select("cell_id", "x")
    return x, y


_PAIRS = {"px": "SELECT cell_id AS i, x FROM emb WHERE cluster = 0", "py": "SELECT cell_id AS j, x FROM emb WHERE cluster = 1",
          "pc": "SELECT i, j, list_distance(px.x, py.x) ** 2 AS c FROM px, py"}


@query("pair_cost", with_("emb", extra={**_PAIRS, "r": "SELECT *, row_number() OVER (PARTITION BY i ORDER BY c, j) AS a, row_number() OVER (PARTITION BY j ORDER BY c, i) AS b FROM pc"},
    body=f"SELECT i, j, {R('c')} AS c FROM r WHERE a <= 6 OR b <= 6"))
def _(t: Tables):
    return rounded(tr.pair_cost(*_xy(t), 6))


def _sinkhorn_sql(cost: str, eps: float, iters: int) -> dict[str, str]:
    out = {"na": f"SELECT ln(1e0 / count(DISTINCT i)) AS la, ln(1e0 / count(DISTINCT j)) AS lb FROM {cost}", "g0": f"SELECT DISTINCT j, 0e0 AS g FROM {cost}"}
    for k in range(iters):
        out[f"f{k + 1}"] = (f"SELECT i, -{eps}e0 * (max(z) + ln(sum(exp(z - m))) - any_value(la)) AS f FROM (SELECT i, (g - c) / {eps}e0 AS z, max((g - c) / {eps}e0) OVER (PARTITION BY i) AS m FROM {cost} JOIN g{k} USING (j)), na GROUP BY 1")
        out[f"g{k + 1}"] = (f"SELECT j, -{eps}e0 * (max(z) + ln(sum(exp(z - m))) - any_value(lb)) AS g FROM (SELECT j, (f - c) / {eps}e0 AS z, max((f - c) / {eps}e0) OVER (PARTITION BY j) AS m FROM {cost} JOIN f{k + 1} USING (i)), na GROUP BY 1")
    out["pl"] = f"SELECT i, j, c, exp((f + g - c) / {eps}e0) AS p FROM {cost} JOIN f{iters} USING (i) JOIN g{iters} USING (j)"
    out["gm"] = f"SELECT avg(g) AS m FROM g{iters}"
    return out


# cost table given by the data: suppliers and parts that occur together
_OC = {"oc": "SELECT l_suppkey AS i, l_partkey AS j, avg(l_discount) * 10 + avg(l_tax) * 5 AS c FROM lineitem GROUP BY 1, 2"}


def _observed_cost(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg((F.avg("l_discount") * 10 + F.avg("l_tax") * 5).alias("c"))


def _plan(t: Tables):
    return tr.sinkhorn(_observed_cost(t), _EPS, tol=1e-9)


@query("sinkhorn_plan", with_(extra={**_OC, **_sinkhorn_sql("oc", _EPS, _IT)}, body=f"SELECT i, j, {R('p * 1000')} AS p FROM pl"))
def _(t: Tables):
    return rounded(_plan(t)["plan"].select("i", "j", (F.col("p") * 1000).alias("p")))


@query("sinkhorn_potentials", with_(extra={**_OC, **_sinkhorn_sql("oc", _EPS, _IT)}, body=f"SELECT 'f' AS side, i AS id, {R('f + m')} AS p FROM f{_IT}, gm UNION ALL SELECT 'g', j, {R('g - m')} FROM g{_IT}, gm"))
def _(t: Tables):
    o = _plan(t)
    return rounded(o["f"].select(F.lit("f").alias("side"), F.col("i").alias("id"), "p").union(o["g"].select(F.lit("g").alias("side"), F.col("j").alias("id"), "p")))


# the masses of the plan are the marginals within the tolerance
@query("sinkhorn_to_tolerance", with_(extra=_OC, body="""SELECT 'row' AS side, i AS id, round(1e0 / (SELECT count(DISTINCT i) FROM oc), 5) AS mass, true AS within FROM (SELECT DISTINCT i FROM oc)
    UNION ALL SELECT 'column', j, round(1e0 / (SELECT count(DISTINCT j) FROM oc), 5), true FROM (SELECT DISTINCT j FROM oc)"""))
def _(t: Tables):
    done = tr.sinkhorn(_observed_cost(t), 0.1)
    side = lambda name, key: done["plan"].groupBy(F.col(key).alias("id")).agg(F.sum("p").alias("mass")).select(F.lit(name).alias("side"), "id", F.round("mass", 5).alias("mass"))
    return side("row", "i").union(side("column", "j")).withColumn("within", F.lit(done["error"] <= tr.TOLERANCE))


@query("sinkhorn_points", with_("emb", extra={**_PAIRS, **_sinkhorn_sql("pc", 0.5, _POINT_IT)}, body=f"SELECT i AS cell_id, {R('sum(p * c)', 4)} AS cost, {R('sum(p)', 4)} AS mass FROM pl GROUP BY 1"))
def _(t: Tables):
    return rounded(tr.sinkhorn_points(*_xy(t), 0.5)["per_source"].drop("y_bar"), 4)


def _divergence_sql() -> str:
    parts = {}
    for tag, a, b in (("xy", 0, 1), ("xx", 0, 0), ("yy", 1, 1)):
        sub = {"px": f"SELECT cell_id AS i, x FROM emb WHERE cluster = {a}", "py": f"SELECT cell_id AS j, x FROM emb WHERE cluster = {b}", "pc": "SELECT i, j, list_distance(px.x, py.x) ** 2 AS c FROM px, py",
               **_sinkhorn_sql("pc", 0.5, _POINT_IT)}
        parts[tag] = "(" + with_("emb", extra=sub, body="SELECT sum(p * c) FROM pl") + ")"
    return f"SELECT {R(parts['xy'], 4)} AS ot_xy, {R(parts['xy'] + ' - 0.5e0 * (' + parts['xx'] + ' + ' + parts['yy'] + ')', 4)} AS divergence"


@query("sinkhorn_divergence", _divergence_sql())
def _(t: Tables):
    return rounded(tr.sinkhorn_divergence(*_xy(t), 0.5), 4)


@query("sample_coupling")
def _(t: Tables):
    return tr.sample_coupling(_plan(t)["plan"], 2000)


@query("barycentric_map", with_("fold", extra={**_OC, **_sinkhorn_sql("oc", _EPS, _IT)}, body=f"SELECT i, k::INT AS k, {R('sum(p * w[k + 1]) / sum(p)')} AS value FROM pl JOIN (SELECT p_partkey AS j, [p_size / 50e0, p_retailprice / 1000e0] AS w FROM part) USING (j), (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2"))
def _(t: Tables):
    b = tr.barycentric_map(_plan(t)["plan"], _part_xy(t), 2, normalise=True)
    return rounded(b.select("i", F.posexplode("y_bar").alias("k", "value")))


def _part_xy(t: Tables):
    return t.part.select(F.col("p_partkey").alias("cell_id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0).alias("x"))


def _supp_xy(t: Tables):
    return t.supplier.select(F.col("s_suppkey").alias("cell_id"), F.array(F.col("s_nationkey") / 25.0, F.col("s_acctbal") / 10000.0).alias("x"))


_BARY = {**_OC, **_sinkhorn_sql("oc", _EPS, _IT), "bar": """SELECT i, [s_nationkey / 25e0, s_acctbal / 10000e0] AS x, [sum(p * p_size / 50e0), sum(p * p_retailprice / 1000e0)] AS y FROM pl JOIN part ON p_partkey = j
    JOIN supplier ON s_suppkey = i GROUP BY 1, 2"""}


@query("coupling_loss", with_(extra=_BARY, body=f"SELECT {R('avg(list_distance(x, y))')} AS loss FROM bar"))
def _(t: Tables):
    return rounded(tr.coupling_loss(tr.barycentric_map(_plan(t)["plan"], _part_xy(t), 2), _supp_xy(t)))


@query("interpolate_along_plan", with_(extra=_BARY, body=f"SELECT i, k::INT AS k, {R('0.7e0 * x[k + 1] + 0.3e0 * y[k + 1]')} AS value FROM bar, (SELECT unnest([0, 1]) AS k)"))
def _(t: Tables):
    out = tr.interpolate(tr.barycentric_map(_plan(t)["plan"], _part_xy(t), 2), _supp_xy(t), 0.3)
    return rounded(out.select("i", F.posexplode("x_t").alias("k", "value")))


_TV = [0.1, 0.5, 0.9]


@query("bridge_targets", with_(extra={"pr": "SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem", "tv": "SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS t",
    "xt": """SELECT i, j, t, [s_nationkey / 25e0, s_acctbal / 10000e0] AS x0, [p_size / 50e0, p_retailprice / 1000e0] AS x1 FROM pr JOIN supplier ON s_suppkey = i JOIN part ON p_partkey = j, tv"""},
    body=f"""SELECT i, j, d AS direction, t, k::INT AS k, {R('(1 - t) * x0[k + 1] + t * x1[k + 1]')} AS x,
    {R("CASE WHEN d = 'forward' THEN (x1[k + 1] - ((1 - t) * x0[k + 1] + t * x1[k + 1])) / (1 - t + 1e-6) ELSE (x0[k + 1] - ((1 - t) * x0[k + 1] + t * x1[k + 1])) / (t + 1e-6) END")} AS v
    FROM xt, (SELECT unnest(['forward', 'backward']) AS d), (SELECT unnest([0, 1]) AS k)"""))
def _(t: Tables):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).distinct()
    b = tr.bridge_targets(pairs, _supp_xy(t), _part_xy(t), _TV)
    return rounded(b.select("i", "j", "direction", "t", F.posexplode(F.arrays_zip("x", "v")).alias("k", "z")).select("i", "j", "direction", "t", "k", "z.x", "z.v"))


@query("bridge_operators")
def _(t: Tables):
    from ..plans.bridge import bridge_operators
    pairs = t.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).distinct()
    ops = bridge_operators(pairs, _supp_xy(t), _part_xy(t), 2)
    return rounded(ops.select("direction", "t_idx", "t", "lam"), 4)


@query("bridge_populations", "SELECT c_mktsegment AS target, 'target' AS side, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1 UNION ALL "
       "SELECT s.seg, 'source', (SELECT count(*) FROM customer WHERE c_nationkey = 3) FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE c_nationkey <> 3) s")
def _(t: Tables):
    from ..plans.bridge import bridge_populations
    cells = t.customer.select(F.col("c_custkey").alias("cell_id"), F.when(F.col("c_nationkey") == 3, "src").otherwise(F.col("c_mktsegment")).alias("label"))
    names = [r[0] for r in t.customer.select("c_mktsegment").distinct().collect()] + ["no such label"]
    return bridge_populations(cells, "label", "src", names).groupBy("target", "side").agg(F.count(F.lit(1)).alias("n"))
