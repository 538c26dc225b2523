"""Direction fields and local operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import field as f
from ..operators import neighbors as nb
from .base import R, Tables, query, rounded, vec_long, with_

_V0 = {"vr": """SELECT c.cell_id, c.i, coalesce(s / w, 0e0) AS v FROM (SELECT cell_id, i FROM fold, (SELECT unnest(range(1, 9)) AS i)) c LEFT JOIN
        (SELECT a.cell_id, i, sum((b.t - a.t) * (b.x[i] - a.x[i])) AS s, sum(b.t - a.t) AS w FROM nnf JOIN fold a ON a.cell_id = src JOIN fold b ON b.cell_id = dst, (SELECT unnest(range(1, 9)) AS i)
         WHERE b.t > a.t GROUP BY 1, 2) q ON q.cell_id = c.cell_id AND q.i = c.i""",
       "vel": "SELECT cell_id, i, v / ((SELECT avg(n) FROM (SELECT sqrt(sum(v * v)) AS n FROM vr GROUP BY cell_id)) + 1e-8) AS v FROM vr"}


def velocity(t: Tables):
    return f.pseudotime_velocity(t.nnf, t.fold, 8)


@query("pseudotime_velocity", with_("nnf", extra=_V0, body=f"SELECT cell_id, (i - 1)::INT AS i, {R('v')} AS value FROM vel"))
def _(t: Tables):
    return rounded(vec_long(velocity(t), "v", "cell_id"))


def _biased(progenitor: bool) -> dict[str, str]:
    out = {"term": "SELECT i, avg(x[i]) AS c FROM fold, (SELECT unnest(range(1, 9)) AS i) WHERE cluster = 7 GROUP BY 1",
           "prog": "SELECT i, avg(x[i]) AS c FROM fold, (SELECT unnest(range(1, 9)) AS i) WHERE cluster = 0 GROUP BY 1",
           "axis": "SELECT i, (term.c - prog.c) / (sqrt(sum((term.c - prog.c) ** 2) OVER ()) + 1e-8) AS a FROM term JOIN prog USING (i)",
           "d0": "SELECT cell_id, t, i, c - x[i] AS d FROM fold JOIN term ON true"}
    out["d1"] = ("SELECT cell_id, t, i, a * sum(d * a) OVER (PARTITION BY cell_id) AS d FROM d0 JOIN axis USING (i)" if progenitor else "SELECT * FROM d0")
    out["raw"] = "SELECT cell_id, i, v + 1.5e0 * t * d / (sqrt(sum(d * d) OVER (PARTITION BY cell_id)) + 1e-8) AS v FROM d1 JOIN vel USING (cell_id, i)"
    return out


_BIAS_BODY = f"SELECT cell_id, (i - 1)::INT AS i, {R('v / ((SELECT avg(n) FROM (SELECT sqrt(sum(v * v)) AS n FROM raw GROUP BY cell_id)) + 1e-8)')} AS value FROM raw"


@query("biased_velocity", with_("nnf", extra={**_V0, **_biased(False)}, body=_BIAS_BODY))
def _(t: Tables):
    term = f.centroid_of(t.fold, F.col("cluster") == 7, 8)
    return rounded(vec_long(f.biased_velocity(velocity(t), t.fold, term, 1.5), "v", "cell_id"))


@query("biased_velocity_on_axis", with_("nnf", extra={**_V0, **_biased(True)}, body=_BIAS_BODY))
def _(t: Tables):
    term, prog = f.centroid_of(t.fold, F.col("cluster") == 7, 8), f.centroid_of(t.fold, F.col("cluster") == 0, 8)
    return rounded(vec_long(f.biased_velocity(velocity(t), t.fold, term, 1.5, prog), "v", "cell_id"))


@query("centroids", with_("emb", body=f"SELECT cluster, (i - 1)::INT AS i, {R('avg(x[i])')} AS value, count(*) AS n FROM emb, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(vec_long(f.centroids(t.emb, "cluster", 64), "centroid", "cluster", "n"))


@query("axis_alignment", with_("nnf", extra={**_V0, **_biased(True)}, body=f"SELECT {R('sum(m * c) / (sqrt(sum(c * c)) + 1e-8)')} AS alignment FROM (SELECT i, avg(v) AS m FROM vel GROUP BY 1) JOIN term USING (i)"))
def _(t: Tables):
    return rounded(f.axis_alignment(velocity(t), f.centroid_of(t.fold, F.col("cluster") == 7, 8), 8))


@query("time_gate", with_("ax", body=f"SELECT cell_id, 1e0 AS flat, {R('1 - t')} AS root, {R('t')} AS rise, {R('4 * t * (1 - t)')} AS mid FROM ax"))
def _(t: Tables):
    return rounded(t.ax.select("cell_id", *[f.time_gate(m).alias(m) for m in ("flat", "root", "rise", "mid")]))


@query("prior_drift", with_("nnf", extra={"w": "SELECT n.src, f.x AS v, exp(-dist * dist) AS w, sqrt(list_dot_product(f.x, f.x)) / ((SELECT max(sqrt(list_dot_product(x, x))) FROM fold) + 1e-8) AS c FROM nnf n JOIN fold f ON f.cell_id = n.dst",
    "ip": "SELECT src, i, sum(w * v[i]) / sum(w) AS v, sum(w * c) / sum(w) AS conf FROM w, (SELECT unnest(range(1, 9)) AS i) GROUP BY 1, 2"},
    body=f"SELECT src, (i - 1)::INT AS i, {R('0.5e0 * conf * conf * 4 * t * (1 - t) * v')} AS value FROM ip JOIN fold ON cell_id = src"))
def _(t: Tables):
    ip = nb.knn_interpolate(t.nnf, t.fold.select("cell_id", F.col("x").alias("v")), 8)
    return rounded(vec_long(f.prior_drift(ip, t.fold, 0.5, 2.0, "mid"), "drift", "src"))


@query("field_energy", with_("nnf", extra=_V0, body=f"SELECT {R('avg(v * v)')} AS energy FROM vel"))
def _(t: Tables):
    return rounded(f.field_energy(velocity(t)))


@query("grid_flow", f"""WITH p AS (SELECT l_quantity AS px, l_extendedprice AS py, l_discount - 0.05 AS vx, l_tax AS vy FROM lineitem),
    s AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM p)
    SELECT least(floor((px - x0) / (x1 - x0) * 20), 19)::INT AS ix, least(floor((py - y0) / (y1 - y0) * 20), 19)::INT AS iy, {R('avg(vx)')} AS vx, {R('avg(vy)')} AS vy, count(*) AS n
    FROM p, s GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t: Tables):
    p = t.lineitem.select(F.col("l_quantity").alias("px"), F.col("l_extendedprice").alias("py"), (F.col("l_discount") - 0.05).alias("vx"), F.col("l_tax").alias("vy"))
    return rounded(f.grid_flow(p))


def _state(t: Tables):
    """Folded vectors with a linear velocity per component plus a time term, so that operators have a known shape."""
    v = F.transform("x", lambda a, i: a * (F.lit(0.5) - F.col("t")) + F.col("x")[(i + 1) % 8] * 0.25)
    return t.fold.withColumn("v", v)


@query("local_linear_operator")
def _(t: Tables):
    out = f.local_linear_operator(_state(t), [0.2, 0.4, 0.6, 0.8], 0.15, 8, 1e-6)
    return rounded(vec_long(out, "j", "t_idx", "t"), 4)


# the one-dimensional case has a closed form
@query("local_slope_1d", with_("ship", extra={"g": "SELECT unnest([0, 1, 2, 3, 4]) AS t_idx, unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0, 0.9e0]) AS g",
    "w": "SELECT t_idx, exp(-0.5e0 * ((g - t) / 0.1e0) ** 2) AS w, l_quantity / 50e0 AS x, l_discount * l_quantity * t AS v FROM ship, g"},
    body=f"SELECT t_idx, {R('(sum(w * x * v) / sum(w) - sum(w * x) * sum(w * v) / (sum(w) * sum(w))) / (sum(w * x * x) / sum(w) - sum(w * x) ** 2 / (sum(w) * sum(w)))')} AS slope FROM w GROUP BY 1"))
def _(t: Tables):
    d = t.ship.select("t", (F.col("l_quantity") / 50.0).alias("x"), (F.col("l_discount") * F.col("l_quantity") * F.col("t")).alias("v"))
    return rounded(f.slope_on_grid(d, "x", "v", [0.1, 0.3, 0.5, 0.7, 0.9], 0.1))


@query("cluster_operator")
def _(t: Tables):
    from ..operators.spectra import operator_spectrum
    ops = f.cluster_operator(_state(t), "cluster", 8)
    return rounded(operator_spectrum(ops, 8).select("cluster", "n_rows", "lam"), 4)


# one state component: the ridge solution per cluster is a ratio of covariances
@query("cluster_operator_1d", with_("ship", body=f"SELECT l_suppkey AS cluster, count(*)::DOUBLE AS n_rows, {R('covar_pop(l_quantity / 50e0, l_discount * l_quantity) / (var_pop(l_quantity / 50e0) + 0.001e0)')} AS j FROM ship GROUP BY 1 HAVING count(*) >= 5"))
def _(t: Tables):
    d = t.ship.select(F.col("l_suppkey").alias("cluster"), F.array(F.col("l_quantity") / 50.0).alias("x"), F.array(F.col("l_discount") * F.col("l_quantity")).alias("v"))
    out = f.cluster_operator(d, "cluster", 1, 1e-3)
    return rounded(out.select("cluster", "n_rows", F.col("j")[0].alias("j")))
