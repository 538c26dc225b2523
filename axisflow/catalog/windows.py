"""Windows, bins and kernels along the axis."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import windows as w
from ..operators.kernels import POISSON
from .base import N_T, R, Tables, query, rounded, with_

_N, _OV = 50, 0.8
_WIDTH, _STEP = w.window_geometry(_N, _OV)
_GRID = w.linspace(0.02, 0.98, 25)
_GRID_SQL = "SELECT unnest(range(25))::INT AS t_idx, unnest([" + ", ".join(repr(g) + "::DOUBLE" for g in _GRID) + "]) AS g"


def _windows_sql(min_rows: int, agg: str) -> dict[str, str]:
    return {"win": f"SELECT i::INT AS t_idx, i * {_STEP!r}::DOUBLE AS lo, {_STEP!r}::DOUBLE * i + {_WIDTH / 2!r}::DOUBLE AS c FROM (SELECT unnest(range({_N})) AS i)",
            "wf": f"SELECT t_idx, c, count(*) AS n, {agg} AS mean FROM win JOIN ax ON t >= lo AND t <= lo + {_WIDTH!r}::DOUBLE GROUP BY 1, 2",
            "near": f"SELECT t_idx, c, count(*) AS n, {agg} AS mean FROM (SELECT win.t_idx, c, ax.*, row_number() OVER (PARTITION BY win.t_idx ORDER BY abs(t - c), cell_id) AS rk FROM win, ax "
                    f"WHERE t_idx NOT IN (SELECT t_idx FROM wf WHERE n >= {min_rows})) WHERE rk <= {min_rows} GROUP BY 1, 2"}


_BOTH = "SELECT * FROM wf WHERE n >= {m} UNION ALL SELECT * FROM near"


@query("overlapping_windows", with_("ax", extra=_windows_sql(5, "avg(value)"), body="SELECT t_idx, count(*) AS n, min(cell_id) AS first FROM win JOIN ax ON t >= lo AND t <= lo + " + repr(_WIDTH) + "::DOUBLE GROUP BY 1"))
def _(t: Tables):
    return w.overlapping_windows(t.ax, _N, _OV).groupBy("t_idx").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("first"))


# a high floor makes the nearest-row fallback serve part of the windows
@query("window_mean", with_("ax", extra=_windows_sql(925, "avg(value)"), body=f"SELECT t_idx, {R('c')} AS t, n, {R('mean')} AS mean FROM ({_BOTH.format(m=925)})"))
def _(t: Tables):
    return rounded(w.window_mean(t.ax, _N, _OV, min_rows=925))


@query("window_mean_weighted", with_("ax", extra=_windows_sql(5, "sum(value / 100e0 * value) / (sum(value / 100e0) + 1e-8)"), body=f"SELECT t_idx, {R('c')} AS t, n, {R('mean')} AS mean FROM ({_BOTH.format(m=5)})"))
def _(t: Tables):
    return rounded(w.window_mean(t.ax.withColumn("wt", F.col("value") / 100.0), _N, _OV, weight="wt"))


@query("window_mean_by_key", with_("ax", extra={"win": _windows_sql(5, "")["win"]}, body=f"""SELECT event_type, t_idx, {R('c')} AS t, count(*) AS n, {R('avg(value)')} AS mean FROM win JOIN ax ON t >= lo AND t <= lo + {_WIDTH!r}::DOUBLE GROUP BY 1, 2, c"""))
def _(t: Tables):
    return rounded(w.window_mean(t.ax, _N, _OV, keys=["event_type"]))


@query("interior_peak", with_("ax", extra=_windows_sql(5, "avg(value)"), body=f"""SELECT {R('arg_max(c, mean) FILTER (c >= 0.1 AND c <= 0.9)')} AS t, {R('max(mean) FILTER (c >= 0.1 AND c <= 0.9)')} AS value,
    arg_max(t_idx, mean) FILTER (c >= 0.1 AND c <= 0.9) AS idx, count(*) FILTER (c >= 0.1 AND c <= 0.9) AS n_valid, NULL::DOUBLE AS n_eff_at_peak,
    arg_max(c, mean) < 0.1 OR arg_max(c, mean) > 0.9 AS boundary_peak FROM ({_BOTH.format(m=5)})"""))
def _(t: Tables):
    return rounded(w.interior_peak(w.window_mean(t.ax, _N, _OV), "mean"))


@query("interior_peak_n_eff", with_("ax", extra={"g": _GRID_SQL, "k": "SELECT event_type, t_idx, g, exp(-0.5e0 * ((g - t) / 0.02e0) ** 2) AS w, value FROM ax, g",
    "cv": "SELECT event_type, t_idx, g, sum(w * value) / sum(w) AS mean, sum(w) ** 2 / sum(w * w) AS n_eff FROM k GROUP BY 1, 2, 3"},
    body=f"""SELECT event_type, {R('arg_max(g, mean) FILTER (ok)')} AS t, {R('max(mean) FILTER (ok)')} AS value, arg_max(t_idx, mean) FILTER (ok) AS idx, count(*) FILTER (ok) AS n_valid,
    {R('arg_max(n_eff, mean) FILTER (ok)')} AS n_eff_at_peak, arg_max(g, mean) < 0.1 OR arg_max(g, mean) > 0.9 AS boundary_peak FROM (SELECT *, g >= 0.1 AND g <= 0.9 AND n_eff >= 130 AS ok FROM cv) GROUP BY 1"""))
def _(t: Tables):
    c = w.kernel_smooth(t.ax, _GRID, 0.02, keys=["event_type"])
    return rounded(w.interior_peak(c, "mean", n_eff_min=130.0, keys=["event_type"]))


def _kernel(h: str, wt: str = "1e0") -> dict[str, str]:
    return {"g": _GRID_SQL, "k": f"SELECT t_idx, g, exp(-0.5e0 * ((g - t) / {h}) ** 2) * {wt} AS w, value FROM ax, g"}


_KBODY = f"SELECT t_idx, {R('g')} AS t, {R('sum(w * value) / greatest(sum(w), 1e-12)')} AS mean, {R('sum(w) ** 2 / greatest(sum(w * w), 1e-12)')} AS n_eff FROM k GROUP BY 1, g"


@query("kernel_smooth", with_("ax", extra=_kernel("0.05e0"), body=_KBODY))
def _(t: Tables):
    return rounded(w.kernel_smooth(t.ax, _GRID, 0.05))


@query("kernel_smooth_weighted", with_("ax", extra=_kernel("0.03e0", "value / 100e0"), body=_KBODY))
def _(t: Tables):
    return rounded(w.kernel_smooth(t.ax.withColumn("wt", F.col("value") / 100.0), _GRID, 0.03, "wt"))


_H = {"g": _GRID_SQL, "bw": "SELECT t_idx, g, greatest(max(d), 0.005e0) AS h FROM (SELECT t_idx, g, abs(t - g) AS d, row_number() OVER (PARTITION BY t_idx ORDER BY abs(t - g), cell_id) AS rk FROM ax, g) WHERE rk <= 81 GROUP BY 1, 2"}


@query("knn_adaptive_bandwidth", with_("ax", extra=_H, body=f"SELECT t_idx, {R('g')} AS t, {R('h')} AS h FROM bw"))
def _(t: Tables):
    return rounded(w.knn_adaptive_bandwidth(t.ax, _GRID))


@query("kernel_smooth_adaptive", with_("ax", extra={**_H, "k": "SELECT t_idx, g, exp(-0.5e0 * ((g - t) / h) ** 2) AS w, value FROM ax, bw"}, body=_KBODY))
def _(t: Tables):
    return rounded(w.kernel_smooth(t.ax, _GRID, w.knn_adaptive_bandwidth(t.ax, _GRID)))


# operators are averaged entry by entry: eight rows of an 8 x 8 matrix per cell
@query("kernel_smooth_operators", with_("embt", extra={"g": _GRID_SQL, "k": "SELECT t_idx, g, exp(-0.5e0 * ((g - t) / 0.1e0) ** 2) AS w, x FROM embt, g"},
    body=f"SELECT t_idx, i::INT AS i, {R('sum(w * x[i + 1]) / sum(w)')} AS value FROM k, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2"))
def _(t: Tables):
    cols = [f"v{i}" for i in range(64)]
    rows = t.embt.select("t", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    out = w.kernel_smooth(rows, _GRID, 0.1, values=cols)
    return rounded(out.select("t_idx", F.posexplode(F.array(*cols)).alias("i", "value")))


def _mirror_sql(sigma: float, half: int, n: int, repeat: bool) -> dict[str, str]:
    ws = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-half, half + 1)]
    tot = sum(ws)
    ker = "SELECT unnest(range({a}, {b})) AS o, unnest([{w}]) AS w".format(a=-half, b=half + 1, w=", ".join(f"{x / tot!r}::DOUBLE" for x in ws))
    fold = (f"CASE WHEN p < 0 THEN -p - 1 WHEN p >= {n} THEN {2 * n - 1} - p ELSE p END" if repeat else f"CASE WHEN p < 0 THEN -p WHEN p >= {n} THEN {2 * n - 2} - p ELSE p END")
    return {"ker": ker, "pos": f"SELECT i AS t_idx, w, {fold} AS s FROM (SELECT i, w, i + o AS p FROM ker, (SELECT unnest(range({n})) AS i))"}


@query("gaussian_filter", with_("lam", extra=_mirror_sql(1.5, 6, N_T, True), body=f"SELECT pos.t_idx::INT AS t_idx, {R('sum(w * lam)')} AS smooth FROM pos JOIN lam ON lam.t_idx = s GROUP BY 1"))
def _(t: Tables):
    return rounded(w.gaussian_filter(t.lam, "lam", N_T, 1.5))


@query("gaussian_filter_no_edge", with_("act", extra=_mirror_sql(1.5, 3, N_T, False), body=f"SELECT k, pos.t_idx::INT AS t_idx, {R('sum(w * a)')} AS smooth FROM pos JOIN act ON act.t_idx = s GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(w.gaussian_filter(t.act, "a", N_T, 1.5, ["k"], repeat_edge=False))


_SPARSE = {"sp": "SELECT event_type, t, value FROM ax WHERE user_id = 17 OR (t < 0.55 OR t > 0.7)"}


def _gappy(t: Tables):
    return t.ax.where((F.col("user_id") == 17) | (F.col("t") < 0.55) | (F.col("t") > 0.7))


@query("bin_mean", with_("ax", extra={**_SPARSE, "b": "SELECT event_type, greatest(least(ceil(t * 60e0) - 1, 59), 0)::INT AS t_idx, avg(value) AS m, count(*) AS c FROM sp GROUP BY 1, 2",
    "f": "SELECT e.event_type, i::INT AS t_idx, coalesce(c, 0) AS c, coalesce(m, 0) AS x FROM (SELECT DISTINCT event_type FROM ax) e CROSS JOIN (SELECT unnest(range(60)) AS i) LEFT JOIN b ON b.event_type = e.event_type AND b.t_idx = i"},
    body=f"""SELECT event_type, t_idx, c, {R('x')} AS x_mean, {R('''coalesce(CASE WHEN t_idx = 59 THEN CASE WHEN c > 0 AND lag(c) OVER q > 0 THEN x - lag(x) OVER q END
    ELSE CASE WHEN c > 0 AND lead(c) OVER q > 0 THEN lead(x) OVER q - x END END, 0)''')} AS dx FROM f WINDOW q AS (PARTITION BY event_type ORDER BY t_idx)"""))
def _(t: Tables):
    return rounded(w.bin_mean(_gappy(t), 60, ["event_type"]))


@query("bin_curve", with_("ax", extra=_SPARSE, body=f"""SELECT i::INT AS t_idx, {R('m')} AS mean, coalesce(n, 0) AS n FROM (SELECT unnest(range(300)) AS i) LEFT JOIN
    (SELECT least(floor(t * 300e0), 299) AS b, avg(value) AS m, count(*) AS n FROM sp GROUP BY 1) ON b = i"""))
def _(t: Tables):
    return rounded(w.bin_curve(_gappy(t), 300))


@query("bin_mean_std", with_("ax", extra={"s": "SELECT min(t) AS lo, max(t) AS hi FROM ax"}, body=f"""SELECT floor((t - lo) / ((hi - lo) / 20e0))::INT AS t_idx, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, count(*) AS n
    FROM ax, s WHERE floor((t - lo) / ((hi - lo) / 20e0)) < 20 GROUP BY 1"""))
def _(t: Tables):
    return rounded(w.bin_mean_std(t.ax, 20))


@query("window_from_centers", with_("ax", "lam", extra={"st": "SELECT 0.5e0 * quantile_cont(d, 0.5) / 0.2e0 AS h FROM (SELECT t - lag(t) OVER (ORDER BY t_idx) AS d FROM lam)"},
    body=f"SELECT event_type, lam.t_idx, {R('lam.t')} AS t, {R('avg(value)')} AS mean, count(*) AS n FROM lam, st JOIN ax ON ax.t >= lam.t - h AND ax.t <= lam.t + h GROUP BY 1, 2, lam.t"))
def _(t: Tables):
    return rounded(w.window_from_centers(t.ax, t.lam.select("t_idx", "t"), 0.8, ["event_type"]))


_NEAR = {"g": "SELECT i::INT AS t_idx, i / 29e0 AS c FROM (SELECT unnest(range(30)) AS i)",
         "nr": "SELECT event_type, t_idx, c, avg(value) AS mean FROM (SELECT event_type, t_idx, c, value, row_number() OVER (PARTITION BY event_type, t_idx ORDER BY abs(t - c), cell_id) AS rk FROM ax, g) WHERE rk <= 20 GROUP BY 1, 2, 3"}


@query("nearest_m_mean", with_("ax", extra=_NEAR, body=f"SELECT event_type, t_idx, {R('c')} AS t, {R('mean')} AS mean FROM nr"))
def _(t: Tables):
    return rounded(w.nearest_m_mean(t.ax, keys=["event_type"]))


@query("nearest_m_peak", with_("ax", extra=_NEAR, body=f"SELECT event_type, first(t_idx ORDER BY round(mean, 9) DESC, t_idx) AS t_idx, {R('first(c ORDER BY round(mean, 9) DESC, t_idx)')} AS t, {R('max(mean)')} AS peak FROM nr GROUP BY 1"))
def _(t: Tables):
    curve = w.nearest_m_mean(t.ax, keys=["event_type"]).withColumn("mean", F.round("mean", 9))  # equal neighbour sets tie
    return rounded(w.peak(curve, "mean", ["event_type"]))


@query("rolling_mean", with_("ax", body=f"SELECT cell_id, {R('avg(value) OVER (ORDER BY t, cell_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)')} AS smooth FROM ax"))
def _(t: Tables):
    return rounded(w.rolling_mean(t.ax, 25, block=1000).select("cell_id", "smooth"))


@query("fate_bins", with_("ax", extra={**_SPARSE, "b": "SELECT least(floor(t * 200e0), 199)::INT AS t_idx, sum(value / 100e0 * value) / (sum(value / 100e0) + 1e-8) AS m FROM sp WHERE t > 0.03 GROUP BY 1",
    "f": "SELECT i::INT AS t_idx, m, last_value(m IGNORE NULLS) OVER (ORDER BY i) AS l, first_value(m IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM (SELECT unnest(range(200)) AS i) LEFT JOIN b ON t_idx = i"},
    body=f"SELECT t_idx, m IS NULL AS empty, {R('coalesce(m, (l + r) / 2, l, r, 0)')} AS mean FROM f"))
def _(t: Tables):
    return rounded(w.fate_bins(_gappy(t).where(F.col("t") > 0.03).withColumn("w", F.col("value") / 100.0), 200))


_SHAPE = {"g": _GRID_SQL, "h": "SELECT unnest([0.02e0, 0.05e0, 0.1e0]) AS h", "k": "SELECT h, t_idx, g, exp(-0.5e0 * ((g - t) / h) ** 2) AS w, value / 10e0 - 4.5e0 AS value FROM ax, g, h",
          "cv": "SELECT h, t_idx, g, sum(w * value) / sum(w) AS m, sum(w) ** 2 / sum(w * w) AS n_eff FROM k GROUP BY 1, 2, 3",
          "pk": "SELECT h, max(m) AS top, median(m) AS med, arg_max(t_idx, m) AS pk, min(t_idx) AS f, max(t_idx) AS l FROM cv GROUP BY 1",
          "ed": "SELECT h, top, med, coalesce(max(CASE WHEN m <= top / 2 AND t_idx < pk THEN t_idx END), f) AS li, coalesce(min(CASE WHEN m <= top / 2 AND t_idx > pk THEN t_idx END), l) AS ri FROM cv JOIN pk USING (h) GROUP BY h, top, med, f, l",
          "sh": "SELECT e.h, top, top - med AS c, CASE WHEN top > 0 THEN b.g - a.g END AS fwhm FROM ed e JOIN cv a ON a.h = e.h AND a.t_idx = li JOIN cv b ON b.h = e.h AND b.t_idx = ri"}


@query("bandwidth_shape", with_("ax", extra=_SHAPE, body=f"SELECT h, {R('c')} AS c, {R('fwhm')} AS fwhm, {R('CASE WHEN fwhm IS NULL OR fwhm <= 0 THEN 0e0 ELSE top / greatest(fwhm, 1e-6) END')} AS l, {R('top')} AS top FROM sh"))
def _(t: Tables):
    rows = t.ax.withColumn("value", F.col("value") / 10.0 - 4.5)
    out = None
    for h in (0.02, 0.05, 0.1):
        c = w.kernel_smooth(rows, _GRID, h).withColumn("h", F.lit(h))
        out = c if out is None else out.unionByName(c)
    return rounded(w.bandwidth_shape(out, ["h"]))


# replicate counts as SQL: the same arithmetic as kernels.poisson_counts, seed 0
_DRAWS = {"dr": "SELECT cell_id, t, value / 10e0 - 4.5e0 AS value, r AS rep, cell_id % 2147483647 AS h0, ((cell_id % 2147483647) * 48271 + (r + 1) * 40692) % 2147483647 AS h1 FROM ax, (SELECT unnest(range({n}))::BIGINT AS r)",
          "du": "SELECT cell_id, t, value, rep, ((h3 * h3 + h1) % 2147483647 + 0.5e0) / 2147483647e0 AS u FROM (SELECT *, (((h1 * h1 + h0) % 2147483647) * 40014 + rep + 1) % 2147483647 AS h3 FROM dr)",
          "bt": "SELECT t, value, rep, m FROM (SELECT *, list_sum([(u > c)::INT FOR c IN [" + ", ".join(f"{float(c)!r}::DOUBLE" for c in POISSON) + "]]) AS m FROM du) WHERE m > 0 UNION ALL SELECT t, value / 10e0 - 4.5e0, -1, 1 FROM ax"}


def _draws(n: int) -> dict[str, str]:
    return {k: v.replace("{n}", str(n)) for k, v in _DRAWS.items()}


_FULL = w.linspace(0.02, 0.98, 200)  # the default grid, bandwidths and replicates
_SCORE = {**_draws(20), "g": "SELECT unnest(range(200))::INT AS t_idx, unnest([" + ", ".join(repr(g) + "::DOUBLE" for g in _FULL) + "]) AS g, ",
          "hh": f"SELECT unnest([{', '.join(f'{h}::DOUBLE' for h in w.BANDWIDTHS)}]) AS h"}
_SCORE["g"] = _SCORE["g"].rstrip(", ")
_SCORE |= {"cb": "SELECT h, rep, t_idx, g, sum(m * k * value) / greatest(sum(m * k), 1e-12) AS m, sum(m * k) ** 2 / greatest(sum(m * k * k), 1e-12) AS n_eff FROM (SELECT h, rep, t_idx, g, m, value, exp(-0.5e0 * ((g - t) / h) ** 2) AS k FROM bt, hh, g) GROUP BY 1, 2, 3, 4",
           "cv": "SELECT h, t_idx, g, m FROM cb WHERE rep = -1", **{k: _SHAPE[k] for k in ("pk", "ed", "sh")},
           "inn": "SELECT h, min(n_eff) AS ne FROM cb WHERE rep = -1 AND g >= 0.1 AND g <= 0.9 GROUP BY 1",
           "rr": "SELECT h, avg(r) AS r FROM (SELECT x.h AS h, corr(x.m, y.m) AS r FROM cb x JOIN cb y ON x.h = y.h AND x.t_idx = y.t_idx AND x.rep >= 0 AND y.rep > x.rep GROUP BY x.h, x.rep, y.rep) GROUP BY 1",
           "al": "SELECT h, c, CASE WHEN fwhm IS NULL OR fwhm <= 0 THEN 0e0 ELSE top / greatest(fwhm, 1e-6) END AS l, ne, r FROM sh JOIN inn USING (h) JOIN rr USING (h)"}


@query("bandwidth_score", with_("ax", extra=_SCORE, body=f"SELECT h, {R('c')} AS c, {R('l')} AS l, {R('ne')} AS n_eff_interior_min, {R('r')} AS r, {R('r * c * l')} AS s, ne >= 30 AS valid FROM al"))
def _(t: Tables):
    rows = t.ax.withColumn("value", F.col("value") / 10.0 - 4.5)
    return rounded(w.bandwidth_score(rows, _FULL))


@query("select_bandwidth", f"""WITH s AS (SELECT c_custkey AS h, c_acctbal / 1000e0 AS s, c_nationkey >= 5 AS valid FROM customer)
    SELECT arg_max(h, s)::DOUBLE AS h, {R('max(s)')} AS s, true AS valid FROM s WHERE valid""")
def _(t: Tables):
    s = t.customer.select(F.col("c_custkey").cast("double").alias("h"), (F.col("c_acctbal") / 1000.0).alias("s"), (F.col("c_nationkey") >= 5).alias("valid"))
    return rounded(w.select_bandwidth(s))


@query("weighted_centre", with_("ax", body=f"SELECT user_id, {R('sum(t * greatest(value - 30, 0)) / sum(greatest(value - 30, 0))')} AS centre FROM ax GROUP BY 1"))
def _(t: Tables):
    return rounded(w.weighted_centre(t.ax.withColumn("value", F.col("value") - 30), ["user_id"]))


_Q = w.linspace(0.005, 0.995, 67)


@query("resample_to_grid", with_("act", extra={"q": "SELECT unnest(range(67))::INT AS t_idx, unnest([" + ", ".join(f"{x!r}::DOUBLE" for x in _Q) + "]) AS g",
    "sg": "SELECT k, t AS t0, a AS a0, lead(t) OVER p AS t1, lead(a) OVER p AS a1, row_number() OVER p AS i, count(*) OVER (PARTITION BY k) AS n FROM act WINDOW p AS (PARTITION BY k ORDER BY t)"},
    body=f"""SELECT k, q.t_idx, {R('g')} AS t, {R('a0 + (a1 - a0) * (g - t0) / (t1 - t0)')} AS value FROM q JOIN sg ON t1 IS NOT NULL AND (g >= t0 OR i = 1) AND (g < t1 OR i = n - 1)"""))
def _(t: Tables):
    return rounded(w.resample_to_grid(t.act, _Q, "a", ["k"]))


@query("first_crossing", with_("act", extra={"p": "SELECT x.k AS k, x.t_idx, x.t, x.a - y.a AS d FROM act x JOIN act y ON y.k = 'view' AND y.t_idx = x.t_idx WHERE x.k <> 'view'",
    "l": "SELECT *, lag(d) OVER q AS pd, lag(t) OVER q AS pt FROM p WINDOW q AS (PARTITION BY k ORDER BY t)"},
    body=f"SELECT k, {R('arg_min(pt + (t - pt) * pd / (pd - d), t)')} AS t_cross FROM l WHERE pd > 0 AND d <= 0 GROUP BY 1"))
def _(t: Tables):
    b = t.act.where(F.col("k") == "view").select("t_idx", F.col("a").alias("b"))
    return rounded(w.first_crossing(t.act.where(F.col("k") != "view").join(b, "t_idx"), "a", "b", ["k"]))
