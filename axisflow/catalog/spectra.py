"""Spectra, factorisation, projection to features, Fourier analysis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.vectors import vec_sum
from ..operators import fourier as fr
from ..operators import spectra as s
from ..session import cut_lineage
from .base import N_T, R, Tables, query, rounded, vec_long, with_


def _ops(t: Tables):
    """Every 64-component vector is an 8 x 8 operator."""
    return t.embt.select("cell_id", "t", F.col("x").alias("j"))


@query("operator_spectrum")
def _(t: Tables):
    return rounded(s.operator_spectrum(_ops(t), 8).select("cell_id", "lam", vec_sum("re").alias("trace"), F.array_max("re").alias("top")))


# the trace and the sum of squared eigenvalues (trace of the square) are known without an eigensolver
@query("spectrum_identities", with_("embt", body=f"""SELECT cell_id, {R('list_sum([x[8 * i + i + 1] for i in range(8)])')} AS trace,
    {R('list_sum([list_sum([x[8 * i + k + 1] * x[8 * k + i + 1] for k in range(8)]) for i in range(8)])')} AS trace_sq FROM embt"""))
def _(t: Tables):
    sp = s.operator_spectrum(_ops(t), 8)
    sq = vec_sum(F.zip_with("re", "im", lambda a, b: a * a - b * b))
    return rounded(sp.select("cell_id", vec_sum("re").alias("trace"), sq.alias("trace_sq")))


# the leading 2 x 2 block has a closed form
@query("spectrum_2x2", with_("fold", body=f"""SELECT cell_id, {R('CASE WHEN ((x[1] - x[4]) / 2) ** 2 + x[2] * x[3] >= 0 THEN (x[1] + x[4]) / 2 + sqrt(greatest(((x[1] - x[4]) / 2) ** 2 + x[2] * x[3], 0)) ELSE (x[1] + x[4]) / 2 END')} AS lam FROM
    (SELECT cell_id, [x[1] + x[5], x[2] + x[6], x[3] + x[7], x[4] + x[8]] AS x FROM fold)"""))
def _(t: Tables):
    half = t.fold.select("cell_id", F.array(*[F.col("x")[i] + F.col("x")[i + 4] for i in range(4)]).alias("j"))
    return rounded(s.operator_spectrum(half, 2).select("cell_id", "lam"))


@query("spectral_metrics", with_("fold", body=f"""SELECT cell_id, {R('list_max(x)')} AS lambda_max, {R('list_min(x)')} AS lambda_min,
    {R('len([v for v in x if abs(v) < 0.1]) / 8e0')} AS plasticity, len([v for v in x if v < 0])::DOUBLE AS stable_dim FROM fold"""))
def _(t: Tables):
    return rounded(s.spectral_metrics(t.fold.select("cell_id", F.col("x").alias("re"))).drop("re"))


@query("spectrum_features", with_("embt", extra={"z": "SELECT cell_id, list_sort([struct_pack(a := x[i + 1], b := x[i + 33]) for i in range(32)], 'DESC') AS z FROM embt"},
    body=f"SELECT cell_id, i::INT AS i, {R('CASE WHEN i < 32 THEN z[i + 1].a ELSE z[i - 31].b END')} AS value FROM z, (SELECT unnest(range(64)) AS i)"))
def _(t: Tables):
    sp = t.embt.select("cell_id", F.slice("x", 1, 32).alias("re"), F.slice("x", 33, 32).alias("im"))
    return rounded(vec_long(s.spectrum_features(sp), "features", "cell_id"))


@query("operator_embedding")
def _(t: Tables):
    z, model = s.operator_embedding(_ops(t), "pca", 6, 64)
    return rounded(z.select("cell_id", F.posexplode("z").alias("i", "z")).withColumn("explained", F.lit(float(model["ratio"].sum()))))


@query("operator_embedding_spectrum")
def _(t: Tables):
    sp = s.spectrum_features(s.operator_spectrum(_ops(t), 8))
    z, model = s.operator_embedding(sp, "spectrum", 4, 16)
    return rounded(z.select("cell_id", F.posexplode("z").alias("i", "z")).withColumn("explained", F.lit(float(model["ratio"].sum()))))


WIDE_ROWS = 256  # operators of 64 x 64 that are made at once


# operators of 64 x 64, the outer products of the vectors: 4,096 columns by a randomised range
@query("operator_embedding_wide")
def _(t: Tables):
    @F.pandas_udf("array<double>")
    def outer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            for at in range(0, len(x), WIDE_ROWS):  # a row grows 64 times, so a batch goes out in pieces
                v = np.stack(x.iloc[at:at + WIDE_ROWS].to_numpy())
                yield pd.Series(list((v[:, :, None] * v[:, None, :]).reshape(len(v), -1)))
    z, model = s.operator_embedding(t.emb.select("cell_id", outer("x").alias("j")), "pca", 6, 4096)
    return rounded(z.select("cell_id", F.posexplode("z").alias("i", "z")).withColumn("explained", F.lit(float(model["ratio"].sum()))))


# on four metrics the total variance is kept and the raw metrics are returned for n >= 4
@query("operator_embedding_metrics", with_("met", body=f"SELECT cell_id, {R('lambda_max')} AS z0, {R('lambda_min')} AS z1, {R('plasticity')} AS z2, {R('stable_dim')} AS z3 FROM met"))
def _(t: Tables):
    z, _ = s.operator_embedding(t.met, "metrics", 4, 4)
    return rounded(z.select("cell_id", *[F.col("z")[i].alias(f"z{i}") for i in range(4)]))


def _brand_edges(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("i"), F.col("p_type").alias("ty"), "l_quantity")
    # brand x brand operator: co-occurrence weight through part type
    a = j.groupBy("i", "ty").agg((F.sum("l_quantity") / 10000.0).alias("q"))
    return a.join(a.select(F.col("i").alias("j"), "ty", F.col("q").alias("q2")), "ty").groupBy("i", "j").agg(F.sum(F.col("q") * F.col("q2")).alias("v"))


_MODE = {"a": "SELECT p_brand AS i, p_type AS ty, sum(l_quantity) / 10000e0 AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
         "e": "SELECT x.i AS i, y.i AS j, sum(x.q * y.q) AS v FROM a x JOIN a y USING (ty) GROUP BY 1, 2", "x0": "SELECT DISTINCT i, 1e0 AS x FROM e"}
for _r in range(25):
    _MODE[f"y{_r}"] = f"SELECT e.i, sum(v * x) AS x FROM e JOIN x{_r} ON x{_r}.i = e.j GROUP BY 1"
    _MODE[f"x{_r + 1}"] = f"SELECT i, x / (SELECT sqrt(sum(x * x)) FROM y{_r}) AS x FROM y{_r}"


@query("dominant_mode", with_(extra=_MODE, body=f"SELECT i, {R('x')} AS x FROM x25"))
def _(t: Tables):
    return rounded(s.dominant_mode(_brand_edges(t)))


@query("dominant_eigenvalue", with_(extra=_MODE, body=f"SELECT {R('sum(v * p.x * q.x) / (SELECT sum(x * x) FROM x25)')} AS lambda FROM e JOIN x25 p ON p.i = e.i JOIN x25 q ON q.i = e.j"))
def _(t: Tables):
    e = cut_lineage(_brand_edges(t))
    return rounded(s.rayleigh(e, s.dominant_mode(e)))


def _sequence(t: Tables):
    """Temporal operator: one 8 x 8 operator per grid point, kernel mean over all vectors."""
    from ..operators import windows as w
    cols = [f"v{i}" for i in range(64)]
    rows = t.embt.select("t", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    out = w.kernel_smooth(rows, w.linspace(0.05, 0.95, 30), 0.08, values=cols)
    return out.select("t_idx", "t", F.array(*cols).alias("m"))


@query("semi_nmf")
def _(t: Tables):
    seq = cut_lineage(_sequence(t))
    fit, h, err = s.semi_nmf(seq, 3, 64)
    return rounded(s.activations(fit, 3).withColumn("error", F.lit(float(err))))


@query("semi_nmf_r2")
def _(t: Tables):
    seq = cut_lineage(_sequence(t))
    fit, h, _ = s.semi_nmf(seq, 3, 64)
    hat = F.array(*[sum((F.col("w")[k] * float(h[k, d]) for k in range(3)), F.lit(0.0)) for d in range(64)])
    obs = fit.select("t_idx", F.posexplode("m").alias("d", "v"))
    return rounded(s.reconstruction_r2(obs, fit.select("t_idx", F.posexplode(hat).alias("d", "v_hat")), ["t_idx", "d"]))


@query("svd_modes")
def _(t: Tables):
    from ..operators.grn import grn_columns
    cols = grn_columns(t.grn, 12)
    out, u, sv = s.svd_modes(cols, 12, 3)
    return rounded(out.agg(*[F.sum(F.col("v")[k] * F.col("v")[k]).alias(f"norm{k}") for k in range(3)], F.lit(float(sv[0])).alias("s0")))


# all modes together give back the squared norm of the matrix
@query("svd_total_energy", with_("grn", body=f"SELECT {R('sum(v * v)')} AS energy FROM grn"))
def _(t: Tables):
    from ..operators.grn import grn_columns
    cols = grn_columns(t.grn, 12)
    _, _, sv = s.svd_modes(cols, 12, 12)
    return rounded(cols.limit(1).select(F.lit(float((sv ** 2).sum())).alias("energy")))


@query("reconstruction_r2", with_("act", "lam", body=f"SELECT k, {R('greatest(0, 1 - sum((a - (0.5e0 + lam / 10)) ** 2) / (sum(a * a) + 1e-8))')} AS r2 FROM act JOIN lam USING (t_idx) GROUP BY 1"))
def _(t: Tables):
    fit = t.act.select("k", "t_idx").join(t.lam.select("t_idx", "lam"), "t_idx").select("k", "t_idx", (F.lit(0.5) + F.col("lam") / 10).alias("v_hat"))
    return rounded(s.reconstruction_r2(t.act.select("k", "t_idx", F.col("a").alias("v")), fit, ["k", "t_idx"], ["k"]))


@query("normalise_activations", with_("ax", body=f"""SELECT user_id AS k, t_idx, {R('m / (max(m) OVER (PARTITION BY user_id) + 1e-8)')} AS a FROM
    (SELECT user_id, least(floor(t * 40e0), 39)::INT AS t_idx, avg(value) AS m FROM ax GROUP BY 1, 2)"""))
def _(t: Tables):
    from ..operators.windows import bin_index
    m = t.ax.withColumn("t_idx", bin_index("t", N_T)).groupBy(F.col("user_id").alias("k"), "t_idx").agg(F.avg("value").alias("a"))
    return rounded(s.normalise_activations(m))


@query("activation_correlation", with_("act", body=f"SELECT x.k AS k1, y.k AS k2, {R('corr(x.a, y.a)')} AS r FROM act x JOIN act y USING (t_idx) GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(s.activation_correlation(t.act))


_ALIGN = {"cv": "SELECT t_idx, lam, [a1, a2] AS v FROM lam JOIN (SELECT t_idx, max(CASE WHEN k = 'click' THEN a END) - 0.5e0 AS a1, max(CASE WHEN k = 'view' THEN a END) - 0.5e0 AS a2 FROM act GROUP BY 1) USING (t_idx)",
          "isl": "SELECT *, sum(CASE WHEN lam > 0 THEN 0 ELSE 1 END) OVER (ORDER BY t_idx) AS isl, CASE WHEN lam > 0 AND lag(lam) OVER (ORDER BY t_idx) > 0 AND list_dot_product(v, lag(v) OVER (ORDER BY t_idx)) < 0 THEN 1 ELSE 0 END AS neg FROM cv",
          "al": "SELECT t_idx, lam, v, CASE WHEN lam <= 0 THEN 0e0 WHEN sum(neg) OVER (PARTITION BY isl ORDER BY t_idx) % 2 = 1 THEN -1e0 ELSE 1e0 END AS sign FROM isl"}


def _aligned(t: Tables):
    two = t.act.groupBy("t_idx").agg((F.max(F.when(F.col("k") == "click", F.col("a"))) - 0.5).alias("a1"), (F.max(F.when(F.col("k") == "view", F.col("a"))) - 0.5).alias("a2"))
    return s.sign_align(t.lam.select("t_idx", "lam").join(two, "t_idx").select("t_idx", "lam", F.array("a1", "a2").alias("v")))


@query("sign_align", with_("act", "lam", extra=_ALIGN, body=f"SELECT t_idx, {R('lam')} AS lam, sign, {R('v[1] * sign')} AS v1, {R('v[2] * sign')} AS v2 FROM al"))
def _(t: Tables):
    return rounded(_aligned(t).select("t_idx", "lam", "sign", F.col("v")[0].alias("v1"), F.col("v")[1].alias("v2")))


@query("project_features", with_("act", "lam", extra=_ALIGN, body=f"SELECT t_idx, p_partkey AS feature, {R('p_size / 50e0 * v[1] * sign + p_retailprice / 2000e0 * v[2] * sign')} AS score FROM al, part"))
def _(t: Tables):
    load = t.part.select(F.col("p_partkey").alias("feature"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0).alias("w"))
    return rounded(s.project_features(_aligned(t), load, 2))


_GF = {"gf": "SELECT feature, sum(abs(score)) / (SELECT count(*) FROM lam WHERE lam > 0) AS m FROM track WHERE t_idx IN (SELECT t_idx FROM lam WHERE lam > 0) GROUP BY 1"}


@query("global_feature_rank", with_("track", "lam", extra=_GF, body=f"SELECT feature, {R('m')} AS mean_score, row_number() OVER (ORDER BY m DESC, feature)::INT AS rank FROM gf QUALIFY rank <= 50"))
def _(t: Tables):
    return rounded(s.global_feature_rank(t.track, t.lam))


_AG = {"cut": "SELECT k, quantile_cont(a, 0.75) AS c FROM act GROUP BY 1",
       "onk": "SELECT k, t_idx, count(*) OVER (PARTITION BY k) AS n FROM act JOIN cut USING (k) WHERE a >= c AND t_idx IN (SELECT t_idx FROM lam WHERE lam > 0)",
       "af": "SELECT k, feature, sum(abs(score)) / any_value(n) AS m FROM track JOIN onk USING (t_idx) GROUP BY 1, 2",
       "afr": "SELECT *, row_number() OVER (PARTITION BY k ORDER BY m DESC, feature)::INT AS rank FROM af"}


@query("archetype_feature_rank", with_("track", "lam", "act", extra=_AG, body=f"SELECT k, feature, {R('m')} AS mean_score, rank FROM afr WHERE rank <= 20"))
def _(t: Tables):
    return rounded(s.archetype_feature_rank(t.track, t.act, t.lam, 20))


@query("instability_table", with_("track", "lam", "act", extra={**_AG,
    "st": """SELECT k, avg(lam) FILTER (a > 0.5) AS ms, avg(CASE WHEN lam > 0.05 THEN 1e0 ELSE 0e0 END) FILTER (a > 0.5) AS sf, arg_max(act.t, a) AS pt FROM act JOIN lam USING (t_idx) GROUP BY 1 HAVING count(*) FILTER (a > 0.5) > 0"""},
    body=f"SELECT k, {R('ms')} AS mean_sensitivity, {R('sf')} AS sensitive_fraction, {R('pt')} AS peak_t, feature, {R('m')} AS score, rank FROM st JOIN afr USING (k) WHERE rank <= 10 AND sf >= 0.1 AND k IN (SELECT k FROM st WHERE sf >= 0.1 ORDER BY ms DESC, k LIMIT 3)"))
def _(t: Tables):
    return rounded(s.instability_table(t.track, t.act, t.lam, 10, top_archetypes=3))


@query("feature_peak_table", with_("track", "lam", "act", extra={**_GF, "tp": "SELECT feature, m, row_number() OVER (ORDER BY m DESC, feature)::INT AS rank FROM gf QUALIFY rank <= 15",
    "pk": "SELECT feature, m, rank, arg_max(t_idx, abs(score)) AS t_idx FROM track JOIN tp USING (feature) WHERE t_idx IN (SELECT t_idx FROM lam WHERE lam > 0.05) GROUP BY 1, 2, 3"},
    body=f"SELECT feature, rank, {R('m')} AS mean_score, {R('lam.t')} AS peak_t, (SELECT arg_max(k, a) FROM act WHERE act.t_idx = pk.t_idx) AS archetype FROM pk JOIN lam USING (t_idx)"))
def _(t: Tables):
    return rounded(s.feature_peak_table(t.track, t.act, t.lam, 15))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("feature_by_archetype", with_("track", "lam", "act", extra={**_AG, **_GF}, body="SELECT feature, " + ", ".join(R(f"coalesce(max(m) FILTER (k = '{k}'), 0e0)") + f" AS {k}" for k in _TYPES)
    + " FROM af WHERE feature IN (SELECT feature FROM gf ORDER BY m DESC, feature LIMIT 20) GROUP BY 1"))
def _(t: Tables):
    return rounded(s.feature_by_archetype(t.track, t.act, t.lam, _TYPES, 20))


def _br(thr: float) -> dict[str, str]:
    return {n: q.replace("0.95", f"{thr}e0") for n, q in _BR.items()}


_BR = {"bl": "SELECT 'fwd' AS direction, t_idx, lam FROM lam UNION ALL SELECT 'bwd', t_idx, -lam FROM lam",
       "ba": "SELECT 'fwd' AS direction, k, t_idx, t, a FROM act UNION ALL SELECT 'bwd', k, t_idx, t, a * a FROM act",
       "bt": "SELECT 'fwd' AS direction, t_idx, feature, score FROM track UNION ALL SELECT 'bwd', t_idx, feature, score * 0.5e0 FROM track",
       "bm": "SELECT direction, k, t_idx, lam, a >= 0.95 AND lam > 0 AS on_, lam > 0 AS sens, sum(CASE WHEN a >= 0.95 AND lam > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY direction, k) AS non FROM ba JOIN bl USING (direction, t_idx)",
       "bu": "SELECT direction, k, t_idx, lam FROM bm WHERE CASE WHEN non > 0 THEN on_ ELSE sens END",
       "bs": "SELECT direction, k, avg(lam) AS ms, count(*) AS n FROM bu GROUP BY 1, 2",
       "bf": "SELECT direction, k, feature, sum(abs(score)) / any_value(n) AS sc, any_value(ms) AS ms FROM bt JOIN bu USING (direction, t_idx) JOIN bs USING (direction, k) GROUP BY 1, 2, 3",
       "br": "SELECT *, row_number() OVER (PARTITION BY direction, k ORDER BY sc DESC, feature)::INT AS rank FROM bf QUALIFY rank <= 10",
       "bp": "SELECT direction, k, arg_max(t, a) AS pt FROM ba GROUP BY 1, 2"}


def bridge_inputs(t: Tables):
    d = lambda df, name, **c: df.withColumns({"direction": F.lit(name), **c})
    lam = d(t.lam, "fwd").unionByName(d(t.lam, "bwd", lam=-F.col("lam")))
    act = d(t.act, "fwd").unionByName(d(t.act, "bwd", a=F.col("a") * F.col("a")))
    track = d(t.track, "fwd").unionByName(d(t.track, "bwd", score=F.col("score") * 0.5))
    return track, act, lam


@query("bridge_feature_table", with_("track", "lam", "act", extra=_br(0.95), body=f"SELECT direction, k, feature, {R('sc')} AS score, {R('ms')} AS mean_sensitivity, rank, {R('pt')} AS peak_t FROM br JOIN bp USING (direction, k)"))
def _(t: Tables):
    return rounded(s.bridge_feature_table(*bridge_inputs(t), 10, act_thr=0.95))


@query("filter_bridge_features", with_("track", "lam", "act", extra={**_br(0.2), "keep": "SELECT direction, k FROM (SELECT direction, k, row_number() OVER (PARTITION BY direction ORDER BY avg(ms) DESC, k) AS r FROM br WHERE rank <= 4 GROUP BY 1, 2) WHERE r <= 2"},
    body=f"SELECT direction, k, feature, {R('sc')} AS score, rank FROM br JOIN keep USING (direction, k) WHERE rank <= 4"))
def _(t: Tables):
    tab = s.bridge_feature_table(*bridge_inputs(t), 10, act_thr=0.2)
    return rounded(s.filter_bridge_features(tab, 4, 2).select("direction", "k", "feature", "score", "rank"))


@query("direction_asymmetry", with_("act", body=f"SELECT x.t_idx, {R('x.t')} AS t, {R('x.a - y.a')} AS asymmetry FROM act x JOIN act y USING (t_idx) WHERE x.k = 'click' AND y.k = 'error'"))
def _(t: Tables):
    return rounded(s.direction_asymmetry(t.act.where(F.col("k") == "click"), t.act.where(F.col("k") == "error"), "a"))


@query("archetype_profile", with_("track", "lam", "act", extra={**_AG, "top": "SELECT k, string_agg(feature, ',' ORDER BY rank) AS features, count(*) FILTER (feature IN ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7', 'u8'))::INT AS hits FROM afr WHERE rank <= 20 GROUP BY 1",
    "pk": "SELECT k, arg_max(t, a) AS pt, arg_max(t_idx, a) AS t_idx, max(a) AS amp FROM act GROUP BY 1"},
    body=f"SELECT k, {R('pt')} AS peak_t, n_eff AS n_eff_at_peak, pt < 0.05 OR pt > 0.95 AS is_boundary, {R('amp')} AS amplitude, features, hits FROM pk JOIN top USING (k) JOIN lam USING (t_idx)"))
def _(t: Tables):
    sc = s.archetype_feature_score(t.track, t.act, t.lam).withColumnRenamed("mean_score", "score")
    out = s.archetype_profile(t.act, t.lam, sc, [f"u{i}" for i in range(1, 9)])
    return rounded(out.withColumn("features", F.array_join("features", ",")))


@query("handoffs", with_("act", extra={"pr": "SELECT x.k AS k1, y.k AS k2, corr(x.a, y.a) AS r FROM act x JOIN act y USING (t_idx) WHERE x.k < y.k GROUP BY 1, 2",
    "d": "SELECT k1, k2, r, x.t, sign(x.a - y.a) AS s, lead(sign(x.a - y.a)) OVER (PARTITION BY k1, k2 ORDER BY x.t_idx) AS n FROM pr JOIN act x ON x.k = k1 JOIN act y ON y.k = k2 AND y.t_idx = x.t_idx WHERE r < 0"},
    body=f"SELECT k1, k2, {R('r')} AS r, {R('t')} AS t FROM d WHERE n <> s"))
def _(t: Tables):
    return rounded(s.handoffs(t.act, 0.0))


# ---- Fourier ----
_DFT = {"f": """SELECT cell_id, k, list_sum([x[n + 1] * cos(2 * pi() * k * n / 64e0) for n in range(64)]) AS re, -list_sum([x[n + 1] * sin(2 * pi() * k * n / 64e0) for n in range(64)]) AS im
        FROM emb, (SELECT unnest(range(33)) AS k)"""}


@query("dft", with_("emb", extra=_DFT, body=f"SELECT cell_id, k::INT AS k, {R('re')} AS re, {R('im')} AS im, {R('sqrt(re * re + im * im)')} AS mag FROM f"))
def _(t: Tables):
    return rounded(fr.to_long(fr.dft(t.emb)).drop("phase"))


@query("dft_phase", with_("emb", extra=_DFT, body=f"SELECT cell_id, k::INT AS k, {R('atan2(im, re)')} AS phase FROM f WHERE k BETWEEN 1 AND 31"))
def _(t: Tables):
    return rounded(fr.to_long(fr.dft(t.emb)).where(F.col("k").between(1, 31)).select("cell_id", "k", "phase"))


@query("idft_round_trip", with_("emb", body=f"SELECT cell_id, i::INT AS i, {R('x[i + 1]')} AS value FROM emb, (SELECT unnest(range(64)) AS i)"))
def _(t: Tables):
    z = fr.merge_bands(fr.split_bands(fr.dft(t.emb), 33))
    return rounded(vec_long(fr.idft(z, 64), "x_back", "cell_id"))


_BAND = "CASE WHEN k < 6 THEN 'low' WHEN k < 19 THEN 'mid' ELSE 'high' END"


@query("split_bands", with_("emb", extra=_DFT, body=f"SELECT cell_id, {R('sum(re) FILTER (k < 6)')} AS low, {R('sum(re) FILTER (k >= 6 AND k < 19)')} AS mid, {R('sum(re) FILTER (k >= 19)')} AS high FROM f GROUP BY 1"))
def _(t: Tables):
    b = fr.split_bands(fr.dft(t.emb), 33)
    return rounded(b.select("cell_id", *[vec_sum(f"re_{n}").alias(n) for n in ("low", "mid", "high")]))


@query("band_power", with_("emb", extra=_DFT, body=f"SELECT cell_id, {_BAND} AS band, {R('avg(re * re + im * im)')} AS power FROM f GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(fr.band_power(fr.to_long(fr.dft(t.emb)), 33))


@query("low_pass", with_("emb", extra=_DFT, body=f"""SELECT cell_id, n::INT AS i, {R('sum(CASE WHEN k = 0 THEN re ELSE 2 * (re * cos(2 * pi() * k * n / 64e0) - im * sin(2 * pi() * k * n / 64e0)) END) / 64')} AS value
    FROM f, (SELECT unnest(range(64)) AS n) WHERE k < 19 GROUP BY 1, 2"""))
def _(t: Tables):
    return rounded(vec_long(fr.low_pass(t.emb, 64), "smooth", "cell_id"))


@query("spectral_roughness", with_("emb", extra=_DFT, body=f"SELECT {R('avg((n - m) ** 2)')} AS roughness FROM (SELECT sqrt(re * re + im * im + 1e-8) AS m, lead(sqrt(re * re + im * im + 1e-8)) OVER (PARTITION BY cell_id ORDER BY k) AS n FROM f)"))
def _(t: Tables):
    return rounded(fr.roughness(fr.to_long(fr.dft(t.emb))))


@query("band_weighted_difference", with_("emb", extra=_DFT, body=f"SELECT {R('avg(CASE WHEN k < 6 THEN 1e0 WHEN k < 19 THEN 1e0 ELSE 0.5e0 END * (CASE WHEN k < 19 THEN 0 ELSE re * re + im * im END))')} AS difference FROM f"))
def _(t: Tables):
    a = fr.to_long(fr.dft(t.emb))
    b = fr.to_long(fr.dft(fr.low_pass(t.emb, 64).drop("x").withColumnRenamed("smooth", "x")))
    return rounded(fr.band_weighted_difference(a, b, 33))
