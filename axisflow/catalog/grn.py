"""Regulator-to-gene operator sequences: suppliers act on brands along the shipping axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import grn as k
from .base import N_B, R, Tables, query, rounded, with_
from .neighbors import _REG, _regulon

_GENES = {"genes": "SELECT DISTINCT p_brand AS gene FROM part", "pairs": "SELECT l_suppkey AS tf, p_brand AS gene FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 30 AND l_discount >= 0.06 GROUP BY 1, 2"}


def _net(t: Tables):
    j = t.lineitem.where((F.col("l_quantity") >= 30) & (F.col("l_discount") >= 0.06)).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_suppkey").alias("source"), F.col("p_brand").alias("target")).distinct()


def _mask(t: Tables):
    return _net(t).select(F.col("source").alias("tf"), F.col("target").alias("gene"))


def _signs(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("tf"), F.col("p_brand").alias("gene"), "l_returnflag", "l_quantity")
    return k.sign_mask(j.select("tf", "gene").distinct(), j.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)), j.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)))


_SIGN = {"sg": """SELECT tf, gene, CASE WHEN max(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) = 1 THEN -1 WHEN max(CASE WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS sign
    FROM (SELECT l_suppkey AS tf, p_brand AS gene, l_returnflag, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2"""}


@query("tf_mask", """SELECT DISTINCT c_name AS tf, m AS gene FROM (SELECT 'part' || (l_partkey % 300)::VARCHAR AS c_name, 'part' || (l_suppkey)::VARCHAR AS m FROM lineitem WHERE l_quantity > 45)
    WHERE m IN (SELECT 'part' || p_size::VARCHAR FROM part) AND c_name IN (SELECT 'part' || p_size::VARCHAR FROM part WHERE p_size <= 20)
    UNION SELECT DISTINCT 'part' || p_size::VARCHAR, 'part' || p_size::VARCHAR FROM part WHERE p_size <= 20""")
def _(t: Tables):
    name = lambda c: F.concat(F.lit("part"), c.cast("string"))
    net = t.lineitem.where(F.col("l_quantity") > 45).select(name(F.col("l_partkey") % 300).alias("source"), name(F.col("l_suppkey")).alias("target"))
    genes = t.part.select(name(F.col("p_size")).alias("gene")).distinct()
    tfs = t.part.where(F.col("p_size") <= 20).select(name(F.col("p_size")).alias("tf")).distinct()
    return k.tf_mask(genes, tfs, net)


@query("sign_mask", with_(extra=_SIGN, body="SELECT * FROM sg"))
def _(t: Tables):
    return _signs(t)


@query("peak_prior", with_(extra={"m": "SELECT l_suppkey AS tf, l_partkey AS peak, avg(l_discount) AS motif FROM lineitem GROUP BY 1, 2", "a": "SELECT p_partkey AS peak, p_brand AS gene, p_size / 50e0 AS access FROM part",
    "s": "SELECT tf, gene, sum(motif * access) AS s FROM m JOIN a USING (peak) GROUP BY 1, 2"}, body=f"SELECT tf, gene, {R('s / (SELECT max(s) FROM s)')} AS prior FROM s"))
def _(t: Tables):
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("tf"), F.col("l_partkey").alias("peak")).agg(F.avg("l_discount").alias("motif"))
    a = t.part.select(F.col("p_partkey").alias("peak"), F.col("p_brand").alias("gene"), (F.col("p_size") / 50.0).alias("access"))
    return rounded(k.peak_prior(m, a))


def _linear_maps(t: Tables):
    """Decoder rows for parts and encoder columns for suppliers, eight entries each."""
    dec = t.part.select(F.col("p_partkey").alias("gene"), F.array(*[F.sin(F.col("p_size") * (i + 1) / 10.0) for i in range(8)]).alias("d"))
    enc = t.supplier.select(F.col("s_suppkey").alias("tf"), F.array(*[F.cos(F.col("s_nationkey") * (i + 1) / 10.0) for i in range(8)]).alias("e"))
    return dec, enc


_MAPS = {"bj": "SELECT greatest(least(ceil(t * 6e0) - 1, 5), 0)::INT AS bin, i, j, avg(x[8 * i + j + 1]) AS v FROM embt, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) GROUP BY 1, 2, 3",
         "dec": "SELECT p_partkey AS gene, i, sin(p_size * (i + 1) / 10e0) AS d FROM part, (SELECT unnest(range(8)) AS i)", "enc": "SELECT s_suppkey AS tf, j, cos(s_nationkey * (j + 1) / 10e0) AS e FROM supplier, (SELECT unnest(range(8)) AS j)",
         "u": "SELECT bin, tf, i, sum(v * e) AS u FROM bj JOIN enc USING (j) GROUP BY 1, 2, 3"}


def _bins(t: Tables):
    return k.binned_operator(t.embt.select("t", F.col("x").alias("j")), 6, 8)


@query("binned_operator", with_("embt", extra=_MAPS, body=f"SELECT bin, (8 * i + j)::INT AS i, {R('v')} AS value FROM bj"))
def _(t: Tables):
    return rounded(_bins(t).select("bin", F.posexplode("j").alias("i", "value")))


@query("binned_pullback", with_("embt", extra=_MAPS, body=f"SELECT bin, tf, gene, {R('sum(u * d)')} AS v FROM u JOIN dec USING (i) GROUP BY 1, 2, 3"))
def _(t: Tables):
    dec, enc = _linear_maps(t)
    return rounded(k.binned_pullback(t.embt.select("t", F.col("x").alias("j")), dec, enc, 6, 8))


# the restricted product equals the slice of the full product
@query("pullback_all_columns", with_("embt", extra=_MAPS, body=f"SELECT bin, gene, {R('sum(abs(v))')} AS total FROM (SELECT bin, tf, gene, sum(u * d) AS v FROM u JOIN dec USING (i) GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def _(t: Tables):
    dec, enc = _linear_maps(t)
    return rounded(k.pullback(_bins(t).select("bin", "j"), dec, enc, 8, total=True))


@query("soft_threshold", with_("grn", extra=_GENES, body=f"SELECT bin, tf, gene, {R('sign(v) * greatest(abs(v) - 0.00565e0, 0)')} AS v FROM grn JOIN pairs USING (tf, gene) WHERE abs(v) - 0.00565e0 > 0"))
def _(t: Tables):
    return rounded(k.soft_threshold(t.grn, 0.0113, _mask(t)))


def _dx(t: Tables):
    return t.grn.groupBy("bin", "gene").agg((F.avg("v") * 10).alias("dx"))


_DENSE = "SELECT bin, tf, gene, coalesce(v, 0e0) AS v FROM (SELECT DISTINCT tf, gene FROM grn) CROSS JOIN (SELECT unnest(range((SELECT min(bin) FROM grn), (SELECT max(bin) FROM grn) + 1))::INT AS bin) LEFT JOIN grn USING (bin, tf, gene)"


def _prox_sql(steps: int) -> dict[str, str]:
    """lr 0.1, L1 0.002, temporal 0.2, prior 0.3, local 0.05."""
    out = {**_GENES, **_SIGN, "dxs": "SELECT bin, gene, avg(v) * 10 AS dx FROM grn GROUP BY 1, 2", "dense": _DENSE,
           "k0": "SELECT bin, tf, gene, grn.v AS j, grn.v, CASE WHEN pairs.tf IS NULL THEN 0e0 ELSE 1e0 END AS al, coalesce(sg.sign, 0) AS sign, coalesce(x, 0e0) AS x FROM dense AS grn LEFT JOIN pairs USING (tf, gene) LEFT JOIN sg USING (tf, gene) LEFT JOIN xtf USING (bin, tf)"}
    for s in range(steps):
        out[f"r{s}"] = f"SELECT bin, gene, sum(v * x) - any_value(dx) AS res FROM k{s} JOIN dxs USING (bin, gene) GROUP BY 1, 2"
        out[f"h{s}"] = (f"SELECT k{s}.*, v - 0.1e0 * (2 * (v - j) + 0.4e0 * (coalesce(v - lag(v) OVER w, 0) + coalesce(v - lead(v) OVER w, 0)) + 0.6e0 * ((1 - al) * v + CASE WHEN sign > 0 AND v < 0 THEN v WHEN sign < 0 AND v > 0 THEN v ELSE 0 END)"
                        f" + 0.1e0 * coalesce(res, 0) * x) AS mv FROM k{s} LEFT JOIN r{s} USING (bin, gene) WINDOW w AS (PARTITION BY tf, gene ORDER BY bin)")
        out[f"k{s + 1}"] = f"SELECT bin, tf, gene, j, sign(mv) * greatest(abs(mv) - 0.1e0 * 0.002e0, 0) AS v, al, sign, x FROM h{s}"
    return out


@query("refine_grn", with_("grn", "xtf", extra=_prox_sql(4), body=f"SELECT bin, tf, gene, {R('v')} AS v FROM k4 WHERE al > 0 AND v <> 0"))
def _(t: Tables):
    return rounded(k.refine_grn(t.grn, 4, 0.1, 0.002, 0.2, 0.05, 0.3, t.xtf, _dx(t), _mask(t), _signs(t)))


@query("grn_objective", with_("grn", "xtf", extra={**_GENES, **_SIGN, "kk": "SELECT bin, tf, gene, v AS j, sign(v) * greatest(abs(v) - 0.005e0, 0) AS k FROM grn", "dxs": "SELECT bin, gene, avg(v) * 10 AS dx FROM grn GROUP BY 1, 2",
    "dense": _DENSE, "d": "SELECT k - lag(k) OVER (PARTITION BY tf, gene ORDER BY bin) AS d FROM (SELECT bin, tf, gene, sign(v) * greatest(abs(v) - 0.005e0, 0) AS k FROM dense)"},
    body=f"""SELECT {R('avg((k - j) ** 2)', 9)} AS fit, {R('avg(abs(k))', 9)} AS sparse, {R('avg(CASE WHEN pairs.tf IS NULL THEN k * k END)', 9)} AS forbidden,
    {R('coalesce(avg(CASE WHEN sg.sign > 0 THEN greatest(-k, 0) ** 2 END), 0) + coalesce(avg(CASE WHEN sg.sign < 0 THEN greatest(k, 0) ** 2 END), 0)', 9)} AS sign, {R('(SELECT avg(d * d) FROM d)', 9)} AS temporal,
    {R('(SELECT avg((coalesce(p, 0) - dx) ** 2) FROM dxs LEFT JOIN (SELECT bin, gene, sum(k * x) AS p FROM kk JOIN xtf USING (bin, tf) GROUP BY 1, 2) USING (bin, gene))', 9)} AS "local"
    FROM kk LEFT JOIN pairs USING (tf, gene) LEFT JOIN sg USING (tf, gene)"""))
def _(t: Tables):
    return rounded(k.grn_objective(k.soft_threshold(t.grn, 0.01), t.grn, _mask(t), _signs(t), t.xtf, _dx(t)), 9)


@query("grn_modes")
def _(t: Tables):
    m = k.grn_modes(t.grn, N_B, 3)
    head = m["tf_norms"].select("k", "rank", F.col("tf").cast("string").alias("name"), "norm").unionByName(m["gene_norms"].select("k", "rank", F.col("gene").alias("name"), "norm"))
    return rounded(head)


# norms are checked on archetypes given by a rule instead of a decomposition
@query("grn_mode_norms", with_("grn", body=f"SELECT bin AS k, tf, {R('sqrt(sum(v * v))')} AS norm, row_number() OVER (PARTITION BY bin ORDER BY sqrt(sum(v * v)) DESC, tf)::INT AS rank FROM grn GROUP BY 1, 2 QUALIFY rank <= 5"))
def _(t: Tables):
    return rounded(k.mode_norms(t.grn.withColumnRenamed("bin", "k"), "tf", 5))


@query("knockout", with_("grn", "xtf", body=f"SELECT tf, bin, gene, {R('-v * x')} AS effect FROM grn JOIN xtf USING (bin, tf)"))
def _(t: Tables):
    return rounded(k.knockout(t.grn, t.xtf))


_DIR = {"dr": "SELECT p_type AS k, p_brand AS gene, avg(p_retailprice) / 1000e0 - 0.95e0 AS s FROM part GROUP BY 1, 2"}


@query("perturbation_alignment", with_("grn", extra=_DIR, body=f"""SELECT bin, tf, k, {R('sum(v * s) / (any_value(nr) * any_value(nk))')} AS cosine FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY bin, tf)) AS nr FROM grn)
    JOIN (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY k)) AS nk FROM dr) USING (gene) GROUP BY 1, 2, 3"""))
def _(t: Tables):
    d = t.part.groupBy(F.col("p_type").alias("k"), F.col("p_brand").alias("gene")).agg((F.avg("p_retailprice") / 1000.0 - 0.95).alias("s"))
    return rounded(k.perturbation_alignment(t.grn, d))


def _cent(how: str) -> str:
    agg = {"mean": "sum(v) / 12e0", "max": "max(abs(v))", "sum": "sum(v)"}[how]
    return with_("grn", extra={"f": f"SELECT tf, gene, {agg} AS v FROM grn GROUP BY 1, 2"}, body=f"SELECT 'tf' AS side, tf::VARCHAR AS name, {R('sum(abs(v))')} AS degree, {R('sum(v)')} AS net FROM f GROUP BY tf UNION ALL SELECT 'gene', gene, {R('sum(abs(v))')}, {R('sum(v)')} FROM f GROUP BY gene")


for _how in ("mean", "max", "sum"):
    query(f"centrality_{_how}", _cent(_how))(lambda t, how=_how: rounded(k.centrality(t.grn, how, N_B)))


@query("branch_control", with_("grn", "lamp", extra={"a": "SELECT bin, tf, sqrt(sum(v * v)) AS n FROM grn GROUP BY 1, 2", "w": "SELECT t_idx AS bin, greatest(lam, 0) AS w FROM lamp"},
    body=f"SELECT tf, {R('sum(n * w / ((SELECT sum(w) FROM w) + 1e-12))')} AS score FROM a JOIN w USING (bin) GROUP BY 1"))
def _(t: Tables):
    w = t.lamp.select(F.col("t_idx").alias("bin"), F.greatest("lam", F.lit(0.0)).alias("w"))
    return rounded(k.branch_control(t.grn, w))


@query("temporal_activity", with_("grn", extra={"a": "SELECT bin AS t_idx, tf, sqrt(sum(v * v)) AS n FROM grn GROUP BY 1, 2", "k0": "SELECT unnest(range(-3, 4)) AS o", "ker": "SELECT o, exp(-0.5e0 * (o / 1.5e0) ** 2) / sum(exp(-0.5e0 * (o / 1.5e0) ** 2)) OVER () AS w FROM k0",
    "pos": "SELECT i AS t_idx, w, CASE WHEN i + o < 0 THEN -(i + o) WHEN i + o >= 12 THEN 22 - (i + o) ELSE i + o END AS s FROM ker, (SELECT unnest(range(12)) AS i)"},
    body=f"SELECT tf, pos.t_idx::INT AS t_idx, {R('sum(w * n)')} AS activity FROM pos JOIN a ON a.t_idx = s GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(k.temporal_activity(t.grn, N_B))


@query("pullback_stability", with_("emb", extra={"nz": "SELECT s AS seed, cell_id, x, [x[i + 1] + s * 0.02e0 * x[64 - i] for i in range(64)] AS y FROM emb, (SELECT unnest([1, 2, 3]) AS s)",
    "c": "SELECT seed, avg(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-12)) AS c FROM nz GROUP BY 1"},
    body=f"SELECT {R('avg(c)')} AS mean_cosine, {R('stddev_samp(c)')} AS std_cosine, avg(c) > 0.9 AS is_stable FROM c"))
def _(t: Tables):
    ref = t.emb.select("cell_id", F.col("x").alias("j"))
    noisy = ref.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("j", F.zip_with("j", F.reverse("j"), lambda a, b: a + F.col("seed") * 0.02 * b))
    return rounded(k.pullback_stability(ref, noisy))


@query("regulon_correlation", f"""WITH {_REG}, c AS (SELECT l_suppkey AS cell_id, l_returnflag AS branch, l_linenumber AS ln FROM lineitem WHERE false),
    cells AS (SELECT s_suppkey AS cell_id, CASE WHEN s_nationkey < 12 THEN 'west' WHEN s_nationkey < 23 THEN 'east' ELSE 'far' END AS branch, least(floor((s_acctbal + 1000) / 11000e0 * 8e0), 7)::INT AS b FROM supplier),
    sig AS (SELECT l_suppkey AS cell_id, c_mktsegment AS tf, sum(l_quantity) / 1000e0 AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    acc AS (SELECT l_suppkey AS cell_id, source AS tf, sum(l_quantity) / any_value(n) AS score FROM lineitem JOIN regn ON interval_id = l_partkey JOIN (SELECT source, count(*) AS n FROM regn GROUP BY 1) USING (source) GROUP BY 1, 2),
    m AS (SELECT tf, branch, b, sum(coalesce(value, 0)) / count(*) AS s, sum(coalesce(score, 0)) / count(*) AS a, count(*) AS n FROM cells CROSS JOIN (SELECT DISTINCT c_mktsegment AS tf FROM customer) LEFT JOIN sig USING (cell_id, tf) LEFT JOIN acc USING (cell_id, tf) GROUP BY 1, 2, 3)
    SELECT tf, branch, sum(n)::BIGINT AS n_rows, count(*) AS n_bins, any_value(np) AS n_peaks, CASE WHEN sum(n) < 20 THEN 'branch too small' WHEN any_value(np) < 5 THEN 'regulon too small' WHEN count(*) < 5 THEN 'not enough non-empty bins' ELSE 'ok' END AS reason,
    {R("CASE WHEN sum(n) < 20 OR any_value(np) < 5 OR count(*) < 5 THEN NULL ELSE corr(s, a) END")} AS r FROM m JOIN (SELECT source AS tf, count(*) AS np FROM regn GROUP BY 1) USING (tf) GROUP BY 1, 2""".replace("c AS (SELECT l_suppkey AS cell_id, l_returnflag AS branch, l_linenumber AS ln FROM lineitem WHERE false),\n    ", ""))
def _(t: Tables):
    peaks = _regulon(t)
    region = F.when(F.col("s_nationkey") < 12, "west").when(F.col("s_nationkey") < 23, "east").otherwise("far")
    cells = t.supplier.select(F.col("s_suppkey").alias("cell_id"), region.alias("branch"), ((F.col("s_acctbal") + 1000) / 11000.0).alias("t"))
    sig = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
           .groupBy(F.col("l_suppkey").alias("cell_id"), F.col("c_mktsegment").alias("tf")).agg((F.sum("l_quantity") / 1000.0).alias("value")))
    acc = g.accessibility_score(t.expr, peaks).withColumnRenamed("source", "tf")
    reg = peaks.groupBy(F.col("source").alias("tf")).agg(F.count(F.lit(1)).alias("n_peaks"))
    return rounded(k.regulon_correlation(sig, acc, cells, reg, 8))


@query("hybrid_grn")
def _(t: Tables):
    from ..plans.hybrid import hybrid_grn
    dec, enc = _linear_maps(t)
    tfs = t.supplier.where(F.col("s_nationkey") <= 6).select(F.col("s_suppkey").alias("tf"))
    genes = t.part.select(F.col("p_partkey").alias("gene"))
    net = t.lineitem.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    out = hybrid_grn(t.embt.select("t", F.col("x").alias("j")), dec, enc, genes, tfs, net, 6, 8, rank=2, lam_sparse=0.01)
    return rounded(out["modes"]["tf_norms"])
