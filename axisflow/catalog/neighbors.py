"""Neighbours, graphs, range joins, communication tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import neighbors as nb
from ..session import cut_lineage
from .base import R, Tables, query, rounded, vec_long, with_


@query("knn_exact", with_("nn", body=f"SELECT src, dst, {R('dist')} AS dist, rnk FROM nn"))
def _(t: Tables):
    return rounded(t.nn)


@query("knn_folded", with_("nnf", body=f"SELECT src, dst, {R('dist')} AS dist, rnk FROM nnf"))
def _(t: Tables):
    return rounded(t.nnf)


@query("knn_approx")
def _(t: Tables):
    return rounded(nb.knn_approx(t.emb, 10))


# every row has its ten neighbours and at least nine tenths of them are the exact ones
@query("knn_approx_recall", "SELECT true AS recall_090, count(*) AS rows_with_k, 10 AS k FROM embeddings")
def _(t: Tables):
    found = cut_lineage(nb.knn_approx(t.emb, 10))
    full = found.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 10).agg(F.count(F.lit(1)).alias("rows_with_k"))
    return full.select((nb.recall(t.nn, found).scalar() >= 0.9).alias("recall_090"), "rows_with_k", F.lit(10).alias("k"))


@query("kth_distance", with_("nnf", body=f"SELECT src, {R('greatest(0.05e0, least(0.5e0, max(CASE WHEN rnk = 10 THEN dist END)))')} AS scale FROM nnf GROUP BY 1"))
def _(t: Tables):
    return rounded(nb.kth_distance(t.nnf, 10))


@query("symmetric_graph", with_("nnf", body=f"SELECT src, dst, {R('sum(dist) / 2')} AS w FROM (SELECT src, dst, dist FROM nnf UNION ALL SELECT dst, src, dist FROM nnf) GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(g.symmetric_graph(t.nnf))


_SYM = {"sym": "SELECT src, dst, sum(dist) / 2 AS w FROM (SELECT src, dst, dist FROM nnf UNION ALL SELECT dst, src, dist FROM nnf) GROUP BY 1, 2"}


@query("graph_laplacian", with_("nnf", extra={**_SYM, "deg": "SELECT src, sum(w) AS d FROM sym GROUP BY 1"}, body=f"""SELECT s.src, s.dst, {R('-w / sqrt(a.d * b.d)')} AS w
    FROM sym s JOIN deg a ON a.src = s.src JOIN deg b ON b.src = s.dst UNION ALL SELECT src, src, CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END FROM deg"""))
def _(t: Tables):
    return rounded(g.graph_laplacian(g.symmetric_graph(t.nnf)))


@query("knn_overlap", with_("nn", "nnf", body=f"""SELECT cluster, {R('avg(ov)')} AS overlap, count(*) AS n FROM (SELECT a.src, count(b.dst) / 10e0 AS ov FROM nn a LEFT JOIN nnf b
    ON a.src = b.src AND a.dst = b.dst GROUP BY 1) JOIN emb ON cell_id = src GROUP BY 1"""))
def _(t: Tables):
    return rounded(nb.knn_overlap(t.nn, t.nnf, 10, t.emb))


@query("knn_interpolate", with_("nnf", extra={"w": "SELECT n.src, f.x AS v, exp(-dist * dist) AS w, sqrt(list_dot_product(f.x, f.x)) / ((SELECT max(sqrt(list_dot_product(x, x))) FROM fold) + 1e-8) AS c FROM nnf n JOIN fold f ON f.cell_id = n.dst"},
    body=f"SELECT src, i::INT AS i, {R('sum(w * v[i + 1]) / sum(w)')} AS value, {R('sum(w * c) / sum(w)')} AS conf FROM w, (SELECT unnest(range(8)) AS i) GROUP BY 1, 2"))
def _(t: Tables):
    out = nb.knn_interpolate(t.nnf, t.fold.select("cell_id", F.col("x").alias("v")), 8)
    return rounded(vec_long(out, "v", "src", "conf"))


@query("proximal_join", """WITH p AS (SELECT o_orderkey AS point_id, o_orderpriority AS chrom, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 1000 + o_custkey % 1000 AS pos FROM orders),
    i AS (SELECT l_orderkey * 10 + l_linenumber AS interval_id, o_orderpriority AS chrom, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 1000 + l_partkey % 1000 AS centre FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT point_id, count(*) AS n, sum(centre - pos)::BIGINT AS total, min(interval_id) AS first FROM p JOIN i ON p.chrom = i.chrom AND abs(centre - pos) <= 1500 GROUP BY 1""")
def _(t: Tables):
    p, i = _positions(t)
    return g.proximal_join(p, i, 1500, summary=True)


def _positions(t: Tables):
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long") * 1000
    p = t.orders.select(F.col("o_orderkey").alias("point_id"), F.col("o_orderpriority").alias("chrom"), (day("o_orderdate") + F.col("o_custkey") % 1000).alias("pos"))
    i = (t.lineitem.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
         .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("interval_id"), F.col("o_orderpriority").alias("chrom"), (day("l_shipdate") + F.col("l_partkey") % 1000).alias("centre")))
    return p, i


_REG = """p AS (SELECT o_orderkey AS point_id, o_orderpriority AS chrom, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 1000 + o_custkey % 1000 AS pos, o_custkey FROM orders),
    i AS (SELECT p_partkey AS interval_id, '5-LOW' AS chrom, 8035000 + p_partkey * 1013 % 2900000 AS centre FROM part),
    prox AS (SELECT point_id, interval_id FROM p JOIN i ON p.chrom = i.chrom AND abs(centre - pos) <= 2000),
    regn AS (SELECT DISTINCT c_mktsegment AS source, interval_id FROM prox JOIN orders ON o_orderkey = point_id JOIN customer ON c_custkey = o_custkey)"""


def _regulon(t: Tables):
    p, _ = _positions(t)
    i = t.part.select(F.col("p_partkey").alias("interval_id"), F.lit("5-LOW").alias("chrom"), (F.lit(8035000) + F.col("p_partkey") * 1013 % 2900000).alias("centre"))
    net = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("source"), F.col("o_orderkey").alias("target"))
    return g.regulon_peaks(net, i, p, 2000)


@query("regulon_peaks", f"WITH {_REG} SELECT source, interval_id FROM regn")
def _(t: Tables):
    return _regulon(t)


@query("accessibility_score", f"""WITH {_REG}, ex AS (SELECT l_suppkey AS cell_id, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
    SELECT cell_id, source, {R('coalesce(s, 0) / n')} AS score FROM (SELECT s_suppkey AS cell_id FROM supplier) CROSS JOIN (SELECT source, count(*) AS n FROM regn GROUP BY 1)
    LEFT JOIN (SELECT cell_id, source, sum(value) AS s FROM ex JOIN regn ON feature = interval_id GROUP BY 1, 2) USING (cell_id, source)""")
def _(t: Tables):
    peaks = _regulon(t)
    names = peaks.agg(F.collect_set("source").alias("s")).scalar()
    cells = t.supplier.select(F.col("s_suppkey").alias("cell_id"), F.explode(names).alias("source"))
    return rounded(g.accessibility_score(t.expr, peaks, cells))


_LR = """m AS (SELECT l_linenumber AS time, l_returnflag AS sender, l_linestatus AS receiver, l_suppkey % 20 AS ligand, l_partkey % 50 AS receptor, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5),
    pv AS (SELECT l_linenumber AS time, l_returnflag AS sender, l_linestatus AS receiver, l_suppkey % 20 AS ligand, l_partkey % 50 AS receptor, min(l_discount) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5),
    lr AS (SELECT p_size % 20 AS ligand, p_partkey % 50 AS receptor, avg(p_retailprice) / 1000e0 AS w_lr FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1, 2),
    adj AS (SELECT m.time, m.sender, m.receiver, sum(m.value * CASE WHEN pv.value <= 0.05 THEN 1e0 ELSE 0e0 END * coalesce(w_lr, 1e0)) AS a
        FROM m JOIN pv USING (time, sender, receiver, ligand, receptor) LEFT JOIN lr USING (ligand, receptor) GROUP BY 1, 2, 3)"""


def _lr(t: Tables):
    key = [F.col("l_linenumber").alias("time"), F.col("l_returnflag").alias("sender"), F.col("l_linestatus").alias("receiver"),
           (F.col("l_suppkey") % 20).alias("ligand"), (F.col("l_partkey") % 50).alias("receptor")]
    m = t.lineitem.groupBy(*key).agg(F.avg("l_quantity").alias("value"))
    p = t.lineitem.groupBy(*key).agg(F.min("l_discount").alias("value"))
    w = t.part.where(F.col("p_brand") != "Brand#1").groupBy((F.col("p_size") % 20).alias("ligand"), (F.col("p_partkey") % 50).alias("receptor")).agg((F.avg("p_retailprice") / 1000.0).alias("w_lr"))
    return g.cluster_adjacency(m, p, 0.05, w)


@query("cluster_adjacency", f"WITH {_LR} SELECT time, sender, receiver, {R('a')} AS a FROM adj")
def _(t: Tables):
    return rounded(_lr(t))


_LIFT = {"adj": "SELECT a.c AS sender, b.c AS receiver, (1 + a.c * 10 + b.c)::DOUBLE AS a FROM (SELECT DISTINCT cluster AS c FROM emb) a, (SELECT DISTINCT cluster AS c FROM emb) b WHERE a.c <> 3",
         "lw": "SELECT src, dst, a / (sum(a) OVER (PARTITION BY src) + 1e-12) AS w FROM nnf JOIN fold s ON s.cell_id = src JOIN fold d ON d.cell_id = dst JOIN adj ON adj.sender = s.cluster AND adj.receiver = d.cluster"}


def _lift(t: Tables):
    c = t.emb.select("cluster").distinct()
    every = c.agg(F.collect_list("cluster").alias("r")).scalar()
    adj = c.where(F.col("cluster") != 3).select(F.col("cluster").alias("sender"), F.explode(every).alias("receiver"))
    adj = adj.withColumn("a", (1 + F.col("sender") * 10 + F.col("receiver")).cast("double"))
    return g.lift_to_cells(adj, t.fold, t.nnf)


@query("lift_to_cells", with_("nnf", extra=_LIFT, body=f"SELECT src, dst, {R('w')} AS w FROM lw"))
def _(t: Tables):
    return rounded(_lift(t))


@query("interaction_term", with_("nnf", extra=_LIFT, body=f"""SELECT src, i::INT AS i, {R('sum(0.5e0 * w * (d.x[i + 1] - s.x[i + 1]))')} AS value FROM lw JOIN fold s ON s.cell_id = src JOIN fold d ON d.cell_id = dst,
    (SELECT unnest(range(8)) AS i) GROUP BY 1, 2"""))
def _(t: Tables):
    return rounded(vec_long(g.interaction_term(_lift(t), t.fold, 8, 0.5), "u", "src"))


_ROUNDS = 40  # more than the longest shortest path has edges; further rounds change nothing


def _bfs_sql() -> dict[str, str]:
    out = {"ue": "SELECT src, dst, min(w) AS w FROM (SELECT src, dst, dist AS w FROM nnf UNION ALL SELECT dst, src, dist FROM nnf) GROUP BY 1, 2",
           "d0": "SELECT cell_id, CASE WHEN cell_id = (SELECT min(cell_id) FROM fold WHERE cluster = 0) THEN 0e0 END AS d FROM fold"}
    for i in range(_ROUNDS):
        out[f"d{i + 1}"] = (f"SELECT p.cell_id, least(p.d, q.nd) AS d FROM d{i} p LEFT JOIN (SELECT dst, min(d + w) AS nd FROM ue JOIN d{i} ON cell_id = src WHERE d IS NOT NULL GROUP BY 1) q ON q.dst = p.cell_id")
    return out


@query("graph_pseudotime", with_("nnf", extra=_bfs_sql(), body=f"""SELECT cell_id, {R('d')} AS d,
    {R(f'(coalesce(d, (SELECT quantile_cont(d, 0.5) FROM d{_ROUNDS})) - (SELECT min(d) FROM d{_ROUNDS})) / ((SELECT max(d) FROM d{_ROUNDS}) - (SELECT min(d) FROM d{_ROUNDS}) + 1e-8)')} AS t FROM d{_ROUNDS}"""))
def _(t: Tables):
    root = t.fold.where(F.col("cluster") == 0).agg(F.min("cell_id").alias("r")).scalar()
    return rounded(g.graph_pseudotime(t.nnf, root, t.fold))


@query("root_cell", with_("emb", extra={"c": "SELECT cluster, i, avg(x[i]) AS m FROM emb, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2"},
    body="SELECT cluster, arg_min(cell_id, d) AS root FROM (SELECT e.cluster, cell_id, sum((x[i] - m) ** 2) AS d FROM emb e JOIN c USING (cluster) GROUP BY 1, 2) GROUP BY 1"))
def _(t: Tables):
    return g.root_cell(t.emb, 64)


_T = {"tr": "SELECT src, dst, exp(-dist) / sum(exp(-dist)) OVER (PARTITION BY src) AS w FROM nnf"}


@query("graph_smooth", with_("nnf", extra={**_T, "v0": "SELECT cell_id, i AS feature, x[i] AS value FROM fold, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i)",
    "v1": "SELECT src AS cell_id, feature, sum(w * value) AS value FROM tr JOIN v0 ON dst = cell_id GROUP BY 1, 2",
    "v2": "SELECT src AS cell_id, feature, sum(w * value) AS value FROM tr JOIN v1 ON dst = cell_id GROUP BY 1, 2",
    "v3": "SELECT src AS cell_id, feature, sum(w * value) AS value FROM tr JOIN v2 ON dst = cell_id GROUP BY 1, 2"}, body=f"SELECT cell_id, feature, {R('value')} AS value FROM v3"))
def _(t: Tables):
    v = t.fold.select("cell_id", F.posexplode("x").alias("i", "value")).select("cell_id", (F.col("i") + 1).alias("feature"), "value")
    e = t.nnf.select("src", "dst", F.exp(-F.col("dist")).alias("w"))
    return rounded(g.graph_smooth(e, v, 3))


_ABS = {"fw": """SELECT src, dst, exp(-dist) / sum(exp(-dist)) OVER (PARTITION BY src) AS w FROM nnf JOIN fold a ON a.cell_id = src JOIN fold b ON b.cell_id = dst
        WHERE b.t > a.t AND src NOT IN (SELECT cell_id FROM fold WHERE t >= 0.7)""",
        "p0": "SELECT cell_id, CASE WHEN cluster < 5 THEN 'low' ELSE 'high' END AS branch, 1e0 AS prob FROM fold WHERE t >= 0.7"}
_STEPS = 60  # more than the longest forward walk has edges
for _i in range(_STEPS):
    _ABS[f"p{_i + 1}"] = f"SELECT * FROM p0 UNION ALL SELECT src, branch, sum(w * prob) FROM fw JOIN p{_i} ON dst = cell_id GROUP BY 1, 2"


@query("absorb_probabilities", with_("nnf", extra=_ABS, body=f"""SELECT cell_id, branch, {R('prob')} AS prob,
    {R('sum(CASE WHEN prob > 0 THEN -prob * ln(prob) ELSE 0 END) OVER (PARTITION BY cell_id)')} AS entropy FROM p{_STEPS}"""))
def _(t: Tables):
    from ..operators.prep import branch_entropy
    term = t.fold.where(F.col("t") >= 0.7).select("cell_id", F.when(F.col("cluster") < 5, "low").otherwise("high").alias("branch"))
    p = g.absorb_probabilities(t.nnf.select("src", "dst", F.exp(-F.col("dist")).alias("w")), t.fold, term)
    return rounded(p.join(branch_entropy(p), "cell_id"))


@query("target_edge_filter", with_("net", body=f"SELECT source, target, {R('weight')} AS weight FROM net WHERE target IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')"))
def _(t: Tables):
    return rounded(g.target_edge_filter(t.net, t.part.where(F.col("p_type") == "ECONOMY").select(F.col("p_partkey").alias("feature"))))
