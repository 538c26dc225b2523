"""Readers, writers and table assembly. Text inputs are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staging_path
from ..sources import assemble, readers, writers
from .base import R, Tables, query, rounded, vec_long, with_


def staged_text(lines: DataFrame, name: str) -> str:
    """Write one text column below the shared folder."""
    path = staging_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _mode(flag):
    return F.when(flag == "A", "Activation").when(flag == "R", "Repression").otherwise("Unknown")


@query("network_tsv", "SELECT 's' || l_suppkey::VARCHAR AS source, 'p' || l_partkey::VARCHAR AS target, "
       "CASE l_returnflag WHEN 'A' THEN 1e0 WHEN 'R' THEN -1e0 ELSE 0.5e0 END AS weight FROM lineitem")
def _(t: Tables):
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    lines = t.lineitem.select(F.concat_ws("\t", s, p, _mode(F.col("l_returnflag")), F.col("l_orderkey").cast("string")))
    return readers.read_network_tsv(t.spark, staged_text(lines, "network"))


@query("normalise_network", "SELECT l_suppkey AS source, l_partkey AS target, CASE WHEN l_tax > 0.02 THEN l_tax ELSE 1e0 END AS weight FROM lineitem WHERE l_returnflag <> 'N'")
def _(t: Tables):
    raw = t.lineitem.select(F.col("l_suppkey").alias("TF"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("genesymbol"),
                            F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("weight"))
    return readers.normalise_network(raw)


@query("curated_network_human", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'HLA-DRA' ELSE upper(p_type) END AS source, upper(p_name) AS target, p_retailprice AS weight FROM part")
def _(t: Tables):
    # the same symbol mapping as the curated human table, applied to part names
    src = F.when(F.col("p_type") == "ECONOMY", F.lit("H2-Aa")).otherwise(F.col("p_type"))
    return readers.humanise(t.part.select(src.alias("source"), F.col("p_name").alias("target"), F.col("p_retailprice").alias("weight")))


@query("base_grn_csv", "SELECT DISTINCT l_suppkey::VARCHAR AS tf, l_partkey::VARCHAR AS gene FROM lineitem")
def _(t: Tables):
    path = staging_path(t.spark, "base_grn")
    t.lineitem.select(F.col("l_partkey").alias("Gene"), F.col("l_suppkey").alias("Regulator")).write.option("header", True).csv(path)
    return readers.read_base_grn_csv(t.spark, path)


@query("feature_table", """SELECT 'o' || (o_orderkey % 9000)::VARCHAR AS feature_id, arg_min(o_custkey, o_orderkey) AS start,
    arg_min(o_custkey, o_orderkey) + 100 AS "end", count(*) AS n FROM orders GROUP BY 1""")
def _(t: Tables):
    fid = F.concat(F.lit("o"), (F.col("o_orderkey") % 9000).cast("string"))
    lines = t.orders.orderBy("o_orderkey").select(F.concat_ws("\t", fid, F.concat(F.lit("n"), fid), F.lit("Gene Expression"), "o_orderpriority",
                                        F.col("o_custkey").cast("string"), (F.col("o_custkey") + 100).cast("string")))
    path = staged_text(lines, "features")
    n = t.orders.groupBy(fid.alias("feature_id")).agg(F.count(F.lit(1)).alias("n"))
    return readers.read_feature_table(t.spark, path, "Gene Expression").select("feature_id", "start", "end").join(n, "feature_id")


@query("matrix_triplets", with_("expr", body="""SELECT 'cell' || cell_id::VARCHAR AS cell, 'f' || feature::VARCHAR AS feature,
    CASE WHEN p_size <= 25 THEN 'Gene Expression' ELSE 'Peaks' END AS type, value FROM expr JOIN part ON p_partkey = feature"""))
def _(t: Tables):
    folder = staging_path(t.spark, "mtx")
    cells = t.supplier.select((F.col("s_suppkey") + 1).alias("ci"), F.concat(F.lit("cell"), F.col("s_suppkey").cast("string")).alias("v")).orderBy("ci")
    cells.select("v").write.text(f"{folder}/barcodes.tsv")
    kind = F.when(F.col("p_size") <= 25, "Gene Expression").otherwise("Peaks")
    f = t.part.select("p_partkey", F.concat_ws("\t", F.concat(F.lit("f"), F.col("p_partkey").cast("string")), "p_name", kind).alias("v")).orderBy("p_partkey")
    f.select("v").write.text(f"{folder}/features.tsv")
    # the first part file is the head, and the entries follow in as many as there are
    head = t.spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("%",), ("1 1 1",)], "v string").coalesce(1)
    body = t.expr.select(F.concat_ws(" ", (F.col("feature") + 1).cast("string"), (F.col("cell_id") + 1).cast("string"), F.col("value").cast("string")).alias("v"))
    head.union(body).write.text(f"{folder}/matrix.mtx")
    return readers.read_matrix_triplets(t.spark, folder)


@query("gene_major_matrix", with_("expr", body="SELECT 'c' || cell_id::VARCHAR AS cell, feature::VARCHAR AS feature, value FROM expr"))
def _(t: Tables):
    names = t.supplier.agg(F.sort_array(F.collect_list("s_suppkey")).alias("s"))
    at = names.select(F.posexplode("s").alias("pos", "cell_id"))
    count = names.select(F.size("s").alias("n")).scalar()
    pieces = 4 * t.spark.sparkContext.defaultParallelism  # few bytes, long lines: not to be coalesced
    wide = t.expr.join(at, "cell_id").repartition(pieces, "feature").groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("e"))
    # a line is its entries with runs of zeros between them
    zeros = lambda n: F.repeat(F.lit("\t0.0"), n)
    before = lambda i: F.coalesce(F.get("e", i - 1)["pos"], F.lit(-1))
    parts = F.transform("e", lambda x, i: F.concat(zeros(x["pos"] - before(i) - 1), F.lit("\t"), x["value"].cast("string")))
    row = F.concat(F.col("feature").cast("string"), F.array_join(parts, ""), zeros(F.col("n") - F.element_at("e", -1)["pos"] - 1))
    head = names.select(F.concat(F.lit("GENE\t"), F.array_join(F.transform("s", lambda c: F.concat(F.lit("c"), c.cast("string"))), "\t")).alias("v")).coalesce(1)
    lines = head.union(wide.withColumn("n", count).select(row.alias("v")))  # the first part file is the head
    return readers.gene_major_to_long(t.spark, staged_text(lines, "wide"))


@query("stratified_sample")
def _(t: Tables):
    picked = assemble.stratified_sample(t.customer, "c_mktsegment", 200, "c_custkey")
    return picked.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


@query("set_file_labels", """SELECT c_custkey AS cell, CASE WHEN c_acctbal > 9000 THEN 'top' ELSE coalesce(seg, 'Other') END AS label FROM customer
    LEFT JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'MACHINERY') ON seg = c_mktsegment""")
def _(t: Tables):
    seg = t.customer.where(F.col("c_mktsegment") != "MACHINERY").groupBy("c_mktsegment").agg(F.collect_list(F.col("c_custkey").cast("string")).alias("m"))
    top = t.customer.where(F.col("c_acctbal") > 9000).agg(F.collect_list(F.col("c_custkey").cast("string")).alias("m")).select(F.lit("top").alias("c_mktsegment"), "m")
    lines = (seg.withColumn("o", F.lit(0)).unionByName(top.withColumn("o", F.lit(1))).repartition(1).sortWithinPartitions("o")
             .select(F.concat_ws("\t", "c_mktsegment", F.lit("a set"), F.array_join("m", "\t"))))
    sets = readers.read_set_file(t.spark, staged_text(lines, "sets"))
    cells = t.customer.select(F.col("c_custkey").cast("string").alias("cell"))
    return readers.label_by_set(cells, sets).select(F.col("cell").cast("long").alias("cell"), "label")


@query("latent_from_tables", with_("embt", body=f"SELECT cell_id, {R('t')} AS t, len(x)::INT AS width, {R('list_sum(x)')} AS total, v_ok FROM (SELECT *, true AS v_ok FROM embt)"))
def _(t: Tables):
    cells = t.embt.select("cell_id", "t")
    out = assemble.latent_from_tables(cells, t.emb, t.emb.select("cell_id", F.col("x").alias("v")))
    from ..functions.vectors import vec_sum
    return rounded(out.select("cell_id", "t", F.size("x").alias("width"), vec_sum("x").alias("total"), F.col("v").isNotNull().alias("v_ok")))


@query("project_velocity", with_("expr", body=f"""SELECT cell_id, i, {R('sum(value * w[i + 1]) / 1000')} AS v FROM expr
    JOIN (SELECT p_partkey AS feature, [p_size / 50e0, p_retailprice / 2000e0, 1e0] AS w FROM part) USING (feature), (SELECT unnest([0, 1, 2]) AS i) GROUP BY 1, 2"""))
def _(t: Tables):
    load = t.part.select(F.col("p_partkey").alias("feature"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0, F.lit(1.0)).alias("w"))
    out = assemble.project_velocity(t.expr, load, 3)
    return rounded(vec_long(out, "v", "cell_id", value="v").withColumn("v", F.col("v") / 1000))


@query("select_panel", with_("expr", body="""SELECT feature, is_tf, count(*) AS n FROM expr JOIN (SELECT p_partkey AS feature, p_brand = 'Brand#7' AS is_tf
    FROM part WHERE p_size <= 20) USING (feature) GROUP BY 1, 2 UNION ALL SELECT p_partkey, NULL, 0 FROM part
    WHERE p_size <= 20 AND p_partkey NOT IN (SELECT feature FROM expr)"""))
def _(t: Tables):
    panel = t.part.where(F.col("p_size") <= 20).select(F.col("p_partkey").alias("feature"))
    tfs = t.part.where(F.col("p_brand") == "Brand#7").select(F.col("p_partkey").alias("feature"))
    got, missing = assemble.select_panel(t.expr, panel, tfs)
    return got.groupBy("feature", "is_tf").agg(F.count(F.lit(1)).alias("n")).unionByName(
        missing.select("feature", F.lit(None).cast("boolean").alias("is_tf"), F.lit(0).cast("long").alias("n")))


@query("write_results", "SELECT l_returnflag, sum(l_quantity) AS q, 'a' AS run FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, sum(l_quantity) * 2, 'b' FROM lineitem GROUP BY 1")
def _(t: Tables):
    folder = staging_path(t.spark, "results")
    q = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))
    writers.write_results("a", {"flow": q}, folder)
    writers.write_results("b", {"flow": q.withColumn("q", F.col("q") * 2)}, folder)
    return writers.read_results(t.spark, folder, "flow")


@query("write_branch_csv", "SELECT l_returnflag AS branch, l_linestatus AS direction, l_suppkey AS regulator, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def _(t: Tables):
    folder = staging_path(t.spark, "csv")
    df = t.lineitem.groupBy(F.col("l_returnflag").alias("branch"), F.col("l_linestatus").alias("direction"), F.col("l_suppkey").alias("regulator")).agg(F.count(F.lit(1)).alias("n"))
    writers.write_branch_csv(df, folder)
    return t.spark.read.schema("regulator long, n long, branch string, direction string").option("header", True).csv(folder)


@query("align_observations", "SELECT c_custkey AS cell_id, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0e0) AS total FROM customer LEFT JOIN "
       "(SELECT o_custkey, count(*) AS n, max(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t: Tables):
    second = t.orders.groupBy(F.col("o_custkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("total"))
    out = assemble.align_observations(t.customer.select(F.col("c_custkey").alias("cell_id")), second)
    return out.withColumn("n", F.col("n").cast("long"))


@query("fate_probabilities", with_("emb", body=f"SELECT cell_id, branch, {R('p')} AS prob FROM (SELECT cell_id, unnest(['b0','b1','b2']) AS branch, unnest([abs(x[1]), abs(x[2]), abs(x[3])]) AS p FROM emb)"))
def _(t: Tables):
    df = t.emb.select("cell_id", F.array(F.abs(F.col("x")[0]), F.abs(F.col("x")[1]), F.abs(F.col("x")[2])).alias("lineages"))
    return rounded(assemble.fate_probabilities(df, ["to_fates", "to_terminal_states", "to_absorption_probabilities", "lineages"], ["b0", "b1", "b2"]))
