"""Registration and the analysis tables derived from the given tables.

Every derived table exists twice: as a DataFrame here and as a SQL common table expression of the same name,
so a query and its SQL start from the same rows. All rows and whole vectors are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import stat
from ..functions.vectors import vec_sum
from ..session import cut_lineage
from ..operators.windows import bin_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NUDGE = 1e-10  # moves exact decimal midpoints off the rounding edge on both sides


def query(name: str, sql: str | None = None):
    def register(fn: Callable[["Tables"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column so that the order of summation does not show."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(_NUDGE), digits) for c, t in df.dtypes if t in ("double", "float")})


def R(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero removes the sign of a rounded negative zero."""
    return f"(round(({expr}) + 1e-10, {digits}) + 0e0)"


def vec_long(df: DataFrame, col: str, *keys: str, value: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("i", value))


N_T = 40          # grid points of the event curves
N_B = 12          # bins of the shipping axis
DIM, FOLD = 64, 8  # embedding width and number of folded components

# name -> SQL of the derived table; `needs` are resolved by with_()
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    # cells on an axis: one row per event, t in [0, 1]
    "ax": ((), """SELECT event_id AS cell_id, user_id, event_type, value,
        (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE
        / ((SELECT max(epoch_us(ts)) FROM events) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE AS t FROM events"""),
    # activation of archetype k (event type) on the grid, min-max scaled
    "act": (("ax",), f"""SELECT k, t_idx, (t_idx + 0.5e0) / {N_T}e0 AS t,
        (m - min(m) OVER (PARTITION BY k)) / (max(m) OVER (PARTITION BY k) - min(m) OVER (PARTITION BY k) + 1e-8) AS a FROM
        (SELECT event_type AS k, least(floor(t * {N_T}e0), {N_T - 1})::INT AS t_idx, avg(value) AS m FROM ax GROUP BY 1, 2)"""),
    # sensitivity curve on the same grid: deviation of the mean value
    "lam": (("ax",), f"""SELECT least(floor(t * {N_T}e0), {N_T - 1})::INT AS t_idx,
        (least(floor(t * {N_T}e0), {N_T - 1})::INT + 0.5e0) / {N_T}e0 AS t,
        (avg(value) - (SELECT avg(value) FROM events)) / 10e0 AS lam, count(*)::DOUBLE AS n_eff FROM ax GROUP BY 1, 2"""),
    # feature track: users as features
    "track": (("ax",), f"""SELECT least(floor(t * {N_T}e0), {N_T - 1})::INT AS t_idx, 'u' || user_id::VARCHAR AS feature,
        (avg(value) - (SELECT avg(value) FROM events)) / 10e0 AS score FROM ax GROUP BY 1, 2"""),
    # sparse matrix: suppliers by parts
    "expr": ((), "SELECT l_suppkey AS cell_id, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"),
    # vectors
    "emb": ((), "SELECT vec_id AS cell_id, label AS cluster, embedding::DOUBLE[] AS x FROM embeddings"),
    # axis on the vectors: min-max of the component sum
    "embt": (("emb",), """SELECT cell_id, cluster, x, (s - (SELECT min(list_sum(x)) FROM emb)) /
        ((SELECT max(list_sum(x)) FROM emb) - (SELECT min(list_sum(x)) FROM emb)) AS t FROM (SELECT *, list_sum(x) AS s FROM emb)"""),
    # folded vectors: eight means of eight consecutive components
    "fold": (("embt",), f"""SELECT cell_id, cluster, t, [list_sum(x[8 * j + 1 : 8 * j + 8]) / 8e0 for j in range({FOLD})] AS x FROM embt"""),
    # exact neighbours of the vectors, k = 10
    "nn": (("emb",), """SELECT src, dst, dist, rnk::INT AS rnk FROM (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.x, b.x) AS dist,
        row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.x, b.x), b.cell_id) AS rnk
        FROM emb a JOIN emb b ON a.cell_id <> b.cell_id) WHERE rnk <= 10"""),
    # exact neighbours of the folded vectors, k = 10
    "nnf": (("fold",), """SELECT src, dst, dist, rnk::INT AS rnk FROM (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.x, b.x) AS dist,
        row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.x, b.x), b.cell_id) AS rnk
        FROM fold a JOIN fold b ON a.cell_id <> b.cell_id) WHERE rnk <= 10"""),
    # network: supplier -> part with the mean discount as weight
    "net": ((), "SELECT 's' || l_suppkey::VARCHAR AS source, l_partkey AS target, avg(l_discount) AS weight FROM lineitem GROUP BY 1, 2"),
    # feature scores: part price, min-max
    "gs": ((), """SELECT p_partkey AS feature, (p_retailprice - (SELECT min(p_retailprice) FROM part)) /
        ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)) AS score FROM part"""),
    # shipping axis
    "ship": ((), """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax,
        (epoch_us(l_shipdate) - (SELECT min(epoch_us(l_shipdate)) FROM lineitem))::DOUBLE
        / ((SELECT max(epoch_us(l_shipdate)) FROM lineitem) - (SELECT min(epoch_us(l_shipdate)) FROM lineitem))::DOUBLE AS t FROM lineitem"""),
    "trackp": (("ship",), f"SELECT least(floor(t * {N_B}e0), {N_B - 1})::INT AS t_idx, l_partkey AS feature, avg(l_discount) - 0.05e0 AS score FROM ship GROUP BY 1, 2"),
    "actp": (("ship",), f"""SELECT k, t_idx, (m - min(m) OVER (PARTITION BY k)) / (max(m) OVER (PARTITION BY k) - min(m) OVER (PARTITION BY k) + 1e-8) AS a
        FROM (SELECT l_returnflag AS k, least(floor(t * {N_B}e0), {N_B - 1})::INT AS t_idx, avg(l_quantity) AS m FROM ship GROUP BY 1, 2)"""),
    "lamp": (("ship",), f"SELECT least(floor(t * {N_B}e0), {N_B - 1})::INT AS t_idx, (avg(l_tax) - 0.03e0) * 10e0 AS lam FROM ship GROUP BY 1"),
    # operator sequence: bins of shipping by supplier (tf) and brand (gene)
    "grn": (("ship",), f"""SELECT least(floor(t * {N_B}e0), {N_B - 1})::INT AS bin, l_suppkey AS tf, p_brand AS gene, avg(l_discount) - 0.05e0 AS v
        FROM ship JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""),
    "xtf": (("ship",), f"SELECT least(floor(t * {N_B}e0), {N_B - 1})::INT AS bin, l_suppkey AS tf, avg(l_quantity) / 50e0 AS x FROM ship GROUP BY 1, 2"),
    # stability metrics of customers
    "met": ((), """SELECT c_custkey AS cell_id, c_mktsegment AS cell_type, c_nationkey AS condition, c_acctbal / 10000e0 - 0.4e0 AS lambda_max,
        -(((c_custkey * 7919) % 1000)::DOUBLE) / 600e0 AS lambda_min, ((c_custkey * 31) % 100)::DOUBLE / 100e0 AS plasticity,
        ((c_custkey * 17) % 9)::DOUBLE AS stable_dim FROM customer"""),
    "reg": (("met",), """SELECT *, CASE WHEN lambda_max > 0.1 THEN 'unstable' WHEN lambda_min < -1.0 THEN 'deeply_stable'
        WHEN abs(lambda_max) < 0.05 AND plasticity > 0.3 THEN 'plastic' ELSE 'stable' END AS regime FROM met"""),
    # branch probabilities: share of a user's value by event type
    "prob": (("ax",), """SELECT user_id AS cell_id, event_type AS branch, sum(value) / sum(sum(value)) OVER (PARTITION BY user_id) AS prob FROM ax GROUP BY 1, 2"""),
}


def with_(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause of the named derived tables (and what they need), extra tables, then the body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _SQL[n][0]:
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    parts = [f"{n} AS ({_SQL[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Tables:
    """The given tables and the derived ones, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
                    "pages", "benchmark", "labels", "conversations"}:
            return self.raw(name)
        raise AttributeError(name)

    @cached_property
    def ax(self) -> DataFrame:
        e = self.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
        s = stat(e, lo=F.min("us"), hi=F.max("us"))
        t = (F.col("us") - s["lo"]).cast("double") / (s["hi"] - s["lo"]).cast("double")
        return e.select(F.col("event_id").alias("cell_id"), "user_id", "event_type", "value", t.alias("t"))

    @property
    def _mean_value(self) -> Column:
        return self.events.agg(F.avg("value").alias("m")).scalar()

    @cached_property
    def act(self) -> DataFrame:
        m = self.ax.withColumn("t_idx", bin_index("t", N_T)).groupBy(F.col("event_type").alias("k"), "t_idx").agg(F.avg("value").alias("m"))
        ends = m.groupBy("k").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
        a = (F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)
        return m.join(ends, "k").select("k", "t_idx", ((F.col("t_idx") + 0.5) / float(N_T)).alias("t"), a.alias("a"))

    @cached_property
    def lam(self) -> DataFrame:
        g = self.ax.withColumn("t_idx", bin_index("t", N_T)).groupBy("t_idx").agg(F.avg("value").alias("m"), F.count(F.lit(1)).cast("double").alias("n_eff"))
        return g.select("t_idx", ((F.col("t_idx") + 0.5) / float(N_T)).alias("t"), ((F.col("m") - self._mean_value) / 10.0).alias("lam"), "n_eff")

    @cached_property
    def track(self) -> DataFrame:
        g = self.ax.withColumn("t_idx", bin_index("t", N_T)).groupBy("t_idx", "user_id").agg(F.avg("value").alias("m"))
        return g.select("t_idx", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("feature"), ((F.col("m") - self._mean_value) / 10.0).alias("score"))

    @cached_property
    def expr(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))

    @property
    def n_cells(self) -> Column:
        """Number of rows of ``expr`` as a scalar."""
        return self.lineitem.agg(F.count_distinct("l_suppkey").alias("n")).scalar()

    @cached_property
    def emb(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("cell_id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("x"))

    @cached_property
    def embt(self) -> DataFrame:
        e = self.emb.withColumn("s", vec_sum("x"))
        s = stat(e, lo=F.min("s"), hi=F.max("s"))
        return e.select("cell_id", "cluster", "x", ((F.col("s") - s["lo"]) / (s["hi"] - s["lo"])).alias("t"))

    @cached_property
    def fold(self) -> DataFrame:
        parts = F.array(*[vec_sum(F.slice("x", 8 * j + 1, 8)) / 8.0 for j in range(FOLD)])
        return self.embt.withColumn("x", parts)

    @cached_property
    def nn(self) -> DataFrame:
        from ..operators.neighbors import knn
        return cut_lineage(knn(self.emb, 10))

    @cached_property
    def nnf(self) -> DataFrame:
        from ..operators.neighbors import knn
        return cut_lineage(knn(self.fold, 10))

    @cached_property
    def net(self) -> DataFrame:
        s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
        net = self.lineitem.groupBy(s.alias("source"), F.col("l_partkey").alias("target")).agg(F.avg("l_discount").alias("weight"))
        return cut_lineage(net)  # stands in for a stored table that is read many times

    @cached_property
    def gs(self) -> DataFrame:
        s = stat(self.part, lo=F.min("p_retailprice"), hi=F.max("p_retailprice"))
        return self.part.select(F.col("p_partkey").alias("feature"), ((F.col("p_retailprice") - s["lo"]) / (s["hi"] - s["lo"])).alias("score"))

    @cached_property
    def ship(self) -> DataFrame:
        e = self.lineitem.withColumn("us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
        s = stat(e, lo=F.min("us"), hi=F.max("us"))
        t = (F.col("us") - s["lo"]).cast("double") / (s["hi"] - s["lo"]).cast("double")
        return e.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", t.alias("t"))

    @property
    def _shipb(self) -> DataFrame:
        return self.ship.withColumn("t_idx", bin_index("t", N_B))

    @cached_property
    def trackp(self) -> DataFrame:
        return self._shipb.groupBy("t_idx", F.col("l_partkey").alias("feature")).agg((F.avg("l_discount") - 0.05).alias("score"))

    @cached_property
    def actp(self) -> DataFrame:
        m = self._shipb.groupBy(F.col("l_returnflag").alias("k"), "t_idx").agg(F.avg("l_quantity").alias("m"))
        ends = m.groupBy("k").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
        return m.join(ends, "k").select("k", "t_idx", ((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("a"))

    @cached_property
    def lamp(self) -> DataFrame:
        return self._shipb.groupBy("t_idx").agg(((F.avg("l_tax") - 0.03) * 10.0).alias("lam"))

    @cached_property
    def grn(self) -> DataFrame:
        j = self._shipb.join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return cut_lineage(j.groupBy(F.col("t_idx").alias("bin"), F.col("l_suppkey").alias("tf"), F.col("p_brand").alias("gene")).agg((F.avg("l_discount") - 0.05).alias("v")))

    @cached_property
    def xtf(self) -> DataFrame:
        return self._shipb.groupBy(F.col("t_idx").alias("bin"), F.col("l_suppkey").alias("tf")).agg((F.avg("l_quantity") / 50.0).alias("x"))

    @cached_property
    def met(self) -> DataFrame:
        return self.metrics_of(self.customer)

    def metrics_of(self, customer: DataFrame) -> DataFrame:
        """Stability metrics of customers, of the table or a stream of it."""
        k = F.col("c_custkey")
        return customer.select(
            k.alias("cell_id"), F.col("c_mktsegment").alias("cell_type"), F.col("c_nationkey").alias("condition"),
            (F.col("c_acctbal") / 10000.0 - 0.4).alias("lambda_max"), (-((k * 7919) % 1000).cast("double") / 600.0).alias("lambda_min"),
            (((k * 31) % 100).cast("double") / 100.0).alias("plasticity"), ((k * 17) % 9).cast("double").alias("stable_dim"))

    @cached_property
    def reg(self) -> DataFrame:
        from ..operators.regimes import classify_regime
        return classify_regime(self.met)

    @cached_property
    def prob(self) -> DataFrame:
        s = self.ax.groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("branch")).agg(F.sum("value").alias("s"))
        tot = s.groupBy("cell_id").agg(F.sum("s").alias("tot"))
        return s.join(tot, "cell_id").select("cell_id", "branch", (F.col("s") / F.col("tot")).alias("prob"))
