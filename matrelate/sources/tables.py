"""Named matrices made from the driver's tables, and the same in SQL.

Keys are 0-based in the tables, so one is added.  ``SQL`` holds the bodies of
the common table expressions that the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators import aggregate

#: Nations, supplier classes and part classes: dimensions that do not grow with the data.
NATIONS, SIDE, REGIONS = 25, 100, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sp(spark: SparkSession, sf_dir: str) -> Matrix:
    """Quantity by supplier class and part class."""
    lines = table(spark, sf_dir, "lineitem")
    df = lines.select((F.col("l_suppkey") % SIDE + 1).alias("i"), (F.col("l_partkey") % SIDE + 1).alias("j"), F.col("l_quantity").alias("v"))
    return Matrix.from_triplets(df, SIDE)


def nn(spark: SparkSession, sf_dir: str) -> Matrix:
    """Quantity from customers' nations to suppliers' nations.

    Lines are summed per order and supplier class of nation before the order
    join, suppliers being the small side.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.sum("l_quantity").alias("v"))
    joined = per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return Matrix.from_triplets(joined.select((F.col("c_nationkey") + 1).alias("i"), (F.col("s_nationkey") + 1).alias("j"), "v"), NATIONS)


def ns(spark: SparkSession, sf_dir: str) -> Matrix:
    """Trade both ways: symmetric."""
    from ..operators import algebra, select

    m = nn(spark, sf_dir)
    return algebra.axpy(m, select.transpose(m))


def _scaled(spark, sf_dir, off: float) -> DataFrame:
    """NS over its 1-norm, times ``off``."""
    m = ns(spark, sf_dir).settled()
    return m.df.select("i", "j", (F.col("v") / aggregate.norm1(m) * off).alias("v"))


def dd(spark: SparkSession, sf_dir: str) -> Matrix:
    """Symmetric, diagonally dominant, spectrum within [0.5, 1.5]."""
    df = _scaled(spark, sf_dir, 0.25).unionByName(spark.range(1, NATIONS + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), (F.lit(0.75) + F.col("id") / 50.0).alias("v")))
    return Matrix.from_triplets(df, NATIONS)


def hh(spark: SparkSession, sf_dir: str) -> Matrix:
    """A Hamiltonian with ten occupied states below a gap."""
    level = F.when(F.col("id") <= 10, -1.0 - F.col("id") / 100.0).otherwise(0.5 + F.col("id") / 100.0)
    df = _scaled(spark, sf_dir, 0.3).unionByName(spark.range(1, NATIONS + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), level.alias("v")))
    return Matrix.from_triplets(df, NATIONS)


def rr(spark: SparkSession, sf_dir: str) -> Matrix:
    """Region to region, positive definite: 5 x 5."""
    m = nn(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k"), (F.col("n_regionkey") + 1).alias("r"))
    a, b = F.broadcast(nations.toDF("i", "ri")), F.broadcast(nations.toDF("j", "rj"))  # 25 rows
    per = m.df.join(a, "i").join(b, "j").groupBy("ri", "rj").agg(F.sum("v").alias("v"))
    both = per.select(F.col("ri").alias("i"), F.col("rj").alias("j"), "v").unionByName(per.select(F.col("rj").alias("i"), F.col("ri").alias("j"), "v"))
    both = both.groupBy("i", "j").agg(F.sum("v").alias("v"))
    summed = Matrix.of(both, REGIONS).settled()
    one = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return summed.with_df(summed.df.select("i", "j", (F.col("v") / aggregate.grand_sum(summed) + one).alias("v")))


def ue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type, types numbered by name."""
    types = ["click", "error", "purchase", "signup", "view"]
    number = F.coalesce(*[F.when(F.col("event_type") == t, k + 1) for k, t in enumerate(types)], F.lit(len(types) + 1))
    events = table(spark, sf_dir, "events")
    return events.groupBy((F.col("user_id") + 1).alias("i"), number.cast("long").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def eg(spark: SparkSession, sf_dir: str) -> Matrix:
    """Embeddings as a matrix of vectors by coordinates."""
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("i"), F.posexplode("embedding").alias("p", "x"))
    return Matrix.of(vectors.select("i", (F.col("p") + 1).alias("j"), F.col("x").cast("double").alias("v")), rows=1 << 31, cols=64)


_TRADE = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"

SQL = {
    "SP": f"SELECT l_suppkey % {SIDE} + 1 AS i, l_partkey % {SIDE} + 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "NN": f"SELECT (c_nationkey + 1)::BIGINT AS i, (s_nationkey + 1)::BIGINT AS j, sum(l_quantity) AS v FROM {_TRADE} GROUP BY 1, 2",
    "NS": "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM NN UNION ALL SELECT j, i, v FROM NN) GROUP BY i, j",
    "NORM": "SELECT max(s) AS norm FROM (SELECT sum(abs(v)) AS s FROM NS GROUP BY j)",
    "E": f"SELECT range AS i, range AS j, 1.0::DOUBLE AS v FROM range(1, {NATIONS + 1})",
    "DD": f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, v / norm * 0.25 AS v FROM NS, NORM UNION ALL SELECT range, range, 0.75 + range / 50.0 FROM range(1, {NATIONS + 1})) GROUP BY i, j",
    "HH": f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, v / norm * 0.3 AS v FROM NS, NORM UNION ALL SELECT range, range, CASE WHEN range <= 10 THEN -1.0 - range / 100.0 ELSE 0.5 + range / 100.0 END FROM range(1, {NATIONS + 1})) GROUP BY i, j",
    "RP": "SELECT (a.n_regionkey + 1)::BIGINT AS i, (b.n_regionkey + 1)::BIGINT AS j, sum(v) AS v FROM NN JOIN nation a ON a.n_nationkey + 1 = i JOIN nation b ON b.n_nationkey + 1 = j GROUP BY 1, 2",
    "RS": "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM RP UNION ALL SELECT j, i, v FROM RP) GROUP BY i, j",
    "RR": "SELECT i, j, v / (SELECT sum(v) FROM RS) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM RS",
    "UE": "SELECT user_id + 1 AS i, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 6 END::BIGINT AS j, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2",
    "EG": "SELECT vec_id + 1 AS i, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings",
}
#: What each named expression is made of.
NEEDS = {
    "NS": ["NN"], "NORM": ["NN", "NS"], "DD": ["NN", "NS", "NORM"], "HH": ["NN", "NS", "NORM"],
    "RP": ["NN"], "RS": ["NN", "RP"], "RR": ["NN", "RP", "RS"],
}
