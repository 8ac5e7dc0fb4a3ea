"""Reading tables, and the logical tables of the domain over the ones at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G

HEIGHT, WIDTH = 64, 128


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, a cell of a stack of panoramas: y, x, value, label, valid.

    Rows are numbered through the stack, so row y of panorama k is k * HEIGHT + y; every event is a cell of some panorama.
    """
    y, x = F.floor(F.col("event_id") / WIDTH).cast("int").alias("y"), (F.col("event_id") % WIDTH).cast("int").alias("x")
    return read(spark, sf_dir, "events").select(y, x, "value", F.col("event_type").alias("label"), (F.col("event_type") != "error").alias("valid"))


CELLS = """cells AS (SELECT CAST(event_id // 128 AS INTEGER) AS y, CAST(event_id % 128 AS INTEGER) AS x, value, event_type AS label, event_type <> 'error' AS valid FROM events)"""
AREA = "((sin(pi()/2 - pi()*(y%64)/64) - sin(pi()/2 - pi()*(y%64+1)/64)) * (2*pi()/128))"


def with_area(df: DataFrame) -> DataFrame:
    return df.withColumn("area", G.row_area(F.col("y"), HEIGHT, WIDTH))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evidence: cell, view, value, valid; of several line items the last stands."""
    raw = read(spark, sf_dir, "lineitem").select((F.col("l_partkey")).alias("cell"), (F.col("l_suppkey") % 8).alias("view"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    last = F.max(F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"))
    return raw.groupBy("cell", "view").agg(last.alias("m")).select("cell", "view", F.col("m.l_extendedprice").alias("value"), (F.col("m.l_returnflag") != "R").alias("valid"))


EVIDENCE = """evidence AS (SELECT cell, view, value, flag <> 'R' AS valid FROM (SELECT l_partkey AS cell, l_suppkey % 8 AS view, l_extendedprice AS value, l_returnflag AS flag,
 row_number() OVER (PARTITION BY l_partkey, l_suppkey % 8 ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_returnflag DESC) AS rn FROM lineitem) WHERE rn = 1)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, bearing on a Fibonacci spiral over 2,000 places, score and label."""
    k = (F.col("c_custkey") % 2000).cast("double")
    golden = G.PI * (3 - 5**0.5)
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.pmod(k * golden, F.lit(2 * G.PI)).alias("lon"), F.asin(1 - 2 * (k + 0.5) / 2000).alias("lat"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("label")
    )


OBSERVATIONS = """observations AS (SELECT c_custkey AS id, CAST(c_custkey % 2000 AS DOUBLE) * (pi() * (3 - sqrt(5.0::DOUBLE))) - floor(CAST(c_custkey % 2000 AS DOUBLE) * (pi() * (3 - sqrt(5.0::DOUBLE))) / (2*pi())) * (2*pi()) AS lon,
 asin(1 - 2 * (CAST(c_custkey % 2000 AS DOUBLE) + 0.5) / 2000) AS lat, c_acctbal AS score, c_mktsegment AS label FROM customer)"""


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
