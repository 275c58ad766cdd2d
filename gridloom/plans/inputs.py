"""Canonical frames over the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import Graph
from gridloom.operators.matrix import Matrix
from gridloom.operators.tensor import Cube
from gridloom.operators.timeseries import TimeSeries

EVENT_TYPES = 5  # of the event table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> Matrix:
    df = read(spark, sf_dir, "embeddings")
    size = df.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    return Matrix.from_vectors(df, "vec_id", "embedding", size[0], size[1])


def items(spark: SparkSession, sf_dir: str) -> Matrix:
    """Quantity, price in thousands, discount and tax of all line items; for operators that need no row order."""
    df = read(spark, sf_dir, "lineitem")
    x = F.array("l_quantity", F.col("l_extendedprice") / 1000.0, "l_discount", "l_tax")
    return Matrix.from_vectors(df.select(F.monotonically_increasing_id().alias("i"), x.alias("x")), "i", "x", df.count(), 4)


def series(spark: SparkSession, sf_dir: str) -> TimeSeries:
    """Value sums by day and event type, 0 on days without."""
    df = read(spark, sf_dir, "events")
    day = F.datediff("ts", F.lit("2024-01-01").cast("timestamp"))
    sums = df.groupBy(day.alias("t"), "event_type").agg(F.sum("value").alias("s"))
    types = sums.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("j"))  # a handful of types
    days = sums.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = days.select(F.explode(F.sequence("lo", "hi")).alias("t"), "lo").join(F.broadcast(types), F.lit(True))
    cells = grid.join(sums, ["t", "event_type"], "left").select((F.col("t") - F.col("lo")).alias("i"), "j", F.coalesce("s", F.lit(0.0)).alias("v"))
    size = days.first()
    return TimeSeries(cells, size["hi"] - size["lo"] + 1, types.count())


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations linked by the number of line items between their customers and suppliers."""
    own = lambda t, *c: read(spark, sf_dir, t).select(*c)
    lines = own("lineitem", "l_orderkey", "l_suppkey").join(own("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(own("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(own("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = ends.groupBy(F.least("c_nationkey", "s_nationkey").cast("long").alias("src"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return Graph(pairs.where("src <> dst"))


def cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Quantity by nation, return flag and year of the order; cells that exist."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    cells = joined.groupBy(F.col("c_nationkey").alias("i"), flag.alias("j"), F.col("y").alias("k")).agg(F.sum("l_quantity").alias("v"))
    low = orders.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    return Cube(cells.withColumn("k", F.col("k") - low["lo"]), 25, 3, low["hi"] - low["lo"] + 1)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as imaged objects: idx, label, day as time, type as class."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("obj_label_id"), F.datediff("ts", F.lit("2024-01-01").cast("timestamp")).alias("time_idx"), F.col("event_type").alias("class_name"), "ts")


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event leads to the next one of its user."""
    after = F.lead("idx").over(Window.partitionBy("obj_label_id").orderBy("ts", "idx"))
    return objects(spark, sf_dir).select("obj_label_id", F.col("idx").alias("obj_idx1"), after.alias("obj_idx2"), "ts").where("obj_idx2 is not null")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as a container catalog: every prefix is a group, every whole path a dataset."""
    parts = read(spark, sf_dir, "pages").select(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/").alias("p"))
    each = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    path = F.concat(F.lit("/"), F.array_join(F.slice("p", 1, F.col("n")), "/"))
    parent = F.when(F.col("n") == 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice("p", 1, F.col("n") - 1), "/")))
    rows = each.select(path.alias("path"), parent.alias("parent"), F.col("p")[F.col("n") - 1].alias("name"), F.when(F.col("n") < F.size("p"), "group").otherwise("dataset").alias("kind"))
    return rows.distinct()


#: The same frames as SQL, for WITH.
M = "M AS (SELECT vec_id AS i, unnest(range(len(embedding)))::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
L = "L AS (SELECT i, unnest([0, 1, 2, 3])::INTEGER AS j, unnest([l_quantity, l_extendedprice / 1000.0, l_discount, l_tax])::DOUBLE AS v FROM (SELECT row_number() OVER () AS i, * FROM lineitem))"
T = """S AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS t, event_type, sum(value) AS s FROM events GROUP BY ALL),
Y AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS j FROM (SELECT DISTINCT event_type FROM S)),
T AS (SELECT (d.t - (SELECT min(t) FROM S))::BIGINT AS i, Y.j::INTEGER AS j, coalesce(S.s, 0)::DOUBLE AS v
    FROM (SELECT unnest(generate_series((SELECT min(t) FROM S), (SELECT max(t) FROM S))) AS t) d CROSS JOIN Y LEFT JOIN S ON S.t = d.t AND S.event_type = Y.event_type)"""
G = """G AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*)::DOUBLE AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY ALL),
B AS (SELECT src, dst, w FROM G UNION ALL SELECT dst, src, w FROM G)"""
A = G + """,
V AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT src AS id FROM B)),
A AS (SELECT a.n::BIGINT AS i, b.n::INTEGER AS j, coalesce(B.w, 0)::DOUBLE AS v FROM V a CROSS JOIN V b LEFT JOIN B ON B.src = a.id AND B.dst = b.id)"""
C = """C AS (SELECT c_nationkey::BIGINT AS i, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS j,
    (year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders))::BIGINT AS k, sum(l_quantity)::DOUBLE AS v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
O = "O AS (SELECT event_id AS idx, user_id AS obj_label_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS time_idx, event_type AS class_name, ts FROM events)"  # noqa: E741
K = O + ", K AS (SELECT * FROM (SELECT obj_label_id, idx AS obj_idx1, lead(idx) OVER (PARTITION BY obj_label_id ORDER BY ts, idx) AS obj_idx2, ts FROM O) WHERE obj_idx2 IS NOT NULL)"
H = """U AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages),
E AS (SELECT p, unnest(generate_series(1, len(p))) AS n FROM U),
H AS (SELECT DISTINCT '/' || array_to_string(p[1:n], '/') AS path, CASE WHEN n = 1 THEN '/' ELSE '/' || array_to_string(p[1:n-1], '/') END AS parent, p[n] AS name, CASE WHEN n < len(p) THEN 'group' ELSE 'dataset' END AS kind FROM E)"""
