"""Relational operators that the conversion itself doesn't need, one query each, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .queries import s, table


def asof_orders(spark, d):
    """As-of join: the customer's latest order before each order, by a window over one shuffle."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"))


def size_ranges(spark, d):
    """Range join with a table of ten ranges, a side of fixed size."""
    ranges = spark.range(10).select(F.col("id").alias("r"), (F.col("id") * 5).alias("lo"), (F.col("id") * 5 + 7).alias("hi"))
    met = table(spark, d, "part").join(F.broadcast(ranges), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi")))
    return met.groupBy("r").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


def flag_rollup(spark, d):
    """Grouping sets with a distinct aggregate."""
    out = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))
    return out.select("l_returnflag", "l_linestatus", "level", "n", "suppliers")


def supplier_ranks(spark, d):
    """Ranking functions and an explicit frame."""
    w = Window.partitionBy("s_nationkey").orderBy("half")
    unique = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    sup = table(spark, d, "supplier").withColumn("half", F.floor(F.col("s_suppkey") / 2))
    return sup.select(
        "s_suppkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(3).over(unique).alias("third"), F.percent_rank().over(w).alias("share"),
        F.sum("s_suppkey").over(unique.rowsBetween(-2, 1)).alias("around"),
    )


def part_page(spark, d):
    """One page of an ordering: ORDER BY, OFFSET and LIMIT are the feature."""
    return table(spark, d, "part").orderBy(F.col("p_size").desc(), "p_partkey").offset(10).limit(25).select("p_partkey", "p_size")


def key_sets(spark, d):
    """UNION, INTERSECT and EXCEPT, all distinct."""
    keys = lambda name, c: table(spark, d, name).select((F.col(c) % 50).cast("long").alias("k"))
    a, b, c = keys("customer", "c_custkey"), keys("supplier", "s_suppkey"), keys("part", "p_size")
    tagged = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tagged(a.union(b).distinct(), "union").unionAll(tagged(a.intersect(c), "intersect")).unionAll(tagged(a.subtract(b.where("k % 3 = 0")), "except"))


def json_maps(spark, d):
    """JSON written and read, and map functions."""
    made = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.create_map(F.lit("size"), F.col("p_size"), F.lit("key"), F.col("p_partkey").cast("int")).alias("m"))).alias("json"))
    read = made.select("p_partkey", F.get_json_object("json", "$.name").alias("name"), F.from_json("json", "m map<string,int>")["m"].alias("m"))
    return read.select("p_partkey", "name", F.size("m").cast("long").alias("n"), F.element_at("m", "size").cast("long").alias("size"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


def regex_words(spark, d):
    """Matches of a pattern: how many, and the first."""
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[a-z]+ing")).cast("long").alias("n"), F.regexp_extract("text", "([a-z]+)ing", 1).alias("stem"))


QUERIES = {f.__name__: f for f in (asof_orders, size_ranges, flag_rollup, supplier_ranks, part_page, key_sets, json_maps, regex_words)}
ORACLES = {
    "asof_orders": "SELECT a.o_orderkey, max(b.o_orderkey) AS previous FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey GROUP BY 1",
    "size_ranges": "SELECT r, count(*) AS n, min(p_partkey) AS first_key FROM part JOIN (SELECT r, r * 5 AS lo, r * 5 + 7 AS hi FROM range(10) t(r)) ON p_size >= lo AND p_size < hi GROUP BY 1",
    "flag_rollup": "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "supplier_ranks": """SELECT s_suppkey, rank() OVER w::INT AS rank, dense_rank() OVER w::INT AS dense, ntile(3) OVER u::INT AS third, percent_rank() OVER w AS share,
 (sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))::BIGINT AS around
 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey // 2), u AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""",
    "part_page": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 10",
    "key_sets": """WITH a AS (SELECT (c_custkey % 50)::BIGINT AS k FROM customer), b AS (SELECT (s_suppkey % 50)::BIGINT AS k FROM supplier), c AS (SELECT (p_size % 50)::BIGINT AS k FROM part)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM c)
UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b WHERE k % 3 = 0)""",
    "json_maps": "SELECT p_partkey, p_name AS name, 2::BIGINT AS n, p_size::BIGINT AS size, 'key,size' AS keys FROM part",
    "regex_words": "SELECT doc_id, len(regexp_extract_all(text, '[a-z]+ing'))::BIGINT AS n, regexp_extract(text, '([a-z]+)ing', 1) AS stem FROM documents",
}
