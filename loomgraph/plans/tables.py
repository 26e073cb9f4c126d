"""The given tables as a typed property graph and as review sheets.

part = Drug, supplier = Condition, nation = Biomarker, region = RiskFactor, orders = Paper; line items are
edges from part to supplier, typed by their return flag, and mentions of a part by an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE_BY_FLAG = {"R": "TREATS", "A": "PREVENTS", "N": "ASSOCIATED_WITH"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(prefix: str, key: str):  # noqa: ANN201
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, name)."""
    one = lambda t, prefix, key, label, name: table(spark, sf_dir, t).select(node_id(prefix, key).alias("id"), F.lit(label).alias("label"), name.alias("name"))
    out = one("part", "drug:", "p_partkey", "Drug", F.col("p_name"))
    out = out.unionByName(one("supplier", "condition:", "s_suppkey", "Condition", F.col("s_name")))
    out = out.unionByName(one("nation", "biomarker:", "n_nationkey", "Biomarker", F.col("n_name")))
    out = out.unionByName(one("region", "riskfactor:", "r_regionkey", "RiskFactor", F.col("r_name")))
    return out.unionByName(one("orders", "paper:", "o_orderkey", "Paper", node_id("Order ", "o_orderkey")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, src, dst, confidence, source_pmcid): line items, nations, regions, and mentions."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "TREATS").when(F.col("l_returnflag") == "A", "PREVENTS").otherwise("ASSOCIATED_WITH")
    parts = li.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"), F.min("l_orderkey").alias("o"))
    out = parts.select(F.concat_ws("-", node_id("rel:", "l_partkey"), "l_suppkey", "l_returnflag").alias("id"), kind.alias("type"), node_id("drug:", "l_partkey").alias("src"), node_id("condition:", "l_suppkey").alias("dst"), "confidence", node_id("PMC", "o").alias("source_pmcid"))
    none = F.lit("").alias("source_pmcid")
    s = table(spark, sf_dir, "supplier")
    out = out.unionByName(s.select(node_id("rel:s", "s_suppkey").alias("id"), F.lit("ASSOCIATED_WITH").alias("type"), node_id("condition:", "s_suppkey").alias("src"), node_id("biomarker:", "s_nationkey").alias("dst"), F.lit(0.9).alias("confidence"), none))
    n = table(spark, sf_dir, "nation")
    out = out.unionByName(n.select(node_id("rel:n", "n_nationkey").alias("id"), F.lit("ASSOCIATED_WITH").alias("type"), node_id("biomarker:", "n_nationkey").alias("src"), node_id("riskfactor:", "n_regionkey").alias("dst"), F.lit(0.8).alias("confidence"), none))
    m = li.select("l_orderkey", "l_partkey").distinct()
    return out.unionByName(m.select(F.concat_ws("-", node_id("rel:m", "l_orderkey"), "l_partkey").alias("id"), F.lit("MENTIONS").alias("type"), node_id("paper:", "l_orderkey").alias("src"), node_id("drug:", "l_partkey").alias("dst"), F.lit(None).cast("double").alias("confidence"), none))


GRAPH_SQL = """
nodes AS (
  SELECT 'drug:' || p_partkey AS id, 'Drug' AS label, p_name AS name FROM part
  UNION ALL SELECT 'condition:' || s_suppkey, 'Condition', s_name FROM supplier
  UNION ALL SELECT 'biomarker:' || n_nationkey, 'Biomarker', n_name FROM nation
  UNION ALL SELECT 'riskfactor:' || r_regionkey, 'RiskFactor', r_name FROM region
  UNION ALL SELECT 'paper:' || o_orderkey, 'Paper', 'Order ' || o_orderkey FROM orders),
edges AS (
  SELECT 'rel:' || l_partkey || '-' || l_suppkey || '-' || l_returnflag AS id,
         CASE l_returnflag WHEN 'R' THEN 'TREATS' WHEN 'A' THEN 'PREVENTS' ELSE 'ASSOCIATED_WITH' END AS type,
         'drug:' || l_partkey AS src, 'condition:' || l_suppkey AS dst, max(round(1 - l_discount, 2)) AS confidence, 'PMC' || min(l_orderkey) AS source_pmcid
  FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag
  UNION ALL SELECT 'rel:s' || s_suppkey, 'ASSOCIATED_WITH', 'condition:' || s_suppkey, 'biomarker:' || s_nationkey, 0.9, '' FROM supplier
  UNION ALL SELECT 'rel:n' || n_nationkey, 'ASSOCIATED_WITH', 'biomarker:' || n_nationkey, 'riskfactor:' || n_regionkey, 0.8, '' FROM nation
  UNION ALL SELECT 'rel:m' || l_orderkey || '-' || l_partkey, 'MENTIONS', 'paper:' || l_orderkey, 'drug:' || l_partkey, NULL, '' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
plain AS (SELECT * FROM edges WHERE type <> 'MENTIONS'),
sym AS (SELECT id, type, confidence, src AS u, dst AS v FROM plain UNION ALL SELECT id, type, confidence, dst, src FROM plain WHERE src <> dst)
"""

#: A stated batch of questions over the graph.
QUESTIONS = [
    (1, "What does the small ring prevent?"),
    (2, "Which path connects the red widget with Supplier#000000007 through a drug?"),
    (3, "What is NATION_3 associated with in the graph?"),
    (4, "Does the blue bolt treat Supplier#000000002?"),
    (5, "Which drug lowers the risk of AFRICA?"),
]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "q int, question string")


QUESTIONS_SQL = "questions(q, question) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in QUESTIONS) + ")"
