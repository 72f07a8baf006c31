"""Reference-shaped relations over the raw tables of a folder.

records   one row per happening        (orders with the customer's nation as region)
reports   one row per report of it     (lineitem with the supplier's nation as publisher)
mentions  one row per record and actor (distinct order and part)
dossiers  mentions of denser records   (distinct customer and part), with ``dossier_nodes`` for their outlets and time
actors    one row per actor            (part)
clocks    usage rows                   (events)
vectors   dense vectors with labels    (embeddings)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of ``sf_dir``; columns that no query asks for are never read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def records(self) -> DataFrame:
        customers = self.raw("customer").select("c_custkey", "c_nationkey")
        return self.raw("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderpriority").alias("sector"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("weight"), F.col("o_custkey").alias("author_id"), F.col("c_nationkey").alias("region"),
        )

    @property
    def reports(self) -> DataFrame:
        suppliers = self.raw("supplier").select("s_suppkey", "s_nationkey")
        return self.raw("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source_id"), F.col("s_nationkey").alias("publisher"),
            F.col("l_shipdate").alias("published_at"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("position"),
            F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"),
        )

    @property
    def mentions(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct()

    @property
    def dossiers(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("event_id"))
        items = self.raw("lineitem").select("l_orderkey", F.col("l_partkey").alias("entity_id"))
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("event_id", "entity_id").distinct()

    @property
    def dossier_nodes(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("event_id"), "o_orderdate")
        items = self.raw("lineitem").select("l_orderkey", "l_suppkey")
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("event_id").agg(F.countDistinct("l_suppkey").alias("outlets"), F.min("o_orderdate").alias("at"))

    @property
    def actors(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")
        )

    @property
    def clocks(self) -> DataFrame:
        return self.raw("events")

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "lang", "source")

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", "embedding", "label")


#: The same relations as common table expressions for the SQL twins.
RECORDS = """records AS (
  SELECT o_orderkey AS event_id, o_orderdate AS first_seen, o_orderpriority AS sector, o_orderstatus AS status,
         o_totalprice AS weight, o_custkey AS author_id, c_nationkey AS region
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""
REPORTS = """reports AS (
  SELECT l_orderkey AS event_id, l_suppkey AS source_id, s_nationkey AS publisher, l_shipdate AS published_at,
         l_partkey AS entity_id, l_linenumber AS position, l_returnflag AS flag, l_quantity AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""
MENTIONS = "mentions AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem)"
DOSSIERS = "mentions AS (SELECT DISTINCT o_custkey AS event_id, l_partkey AS entity_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
DOSSIER_NODES = "nodes AS (SELECT o_custkey AS event_id, count(DISTINCT l_suppkey) AS outlets, min(o_orderdate) AS told FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)"
