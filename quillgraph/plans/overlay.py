"""A property graph laid over the star-schema tables.

Vertices are customers, orders, parts and so on; edges are frames of src, dst and
properties. An order with its lines stands for a unit with its dependencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import ship


class Overlay:
    """Lazy frames over one folder of tables; every method scans only what it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def next_part(self) -> DataFrame:
        """src -> dst: part on line 1 to part on line 2 of one order; no loops; distinct. Cyclic."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        a = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
        b = lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst"))
        return a.join(b, "l_orderkey").select("src", "dst").where("src <> dst").distinct()

    def typed_next_part(self) -> DataFrame:
        """next_part with rel, the first line's return flag; parallel edges where flags differ."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
        a = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("rel"))
        b = lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst"))
        return a.join(b, "l_orderkey").select("src", "dst", "rel").where("src <> dst").distinct()

    def line(self) -> DataFrame:
        """Order -> part, an edge for each line, with config (return flag) and line number."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("config"), F.col("l_linenumber").alias("line"))

    def supplies(self) -> DataFrame:
        """Supplier -> part, distinct."""
        return self.table("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()

    def contains(self) -> DataFrame:
        """Region -> nation -> customer and supplier; ids as label:key. Acyclic."""
        r = F.concat(F.lit("Region:"), "n_regionkey")
        n = lambda c: F.concat(F.lit("Nation:"), c)
        top = self.table("nation").select(r.alias("src"), n("n_nationkey").alias("dst"))
        customers = self.table("customer").select(n("c_nationkey").alias("src"), F.concat(F.lit("Customer:"), "c_custkey").alias("dst"))
        suppliers = self.table("supplier").select(n("s_nationkey").alias("src"), F.concat(F.lit("Supplier:"), "s_suppkey").alias("dst"))
        return top.unionByName(customers).unionByName(suppliers)

    def transition(self) -> DataFrame:
        """src -> dst: a user's event type and the next one's."""
        order = W.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst IS NOT NULL")

    def links(self) -> DataFrame:
        """page_id, href for each link of a page, in the page's order and number."""
        hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
        return self.table("pages").select("page_id", F.posexplode(hrefs).alias("n", "href"))

    def vertices(self) -> DataFrame:
        """label, id, name of every vertex with a name of its own."""
        parts = [("Region", "region", "r_regionkey", "r_name"), ("Nation", "nation", "n_nationkey", "n_name"), ("Customer", "customer", "c_custkey", "c_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Part", "part", "p_partkey", "p_name")]
        out = None
        for label, table, key, name in parts:
            v = self.table(table).select(F.lit(label).alias("label"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
            out = v if out is None else out.unionByName(v)
        return out
