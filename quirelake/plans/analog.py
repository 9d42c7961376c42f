"""The logical relations as views over the star-schema test tables.

A paper is a customer, its paragraphs are orders, citations are order lines and references are parts; a
reference's year is the order's, sections are order priorities. The citation graph links a part to the
part on the order's next line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.operators.graph import dealt

AS_OF = 2001

# The same relations for DuckDB.
CITATIONS_SQL = """cit AS (SELECT o_custkey AS paper_id, o_orderkey AS paragraph_index, l_partkey AS ref_key, l_linenumber AS line, year(o_orderdate)::INTEGER AS year,
  o_orderpriority AS section, l_quantity, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BASELINE_SQL = "base AS (SELECT year(o_orderdate)::INTEGER AS year, count(*) AS cnt FROM orders GROUP BY 1)"
EDGES_SQL = """nxt AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem),
  edges AS (SELECT DISTINCT src, dst FROM nxt WHERE dst IS NOT NULL AND src <> dst)"""
#: Weak components by minima that travel along the links, one row a node at any time; follows EDGES_SQL in a recursive WITH.
COMPONENTS_SQL = """und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
  comps(id, comp) USING KEY (id) AS (SELECT p_partkey, p_partkey FROM part UNION
    SELECT u.a, min(c.comp) FROM comps c JOIN und u ON u.b = c.id JOIN recurring.comps o ON o.id = u.a WHERE c.comp < o.comp GROUP BY u.a)"""
PART_YEARS_SQL = "py AS (SELECT p_partkey AS id, min(year(o_orderdate))::INTEGER AS year FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"
DEGREES_SQL = EDGES_SQL + """, deg AS (SELECT p_partkey AS id, coalesce(i.n, 0) AS in_deg, coalesce(o.n, 0) AS out_deg FROM part
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON i.dst = p_partkey LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = p_partkey)"""


class Analog:
    """Views of one scale's tables; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Order lines, many of them dealt by order in tasks of a bounded number of rows, which joins and sums by order keep."""
        lines = self.table("lineitem")
        return dealt(lines, lines.count(), "l_orderkey")

    def citations(self) -> DataFrame:
        """(paper_id, paragraph_index, ref_key, line, year, section, ...)."""
        lines = self.lines().select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("section"))
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
            F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("paragraph_index"), F.col("l_partkey").alias("ref_key"), F.col("l_linenumber").alias("line"), "year", "section", "l_quantity", "l_returnflag"
        )

    def baseline(self) -> DataFrame:
        return self.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("cnt"))

    def edges(self, kind: str = "string") -> DataFrame:
        """(paper_id, src, dst) of one graph over all parts, ids as text, or as numbers (long) where they are exchanged often."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        lines = self.lines().select(*columns).withColumn("dst", F.lead("l_partkey").over(order))
        pairs = lines.where("dst is not null and dst <> l_partkey").select(F.col("l_partkey").alias("src"), "dst").distinct()
        return pairs.select(F.lit("parts").alias("paper_id"), F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))

    def parts(self, kind: str = "string") -> DataFrame:
        """(paper_id, id): the graph's nodes without their years, for which all lines would be read again."""
        return self.table("part").select(F.lit("parts").alias("paper_id"), F.col("p_partkey").cast(kind).alias("id"))

    def years_of(self, parts: DataFrame) -> DataFrame:
        """(paper_id, id, year) of few parts (paper_id, id long), so few that they are broadcast."""
        lines = self.table("lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("id")).join(F.broadcast(parts.select("id")), "id")
        dated = lines.join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year")), "l_orderkey")
        return parts.select("paper_id", "id").join(dated.groupBy("id").agg(F.min("year").alias("year")), "id", "left").select("paper_id", "id", "year")

    def nodes(self) -> DataFrame:
        """(paper_id, id, year): parts, with the first year of their orders."""
        years = self.table("lineitem").select("l_orderkey", "l_partkey").join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year")), "l_orderkey")
        years = years.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("year").alias("year"))
        return self.table("part").select("p_partkey").join(years, "p_partkey", "left").select(F.lit("parts").alias("paper_id"), F.col("p_partkey").cast("string").alias("id"), "year")

    def votes(self) -> DataFrame:
        """(paper_id, sub_id, model, pos, score, confidence): events as model votes."""
        return self.table("events").select(
            F.lit("events").alias("paper_id"), F.col("event_type").alias("sub_id"), F.col("user_id").cast("string").alias("model"), F.col("event_id").alias("pos"),
            (1 + F.pmod("event_id", F.lit(5))).cast("double").alias("score"), F.col("value").alias("confidence"),
        )
