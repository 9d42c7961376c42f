"""Queries of the evidence operators over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.operators import evidence as E
from quirelake.plans.analog import CITATIONS_SQL, EDGES_SQL, Analog

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Analog(spark, sf_dir))
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {CITATIONS_SQL}, k AS (SELECT DISTINCT o_custkey AS paper_id, o_orderpriority AS section_index FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')),
s AS (SELECT paper_id, section AS section_index, count(*) AS n, count(DISTINCT ref_key) AS refs, count(DISTINCT paragraph_index) AS paragraphs, min(paragraph_index) AS first FROM cit GROUP BY ALL)
SELECT paper_id, section_index, coalesce(paragraphs, 0)::BIGINT AS paragraph_count, coalesce(n, 0)::BIGINT AS citation_count, coalesce(refs, 0)::BIGINT AS unique_references, first AS first_paragraph FROM k LEFT JOIN s USING (paper_id, section_index)""")
def section_table(a: Analog) -> DataFrame:
    sections = a.table("orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("section_index"), F.col("o_orderpriority").alias("kind"))
    cited = a.citations().withColumnRenamed("section", "section_index")
    rows = E.section_table(sections, cited, exclude=("1-URGENT", "5-LOW"))
    return rows.select("paper_id", "section_index", F.col("paragraph_count").cast("long").alias("paragraph_count"), "citation_count", "unique_references", F.get("paragraph_indices", F.lit(0)).alias("first_paragraph"))


@query("""WITH t AS (SELECT o_custkey AS paper_id, year(o_orderdate)::INTEGER AS year, count(*) AS cnt FROM orders GROUP BY ALL), s AS (SELECT o_custkey AS paper_id, max(n) AS top FROM (SELECT o_custkey, year(o_orderdate), sum(l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1),
h AS (SELECT paper_id, max(cnt) AS high FROM t GROUP BY 1) SELECT paper_id, year, round(cnt * top / high::DOUBLE, 6) AS scaled FROM t JOIN h USING (paper_id) JOIN s USING (paper_id)""")
def scaled_trend(a: Analog) -> DataFrame:
    orders = a.table("orders").select(F.col("o_custkey").alias("paper_id"), F.year("o_orderdate").alias("year"), "o_orderkey")
    survey = orders.join(a.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey").groupBy("paper_id", "year").agg(F.sum("l_linenumber").alias("cnt"))
    return E.scaled_trend(orders.groupBy("paper_id", "year").agg(F.count(F.lit(1)).alias("cnt")), survey).select("paper_id", "year", F.round("scaled", 6).alias("scaled"))


@query("SELECT o_custkey AS paper_id, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS rate FROM orders GROUP BY 1")
def partial_verify_rate(a: Analog) -> DataFrame:
    rows = a.table("orders").select(F.col("o_custkey").alias("paper_id"), (F.col("o_orderstatus") == "F").alias("is_valid"))
    return E.partial_verify_rate(rows).select("paper_id", F.round("rate", 6).alias("rate"))


@query(f"""WITH {EDGES_SQL}, i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1), ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges UNION SELECT p_partkey FROM part)
SELECT ends.id::VARCHAR AS id, coalesce(i.n, 0)::BIGINT AS in_deg, coalesce(o.n, 0)::BIGINT AS out_deg FROM ends LEFT JOIN i ON i.id = ends.id LEFT JOIN o ON o.id = ends.id""")
def shown_degrees(a: Analog) -> DataFrame:
    keys = a.nodes().select("paper_id", F.col("id").alias("key"))
    return E.degrees_among(E.shown_nodes(keys, keys, a.edges()), a.edges()).select("id", "in_deg", "out_deg")


@query("""SELECT DISTINCT s.s_nationkey::BIGINT AS nation, c.c_name[length(c.c_name):] AS key FROM (SELECT DISTINCT s_nationkey, s_name[length(s_name):] AS key FROM supplier) s JOIN customer c ON c.c_nationkey = s.s_nationkey AND c.c_name[length(c.c_name):] = s.key""")
def common_references(a: Analog) -> DataFrame:
    c = a.table("customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.substring("c_name", -1, 1).alias("key"))
    s = a.table("supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.substring("s_name", -1, 1).alias("key"))
    return E.common_references(c, s, ["nation"])


@query("""WITH v AS (SELECT event_type AS sub_id, user_id, event_id AS pos, (1 + event_id % 5)::DOUBLE AS score, 'r' || event_id AS reasoning FROM events), m AS (SELECT sub_id, user_id, median(score) AS med, count(*) AS n, list(score ORDER BY pos) AS scores, arg_min(reasoning, pos) AS first FROM v GROUP BY ALL),
k AS (SELECT v.sub_id, v.user_id, arg_min(v.reasoning, v.pos) AS near FROM v JOIN m ON m.sub_id = v.sub_id AND m.user_id = v.user_id WHERE abs(score - med) < 0.5 GROUP BY ALL)
SELECT m.user_id AS paper_id, m.sub_id, coalesce(near, first) || CASE WHEN n > 1 THEN chr(10) || chr(10) || '[Based on ' || n || ' model evaluations with majority voting. Scores: [' || array_to_string(scores, ', ') || ']]' ELSE '' END AS reasoning
FROM m LEFT JOIN k ON k.sub_id = m.sub_id AND k.user_id = m.user_id""")
def combined_reasoning(a: Analog) -> DataFrame:
    votes = a.table("events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("sub_id"), F.col("event_id").alias("pos"), (1 + F.pmod("event_id", F.lit(5))).cast("double").alias("score"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reasoning"))
    return E.combined_reasoning(votes)


@query("""SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 4 <> 0 THEN 'C5=' || printf('%.2f', (o_orderkey % 4) / 4.0) ELSE 'N/A' END
  WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 4) || '/9 supported' ELSE 'N/A' END WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 4 <> 0 THEN 'S3=' || printf('%.2f', (o_orderkey % 4) / 4.0) ELSE 'N/A' END ELSE 'N/A' END AS evidence,
CASE o_orderpriority WHEN '1-URGENT' THEN 'Verify unverified references.' WHEN '2-HIGH' THEN 'Review citation-claim alignment.' WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 4 <> 0 THEN 'Balance citation distribution across sections (current Gini=' || printf('%.2f', (o_orderkey % 4) / 4.0) || ').' ELSE 'Balance information across sections.' END ELSE 'Review and improve this aspect.' END AS advice,
'Good overall performance' AS strength FROM orders""")
def evidence_lines(a: Analog) -> DataFrame:
    orders, k = a.table("orders"), F.pmod("o_orderkey", F.lit(4))
    sub, value = F.element_at(F.create_map(*[F.lit(x) for p in (("1-URGENT", "V1"), ("2-HIGH", "V2"), ("3-MEDIUM", "R2"), ("4-NOT SPECIFIED", "E3x"), ("5-LOW", "X")) for x in p]), F.col("o_orderpriority")), k / 4.0
    sub = F.regexp_replace(sub, "^E3x$", "Z9")
    none = F.array().cast("array<string>")
    return orders.select(F.col("o_orderkey").alias("id"), E.evidence_line(sub, value, k, F.lit(9)).alias("evidence"), E.recommendation(sub, none, value).alias("advice"), E.strength(sub, value).alias("strength"))
