"""Queries of the temporal, paragraph, graph, coverage and scoring operators over the analog views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import coverage as C
from quirelake.operators import graph as G
from quirelake.operators import linkage as L
from quirelake.operators import paragraphs as P
from quirelake.operators import temporal as Y
from quirelake.operators import voting as V
from quirelake.plans.analog import AS_OF, BASELINE_SQL, CITATIONS_SQL, COMPONENTS_SQL, DEGREES_SQL, EDGES_SQL, PART_YEARS_SQL, Analog

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Analog(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``; whole numbers as long."""
    cast = {c: F.round(F.col(c), places) for c, t in df.dtypes if t == "double"} | {c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint") or t.startswith("decimal")}
    return df.withColumns(cast) if cast else df


# Temporal


@query(f"""WITH {CITATIONS_SQL}, {BASELINE_SQL}, per AS (SELECT paper_id, year, count(*) AS n FROM cit GROUP BY ALL),
gap AS (SELECT *, year - lag(year) OVER (PARTITION BY paper_id ORDER BY year) AS g FROM per),
s AS (SELECT paper_id, min(year) AS lo, max(year) - min(year) AS t1, coalesce(max(g), 0) AS t4, sum(CASE WHEN year >= {AS_OF - 2} THEN n ELSE 0 END) / sum(n) AS t3 FROM gap GROUP BY 1),
f AS (SELECT paper_id, count(*) AS k, sum(n::DOUBLE) AS x, sum(cnt::DOUBLE) AS y, sum(n::DOUBLE*n) AS xx, sum(cnt::DOUBLE*cnt) AS yy, sum(n::DOUBLE*cnt) AS xy FROM per JOIN base USING (year) WHERE cnt > 0 GROUP BY 1)
SELECT s.paper_id, t1::BIGINT AS t1_span, (lo - (SELECT min(year) FROM base WHERE cnt > 0))::BIGINT AS t2_gap, round(t3, 3) AS t3_ratio, t4::BIGINT AS t4_gap,
round(CASE WHEN k >= 3 THEN (k*xy - x*y) / nullif(sqrt(greatest(k*xx - x*x, 0)) * sqrt(greatest(k*yy - y*y, 0)), 0) END, 3) AS t5_corr, 'success' AS status FROM s LEFT JOIN f USING (paper_id)""")
def temporal_metrics(a: Analog) -> DataFrame:
    return rounded(Y.temporal_metrics(a.citations(), a.baseline(), AS_OF))


@query("""SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate)::VARCHAR END, 'unknown') AS year, count(*) AS cnt FROM orders GROUP BY 1""")
def year_counts(a: Analog) -> DataFrame:
    refs = a.table("orders").select(F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("year"))
    return rounded(Y.year_counts(refs, []))


@query(f"WITH {CITATIONS_SQL} SELECT paper_id, count(*) AS total, count(DISTINCT year) AS distinct_years, min(year)::BIGINT AS earliest, max(year)::BIGINT AS latest, count(*) FILTER (year IS NULL) AS unknown FROM cit GROUP BY 1")
def reference_summary(a: Analog) -> DataFrame:
    return rounded(Y.reference_summary(a.citations()))


@query(f"""WITH {CITATIONS_SQL}, b AS (SELECT paper_id, min(year) AS lo, max(year) AS hi FROM cit GROUP BY 1), g AS (SELECT paper_id, lo, unnest(range(lo, hi + 1, 2)) AS s FROM b)
SELECT g.paper_id, s::BIGINT AS start_year, (s + 1)::BIGINT AS end_year, count(c.year) AS cnt FROM g LEFT JOIN cit c ON c.paper_id = g.paper_id AND c.year BETWEEN s AND s + 1 GROUP BY ALL""")
def year_buckets(a: Analog) -> DataFrame:
    return rounded(Y.year_buckets(a.citations(), 2))


@query(f"""WITH {CITATIONS_SQL}, per AS (SELECT paper_id, year, count(*) AS cnt FROM cit GROUP BY ALL)
SELECT paper_id, year::BIGINT AS year, cnt, (cnt - lag(cnt) OVER w)::BIGINT AS delta, round((cnt - lag(cnt) OVER w) / lag(cnt) OVER w * 100, 6) AS pct,
round(CASE WHEN row_number() OVER w >= 3 THEN avg(cnt) OVER (PARTITION BY paper_id ORDER BY year ROWS 2 PRECEDING) END, 6) AS ma FROM per WINDOW w AS (PARTITION BY paper_id ORDER BY year)""")
def year_trend(a: Analog) -> DataFrame:
    return rounded(Y.year_trend(a.citations()))


@query(f"""WITH {CITATIONS_SQL} SELECT paper_id, CASE WHEN {AS_OF} - year < 0 THEN 'future' WHEN {AS_OF} - year < 2 THEN '0-1' WHEN {AS_OF} - year < 5 THEN '2-4' ELSE '5+' END AS label, count(*) AS cnt FROM cit GROUP BY ALL""")
def age_distribution(a: Analog) -> DataFrame:
    return rounded(Y.age_distribution(a.citations(), AS_OF, [0, 2, 5]))


@query(f"""WITH {CITATIONS_SQL}, per AS (SELECT paper_id, year, count(*) AS cnt FROM cit GROUP BY ALL),
r AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY paper_id) AS share, row_number() OVER (PARTITION BY paper_id ORDER BY cnt DESC, year) AS rk FROM per)
SELECT paper_id, rk, year::BIGINT AS year, cnt, round(share, 6) AS share FROM r WHERE rk <= 3""")
def top_years(a: Analog) -> DataFrame:
    return rounded(Y.top_years(a.citations()).select("paper_id", "rk", "year", "cnt", "share"))


@query("""WITH h AS (SELECT o_orderstatus AS source, year(o_orderdate)::INTEGER AS year, count(*) AS cnt FROM orders GROUP BY ALL), g AS (SELECT unnest(range(1990, 2006)) AS year)
SELECT g.year::BIGINT AS year, coalesce(sum(cnt), 0)::BIGINT AS cnt FROM g LEFT JOIN h ON h.year = g.year GROUP BY 1""")
def trend_baseline(a: Analog) -> DataFrame:
    hits = a.table("orders").groupBy(F.col("o_orderstatus").alias("source"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("cnt"))
    return rounded(Y.trend_baseline(hits, (1990, 2005)))


# Citations and paragraphs


@query("""SELECT count(*) AS total, count(*) FILTER (l.l_orderkey IS NULL) AS uncited, round(avg(CASE WHEN l.l_orderkey IS NULL THEN 1.0 ELSE 0 END), 6) AS rate
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l_orderkey = o_orderkey""")
def orphan_rate(a: Analog) -> DataFrame:
    refs = a.table("orders").select(F.lit(0).alias("paper_id"), F.col("o_orderkey").alias("key"))
    return rounded(P.orphan_rate(refs, a.table("lineitem").select(F.lit(0).alias("paper_id"), F.col("l_orderkey").alias("ref_key"))).drop("paper_id"))


@query("""SELECT source AS paper_id, count(*) AS total, count(*) FILTER (quality = 1) AS verified, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def verify_rate(a: Analog) -> DataFrame:
    labels = a.table("labels").select("doc_id", (F.col("quality") == 1).alias("is_valid"))
    refs = a.table("documents").select("doc_id", F.col("source").alias("paper_id")).join(labels, "doc_id", "left")
    return rounded(P.verify_rate(refs))


@query(f"WITH {CITATIONS_SQL} SELECT paper_id, section, ref_key, count(*) AS cnt FROM cit GROUP BY ALL")
def section_counts(a: Analog) -> DataFrame:
    return rounded(P.section_counts(a.citations()))


@query(f"""WITH {CITATIONS_SQL}, sec AS (SELECT DISTINCT o_custkey AS paper_id, o_orderpriority AS section FROM orders), t AS (SELECT s.paper_id, s.section, count(c.ref_key) AS total FROM sec s LEFT JOIN cit c ON c.paper_id = s.paper_id AND c.section = s.section GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY total) AS i FROM t WHERE total > 0),
g AS (SELECT paper_id, greatest(0, least(1, 2 * sum(i * total) / (count(*) * sum(total)::DOUBLE) - (count(*) + 1) / count(*))) AS gini FROM r GROUP BY 1),
par AS (SELECT o_custkey AS paper_id, count(*) AS n FROM orders GROUP BY 1)
SELECT paper_id, count(*) AS s1, round(sum(total) / any_value(n), 3) AS s2, round(coalesce(any_value(gini), 0), 3) AS s3_gini, round(avg(CASE WHEN total = 0 THEN 1.0 ELSE 0 END), 3) AS s4
FROM t LEFT JOIN g USING (paper_id) JOIN par USING (paper_id) GROUP BY 1""")
def structural_metrics(a: Analog) -> DataFrame:
    orders = a.table("orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("section"))
    paragraphs = orders.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.structural_metrics(orders, P.section_counts(a.citations()), paragraphs))


@query(f"""WITH {CITATIONS_SQL} SELECT paper_id, paragraph_index, count(*) AS citations, count(DISTINCT ref_key) AS uniq, min(line)::BIGINT AS min_line, max(line)::BIGINT AS max_line,
count(*) FILTER (l_returnflag = 'A') AS valid, count(*) FILTER (l_returnflag = 'R') AS invalid, count(*) FILTER (l_returnflag = 'N') AS unknown FROM cit GROUP BY ALL""")
def paragraph_rollup(a: Analog) -> DataFrame:
    cit = a.citations().withColumn("is_valid", F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)).withColumn("page", F.lit(1))
    return rounded(P.paragraph_rollup(cit).select("paper_id", "paragraph_index", "citations", "uniq", "min_line", "max_line", "valid", "invalid", "unknown"))


@query(f"""WITH {CITATIONS_SQL}, per AS (SELECT paper_id, paragraph_index, ref_key, count(*) AS cnt FROM cit GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, paragraph_index ORDER BY cnt DESC, ref_key) AS rk FROM per) SELECT paper_id, paragraph_index, rk, ref_key, cnt FROM r WHERE rk <= 8""")
def paragraph_top_refs(a: Analog) -> DataFrame:
    return rounded(P.paragraph_top_refs(a.citations()).select("paper_id", "paragraph_index", "rk", "ref_key", "cnt"))


@query(f"""WITH {CITATIONS_SQL}, s AS (SELECT paper_id, paragraph_index, list(DISTINCT ref_key) AS refs FROM cit GROUP BY ALL),
p AS (SELECT paper_id, paragraph_index AS left_p, lead(paragraph_index) OVER w AS right_p, refs, lead(refs) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY paper_id ORDER BY paragraph_index)),
q AS (SELECT paper_id, left_p, right_p, len(list_intersect(refs, nxt)) AS shared, len(list_distinct(list_concat(refs, nxt))) AS u FROM p WHERE right_p IS NOT NULL)
SELECT paper_id, left_p, right_p, round(shared / u, 4) AS jaccard, shared FROM q""")
def adjacent_jaccard(a: Analog) -> DataFrame:
    return rounded(P.adjacent_overlap(a.citations()))


@query(f"""WITH {CITATIONS_SQL}, t AS (SELECT paper_id, count(DISTINCT paragraph_index) AS n FROM cit GROUP BY 1)
SELECT paper_id, ref_key, count(DISTINCT paragraph_index) AS paragraphs, count(*) AS citations, round(count(DISTINCT paragraph_index) / any_value(n), 4) AS dispersion FROM cit JOIN t USING (paper_id) GROUP BY ALL""")
def ref_dispersion(a: Analog) -> DataFrame:
    return rounded(P.reference_dispersion(a.citations()))


@query(f"""WITH {CITATIONS_SQL}, p AS (SELECT paper_id, paragraph_index, count(*) AS c, count(DISTINCT ref_key) AS u FROM cit GROUP BY ALL),
m AS (SELECT paper_id, count(*) AS paragraphs, sum(c)::BIGINT AS citations, round(avg(c), 2) AS avg_citations, round(avg(u), 2) AS avg_unique FROM p GROUP BY 1),
r AS (SELECT paper_id, count(DISTINCT ref_key) AS refs FROM cit GROUP BY 1), s AS (SELECT o_custkey AS paper_id, count(DISTINCT o_orderpriority) AS sections FROM orders GROUP BY 1)
SELECT m.*, refs, sections, round(citations / sections, 2) AS avg_per_section FROM m JOIN r USING (paper_id) JOIN s USING (paper_id)""")
def distribution_summary(a: Analog) -> DataFrame:
    sections = a.table("orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("section"))
    return rounded(P.distribution_summary(a.citations(), sections))


@query("""WITH j AS (SELECT l_suppkey AS paper_id, CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN CASE WHEN l_discount > 0.08 THEN 'contradict' ELSE 'support' END ELSE 'insufficient' END AS judgment FROM lineitem),
s AS (SELECT paper_id, count(*) FILTER (judgment = 'support') AS support, count(*) FILTER (judgment = 'contradict') AS contradict, count(*) FILTER (judgment = 'insufficient') AS insufficient FROM j GROUP BY 1)
SELECT *, round(coalesce(contradict / nullif(support + contradict, 0), 0), 4) AS contradiction_rate, coalesce(contradict / nullif(support + contradict, 0), 0) >= 0.05 AS auto_fail FROM s""")
def c6_rates(a: Analog) -> DataFrame:
    flag = F.col("l_returnflag")
    judged = F.when(flag == "A", "support").when(flag == "R", F.when(F.col("l_discount") > 0.08, "contradict").otherwise("support")).otherwise("insufficient")
    return rounded(P.alignment_rates(a.table("lineitem").select(F.col("l_suppkey").alias("paper_id"), judged.alias("judgment"))))


@query(f"""WITH {CITATIONS_SQL}, r AS (SELECT paper_id, paragraph_index, line, ref_key, l_quantity, row_number() OVER (PARTITION BY paper_id ORDER BY paragraph_index, line, ref_key, l_quantity) AS n FROM cit)
SELECT paper_id, floor((n - 1) / 10)::BIGINT AS batch_id, count(*) AS size FROM r GROUP BY ALL""")
def c6_batches(a: Analog) -> DataFrame:
    rows = P.batches(a.citations(), 10, ["paragraph_index", "line", "ref_key", "l_quantity"])
    return rounded(rows.groupBy("paper_id", "batch_id").agg(F.count(F.lit(1)).alias("size")))


# Graph


@query(f"WITH {EDGES_SQL} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM edges")
def graph_edges(a: Analog) -> DataFrame:
    edges, _ = G.resolve_edges(G.clean_edges(a.edges()), a.nodes())
    return edges.select("src", "dst")


@query("""WITH t AS (SELECT doc_id, source || ':' || lang AS a, 'n:' || n_chars AS b FROM documents),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY a) AS ca, count(*) OVER (PARTITION BY a) AS na, min(doc_id) OVER (PARTITION BY b) AS cb, count(*) OVER (PARTITION BY b) AS nb, count(*) OVER (PARTITION BY a, b) AS nab FROM t)
SELECT doc_id, CASE WHEN a IS NOT NULL THEN ca END AS class_a, CASE WHEN b IS NOT NULL THEN cb END AS class_b,
greatest(CASE WHEN a IS NOT NULL THEN na ELSE 0 END + CASE WHEN b IS NOT NULL THEN nb ELSE 0 END - CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN nab ELSE 0 END - 1, 0)::BIGINT AS links FROM c""")
def token_edge_classes(a: Analog) -> DataFrame:
    docs = a.table("documents").select("doc_id", F.concat("source", F.lit(":"), "lang").alias("a"), F.concat(F.lit("n:"), F.col("n_chars").cast("string")).alias("b"))
    return L.token_classes(docs, "doc_id", "a", "b")


@query(f"WITH {DEGREES_SQL} SELECT id::VARCHAR AS id, in_deg, out_deg FROM deg")
def graph_degrees(a: Analog) -> DataFrame:
    return rounded(G.degrees(a.nodes(), a.edges()).drop("paper_id"))


@query(f"WITH {DEGREES_SQL} SELECT count(*) AS n, sum(out_deg)::BIGINT AS m, count(*) FILTER (in_deg + out_deg = 0) AS isolates, round(sum(out_deg) / (count(*) * (count(*) - 1)), 6) AS density FROM deg")
def graph_density(a: Analog) -> DataFrame:
    return rounded(G.density(G.degrees(a.nodes(), a.edges())).drop("paper_id"))


@query(f"""WITH {DEGREES_SQL} SELECT quantile_disc(in_deg, 0.5)::BIGINT AS p50, quantile_disc(in_deg, 0.75)::BIGINT AS p75, quantile_disc(in_deg, 0.9)::BIGINT AS p90, quantile_disc(in_deg, 0.99)::BIGINT AS p99, max(in_deg)::BIGINT AS mx,
round(quantile_disc(in_deg, 0.99) / greatest(quantile_disc(in_deg, 0.5)::DOUBLE, 1e-9), 6) AS tail_index FROM deg""")
def degree_quantiles(a: Analog) -> DataFrame:
    out = G.quantiles(G.degrees(a.nodes(), a.edges()), "in_deg").drop("paper_id")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("p50", "p75", "p90", "p99", "mx")}))


@query(f"WITH {DEGREES_SQL} SELECT row_number() OVER (ORDER BY in_deg DESC, id::VARCHAR) AS rk, id::VARCHAR AS id, in_deg AS score FROM deg QUALIFY rk <= 20")
def top_in_degree(a: Analog) -> DataFrame:
    return rounded(G.top_k(G.degrees(a.nodes(), a.edges()), "in_deg", 20).select("rk", "id", "score"))


@query(f"""WITH {EDGES_SQL}, {PART_YEARS_SQL}, lag AS (SELECT s.year - d.year AS lag FROM edges JOIN py s ON s.id = src JOIN py d ON d.id = dst WHERE s.year IS NOT NULL AND d.year IS NOT NULL)
SELECT count(*) AS n, quantile_disc(lag, 0.5)::BIGINT AS p50, quantile_disc(lag, 0.9)::BIGINT AS p90, round(avg(CASE WHEN lag < 0 THEN 1.0 ELSE 0 END), 6) AS neg_ratio FROM lag""")
def citation_lag(a: Analog) -> DataFrame:
    out = G.citation_lag(a.edges(), a.nodes()).drop("paper_id")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("p50", "p90")}))


@query(f"""WITH {PART_YEARS_SQL} SELECT round(avg(CASE WHEN year IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_ratio, quantile_disc({AS_OF} - year, 0.5)::BIGINT AS median_age,
round(avg(CASE WHEN year >= {AS_OF} - 1 THEN 1.0 WHEN year IS NOT NULL THEN 0 END), 6) AS r2, round(avg(CASE WHEN year >= {AS_OF} - 4 THEN 1.0 WHEN year IS NOT NULL THEN 0 END), 6) AS r5 FROM py""")
def recency(a: Analog) -> DataFrame:
    out = G.recency(a.nodes(), AS_OF).drop("paper_id")
    return rounded(out.withColumn("median_age", F.col("median_age").cast("long")))


@query(f"WITH {PART_YEARS_SQL} SELECT year::BIGINT AS year, count(*) AS cnt FROM py WHERE year IS NOT NULL GROUP BY 1")
def year_histogram(a: Analog) -> DataFrame:
    return rounded(G.year_histogram(a.nodes()).drop("paper_id"))


@query(f"""WITH {EDGES_SQL}, k AS (SELECT e.src, e.dst FROM edges e) SELECT a.dst::VARCHAR AS a, b.dst::VARCHAR AS b, count(*) AS weight FROM k a JOIN k b ON a.src = b.src AND a.dst::VARCHAR < b.dst::VARCHAR GROUP BY 1, 2 HAVING count(*) >= 2""")
def cocitation_pairs(a: Analog) -> DataFrame:
    return rounded(G.cocitation_pairs(a.edges()).drop("paper_id"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {COMPONENTS_SQL}, s AS (SELECT comp, count(*) AS size FROM comps GROUP BY 1) SELECT size, count(*) AS cnt FROM s GROUP BY 1")
def components_hist(a: Analog) -> DataFrame:
    return _component_sizes(a, a.edges("long"))


def _component_sizes(a: Analog, edges: DataFrame) -> DataFrame:
    sizes = G.weak_components(a.parts("long"), edges).groupBy("paper_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return rounded(sizes.groupBy("size").agg(F.count(F.lit(1)).alias("cnt")))


def _pagerank_sql(select: str, rounds: int = 30, d: float = 0.85) -> str:
    """The rounds as chained tables."""
    ctes = [EDGES_SQL, "nn AS (SELECT count(*)::DOUBLE AS n FROM part)", "od AS (SELECT p_partkey AS id, count(src) AS o FROM part LEFT JOIN edges ON src = p_partkey GROUP BY 1)", "r0 AS MATERIALIZED (SELECT id, 1 / n AS pr, o FROM od, nn)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        ctes.append(
            f"r{i} AS MATERIALIZED (SELECT a.id, {1 - d} / n + {d} * (coalesce(s, 0) + coalesce((SELECT sum(pr) FROM {p} WHERE o = 0), 0) / n) AS pr, a.o FROM {p} a CROSS JOIN nn LEFT JOIN (SELECT dst, sum(pr / o) AS s FROM edges JOIN {p} ON src = id GROUP BY 1) t ON t.dst = a.id)"
        )
    return "WITH " + ", ".join(ctes) + " " + select


@query(_pagerank_sql("SELECT id::VARCHAR AS id, round(pr * 1000, 6) AS pr_milli FROM r30"))
def pagerank30(a: Analog) -> DataFrame:
    return rounded(G.pagerank(a.parts("long"), a.edges("long")).select(F.col("id").cast("string").alias("id"), (F.col("pr") * 1000).alias("pr_milli")))


@query(_pagerank_sql(f", {PART_YEARS_SQL}, core AS (SELECT id FROM r30 ORDER BY round(pr, 12) DESC, id::VARCHAR LIMIT 50) SELECT round(avg(CASE WHEN year >= {AS_OF} - 1 THEN 1.0 ELSE 0 END), 6) AS r2, round(avg(CASE WHEN year >= {AS_OF} - 4 THEN 1.0 ELSE 0 END), 6) AS r5 FROM core JOIN py USING (id)"))
def core_recency(a: Analog) -> DataFrame:
    ranks = G.pagerank(a.parts("long"), a.edges("long")).select("paper_id", F.col("id").cast("string").alias("id"), F.round("pr", 12).alias("pr"))
    top = G._cut(G.top_k(ranks, "pr", 50).select("paper_id", F.col("id").cast("long").alias("id")), "core")
    core = a.years_of(top)
    return rounded(G.recency(core, AS_OF).select("r2", "r5"))


_TOP3 = "top3 AS (SELECT id, row_number() OVER (ORDER BY in_deg DESC, id::VARCHAR) AS rk FROM deg QUALIFY rk <= 3)"


@query(f"""WITH {DEGREES_SQL}, {_TOP3}, h0 AS (SELECT id, id AS centre, rk, 0 AS hops FROM top3), h1 AS (SELECT DISTINCT e.src AS id, centre, rk, 1 AS hops FROM h0 JOIN edges e ON e.dst = h0.id),
h2 AS (SELECT DISTINCT e.src AS id, centre, rk, 2 AS hops FROM h1 JOIN edges e ON e.dst = h1.id), h3 AS (SELECT DISTINCT e.src AS id, centre, rk, 3 AS hops FROM h2 JOIN edges e ON e.dst = h2.id),
u AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
SELECT id::VARCHAR AS id, centre::VARCHAR AS centre, hops::BIGINT AS hops FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops, rk) = 1""")
def bounded_bfs(a: Analog) -> DataFrame:
    start = G.top_k(G.degrees(a.nodes(), a.edges()), "in_deg", 3).select("paper_id", F.col("id").alias("centre"), "rk")
    return rounded(G.nearest_centre(G.bounded_reach(a.edges(), start)).select("id", "centre", "hops"))


@query(f"""WITH {DEGREES_SQL}, r AS (SELECT in_deg, row_number() OVER (ORDER BY in_deg DESC) - 1 AS i FROM deg QUALIFY i < 8), e AS (SELECT count(*) AS m, max(in_deg)::DOUBLE AS y1, min(in_deg)::DOUBLE AS y2 FROM r),
d AS (SELECT i, round(abs((y2 - y1) * i - (m - 1) * in_deg + (m - 1) * y1), 9) AS far, m FROM r, e WHERE i BETWEEN 1 AND m - 2)
SELECT greatest(1, least(max(m), greatest(2, arg_max(i, far * 1000000 - i) + 1)))::BIGINT AS k FROM d""")
def elbow_k(a: Analog) -> DataFrame:
    return rounded(G.elbow_k(G.degrees(a.nodes(), a.edges()), 2, 8, value="in_deg").select("k"))


@query("""WITH l AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), r AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1),
mi AS (SELECT sum(n / t * ln(t * n / (ra * cb))) AS mi, sum(n * (n - 1) / 2) AS sij FROM c JOIN r USING (a) JOIN k USING (b), t), ha AS (SELECT -sum(ra / t * ln(ra / t)) AS ha, sum(ra * (ra - 1) / 2) AS sa FROM r, t), hb AS (SELECT -sum(cb / t * ln(cb / t)) AS hb, sum(cb * (cb - 1) / 2) AS sb FROM k, t)
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi, round((sij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM mi, ha, hb, t""")
def label_agreement(a: Analog) -> DataFrame:
    labels = a.table("embeddings").select(F.lit(0).alias("paper_id"), F.col("label").alias("la"), F.pmod("vec_id", F.lit(7)).alias("lb"))
    return rounded(G.label_agreement(labels, "la", "lb").select("nmi", "ari"))


@query(f"""WITH {CITATIONS_SQL}, c AS (SELECT paper_id, section, ref_key, count(*) AS cnt FROM cit GROUP BY ALL)
SELECT paper_id, ref_key, section FROM c QUALIFY row_number() OVER (PARTITION BY paper_id, ref_key ORDER BY cnt DESC, section) = 1""")
def section_of_reference(a: Analog) -> DataFrame:
    return G.section_of_reference(P.section_counts(a.citations()))


@query(f"WITH {PART_YEARS_SQL} SELECT p_brand AS node_id, min(year)::BIGINT AS year, count(*) AS members FROM part JOIN py ON id = p_partkey GROUP BY 1")
def canonical_nodes(a: Analog) -> DataFrame:
    refs = a.nodes().select("paper_id", F.col("id").alias("key"), "year")
    brands = a.table("part").select(F.lit("parts").alias("paper_id"), F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("canonical"))
    return rounded(G.canonical_nodes(refs, brands).select(F.col("id").alias("node_id"), "year", "members"))


@query(f"WITH {DEGREES_SQL} SELECT id::VARCHAR AS id, round(greatest(8.0, least(40.0, 10 + 5.2 * ln(1 + 2.2 * in_deg + out_deg))), 6) AS size, CASE WHEN in_deg + out_deg = 0 THEN '#9ca3af' ELSE '#60a5fa' END AS color FROM deg")
def node_style(a: Analog) -> DataFrame:
    i, o = F.col("in_deg"), F.col("out_deg")
    return rounded(G.degrees(a.nodes(), a.edges()).select("id", G.node_size(i, o).alias("size"), G.node_color(i, o, F.lit(None).cast("int")).alias("color")))


def _warning_stats(a: Analog, edges: DataFrame) -> DataFrame:
    nodes, edges = G._cut(a.nodes(), "nodes"), G._cut(edges, "edges")
    stats = G.density(G.degrees(nodes, edges))
    comps = G.weak_components(nodes, edges).groupBy("paper_id").agg(F.count_distinct("component").alias("components"))
    lag = G.citation_lag(edges, nodes).select("paper_id", "neg_ratio")
    rec = G.recency(nodes, AS_OF).select("paper_id", "missing_ratio", "median_age")
    return stats.join(comps, "paper_id").join(lag, "paper_id", "left").join(rec, "paper_id").withColumns({"unresolved_ratio": F.lit(0.0), "betweenness_done": F.lit(False)})


@query(f"""WITH RECURSIVE {EDGES_SQL}, {PART_YEARS_SQL}, {COMPONENTS_SQL},
x AS (SELECT (SELECT count(*) FROM part) AS n, (SELECT count(DISTINCT comp) FROM comps) AS comps, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT a FROM und)) AS iso,
  (SELECT avg(CASE WHEN s.year < d.year THEN 1.0 ELSE 0 END) FROM edges JOIN py s ON s.id = src JOIN py d ON d.id = dst) AS neg)
SELECT 'NEGATIVE_CITATION_LAG_HIGH' AS code, 'warning' AS severity FROM x WHERE neg > 0.05 UNION ALL SELECT 'MANY_COMPONENTS', 'info' FROM x WHERE comps > greatest(10, floor(n * 0.05))
UNION ALL SELECT 'ISOLATES_HIGH', 'info' FROM x WHERE iso / n > 0.05 UNION ALL SELECT 'BETWEENNESS_SKIPPED', 'info'""")
def graph_warnings(a: Analog) -> DataFrame:
    return G.graph_warnings(_warning_stats(a, a.edges())).select("code", "severity")


@query()
def betweenness(a: Analog) -> DataFrame:
    edges = G._cut(a.edges("long"), "edges")
    scores = G.betweenness(edges, components=G.weak_components(a.parts("long"), edges))
    return rounded(scores.select(F.col("id").cast("string").alias("id"), "betweenness"))


@query()
def authority_clusters(a: Analog) -> DataFrame:
    nodes, edges = a.parts("long"), G._cut(a.edges("long"), "edges")
    comps = G._cut(G.weak_components(nodes, edges), "components")
    ranks = G.pagerank(nodes, edges, components=comps)
    found = G.authority_clusters(nodes, edges, G.degrees(nodes, edges), ranks, components=comps)
    return found.select(F.col("id").cast("string").alias("id"), "cluster")


@query()
def louvain_clusters(a: Analog) -> DataFrame:
    return G.louvain_clusters(a.parts("long"), a.edges("long")).select(F.col("id").cast("string").alias("id"), "cluster")


@query(f"""WITH {EDGES_SQL}, k AS (SELECT row_number() OVER (ORDER BY src::VARCHAR, dst::VARCHAR) AS rk, src, dst FROM edges) SELECT 'graph LR' || chr(10) || string_agg('    ' || src || ' --> ' || dst, chr(10) ORDER BY rk) AS diagram FROM k WHERE rk <= 80""")
def mermaid(a: Analog) -> DataFrame:
    return G.mermaid(a.edges()).select("diagram")


# Linkage, coverage, literature


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct([source || ':' || lang, 'n:' || n_chars])) AS token FROM documents)
SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id""")
def token_edges(a: Analog) -> DataFrame:
    docs = a.table("documents").select(F.lit(0).alias("paper_id"), "doc_id", F.array_distinct(F.array(F.concat_ws(":", "source", "lang"), F.concat(F.lit("n:"), F.col("n_chars").cast("string")))).alias("tokens"))
    edges, _ = L.real_edges(docs.withColumnRenamed("doc_id", "key"), docs.select("paper_id", F.col("doc_id").alias("source"), F.lit(0).alias("target_id"), "tokens"))
    return edges.select("src", "dst")


@query("""WITH c AS (SELECT o_orderkey AS k, o_custkey AS paper_id, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
r AS (SELECT paper_id, p, max(k) AS ref FROM c GROUP BY ALL) SELECT k AS citation, ref AS ref_key FROM c JOIN r USING (paper_id, p)""")
def numeric_links(a: Analog) -> DataFrame:
    orders = a.table("orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).cast("int").alias("reference_number"))
    refs = orders.select("paper_id", "reference_number", F.col("k").alias("key"), F.col("k").alias("pos"))
    return L.link_numeric(orders, refs).select(F.col("k").alias("citation"), "ref_key")


_SOURCES = "u AS (SELECT 'customer' AS source, c_name AS name, c_acctbal AS score, c_custkey AS pos FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, s_suppkey FROM supplier)"


@query(f"WITH {_SOURCES} SELECT source, name, score, row_number() OVER (ORDER BY score DESC, source, pos) AS rk FROM u QUALIFY rk <= 25")
def source_union_topk(a: Analog) -> DataFrame:
    c = a.table("customer").select(F.lit("customer").alias("source"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("pos"))
    s = a.table("supplier").select(F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("pos"))
    top = C.merge_sources([c, s]).orderBy(F.desc("score"), "source", "pos").limit(25)
    order = F.row_number().over(G.Window.orderBy(F.desc("score"), "source", "pos"))  # 25 rows
    return rounded(top.select("source", "name", "score", order.alias("rk")))


@query("""WITH u AS (SELECT 'customer' AS source, 1 AS pr, c_nationkey AS nation, c_name AS name, c_custkey AS pos FROM customer UNION ALL SELECT 'supplier', 0, s_nationkey, s_name, s_suppkey FROM supplier)
SELECT nation::BIGINT AS nation, arg_min(source, pr * 1000000000 + pos) AS source, arg_min(name, pr * 1000000000 + pos) AS name FROM u GROUP BY 1""")
def best_source(a: Analog) -> DataFrame:
    c = a.table("customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("report"), F.col("c_custkey").alias("pos"))
    s = a.table("supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("report"), F.col("s_suppkey").alias("pos"))
    priority = a.spark.createDataFrame([("supplier", 0), ("customer", 1)], "source string, priority int")
    return rounded(L.best_report(c.unionByName(s), priority, ["nation"]).select("nation", "source", F.col("report").alias("name")))


# A paper's orders as its headings: levels and kinds by their keys.
_TREE = """RECURSIVE h AS (SELECT o_custkey AS paper_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, 1 + o_orderkey % 4 AS level, o_orderkey % 17 = 0 AS appendix,
    CASE o_orderkey % 13 WHEN 0 THEN '3.2' WHEN 5 THEN 'B' END AS given FROM orders),
  w AS (SELECT paper_id, 0::BIGINT AS i, []::BIGINT[] AS counters, 0::BIGINT AS letter, '' AS number, []::STRUCT(level BIGINT, i BIGINT)[] AS stack, []::STRUCT(level BIGINT, i BIGINT)[] AS above FROM (SELECT DISTINCT paper_id FROM h)
    UNION ALL SELECT paper_id, i, CASE WHEN given = '3.2' THEN [3, 2] WHEN given IS NOT NULL OR appendix THEN counters ELSE bumped END, new_letter,
      CASE WHEN given IS NOT NULL THEN given WHEN appendix THEN chr((64 + new_letter)::INT) ELSE array_to_string(list_transform(bumped, lambda c: greatest(1, c)), '.') END,
      list_append(kept, {'level': level, 'i': i}), kept
    FROM (SELECT h.*, w.counters, CASE WHEN given = 'B' THEN 2 WHEN given IS NULL AND appendix THEN w.letter + 1 ELSE w.letter END AS new_letter,
      list_transform(range(1, h.level + 1), lambda k: coalesce(w.counters[k], 0) + (k = h.level)::INT) AS bumped, list_filter(w.stack, lambda s: s.level < h.level) AS kept
      FROM w JOIN h ON h.paper_id = w.paper_id AND h.i = w.i + 1))"""


def _headings(a: Analog) -> DataFrame:
    """(paper_id, o_orderkey, section_index, level, kind, section_title)."""
    key = F.col("o_orderkey")
    return a.table("orders").select(
        F.col("o_custkey").alias("paper_id"), key, F.row_number().over(Window.partitionBy("o_custkey").orderBy(key)).alias("section_index"), (1 + key % 4).alias("level"),
        F.when(key % 17 == 0, "appendix").otherwise("main").alias("kind"), F.when(key % 13 == 0, "3.2 Part").when(key % 13 == 5, "B Extra").otherwise(F.col("o_orderpriority")).alias("section_title"),
    )


@query(f"WITH {_TREE} SELECT paper_id, i AS section_index, above[-1].i AS parent_index, coalesce(above[1].i, i) AS root_index, number FROM w WHERE i > 0")
def section_tree(a: Analog) -> DataFrame:
    return P.section_hierarchy(_headings(a))


@query(f"""WITH {_TREE}, up AS (SELECT paper_id, i AS leaf, unnest(list_append(list_transform(above, lambda s: s.i), i)) AS section_index FROM w WHERE i > 0)
SELECT up.paper_id, section_index, count(*) AS citations, count(DISTINCT l_partkey) AS uniq, count(DISTINCT h.o_orderkey) AS paragraphs
FROM up JOIN h ON h.paper_id = up.paper_id AND h.i = up.leaf JOIN lineitem ON l_orderkey = h.o_orderkey GROUP BY ALL""")
def section_tree_rollup(a: Analog) -> DataFrame:
    headings = _headings(a)
    cited = a.citations().join(headings.select("paper_id", F.col("o_orderkey").alias("paragraph_index"), "section_index"), ["paper_id", "paragraph_index"])
    return P.section_rollup(cited, P.section_hierarchy(headings))


_MATCH = "m AS (SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text))))"


def _covered(a: Analog) -> DataFrame:
    hits = C.contained_items(a.table("benchmark"), a.table("documents")).groupBy("item_id").agg(F.min("doc_id").alias("ref_key"))
    return a.table("benchmark").select(F.lit(0).alias("paper_id"), "item_id").join(hits, "item_id", "left")


@query(f"WITH {_MATCH} SELECT count(*) AS candidates, count(m.item_id) AS matched, round(count(m.item_id) / count(*), 6) AS rate FROM benchmark LEFT JOIN m USING (item_id)")
def coverage(a: Analog) -> DataFrame:
    return rounded(C.coverage(_covered(a)).drop("paper_id"))


@query(f"WITH {_MATCH} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM m)")
def missing_candidates(a: Analog) -> DataFrame:
    return _covered(a).where("ref_key is null").select("item_id")


@query("SELECT p_partkey AS ref_key, count(l_partkey) AS cnt FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(l_partkey) < 10")
def suspicious(a: Analog) -> DataFrame:
    cache = a.table("lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("citation_count")).withColumn("paper_id", F.lit(0))
    matched = a.table("part").select(F.lit(0).alias("paper_id"), F.col("p_partkey").alias("ref_key"))
    return rounded(C.suspicious(matched, cache).select("ref_key", "cnt"))


# Votes and scores


_VOTES = "v AS (SELECT event_type AS dim, user_id, event_id, (1 + event_id % 5)::DOUBLE AS score, value FROM events)"


@query(f"WITH {_VOTES} SELECT dim, count(*) AS n, median(score) AS med, round(stddev_samp(score), 6) AS sd, stddev_samp(score) > 1 OR max(score) - min(score) > 2 AS high_disagreement FROM v GROUP BY 1")
def vote_stats(a: Analog) -> DataFrame:
    return rounded(V.vote_stats(a.votes()).withColumnRenamed("sub_id", "dim").drop("paper_id"))


@query(f"WITH {_VOTES}, c AS (SELECT dim, round_even(score, 0) AS s, count(*) AS n, min(event_id) AS f FROM v GROUP BY ALL) SELECT dim, s AS mode_score FROM c QUALIFY row_number() OVER (PARTITION BY dim ORDER BY n DESC, f) = 1")
def vote_mode(a: Analog) -> DataFrame:
    return rounded(V.majority_vote(a.votes()).withColumnRenamed("sub_id", "dim").drop("paper_id"))


@query(f"""WITH {_VOTES}, n AS (SELECT dim, count(*) AS n FROM v GROUP BY 1), r AS (SELECT dim, score, n, row_number() OVER (PARTITION BY dim ORDER BY score) - 1 AS i FROM v JOIN n USING (dim)), q AS (SELECT dim, max(score) FILTER (i = n // 4) AS q1, max(score) FILTER (i = 3 * n // 4) AS q3 FROM r GROUP BY 1),
k AS (SELECT dim, score FROM v JOIN q USING (dim) WHERE score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) SELECT dim, count(*) AS kept, round(greatest(0.5, 1 - stddev_samp(score) / 3), 6) AS confidence FROM k GROUP BY 1""")
def iqr_filter(a: Analog) -> DataFrame:
    kept = V.without_extremes_rows(a.votes())
    out = kept.groupBy(F.col("sub_id").alias("dim")).agg(F.count(F.lit(1)).alias("kept"), F.stddev_samp("score").alias("sd"))
    return rounded(out.select("dim", "kept", V.vote_confidence(F.col("kept"), F.col("sd")).alias("confidence")))


@query(f"WITH {_VOTES} SELECT dim AS dimension, round(sum(score * value) / sum(value), 6) AS wmean, round(avg(score), 6) AS mean, median(score) AS med, min(score) AS mn, max(score) AS mx, round(stddev_samp(score), 6) AS sd, round(avg(value), 6) AS confidence FROM v GROUP BY 1")
def legacy_aggregate(a: Analog) -> DataFrame:
    return rounded(V.legacy_dimensions(a.votes().withColumnRenamed("sub_id", "dimension")).drop("paper_id"))


@query("WITH e AS (SELECT user_id AS paper_id, event_type AS dimension, max(value) - min(value) AS range, count(value) AS n FROM events GROUP BY ALL) SELECT paper_id, dimension, round(range, 6) AS range, n >= 2 AND range > 2 AS conflict FROM e")
def debate_needed(a: Analog) -> DataFrame:
    rows = a.table("events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("dimension"), F.col("value").alias("score"))
    return rounded(V.debate_needed(rows))


@query(f"""WITH {_VOTES}, d AS (SELECT user_id, dim, avg(score) AS s FROM v GROUP BY ALL), w AS (SELECT * FROM (VALUES ('click', 2.0), ('view', 0.5), ('purchase', 1.5)) t(dim, weight)),
o AS (SELECT user_id AS paper_id, round(sum(s * coalesce(weight, 1)) / sum(coalesce(weight, 1)), 2) AS overall FROM d LEFT JOIN w USING (dim) GROUP BY 1)
SELECT paper_id, overall, CASE WHEN overall >= 4.25 THEN 'A' WHEN overall >= 3.75 THEN 'B' WHEN overall >= 3.25 THEN 'C' WHEN overall >= 2.75 THEN 'D' ELSE 'F' END AS grade FROM o""")
def weighted_overall(a: Analog) -> DataFrame:
    dims = a.votes().groupBy(F.col("model").cast("long").alias("paper_id"), "sub_id").agg(F.avg("score").alias("final_score"))
    weights = a.spark.createDataFrame([("click_x", 2.0), ("view", 0.5), ("purchase", 1.5)], "sub_id string, weight double")
    return rounded(V.weighted_overall(dims, weights))


@query(f"""WITH {CITATIONS_SQL}, m AS (SELECT paper_id, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END) AS c5, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0 END) AS g4 FROM cit GROUP BY 1)
SELECT paper_id, 'V1' AS sub_id, CASE WHEN c5 >= 0.95 THEN 5.0 WHEN c5 >= 0.85 THEN 4.0 WHEN c5 >= 0.7 THEN 3.0 WHEN c5 >= 0.5 THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM m
UNION ALL SELECT paper_id, 'E1', CASE WHEN g4 >= 0.8 THEN 5.0 WHEN g4 >= 0.6 THEN 4.0 WHEN g4 >= 0.4 THEN 3.0 WHEN g4 >= 0.2 THEN 2.0 ELSE 1.0 END FROM m""")
def rubric_scores(a: Analog) -> DataFrame:
    flag = F.col("l_returnflag")
    null = F.lit(None).cast("double")
    metrics = a.citations().groupBy("paper_id").agg(F.avg((flag != "R").cast("int")).alias("c5"), F.avg((flag == "A").cast("int")).alias("g4"))
    return rounded(V.rubric_scores(metrics.withColumns({c: null for c in ("c6_rate", "t2", "t4", "t5", "s5")} | {"c6_auto_fail": F.lit(False)})))


_REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{s[0]}', '{s[1]}', '{s[3]}', {list(s[4]) if s[4] else '[]::VARCHAR[]'})" for s in V.SUB_DIMENSIONS) + ") t(sub_id, agent, risk, metric_ids))"


@query(f"WITH {_REG} SELECT sub_id, agent, risk IN ('medium', 'high') AS votes FROM reg")
def corrector_targets(a: Analog) -> DataFrame:
    return V.targets(V.registry(a.spark)).select("sub_id", "agent", "votes")


@query(f"WITH {_REG} SELECT unnest(metric_ids) AS metric_id, sub_id AS consumer FROM reg")
def metric_lineage(a: Analog) -> DataFrame:
    return V.metric_lineage(V.registry(a.spark))


# Text over whole tables


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_path(a: Analog) -> DataFrame:
    return rounded(a.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k")))


@query(r"SELECT doc_id, regexp_extract(text, '\b(?:19|20)\d{2}\b', 0) AS year FROM documents WHERE regexp_extract(text, '\b(?:19|20)\d{2}\b', 0) <> ''")
def year_regex(a: Analog) -> DataFrame:
    return a.table("documents").select("doc_id", T.entry_year(F.col("text")).alias("year")).where("year <> ''")


@query(r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS href FROM pages")
def html_links(a: Analog) -> DataFrame:
    return a.table("pages").select("page_id", F.explode(F.array_distinct(T.html_links(F.col("html")))).alias("href"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7f]', ' ', 'g'), '[a-z]{{2,}}', 0) AS w FROM documents), p AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM w),
b AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS bigram FROM p WHERE w[i] NOT IN ({_STOP}) AND w[i + 1] NOT IN ({_STOP})), f AS (SELECT doc_id, bigram, min(i) AS i FROM b GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, bigram FROM f QUALIFY pos <= 5""")
def keyword_bigrams(a: Analog) -> DataFrame:
    plain = F.regexp_replace(F.lower("text"), r"[^\x00-\x7f]", " ")
    return rounded(a.table("documents").select("doc_id", F.posexplode(T.keyword_bigrams(plain)).alias("i", "bigram")).select("doc_id", (F.col("i") + 1).alias("pos"), "bigram"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, list_distinct(string_split(lower(p_name), ' ')) AS w FROM n)
SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jac, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS lev
FROM w a JOIN w b ON a.p_name < b.p_name AND len(list_intersect(a.w, b.w)) > 0""")
def title_similarity(a: Analog) -> DataFrame:
    """Names that share a word, met at the word."""
    names = a.table("part").select("p_name").distinct()
    words = names.select("p_name", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("w"))
    pairs = words.select(F.col("p_name").alias("a"), "w").join(words.select(F.col("p_name").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()
    return rounded(pairs.select("a", "b", T.word_jaccard(F.col("a"), F.col("b")).alias("jac"), T.edit_similarity(F.col("a"), F.col("b")).alias("lev")))
