"""Queries of the layout scan, of Markdown papers and of judges, over papers and targets made of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake import engine
from quirelake.operators import graph, judging, paragraphs, titles, voting
from quirelake.sources import layout

QUERIES: dict = {}
SQL: dict[str, str] = {}

# A customer's orders are the pages of a paper and order lines the lines on them; two lines or fewer share a block.
# Spark and DuckDB both read this.
LINES = """SELECT paper_id, page, n, block, CASE WHEN headed THEN CAST(l_suppkey % 9 + 1 AS STRING) || ' ' || o_orderpriority WHEN l_partkey % 6 = 0 THEN 'Nets [' || CAST(l_partkey AS STRING) || '] work as Kipf (' || CAST(1990 + l_suppkey % 30 AS STRING) || ') et al.'
    WHEN l_partkey % 6 = 1 THEN 'and graphs [' || CAST(n AS STRING) || ', ' || CAST(l_suppkey AS STRING) || '] help. They go' WHEN l_partkey % 6 = 2 THEN 'Trees [' || CAST(n AS STRING) || '-' || CAST(n + 2 AS STRING) || '] grow! See e.g.'
    WHEN l_partkey % 6 = 3 THEN 'on and on' WHEN l_partkey % 6 = 4 THEN 'The end [' || CAST(l_suppkey AS STRING) || '].' ELSE '' END AS text,
  CASE WHEN headed THEN 14 ELSE 10 END AS size, 50 + CASE WHEN (page + block) % 4 = 0 THEN 12 ELSE 0 END AS x0, 12 * n + 30 * CAST(FLOOR(block / 2) AS INT) AS y0
FROM (SELECT *, CAST(FLOOR(n / 2) AS INT) + 1 AS block, n = 1 AND page % 3 = 0 AS headed FROM (SELECT o_custkey AS paper_id, o_orderkey AS page, o_orderpriority, l_partkey, l_suppkey,
  CAST(ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) numbered) placed"""

PARTS_SQL = r"""t AS (SELECT *, y0 + 10 AS y1 FROM (INPUT)),
body AS (SELECT paper_id, arg_max(size, (chars, -first_at)) AS body FROM (SELECT paper_id, size, sum(length(text)) AS chars, min(page * 1000 + n) AS first_at FROM t WHERE text <> '' GROUP BY ALL) GROUP BY 1),
b AS (SELECT paper_id, page, block, min(x0) AS x0, min(y0) AS y0, max(y1) AS y1, arg_min(text, n) AS head, arg_max(text, n) AS tail, max(size) >= any_value(body) + 1.5 AND regexp_matches(arg_min(text, n), '^[0-9]+ \S') AS headed
  FROM t LEFT JOIN body USING (paper_id) GROUP BY ALL),
g AS (SELECT *, coalesce(NOT headed AND NOT lag(headed) OVER w AND y0 - lag(y1) OVER w BETWEEN -2 AND 16 AND abs(x0 - lag(x0) OVER w) <= 10
  AND (NOT regexp_matches(lag(tail) OVER w, '[.!?]$') OR regexp_matches(head, '^[a-z]')), false) AS joins FROM b WINDOW w AS (PARTITION BY paper_id, page ORDER BY block)),
k AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id ORDER BY page, block)::INTEGER AS paragraph_index FROM g),
x AS (SELECT paper_id, page, paragraph_index, headed, t.n, text, row_number() OVER w AS line, sum(length(text) + 1) OVER w - length(text) - 1 AS s, sum(length(text) + 1) OVER w - 1 AS e
  FROM t JOIN k USING (paper_id, page, block) WHERE text <> '' WINDOW w AS (PARTITION BY paper_id, paragraph_index ORDER BY t.n)),
p AS (SELECT paper_id, page, paragraph_index, bool_or(headed) AS headed, string_agg(text, chr(10) ORDER BY n) AS text, arg_min(text, n) AS head FROM x GROUP BY ALL),
q AS (SELECT *, nullif(sum(headed::INT) OVER w, 0)::INTEGER AS section_index, last_value(CASE WHEN headed THEN head END IGNORE NULLS) OVER w AS section_title FROM p WINDOW w AS (PARTITION BY paper_id ORDER BY paragraph_index))"""

MARKS_SQL = r"""c AS (SELECT * EXCLUDE (text, cut), unnest(cut) AS piece, generate_subscripts(cut, 1) AS i FROM (SELECT *, string_split(regexp_replace(text, '([.!?]\s+)([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS cut FROM q WHERE NOT headed)),
d AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS s, sum(length(piece)) OVER w - length(piece) + length(rtrim(piece, ' ' || chr(10))) AS e, coalesce(regexp_matches(lag(piece) OVER w, '(et al|e\.g)\.\s*$'), false) AS goes_on
  FROM c WINDOW w AS (PARTITION BY paper_id, paragraph_index ORDER BY i)),
n AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id, paragraph_index ORDER BY i) AS sentence FROM d),
o AS (SELECT paper_id, page, paragraph_index, section_index, section_title, sentence, min(s) AS s, max(e) AS e, trim(regexp_replace(string_agg(piece, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM n GROUP BY ALL),
l AS (SELECT o.*, (SELECT min(x.line) FROM x WHERE x.paper_id = o.paper_id AND x.paragraph_index = o.paragraph_index AND ((x.s <= o.s AND o.s < x.e) OR (o.s <= x.s AND x.s < o.e))) AS line FROM o),
h AS (SELECT * EXCLUDE (text), unnest(regexp_extract_all(text, '\[(?:[0-9]+(?:[-,]\s*[0-9]+)*)\]', 0)) AS whole FROM l),
m AS (SELECT * EXCLUDE (whole), unnest(string_split(regexp_replace(whole, '[\[\]\s]', '', 'g'), ',')) AS part FROM h),
r AS (SELECT * EXCLUDE (part), '[' || unnest(CASE WHEN part LIKE '%-%' THEN range(split_part(part, '-', 1)::INT, split_part(part, '-', 2)::INT + 1) ELSE [part::BIGINT] END) || ']' AS marker, 'numeric' AS kind FROM m
  UNION ALL BY NAME SELECT * EXCLUDE (text), unnest(regexp_extract_all(text, '([A-Z][A-Za-z''`\-]+(?:\s+(?:et al\.|and|&)\s+[A-Z][A-Za-z''`\-]+)*)\s*\((\d{4}[a-z]?)\)', 0)) AS marker, 'author_year' AS kind FROM l)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, layout): every paper's pages as layout JSON."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}
    lines = spark.sql(LINES, **read).select("paper_id", "page", "block", "n", "text", F.col("size").cast("double").alias("size"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0")]).repartition("paper_id")
    box = lambda bottom: F.array("x0", "y0", F.lit(300.0), bottom)
    row = F.struct("n", F.struct(box(F.col("y0") + 10).alias("bbox"), F.array(F.struct("text", "size")).alias("spans")).alias("x"))
    blocks = lines.groupBy("paper_id", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), (F.max("y0") + 10).alias("y1"), F.sort_array(F.collect_list(row)).alias("_x"))
    block = F.struct("block", F.struct(F.lit("text").alias("type"), box(F.col("y1")).alias("bbox"), F.col("_x.x").alias("lines")).alias("b"))
    pages = blocks.groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(block)).alias("_b"))
    page = F.struct("page", F.struct(F.col("page").alias("number"), F.col("_b.b").alias("blocks")).alias("p"))
    whole = pages.groupBy("paper_id").agg(F.sort_array(F.collect_list(page)).alias("_p"))
    return whole.select("paper_id", F.to_json(F.struct(F.col("_p.p").alias("pages"))).alias("layout"))


def add(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.replace("INPUT", LINES.replace("{", "").replace("}", ""))
        return f

    return keep


@add(f"WITH {PARTS_SQL}, {MARKS_SQL} SELECT paper_id, page, paragraph_index, line::INTEGER AS line_in_paragraph, section_index, section_title, marker, kind FROM r")
def layout_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.citations(layout.paragraphs(papers(spark, sf_dir)))
    return found.select("paper_id", F.col("page").cast("long").alias("page"), "paragraph_index", "line_in_paragraph", "section_index", "section_title", "marker", "kind")


@add(f"WITH {PARTS_SQL} SELECT paper_id, section_index, section_title, page, paragraph_index FROM q WHERE headed")
def layout_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.sections(layout.paragraphs(papers(spark, sf_dir)))
    return found.select("paper_id", "section_index", "section_title", F.col("page").cast("long").alias("page"), "paragraph_index")


# A customer's orders are the paragraphs and the reference list of a Markdown paper; Spark and DuckDB both read this.
PARAGRAPHS = """SELECT paper_id, i, n, year, CASE WHEN o_orderkey % 3 = 0 THEN 'Nets [' || CAST(i AS STRING) || '] work, see [' || CAST(CASE WHEN i < n THEN i + 1 ELSE 1 END AS STRING) || '].' WHEN o_orderkey % 3 = 1 THEN 'Graphs help [1-' || CAST(CASE WHEN i < 3 THEN i ELSE 3 END AS STRING) || ']. They do.' ELSE 'No mark here.' END AS text
FROM (SELECT o_custkey AS paper_id, o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS year, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS i, CAST(COUNT(*) OVER (PARTITION BY o_custkey) AS INT) AS n FROM {orders}) numbered"""


def markdown_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, text)."""
    rows = spark.sql(PARAGRAPHS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    cite = lambda c: F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] A. Author. Paper number "), F.col("i").cast("string"), F.lit(" on nets. "), F.col("year").cast("string"), F.lit("."))
    listed = rows.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("i", "text", cite("i").alias("entry")))).alias("_p"))
    body, entries = F.array_join(F.col("_p.text"), "\n\n"), F.array_join(F.col("_p.entry"), "\n")
    return listed.select("paper_id", F.concat(F.lit("# Nets\n\n## 1 Introduction\n\n"), body, F.lit("\n\n## References\n\n"), entries).alias("text"))


@add(f"""WITH p AS ({PARAGRAPHS.replace("{orders}", "orders")}),
m AS (SELECT paper_id, n, unnest(regexp_extract_all(text, '[0-9]+(-[0-9]+)?', 0)) AS part FROM p), c AS (SELECT DISTINCT paper_id, unnest(range(split_part(part, '-', 1)::INT, (CASE WHEN part LIKE '%-%' THEN split_part(part, '-', 2) ELSE part END)::INT + 1)) AS i FROM m)
SELECT paper_id, count(*) AS total, count(*) - count(c.i) AS uncited, 1 - count(c.i) / count(*) AS rate, (max(year) - min(year))::INTEGER AS span FROM p LEFT JOIN c USING (paper_id, i) GROUP BY 1""")
def paper_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 and T1 of Markdown papers: paragraphs, citations and the reference list read from the text, linked by number."""
    found = engine.extract(graph._cut(markdown_papers(spark, sf_dir), "papers"))
    rates = paragraphs.orphan_rate(found.references, found.citations)
    years = found.references.groupBy("paper_id").agg((F.max(F.col("year").cast("int")) - F.min(F.col("year").cast("int"))).alias("span"))
    return rates.join(graph.exchanged(years), "paper_id").select("paper_id", "total", "uncited", "rate", "span")


def table_judge(model: str, context: str, attempt: int) -> str:
    """Answers by the context's number: raises for some targets, for others at the first attempt only, or names no score."""
    n = int(context) + len(model)
    if n % 7 == 6 or (attempt == 1 and n % 5 == 0):
        raise ValueError(context)
    return "no opinion" if n % 7 == 5 else f"Score: {n % 7}"


@add("""WITH v AS (SELECT event_id, CASE WHEN n % 7 = 6 THEN NULL WHEN n % 7 = 5 THEN 5.0 ELSE (n % 7)::DOUBLE END AS score, CASE WHEN n % 7 = 6 THEN 3 WHEN n % 5 = 0 THEN 2 ELSE 1 END AS attempts
  FROM (SELECT event_id, event_id + unnest([1, 2, 9]) AS n FROM events))
SELECT event_id, count(score) AS n, median(score) AS med, stddev_samp(score) AS sd, sum(attempts)::BIGINT AS attempts FROM v GROUP BY 1 HAVING count(score) >= 2""")
def judge_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event judged by three models; median and deviation of those with two votes or more, and the attempts made."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_id").cast("string").alias("context"))
    votes = judging.judge_votes(events, ["a", "bb", "ccccccccc"], table_judge)
    votes = graph._cut(votes.select("event_id", "score", "attempts"), "votes")
    made = votes.groupBy("event_id").agg(F.sum("attempts").alias("attempts"))
    return voting.vote_stats(votes, [], "event_id").join(made, "event_id").select("event_id", "n", "med", "sd", "attempts")


# The longest common subsequence row by row: the new row is the running maximum of what each character adds to the last.
TITLES_SQL = r"""k AS (SELECT page_id, title, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(trim(title)), '\s+'), lambda w: w <> '')), ' ') AS key
  FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)),
d AS (SELECT key, length(key) AS n, unnest(range(1, length(key) + 1)) AS i FROM (SELECT DISTINCT key FROM k)),
held AS (SELECT key, n, substr(key, i, 1) AS c, count(*) AS m FROM d GROUP BY ALL),
pairs AS (SELECT a.key AS a, b.key AS b, a.n AS x, b.n AS y FROM held a JOIN held b ON a.c = b.c AND a.key < b.key AND 200 * least(a.n, b.n) >= 85 * (a.n + b.n)
  GROUP BY ALL HAVING 200 * sum(least(a.m, b.m)) >= 85 * (a.n + b.n)),
steps(a, b, x, y, i, best) AS (SELECT a, b, x, y, 0, list_transform(range(y + 1), lambda j: 0) FROM pairs UNION ALL
  SELECT a, b, x, y, i + 1, list_concat([0], list_transform(range(1, y + 1), lambda j: list_max(v[1:j]))) FROM
    (SELECT *, list_transform(range(1, y + 1), lambda j: greatest(best[j + 1], best[j] + (substr(b, j, 1) = substr(a, i + 1, 1))::INTEGER)) AS v FROM steps WHERE i < x)),
near AS (SELECT a, b, 200::DOUBLE * best[y + 1] / (x + y) AS ratio FROM steps WHERE i = x AND 200 * best[y + 1] >= 85 * (x + y)),
each_way AS (SELECT a AS key, b AS other, ratio FROM near UNION ALL SELECT b, a, ratio FROM near)"""


@add(f"""WITH RECURSIVE {TITLES_SQL}
SELECT page_id, title, count(other) AS n_near, arg_min(other, (-ratio, other)) AS nearest, max(ratio) AS nearest_ratio FROM k LEFT JOIN each_way USING (key) GROUP BY 1, 2""")
def similar_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the titles of all pages that are near to its own, counted, and the nearest of them."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    return titles.similar_titles(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", title))
