"""Queries of the text functions over texts made of whole tables, the same for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import graph as G
from quirelake.operators import temporal as Y
from quirelake.plans.analog import EDGES_SQL, Analog

QUERIES: dict = {}
SQL: dict[str, str] = {}


def over(source: str, sql: str):
    """A query over ``source``, SELECT statements that Spark and DuckDB both read; {name} is a table, INPUT in ``sql`` is ``source``."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", source)))

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.sql(source, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}))
        SQL[f.__name__] = sql.replace("INPUT", f"({re.sub(r'[{}]', '', source)}) t")
        return f

    return add


# Texts of the forms that the functions read, made of the columns of whole tables.
SENTENCES = """SELECT l_orderkey * 10 + l_linenumber AS id, 'Nets [' || CAST(l_partkey AS STRING) || '] work [' || CAST(l_linenumber AS STRING) || ', ' || CAST(l_suppkey AS STRING) || '], see [' || CAST(l_linenumber AS STRING)
  || '-' || CAST(l_linenumber + l_orderkey % 4 - 1 AS STRING) || ', ' || CAST(l_partkey AS STRING) || '], [' || l_returnflag || '] and [ 1 ].' AS text FROM {lineitem}"""
NAMES = """SELECT CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ',  ' || c_name WHEN 1 THEN c_name || ' O''Neil-' || c_mktsegment ELSE c_mktsegment || ' K.  ' || c_name END AS raw FROM {customer}
  UNION ALL SELECT s_name AS raw FROM {supplier} UNION ALL SELECT p_name || ', ' || p_brand AS raw FROM {part}"""
IDS = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'http://dx.doi.org/' WHEN 2 THEN 'doi: ' ELSE '' END || '10.' || CAST(1000 + p_size AS STRING) || '/' || p_brand || CAST(p_partkey AS STRING) AS doi,
  CASE p_partkey % 3 WHEN 0 THEN 'arXiv:' WHEN 1 THEN 'arxiv: ' ELSE '' END || CAST(1500 + p_size AS STRING) || '.' || CAST(10000 + p_partkey AS STRING) || CASE p_partkey % 2 WHEN 0 THEN 'v' || CAST(p_size AS STRING) ELSE '' END AS arxiv,
  CASE p_partkey % 4 WHEN 0 THEN 'https://openalex.org/w' WHEN 1 THEN 'https://api.openalex.org/works/W' WHEN 2 THEN 'openalex:w' ELSE 'W' END || CAST(p_partkey AS STRING) AS openalex FROM {part}"""
TITLES = """SELECT CASE p_partkey % 9 WHEN 0 THEN 'Abstract of ' || p_name WHEN 1 THEN CAST(p_size AS STRING) || ' Introduction' WHEN 2 THEN CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || '.3 ' || p_name
  WHEN 3 THEN 'Conclusions on ' || p_name WHEN 4 THEN 'References' WHEN 5 THEN p_type || ' Bibliography' WHEN 6 THEN 'A Appendix ' || p_brand WHEN 7 THEN p_name END AS title FROM {part}
  UNION ALL SELECT SUBSTRING(text, 1, 60) AS title FROM {documents}"""
ENTRIES = """SELECT p_partkey AS id, CASE p_partkey % 7
  WHEN 0 THEN '[' || CAST(p_partkey AS STRING) || '] Vas, A. and Sha, N. (' || CAST(1960 + p_size AS STRING) || '). A ' || p_name || ' is all. ' || p_type || '. https://doi.org/10.5555/' || CAST(p_partkey AS STRING) || '.'
  WHEN 1 THEN CAST(p_partkey AS STRING) || '. J. Dev. "' || p_brand || ': ' || p_name || '". arXiv:1810.' || CAST(10000 + p_partkey AS STRING) || 'v2, ' || CAST(1960 + p_size AS STRING) || '.'
  WHEN 2 THEN 'No year here. ' || p_name || '. More.' WHEN 3 THEN CAST(p_partkey AS STRING) || ') Foo, B. (' || CAST(1960 + p_size AS STRING) || '). On 10 ' || p_name || ' of order 0 . Venue 1.'
  WHEN 4 THEN '[' || CAST(p_partkey AS STRING) || ']  C. Baz.  ' || p_name || ' of 1 .  Press 20' WHEN 5 THEN 'D. Qux, “' || p_brand || '”, and “' || p_name || ' 0 ” 1999. doi.org' ELSE 'E. ' || p_name END AS entry FROM {part}"""
PAIRS = """SELECT p_name AS a, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' ' || p_name WHEN 2 THEN '' WHEN 3 THEN p_brand ELSE REVERSE(p_name) END AS b FROM {part}"""
AUTHORS = """SELECT CASE p_partkey % 6 WHEN 0 THEN p_name || ' et al.' WHEN 1 THEN p_name || ' and ' || p_type WHEN 2 THEN p_type || ' & ' || p_name WHEN 3 THEN '' ELSE p_name END AS author,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(1960 + p_size AS STRING) || 'a' ELSE CAST(1960 + p_size AS STRING) END AS year FROM {part}"""
REPLIES = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Balance: ' || CAST(o_orderkey % 90 AS STRING) || '.5' WHEN 1 THEN 'score: 3, rating: ' || CAST(o_orderkey % 6 AS STRING) WHEN 2 THEN o_orderstatus
  WHEN 3 THEN 'bias score = ' || CAST(o_orderkey % 4 AS STRING) || ' of ' || o_orderpriority ELSE 'Rating:' || CAST(o_orderkey % 5 AS STRING) || '.25' END AS reply FROM {orders}
  UNION ALL SELECT conv_id AS id, text AS reply FROM {conversations}"""
YEARS = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE YEAR(o_orderdate) + o_orderkey % 12 - o_orderkey % 17 END AS year FROM {orders}"


@over(SENTENCES, r"""SELECT id::BIGINT AS id, unnest(m) AS marker FROM (SELECT id, list_distinct(regexp_extract_all(text, '\[(?:[0-9]+(?:[-,]\s*[0-9]+)*)\]', 0)) AS m FROM INPUT)""")
def markers(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.explode(T.markers(F.col("text"))).alias("marker"))


@over(SENTENCES, r"""WITH r AS (SELECT row_number() OVER () AS row, * FROM INPUT), m AS (SELECT row, id, unnest(regexp_extract_all(text, '\[(?:[0-9]+(?:[-,]\s*[0-9]+)*)\]', 0)) AS marker FROM r),
p AS (SELECT row, id, unnest(string_split(regexp_replace(marker, '[\[\]\s]', '', 'g'), ',')) AS p FROM m),
n AS (SELECT row, id, unnest(CASE WHEN p LIKE '%-%' THEN range(split_part(p, '-', 1)::INT, split_part(p, '-', 2)::INT + 1) ELSE [p::BIGINT] END) AS number FROM p) SELECT id::BIGINT AS id, number FROM (SELECT DISTINCT row, id, number FROM n)""")
def marker_numbers(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.explode(T.citation_numbers(F.col("text")).cast("array<bigint>")).alias("number"))


@over(NAMES, r"""SELECT raw, trim(regexp_replace(regexp_replace(lower(CASE WHEN contains(raw, ',') THEN trim(split_part(raw, ',', 2)) || ' ' || trim(split_part(raw, ',', 1)) ELSE raw END), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM INPUT""")
def name_normalise(rows: DataFrame) -> DataFrame:
    return rows.select("raw", T.name_norm(F.col("raw")).alias("norm"))


@over(IDS, r"""SELECT regexp_replace(regexp_replace(lower(doi), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', '') AS doi_norm, lower(regexp_replace(regexp_replace(arxiv, '^arxiv:\s*', '', 'i'), 'v\d+$', '')) AS arxiv_norm,
upper(regexp_replace(regexp_replace(openalex, '^https?://(api\.)?openalex\.org/(works/)?', '', 'i'), '^openalex:', '', 'i')) AS openalex_norm FROM INPUT""")
def id_normalise(rows: DataFrame) -> DataFrame:
    return rows.select(T.doi_norm(F.col("doi")).alias("doi_norm"), T.arxiv_norm(F.col("arxiv")).alias("arxiv_norm"), T.openalex_norm(F.col("openalex")).alias("openalex_norm"))


@over(TITLES, r"""SELECT title, CASE WHEN t LIKE '%abstract%' THEN 'abstract' WHEN t LIKE '%introduction%' THEN 'introduction' WHEN t LIKE '%conclusion%' THEN 'conclusion' WHEN t LIKE '%references%' OR t LIKE '%bibliography%' THEN 'references'
WHEN t LIKE '%appendix%' OR t LIKE '%appendices%' THEN 'appendix' ELSE 'main' END AS kind, coalesce(CASE WHEN n = '' THEN 1 ELSE length(n) - length(replace(n, '.', '')) + 1 END, 1)::BIGINT AS level
FROM (SELECT title, lower(coalesce(title, '')) AS t, regexp_extract(coalesce(title, ''), '^(\d+(?:\.\d+)*)', 1) AS n FROM INPUT)""")
def section_kind(rows: DataFrame) -> DataFrame:
    return rows.select("title", T.section_kind(F.col("title")).alias("kind"), F.coalesce(T.section_level(F.col("title")), F.lit(1)).cast("long").alias("level"))


@over(ENTRIES, r"""WITH b AS (SELECT id, entry, trim(regexp_replace(entry, '^(?:\[(\d+)\]|(\d+)[.)])\s+', '')) AS body FROM INPUT),
p AS (SELECT *, nullif(list_reduce(list_prepend('', regexp_extract_all(body, '["“”]([^"“”]+)["“”]', 1)), lambda acc, q: CASE WHEN length(q) > length(acc) THEN q ELSE acc END), '') AS quoted,
  nullif(trim(regexp_extract(body, '\(?\b(?:19|20)\d{2}\b\)?[).,;:\- ]*([^.]+)', 1)), '') AS after, list_filter(list_transform(string_split(body, '.'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM b)
SELECT id::BIGINT AS id, coalesce(nullif(regexp_extract(entry, '^(?:\[(\d+)\]|(\d+)[.)])\s+', 1), ''), nullif(regexp_extract(entry, '^(?:\[(\d+)\]|(\d+)[.)])\s+', 2), ''))::BIGINT AS reference_number, regexp_extract(body, '\b(?:19|20)\d{2}\b', 0) AS year,
rtrim(coalesce(nullif(regexp_extract(body, '\b(10\.\d{4,9}/[^\s"<>]+)', 1), ''), ''), ').,;') AS doi, regexp_extract(body, '(?i)arxiv:\s*(\d{4}\.\d{4,5})', 1) AS arxiv_id, coalesce(trim(quoted), after, parts[2], parts[1]) AS title FROM p""")
def reference_entries(rows: DataFrame) -> DataFrame:
    p = T.parsed_entry(F.col("entry"))
    return rows.select(F.col("id").cast("long").alias("id"), p["reference_number"].cast("long").alias("reference_number"), p["year"].alias("year"), p["doi"].alias("doi"), p["arxiv_id"].alias("arxiv_id"), p["title"].alias("title"))


@over(PAIRS, r"""SELECT a, b, round(CASE WHEN a = '' OR b = '' THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard, round(CASE WHEN a = '' OR b = '' THEN 0.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS edit
FROM (SELECT a, b, string_split(lower(a), ' ') AS x, string_split(lower(b), ' ') AS y FROM INPUT)""")
def text_similarity(rows: DataFrame) -> DataFrame:
    return rows.select("a", "b", F.round(T.word_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(T.edit_similarity(F.col("a"), F.col("b")), 6).alias("edit"))


@over(AUTHORS, r"""WITH f AS (SELECT author, year, regexp_extract_all(regexp_split_to_array(replace(regexp_replace(lower(author), 'et al\.?', '', 'g'), '&', 'and'), '\band\b')[1], '[a-z]+') AS words FROM INPUT),
k AS (SELECT author, year, coalesce(words[len(words)], '') AS k FROM f) SELECT author, year, CASE WHEN k = '' OR trim(year) = '' THEN '' ELSE k || '|' || trim(year) END AS key FROM k""")
def author_year_keys(rows: DataFrame) -> DataFrame:
    return rows.select("author", "year", T.author_year_key(F.col("author"), F.col("year")).alias("key"))


@over(REPLIES, r"""WITH f AS (SELECT id, regexp_extract_all(lower(reply), '(?:balance|bias score|score|rating)\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)', 1) AS found FROM INPUT)
SELECT id::BIGINT AS id, (CASE WHEN len(found) = 0 THEN 5.0 ELSE least(5.0, greatest(0.0, found[len(found)]::DOUBLE)) END)::DOUBLE AS score FROM f""")
def reply_scores(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), T.reply_score(F.col("reply")).alias("score"))


def edge_resolution(a: Analog) -> DataFrame:
    nodes = a.table("part").where("p_size > 5").select(F.lit("parts").alias("paper_id"), F.col("p_partkey").cast("string").alias("id"))
    _, stats = G.resolve_edges(a.edges(), nodes)
    return stats.select("total", "unresolved", F.round("ratio", 6).alias("ratio"))


QUERIES["edge_resolution"] = lambda spark, sf_dir: edge_resolution(Analog(spark, sf_dir))
SQL["edge_resolution"] = f"""WITH {EDGES_SQL}, n AS (SELECT p_partkey AS id FROM part WHERE p_size > 5), e AS (SELECT (src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n))::INT AS lost FROM edges)
SELECT count(*) AS total, sum(lost)::BIGINT AS unresolved, round(avg(lost), 6) AS ratio FROM e"""


@over(YEARS, "SELECT label, count(*) AS cnt FROM (SELECT CASE WHEN year IS NULL THEN 'unknown' WHEN year > 2001 THEN 'future' WHEN 2001 - year < 5 THEN '0-4' WHEN 2001 - year < 10 THEN '5-9' WHEN 2001 - year < 20 THEN '10-19' ELSE '20+' END AS label FROM INPUT) GROUP BY 1")
def age_labels(rows: DataFrame) -> DataFrame:
    return Y.age_distribution(rows, 2001, [0, 5, 10, 20], [])

