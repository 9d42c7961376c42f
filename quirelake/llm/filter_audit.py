r"""Filter interaction audit: what each filter removes, in every order in which five of them may run.

Each text gets five failure flags. Rows are summed to one cell for each part and set of flags (at most
32 a part), and ``CUBE`` over the five flags and the part sums the cells: the grouping set that selects
some flags, in its row where all of them are false, counts the documents that survive those filters.
A step of an order is then a pair of subsets, before and after the filter; one join of 600 fixed steps
with the survivors of both gives every count.

Filters (null text: empty; words are maximal ``[^\x20\x09-\x0D]+``, case-sensitive): A under 200 words;
B 100 * distinct words < 50 * words; C 100 * ``[A-Z]`` > 3 * code points; D holds any of ``#$%&*|``;
E identical to the text of any smaller doc_id in the table, removed or not (by SHA-256 of the text).

Equal texts are summed by (text, part) before they meet, least doc_id first, so a text that a third of
all rows share reaches the exchange once for each task and part.

Defined cases: a null part is the empty string; a null doc_id is larger than all others and has no
labels; rows that share doc_id and text are documents of their own, none a copy of the other; of several
labels of a doc_id the largest counts, null labels count as 0; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import literal_table, materialize, release, table

FILTERS = "ABCDE"
LEAST_WORDS = 200
SPACE = " \t\n\x0b\f\r"
MEASURES = ("n", "good", "toxic")
#: Rows without a doc_id are dealt to so many keys for the join with the labels.
NULL_KEYS = 4096


def with_text_flags(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with boolean columns A to D in place of ``text``, which is not null."""
    trimmed = F.btrim(F.col(text), F.lit(SPACE))
    split = rows.select("*", F.split(trimmed, r"[\x20\x09-\x0D]+").alias("words"), (trimmed == "").cast("int").alias("none"))
    counted = split.select("*", (F.size("words") - F.col("none")).alias("n_words"), (F.size(F.array_distinct("words")) - F.col("none")).alias("n_distinct"))
    capitals = F.regexp_count(F.col(text), F.lit("[A-Z]")).cast("bigint")
    flags = {
        "A": F.col("n_words") < LEAST_WORDS, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"), "C": 100 * capitals > 3 * F.length(text),
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }  # fmt: skip
    return counted.select(*[c for c in rows.columns if c != text], *[flag.alias(name) for name, flag in flags.items()])


def failure_cells(documents: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents by part and set of failed filters."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(
        F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("body"),
    )  # fmt: skip
    kinds = ["digest", "part", *FILTERS[:4]]
    same = with_text_flags(rows, "body").groupBy("id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        *[F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).cast("int")).alias(f"is_{name}") for c, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    # Rows without an id find no label; a number of their text spreads them.
    dealt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_KEYS))).otherwise(0)
    marked = same.withColumn("dealt", dealt).join(marks.withColumn("dealt", F.lit(0).cast("bigint")), ["id", "dealt"], "left")
    sums = [F.col("n"), *[(F.col("n") * F.coalesce(f"is_{m}", F.lit(0))).alias(m) for m in MEASURES[1:]]]
    marked = marked.select("id", *kinds, *sums)
    # By text and part: all rows, and those of the least id.
    groups = marked.groupBy(*kinds).agg(
        *[F.sum(m).alias(m) for m in MEASURES], F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *MEASURES)).alias("first")
    )
    least = F.min(F.struct("first.no_id", "first.id")).over(Window.partitionBy("digest"))
    leads = groups.withColumn("leads", least == F.struct("first.no_id", "first.id"))
    at_least = {m: F.when(F.coalesce("leads", F.lit(True)), F.col(f"first.{m}")).otherwise(0) for m in MEASURES}
    halves = F.array(
        F.struct(F.lit(False).alias("E"), *[at_least[m].alias(m) for m in MEASURES]), F.struct(F.lit(True).alias("E"), *[(F.col(m) - at_least[m]).alias(m) for m in MEASURES])
    )
    cells = leads.select("part", *FILTERS[:4], F.inline(halves)).where("n > 0")
    return cells.groupBy("part", *FILTERS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def subset_survivors(cells: DataFrame) -> DataFrame:
    """(part, filters, n, good, toxic): what survives each of the 32 subsets of filters in each part, zeros included.

    ``filters`` has bit k for filter k of FILTERS. The work is one CUBE of the cells.
    """
    flags = ", ".join(FILTERS)
    cube = cells.sparkSession.sql(
        f"SELECT part, {flags}, {', '.join(f'grouping({f}) AS no_{f}' for f in FILTERS)}, grouping(part) AS all_parts, "
        f"{', '.join(f'sum({m}) AS {m}' for m in MEASURES)} FROM {{cells}} GROUP BY CUBE ({flags}, part)",
        cells=cells,
    )
    selected = " AND ".join(f"(no_{f} = 1 OR NOT {f})" for f in FILTERS)
    mask = sum(((1 - F.col(f"no_{f}").cast("int")) * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    found = cube.where("all_parts = 0").where(selected).select("part", mask.alias("filters"), *MEASURES)
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("filters"))
    return every.join(found, ["part", "filters"], "left").select("part", "filters", *[F.coalesce(m, F.lit(0)).cast("bigint").alias(m) for m in MEASURES])


def order_steps() -> list[dict]:
    """The steps of all orders: the filter and the subsets before and after it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            after = before | 1 << FILTERS.index(name)
            rows.append({"filter_order": "".join(order), "step": step, "filter": name, "alone": 1 << FILTERS.index(name), "before": before, "after": after})
            before = after
    return rows


def filter_audit(documents: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark, full = documents.sparkSession, 2 ** len(FILTERS) - 1
    cells = materialize(failure_cells(documents, labels, part, text, doc_id), "cells")
    survivors = materialize(subset_survivors(cells), "survivors")
    release(cells)
    # 600 fixed rows; each meets its subsets by number, in every part.
    steps = F.broadcast(literal_table(spark, order_steps(), "filter_order string, step int, filter string, alone int, before int, after int"))
    of = lambda name, *measures: survivors.select(  # noqa: E731
        F.col("part"), F.col("filters").alias(name), *[F.col(m).alias(f"{name}_{m}") for m in measures]
    )
    paired = of("before", *MEASURES).join(steps, "before").join(of("after", *MEASURES), ["part", "after"]).join(of("alone", "n"), ["part", "alone"])
    total = survivors.where("filters = 0").select("part", F.col("n").alias("total"))
    whole = survivors.where(F.col("filters") == full).select("part", F.col("n").alias("whole"))
    others = of("others", "n").withColumn("alone", F.lit(full) - F.col("others")).drop("others")
    paired = paired.join(others, ["part", "alone"]).join(total, "part").join(whole, "part")
    counted = paired.select(
        "part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), (F.col("before_n") - F.col("after_n")).alias("removed"),
        (F.col("total") - F.col("alone_n") - (F.col("before_n") - F.col("after_n"))).alias("redundant"), (F.col("others_n") - F.col("whole")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )  # fmt: skip
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(w.doc_id > first_id, first_id IS NOT NULL)] AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, ks, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
j AS (SELECT part, filter_order, step, ks[step] AS k, n, good, toxic, fails[ks[step]] AS failed,
    list_bool_or(list_transform(ks[1:step - 1], lambda i: fails[i])) AS earlier, len(list_filter(fails, lambda b: b)) = 1 AS single FROM c, s),
r AS (SELECT part, filter_order, step, k, sum(n) FILTER (NOT failed AND NOT coalesce(earlier, false)) AS kept, sum(n) FILTER (failed AND NOT coalesce(earlier, false)) AS removed,
    sum(n) FILTER (failed AND coalesce(earlier, false)) AS redundant, sum(n) FILTER (failed AND single) AS unique_fails,
    sum(good) FILTER (failed AND NOT coalesce(earlier, false)) AS good_lost, sum(toxic) FILTER (failed AND NOT coalesce(earlier, false)) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, chr(64 + k) AS "filter", coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley
FROM r
"""

QUERIES = {"op11_filter_audit": op11_filter_audit}
SQL = {"op11_filter_audit": OP11_SQL}
