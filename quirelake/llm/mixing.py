"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

Each source gets the mean repetition rate weight * total / size, sizes in UTF-8 bytes. A row's
count inverts the Poisson distribution of that mean at a uniform number hashed from the seed and
the id, so that it never depends on partitioning. Rows are exploded by their counts and dealt
globally in the order of a second hash.

A mean over ``SPLIT`` is a sum of equal smaller means, each inverted at its own hashed number, so
no mean is too large for the distribution table.

Defined cases: null sources are one source; null or empty text has size 0 and takes part with the
rate of its source; a source of size 0 or without weight has rate 0; weights are scaled to sum 1
over the sources present; a null id hashes as the text "null"; equal rows get equal counts;
an empty table gives no rows; further columns pass through unless named copy or shuffle_key,
which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import free_names, materialize, table

#: The largest mean inverted in one piece, and the sources that may be broadcast.
SPLIT, BROADCAST_SOURCES = 16, 10_000


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(documents: DataFrame, weights: dict[str | None, float] | None, source: str, text: str, epochs: float, default_weight: float = 1.0) -> DataFrame:
    """(source, rate): one row for each source. ``weights`` None: all equal; sources not named weigh ``default_weight``."""
    sizes = documents.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint")).alias("_size"))
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    weighed = sizes.withColumn("_weight", weight).where("_size > 0 and _weight > 0")
    total = weighed.agg(F.sum("_size").alias("_total"), F.sum("_weight").alias("_all"))
    return weighed.join(F.broadcast(total)).select(  # the one row of sums
        "_source", (F.col("_weight") / F.col("_all") * F.col("_total") * F.lit(float(epochs)) / F.col("_size")).alias("rate")
    )


def poisson_table(rates: DataFrame) -> DataFrame:
    """(_source, rate, _parts, _cdf): a mean over SPLIT counts as _parts equal means; _cdf sums the terms of one of them."""
    part = F.col("rate") / F.col("_parts")
    # Terms past mean + 14 deviations + 20 are below the last bit of a uniform number.
    terms = F.sequence(F.lit(1), F.ceil(part + 14 * F.sqrt(part) + 20).cast("int"))
    start = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * part / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return rates.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int")).withColumn(
        "_cdf", F.aggregate(terms, start, step, lambda acc: acc["cdf"])
    )


def poisson_mix(
    documents: DataFrame,
    weights: dict[str | None, float] | None = None,
    epochs: float = 1.0,
    seed: int = 42,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    default_weight: float = 1.0,
) -> DataFrame:
    """``documents`` replicated, with copy (from 0) and shuffle_key, in global hash order within each partition."""
    documents = documents.drop("copy", "shuffle_key")
    rates = materialize(poisson_table(source_rates(documents, weights, source, text, epochs, default_weight)), "rates")
    # Sources are few as a rule, and then go to every executor; past the bound both sides are exchanged and Spark splits hot sources.
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    of, law, count = free_names(documents, "_source", "_law", "_count")
    rates = rates.select(F.col("_source").alias(of), F.struct("_parts", "_cdf").alias(law))
    draw = lambda j: F.size(F.filter(F.col(law)["_cdf"], lambda c: c <= hashed_uniform(F.lit(str(seed)), ident, j.cast("string"))))
    counted = documents.join(F.broadcast(rates) if few else rates, documents[source].eqNullSafe(F.col(of))).withColumn(
        count, F.aggregate(F.sequence(F.lit(1), F.col(law)["_parts"]), F.lit(0), lambda acc, j: acc + draw(j))
    )
    copies = (
        counted.where(F.col(count) > 0).drop(law, of)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(count)
        .withColumn("shuffle_key", F.substring(F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), ident, F.col("copy").cast("string"))), 1, 16))
    )
    return copies.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


#: Production mix: the first source, far the largest, is held to a fifth of what each of the others has.
MIX = {"src0": 0.2}


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"), MIX)


def _oracle(mix: dict[str, float], seed: int = 42, docs: str = "documents") -> str:
    """DuckDB SQL; the recursive table holds the distribution of each source in parts of at most SPLIT."""
    cases = " ".join(f"WHEN source = '{k}' THEN {v}::DOUBLE" for k, v in mix.items())
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / {float(1 << 52)}"
    return f"""
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS size, CASE {cases} ELSE 1.0::DOUBLE END AS weight FROM {docs} GROUP BY source),
used AS (SELECT * FROM sizes WHERE size > 0 AND weight > 0),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM used) * (SELECT sum(size) FROM used) * 1.0::DOUBLE / size AS rate FROM used),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {SPLIT}))::INTEGER AS parts FROM rates),
terms AS (
  SELECT source, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS cdf, rate / parts AS part, parts FROM parted
  UNION ALL
  SELECT source, k + 1, p * part / (k + 1), cdf + p * part / (k + 1), part, parts FROM terms WHERE k + 1 <= ceil(part + 14 * sqrt(part) + 20)),
draws AS (SELECT d.doc_id, d.source, j, {draw} AS u FROM {docs} d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.parts + 1)) t(j)),
counts AS (SELECT d.doc_id, count(*) AS n FROM draws d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.cdf <= d.u GROUP BY d.doc_id)
SELECT d.*, c.copy::INTEGER AS copy, substr(md5('shuffle{seed}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.copy), 1, 16) AS shuffle_key
FROM {docs} d JOIN (SELECT doc_id, unnest(range(0, n)) AS copy FROM counts) c ON d.doc_id IS NOT DISTINCT FROM c.doc_id
"""


QUERIES = {"op6_poisson_mix": op6_poisson_mix}
SQL = {"op6_poisson_mix": _oracle(MIX)}
