"""Training corpus: toxicity, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs; all but the last keep the columns of ``documents``, whatever these are called.

Defined cases: a null text is empty; a null doc_id comes after all others; rows that repeat a doc_id
are documents of their own, each judged by its own text; of rows equal in doc_id and text one stays;
an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import free_names, materialize, table
from quirelake.llm.exact_dedup import exact_duplicates, text_digest
from quirelake.llm.mixing import MIX, poisson_mix
from quirelake.llm.packing import op7_tokenizer, pack
from quirelake.llm.pu_toxicity import with_toxicity
from quirelake.llm.token_groups import shingle_components


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score, predicted = free_names(docs, "score", "predicted")
    scored = with_toxicity(docs, table(spark, sf_dir, "labels"), score_name=score, predicted_name=predicted)
    return scored.where(F.col(predicted) == 0).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digest, the_id, the_digest = free_names(docs, "digest", "kept_id", "kept_digest")
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(the_id), F.unhex("text_sha256").alias(the_digest)).distinct()
    rows = docs.withColumn(digest, text_digest(F.col("text")))
    stay = rows.join(kept, rows["doc_id"].eqNullSafe(kept[the_id]) & (rows[digest] == kept[the_digest]), "left_semi")
    return stay.dropDuplicates(["doc_id", digest]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the least doc_id stays. Rows are told apart by a number that is written with them once."""
    (row,) = free_names(docs, "row")
    placed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    parts = shingle_components(placed.select(F.col(row).alias("doc_id"), "text"))
    ids = placed.select(F.col(row).alias("at"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("id"))
    parts = parts.select(F.col("doc_id").alias("at"), "component_id").join(ids, "at")
    kept = parts.groupBy("component_id").agg(F.min(F.struct("id", "at")).alias("least")).select(F.col("least.at").alias("at"))
    return placed.join(kept, placed[row] == kept["at"], "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mix(docs, MIX).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs, op7_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("mixing", mix), ("packing", pack_sequences)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
