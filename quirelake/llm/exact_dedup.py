r"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to
digests and counted; a sort-merge anti-join (the index side needs no shuffle) finds the digests that
the index lacks, and all are appended, marked as entries or as further rows of an earlier entry. What
stays is then read from the index: a sort-merge join of the batch's digests with it. Another session
opens the same folder and goes on.

Defined cases: null text counts as empty; texts are equal when identical after each run
``[\x20\x09-\x0D]+`` becomes one space; of equal rows of a batch the least doc_id stays (a null
doc_id comes after all others); rows that repeat a doc_id stay rows of their own, and all rows with
the doc_id that stays are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import SALTS, materialize, release, shared_path, table

#: Rows that a bucket of the index should hold, and the least and most buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 64, 1 << 16
INDEX_SCHEMA = "digest binary, entry boolean, keep_id bigint, n_rows bigint, batch bigint"
#: Batches that the query deals the documents to, by ranges of doc_id in ascending order.
BATCHES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def bucket_count(rows: int) -> int:
    """A power of two for an index of so many rows."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, rows // BUCKET_ROWS - 1).bit_length()))


class DigestIndex:
    """A digest index in a shared folder. ``buckets`` is fixed when the folder is first used: see bucket_count for the rows it will hold."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.path = spark, path
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> int:
        """Add a batch of (doc_id, digest); returns the batch's number, drawn at random."""
        batch = uuid.uuid4().int >> 65
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))
        groups = materialize(groups, "groups")
        known = self.rows().where("entry").select("digest").hint("merge")
        fresh = groups.join(known, "digest", "left_anti").withColumn("entry", F.lit(True))
        more = groups.join(known, "digest", "left_semi").withColumn("entry", F.lit(False))
        rows = fresh.unionByName(more).select("digest", "entry", "keep_id", "n_rows", F.lit(batch).cast("bigint").alias("batch"))
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )
        release(groups)
        return batch

    def decide(self, digests: DataFrame) -> DataFrame:
        """(doc_id, digest, keep_id, group_size, batch) per row of (doc_id, digest), from the index: ``keep_id`` and ``batch``
        of the entry, ``group_size`` over all batches.

        The batch meets the index as one row a digest; answers go back to the rows by (digest, salt).
        """
        salted = digests.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        salts = salted.groupBy("digest", "salt").count().groupBy("digest").agg(F.collect_list("salt").alias("salts"))
        held = self.rows().groupBy("digest").agg(
            F.sum("n_rows").alias("group_size"), F.min(F.when(F.col("entry"), F.col("keep_id"))).alias("keep_id"), F.max(F.when(F.col("entry"), F.col("batch"))).alias("batch")
        )
        answers = salts.join(held.hint("merge"), "digest").select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size", "batch")
        return salted.join(answers, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", "batch")

    def add(self, documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Append the batch; return (doc_id, digest, keep_id, group_size, kept) per row of it.

        ``keep_id`` is the id of the index's entry; ``kept`` marks the rows that stay, none where an
        earlier batch has the text.
        """
        digests = materialize(digests_of(documents, text, doc_id), "digests")
        batch = self.append(digests)
        kept = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return self.decide(digests).select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))

    def drop(self) -> None:
        """Forget the table; its files stay, for another session to open."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests_of(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_digest(F.col(text)).alias("digest"))


def exact_duplicates(documents: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """Decisions per row: doc_id, keep_id, group_size, kept, text_sha256.

    Without an index a new one is begun, to which the documents go in ``batches`` ranges of doc_id, the least first (nulls last).
    """
    if index:
        decided = index.add(documents, text, doc_id)
    else:
        digests = materialize(digests_of(documents, text, doc_id), "digests")
        low, high, rows = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
        index = DigestIndex(documents.sparkSession, shared_path(documents.sparkSession, "digest-index"), bucket_count(rows))
        low, high = low or 0, high or 0
        part = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(low)) / (float(high) - float(low) + 1) * batches), F.lit(batches - 1))
        part = F.least(F.greatest(part, F.lit(0)), F.lit(batches - 1))
        for k in range(batches):
            index.append(digests.where(part == k))
        decided = index.decide(digests).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        index.drop()  # the plan holds its files; only the name goes
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {"op5_exact_dedup": OP5_SQL}
