"""Sinks: one dataset for each kind of artifact, partitioned by paper; an index with upserts; logs to append to."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("extraction", "validation", "c6_alignment", "citation_analysis", "graph_analysis", "trend_baseline", "key_papers", "node_step")
INDEX = "paper_id string, status string, updated_at timestamp, source_path string"


class ResultStore:
    """Results under a root folder. Saving replaces the papers of the rows written and leaves others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, rows: DataFrame, kind: str, step: str | None = None) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        path = f"{self.root}/{kind}" + (f"/{step}" if step else "")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id").parquet(path)
        return path

    def load(self, kind: str, step: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}" + (f"/{step}" if step else ""))

    def register(self, papers: DataFrame) -> DataFrame:
        """Sources (paper_id, source_path, sha256, size, mtime), each once."""
        rows = papers.select("paper_id", "source_path", "sha256", "size", "mtime").dropDuplicates(["paper_id"])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id").parquet(f"{self.root}/sources")
        return rows

    def update_index(self, changes: DataFrame) -> None:
        """Append changes (paper_id, status, updated_at, source_path); the index is the latest of each paper."""
        changes.select("paper_id", "status", "updated_at", "source_path").write.mode("append").parquet(f"{self.root}/index")

    def index(self) -> DataFrame:
        return latest(self.spark.read.schema(INDEX).parquet(f"{self.root}/index"))

    def compact_index(self) -> None:
        """Rewrite the index with one row a paper."""
        rows = self.index()
        rows.write.mode("overwrite").parquet(f"{self.root}/index_next")
        self.spark.read.parquet(f"{self.root}/index_next").write.mode("overwrite").parquet(f"{self.root}/index")

    def append_log(self, records: DataFrame, name: str) -> None:
        records.write.mode("append").json(f"{self.root}/logs/{name}")

    def runs(self) -> DataFrame:
        """Run summaries, newest first."""
        return self.spark.read.json(f"{self.root}/summaries").orderBy(F.desc("timestamp"), "run_id")


def latest(rows: DataFrame, key: str = "paper_id", at: str = "updated_at") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(at), "status")
    return rows.withColumn("_rk", F.row_number().over(order)).where("_rk = 1").drop("_rk")


def write_run_file(path: str, config: dict, tools: dict, lineage: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump({"config": config, "tools": tools, "metrics_index": lineage}, f, sort_keys=True)
