"""Streams (an extension): windowed vote statistics with a watermark, and sessions of votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_votes(votes: DataFrame, at: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(window, sub_id, n, mean, sd, high_disagreement); rows later than the watermark are left out."""
    out = votes.withWatermark(at, late).groupBy(F.window(at, size), "sub_id").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), (F.max("score") - F.min("score")).alias("range")
    )
    return out.withColumn("high_disagreement", (F.col("sd") > 1) | (F.col("range") > 2))


def vote_sessions(votes: DataFrame, at: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(window, model, n): runs of a model's votes without a gap."""
    return votes.withWatermark(at, late).groupBy(F.session_window(at, gap), "model").agg(F.count(F.lit(1)).alias("n"))


def first_votes(votes: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each (sub_id, model, event_id) once, however often it is sent within the watermark."""
    return votes.withWatermark(at, late).dropDuplicatesWithinWatermark(["sub_id", "model", "event_id"])
