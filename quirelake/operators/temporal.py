"""Year statistics of reference lists and the temporal metrics T1 to T5, for many papers at once.

``by`` are the columns that name a paper. ``year`` is a number or null. The present year is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ["paper_id"]


def year_counts(refs: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, year, cnt): year as text, ``unknown`` for null."""
    return refs.groupBy(*by, F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year")).agg(F.count(F.lit(1)).alias("cnt"))


def reference_summary(refs: DataFrame, by: list[str] = BY) -> DataFrame:
    return refs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("year").alias("distinct_years"), F.min("year").alias("earliest"), F.max("year").alias("latest"),
        F.count_if(F.col("year").isNull()).alias("unknown"),
    )


def year_buckets(refs: DataFrame, window: int = 5, by: list[str] = BY) -> DataFrame:
    """(by, start_year, end_year, cnt): buckets from the first year on, empty ones too."""
    if window <= 0:
        raise ValueError("window must be positive")
    per = refs.where("year is not null").groupBy(*by, "year").agg(F.count(F.lit(1)).alias("n"))
    first = per.groupBy(*by).agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    grid = first.withColumn("start_year", F.explode(F.expr(f"sequence(lo, hi, {window})")))
    bucket = per.join(first, by).withColumn("start_year", (F.col("lo") + F.floor((F.col("year") - F.col("lo")) / window) * window).cast("int"))
    sums = bucket.groupBy(*by, "start_year").agg(F.sum("n").alias("n"))
    return grid.join(sums, [*by, "start_year"], "left").select(
        *by, "start_year", F.least(F.col("start_year") + window - 1, F.greatest("hi", F.col("start_year") + window - 1)).alias("end_year"), F.coalesce("n", F.lit(0)).alias("cnt")
    )


def year_trend(refs: DataFrame, by: list[str] = BY, rows: int = 3) -> DataFrame:
    """(by, year, cnt, delta, pct, ma): change from the year before that occurs, and the mean of the last ``rows`` of them."""
    per = refs.where("year is not null").groupBy(*by, "year").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy(*by).orderBy("year")
    before = F.lag("cnt").over(order)
    mean = F.when(F.row_number().over(order) >= rows, F.avg("cnt").over(order.rowsBetween(1 - rows, 0)))
    return per.select(*by, "year", "cnt", (F.col("cnt") - before).alias("delta"), ((F.col("cnt") - before) / before * 100).alias("pct"), mean.alias("ma"))


def age_label(age: Column, bins: list[int]) -> Column:
    """``0-4``, ..., ``20+`` for an age in years; ``future`` below 0 and ``unknown`` for null."""
    bounds = sorted({0, *bins})
    label = F.lit(f"{bounds[-1]}+")
    for low, high in reversed(list(zip(bounds, bounds[1:], strict=False))):
        label = F.when(age < high, f"{low}-{high - 1}").otherwise(label)
    return F.when(age.isNull(), "unknown").when(age < 0, "future").otherwise(label)


def age_distribution(refs: DataFrame, as_of_year: int | Column, bins: list[int] | None = None, by: list[str] = BY) -> DataFrame:
    as_of = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    return refs.groupBy(*by, age_label(as_of - F.col("year"), bins or [0, 5, 10, 20]).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))


def top_years(refs: DataFrame, k: int = 3, by: list[str] = BY) -> DataFrame:
    """(by, rk, year, cnt, share): the k years with most references, by (-cnt, year); shares of those with a year."""
    per = refs.where("year is not null").groupBy(*by, "year").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy(*by).orderBy(F.desc("cnt"), "year")
    ranked = per.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*by))).withColumn("rk", F.row_number().over(order))
    return ranked.where(F.col("rk") <= k)


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """From sums; null where a series is constant."""
    return F.try_divide(n * xy - x * y, F.sqrt(F.greatest(n * xx - x * x, F.lit(0.0))) * F.sqrt(F.greatest(n * yy - y * y, F.lit(0.0))))


def trend_alignment(counts: DataFrame, baseline: DataFrame, by: list[str] = BY, on: list[str] | None = None, compat: bool = False) -> DataFrame:
    """(by, common_years, t5): correlation of (by, year, n) with (on, year, cnt) over common years with cnt > 0; null under 3 of them.

    ``on`` are the columns of ``by`` that the baseline has. A constant series gives null, 0 with ``compat``.
    """
    common = counts.join(baseline.where("cnt > 0"), [*(on or []), "year"])
    x, y = F.col("n").cast("double"), F.col("cnt").cast("double")
    sums = common.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy")
    )
    r = pearson(F.col("k"), *[F.col(c) for c in ("x", "y", "xx", "yy", "xy")])
    return sums.select(*by, F.col("k").alias("common_years"), F.when(F.col("k") >= 3, F.coalesce(r, F.lit(0.0)) if compat else r).alias("t5"))


def temporal_metrics(refs: DataFrame, baseline: DataFrame, as_of_year: int, by: list[str] = BY, on: list[str] | None = None) -> DataFrame:
    """(by, t1_span, t2_gap, t3_ratio, t4_gap, t5_corr, status), one row a paper.

    The references are summed to years once; all else reads those rows.
    """
    per = refs.groupBy(*by, "year").agg(F.count(F.lit(1)).alias("n"))
    known = per.where("year is not null")
    before = F.lag("year").over(Window.partitionBy(*by).orderBy("year"))
    spans = known.withColumn("gap", F.col("year") - before).groupBy(*by).agg(
        F.min("year").alias("lo"), (F.max("year") - F.min("year")).alias("t1_span"), F.coalesce(F.max("gap"), F.lit(0)).alias("t4_gap"),
        F.round(F.sum(F.when(F.col("year") >= as_of_year - 2, F.col("n")).otherwise(0)) / F.sum("n"), 3).alias("t3_ratio"),
    )
    first = baseline.where("cnt > 0")
    first = first.groupBy(*on).agg(F.min("year").alias("field")) if on else first.agg(F.min("year").alias("field"))
    joined = spans.join(first, on, "left") if on else spans.crossJoin(F.broadcast(first))  # the one row of a shared baseline
    fit = trend_alignment(known, baseline, by, on)
    papers = per.select(*by).distinct()
    return papers.join(joined, by, "left").join(fit, by, "left").select(
        *by, "t1_span", (F.col("lo") - F.col("field")).alias("t2_gap"), "t3_ratio", "t4_gap", F.round("t5", 3).alias("t5_corr"),
        F.when(F.col("t1_span").isNull(), "no_valid_years").otherwise("success").alias("status"),
    )


def trend_baseline(hits: DataFrame, years: tuple[int, int], by: list[str] | None = None) -> DataFrame:
    """(by, year, cnt): counts (by, source, year, cnt) summed over sources, with every year of the range."""
    by = by or []
    spark = hits.sparkSession
    grid = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
    keys = hits.select(*by).distinct().crossJoin(F.broadcast(grid)) if by else grid  # the years of the range, a parameter
    sums = hits.groupBy(*by, "year").agg(F.sum("cnt").alias("cnt"))
    return keys.join(sums, [*by, "year"], "left").select(*by, "year", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def keyword_baseline(hits: DataFrame, most: int = 3, by: list[str] = BY) -> DataFrame:
    """Yearly counts summed over the first ``most`` keywords (pos) of each paper."""
    return hits.where(F.col("pos") < most).groupBy(*by, "year").agg(F.sum("cnt").alias("cnt"))
