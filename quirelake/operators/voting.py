"""Scores: votes of several models, weighted dimensions, rubric rules, dispatch and debate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BY = ["paper_id"]

# Grades, the metrics, and the scored sub-dimensions with their risk, agent and evidence.
GRADES = ((4.25, "A"), (3.75, "B"), (3.25, "C"), (2.75, "D"))
AGENTS = {"verifier": "factuality", "expert": "academic_depth", "reader": "readability"}
SUB_DIMENSIONS = (
    ("V1", "verifier", "citation_existence", "low", ("C5",)),
    ("V2", "verifier", "citation_claim_alignment", "medium", ("C6",)),
    ("V4", "verifier", "internal_consistency", "high", ()),
    ("E1", "expert", "core_literature_coverage", "low", ("G4",)),
    ("E2", "expert", "method_classification", "medium", ("G5", "S5")),
    ("E3", "expert", "technical_accuracy", "high", ()),
    ("E4", "expert", "critical_analysis_depth", "high", ()),
    ("R1", "reader", "timeliness", "low", ("T1", "T2", "T3", "T4", "T5")),
    ("R2", "reader", "information_distribution", "medium", ("S2", "S3", "S5")),
    ("R3", "reader", "structural_clarity", "medium", ("S1", "S5")),
    ("R4", "reader", "writing_quality", "medium", ()),
)
METRICS = ("C3", "C5", "C6", "T1", "T2", "T3", "T4", "T5", "S1", "S2", "S3", "S4", "S5", "G1", "G2", "G3", "G4", "G5", "G6")


def registry(spark: SparkSession) -> DataFrame:
    """(pos, sub_id, agent, name, risk, metric_ids)."""
    return spark.createDataFrame([(i, *s[:4], list(s[4])) for i, s in enumerate(SUB_DIMENSIONS)], "pos int, sub_id string, agent string, name string, risk string, metric_ids array<string>")


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def threshold_note(value: Column, steps: list[tuple[float, str]], higher_is_better: bool = True, compat: bool = False) -> Column:
    """The note of the first threshold that the value meets, else the last note; N/A for null.

    Where lower is better, thresholds ascend and are met from below; ``compat`` meets them from above as listed.
    """
    out = F.lit(steps[-1][1])
    for at, note in reversed(steps):
        out = F.when((value >= at) if higher_is_better or compat else (value <= at), note).otherwise(out)
    return F.when(value.isNull(), "N/A").otherwise(out)


# Votes


def vote_stats(votes: DataFrame, by: list[str] = BY, key: str = "sub_id") -> DataFrame:
    """(by, key, n, med, sd, high_disagreement) of groups with two votes or more."""
    out = votes.groupBy(*by, key).agg(F.count("score").alias("n"), F.median("score").alias("med"), F.stddev_samp("score").alias("sd"), (F.max("score") - F.min("score")).alias("range"))
    return out.where("n >= 2").select(*by, key, "n", "med", "sd", ((F.col("sd") > 1) | (F.col("range") > 2)).alias("high_disagreement"))


def majority_vote(votes: DataFrame, by: list[str] = BY, key: str = "sub_id") -> DataFrame:
    """(by, key, mode_score): the most frequent rounded score (half to even), the first seen on ties."""
    per = votes.groupBy(*by, key, F.bround("score", 0).alias("s")).agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first"))
    return per.groupBy(*by, key).agg(F.max_by("s", F.struct("c", -F.col("first"))).alias("mode_score"))


def without_extremes(scores: Column) -> Column:
    """Of an array those within 1.5 interquartile ranges, quartiles at n // 4 and 3 n // 4; under 3 all."""
    s, n = F.array_sort(scores), F.size(scores)
    q1, q3 = F.get(s, F.floor(n / 4).cast("int")), F.get(s, F.floor(n * 3 / 4).cast("int"))
    iqr = q3 - q1
    return F.when(n < 3, scores).otherwise(F.filter(scores, lambda x: (x >= q1 - 1.5 * iqr) & (x <= q3 + 1.5 * iqr)))


def without_extremes_rows(votes: DataFrame, by: list[str] = BY, key: str = "sub_id") -> DataFrame:
    """Votes within the fence, the quartiles found as order statistics, so that no group is gathered."""
    n = votes.groupBy(*by, key).agg(F.count("score").alias("n"))
    ranked = votes.withColumn("i", F.row_number().over(Window.partitionBy(*by, key).orderBy("score")) - 1).join(n, [*by, key])
    q = ranked.groupBy(*by, key).agg(
        F.max(F.when(F.col("i") == F.floor(F.col("n") / 4), F.col("score"))).alias("q1"), F.max(F.when(F.col("i") == F.floor(F.col("n") * 3 / 4), F.col("score"))).alias("q3"), F.max("n").alias("n")
    )
    span = 1.5 * (F.col("q3") - F.col("q1"))
    return votes.join(q, [*by, key]).where((F.col("n") < 3) | F.col("score").between(F.col("q1") - span, F.col("q3") + span)).drop("q1", "q3", "n")


def vote_confidence(n: Column, sd: Column) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, 0.75).otherwise(F.greatest(F.lit(0.5), 1 - sd / 3))


def vote_variance(votes: DataFrame, by: list[str] = BY, key: str = "sub_id", how: str = "median") -> DataFrame:
    """(by, key, models, scores, center, std): the models used and their scores, in order."""
    center = F.median("score") if how == "median" else F.avg("score")
    listed = F.array_sort(F.collect_list(F.struct("pos", "model", "score")))
    return votes.groupBy(*by, key).agg(listed.alias("l"), center.alias("center"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std")).select(
        *by, key, F.transform("l", lambda x: x["model"]).alias("models"), F.transform("l", lambda x: x["score"]).alias("scores"), "center", "std"
    )


def combined_vote(votes: DataFrame, by: list[str] = BY, key: str = "sub_id") -> DataFrame:
    """(by, key, score, confidence): the mean of mode and median after the fence."""
    kept = without_extremes_rows(votes, by, key)
    stats = kept.groupBy(*by, key).agg(F.median("score").alias("med"), F.count(F.lit(1)).alias("n"), F.stddev_samp("score").alias("sd"))
    return stats.join(majority_vote(kept, by, key), [*by, key]).select(*by, key, ((F.col("mode_score") + F.col("med")) / 2).alias("score"), vote_confidence(F.col("n"), F.col("sd")).alias("confidence"))


def near_reasoning(votes: DataFrame, by: list[str] = BY, key: str = "sub_id") -> DataFrame:
    """(by, key, reasoning): of the first model within 0.5 of the median."""
    med = votes.groupBy(*by, key).agg(F.median("score").alias("med"))
    return votes.join(med, [*by, key]).where(F.abs(F.col("score") - F.col("med")) <= 0.5).groupBy(*by, key).agg(F.min_by("reasoning", "pos").alias("reasoning"))


# Dispatch


def targets(reg: DataFrame, auto_fail: DataFrame | None = None, by: list[str] = BY) -> DataFrame:
    """Sub-dimensions that models vote on: risk medium or high; V2 is low where C6 failed."""
    rows = reg if auto_fail is None else auto_fail.select(*by, "auto_fail").join(F.broadcast(reg))  # the registry, eleven rows
    risk = F.col("risk") if auto_fail is None else F.when((F.col("sub_id") == "V2") & F.col("auto_fail"), "low").otherwise(F.col("risk"))
    return rows.withColumn("risk", risk).withColumn("votes", F.col("risk").isin("medium", "high"))


def metric_lineage(reg: DataFrame) -> DataFrame:
    """(metric_id, consumer)."""
    return reg.select(F.explode("metric_ids").alias("metric_id"), F.col("sub_id").alias("consumer"))


def sub_dimension_context(reg: DataFrame, metrics: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, agent, sub_id, metrics): each sub-dimension's metric values as a map."""
    lineage = reg.select("agent", "sub_id", "pos", F.explode("metric_ids").alias("metric_id"))
    rows = metrics.join(F.broadcast(lineage), "metric_id")  # one row for each metric of the registry
    return rows.groupBy(*by, "agent", "sub_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "value")))).alias("metrics"))


def metric_paths(evidence: Column, paths: dict[str, str]) -> Column:
    """Dotted paths of a variant as a map of doubles; a missing step is null."""
    return F.map_from_arrays(F.array(*map(F.lit, paths)), F.array(*[F.try_variant_get(evidence, f"$.{p}", "double") for p in paths.values()]))


def step_score(value: Column, steps: tuple[float, ...], higher: bool = True) -> Column:
    """5, 4, 3, 2 by the first step met, else 1; null for null."""
    out = F.lit(1.0)
    for points, at in reversed(list(zip((5.0, 4.0, 3.0, 2.0), steps, strict=False))):
        out = F.when((value >= at) if higher else (value < at), points).otherwise(out)
    return F.when(value.isNotNull(), out)


def rubric_scores(metrics: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, sub_id, score) of the sub-dimensions that rules can score, from columns c5, c6_rate, c6_auto_fail, g4, t2, t4, t5, s5."""
    c = F.col
    v2 = F.when(c("c6_auto_fail"), 1.0).otherwise(step_score(c("c6_rate"), (0.01, 0.02, 0.03, 0.05), higher=False))
    r1 = (
        F.when(c("t5").isNull(), F.lit(None).cast("double")).when((c("t5") >= 0.7) & (c("t2") <= 2) & (c("t4") <= 1), 5.0).when((c("t5") >= 0.5) & (c("t4") <= 2), 4.0)
        .when((c("t5") >= 0.3) & (c("t4") < 3), 3.0).otherwise(2.0)
    )
    r3 = F.when(c("s5").isNotNull(), F.when(c("s5") >= 0.7, 5.0).when(c("s5") >= 0.5, 4.0).otherwise(3.0))
    scores = {"V1": step_score(c("c5"), (0.95, 0.85, 0.7, 0.5)), "V2": v2, "E1": step_score(c("g4"), (0.8, 0.6, 0.4, 0.2)), "R1": r1, "R3": r3}
    rows = F.array(*[F.struct(F.lit(k).alias("sub_id"), v.cast("double").alias("score")) for k, v in scores.items()])
    return metrics.select(*by, F.explode(rows).alias("s")).select(*by, "s.sub_id", "s.score").where("score is not null")


def evidence_warnings(metrics: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, agent, code) from columns c5, c6_auto_fail, g4, g6, t4, t5."""
    rule = lambda agent, code, test: F.when(test, F.struct(F.lit(agent).alias("agent"), F.lit(code).alias("code")))
    rules = F.array_compact(F.array(
        rule("verifier", "C5_LOW", F.col("c5") < 0.7), rule("verifier", "C6_AUTO_FAIL", F.col("c6_auto_fail")), rule("expert", "G4_LOW", F.col("g4") < 0.6),
        rule("expert", "G6_ISOLATES", F.col("g6") > 5), rule("reader", "T4_GAP", F.col("t4") >= 3), rule("reader", "T5_LOW", F.col("t5") < 0.3),
    ))
    return metrics.select(*by, F.explode(rules).alias("w")).select(*by, "w.agent", "w.code")


# Aggregation


def corrected(sub_scores: DataFrame, corrections: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, agent, sub_id, final_score, source): the correction where there is one."""
    fixed = corrections.select(*by, "sub_id", "corrected_score")
    return sub_scores.join(fixed, [*by, "sub_id"], "left").withColumn("final_score", F.coalesce("corrected_score", "score")).withColumn(
        "source", F.when(F.col("corrected_score").isNotNull(), "corrected").otherwise("original")
    )


def weighted_overall(dimensions: DataFrame, weights: DataFrame | None = None, by: list[str] = BY) -> DataFrame:
    """(by, overall, grade): sum(score * weight) / sum(weight), 2 places; a weight's name may be the id or the id and a name (``V1_...``); 1 where none is given."""
    rows = dimensions
    if weights is not None:
        short = weights.select(F.substring_index("sub_id", "_", 1).alias("sub_id"), F.col("weight").alias("_w"))
        rows = rows.join(F.broadcast(short), "sub_id", "left")  # one row for each sub-dimension
    else:
        rows = rows.withColumn("_w", F.lit(None).cast("double"))
    w = F.coalesce("_w", F.lit(1.0))
    out = rows.groupBy(*by).agg(F.round(F.sum(F.col("final_score") * w) / F.sum(w), 2).alias("overall"))
    return out.withColumn("grade", grade(F.col("overall")))


def legacy_dimensions(evaluations: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, dimension, wmean, mean, med, mn, mx, sd, confidence): the confidence-weighted mean, the plain one where all are 0."""
    s, c = F.col("score"), F.col("confidence")
    return evaluations.groupBy(*by, "dimension").agg(
        F.coalesce(F.try_divide(F.sum(s * c), F.sum(c)), F.avg(s)).alias("wmean"), F.avg(s).alias("mean"), F.median(s).alias("med"), F.min(s).alias("mn"), F.max(s).alias("mx"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sd"), F.avg(c).alias("confidence"),
    )


def legacy_overall(dimensions: DataFrame, by: list[str] = BY) -> DataFrame:
    return dimensions.groupBy(*by).agg(F.avg("wmean").alias("overall"), F.coalesce(F.stddev_samp("wmean"), F.lit(0.0)).alias("sd"), (F.max("wmean") - F.min("wmean")).alias("range"))


def debate_needed(evaluations: DataFrame, by: list[str] = BY, most: float = 2.0) -> DataFrame:
    """(by, dimension, range, conflict): two scores or more that differ by over ``most``."""
    return evaluations.groupBy(*by, "dimension").agg((F.max("score") - F.min("score")).alias("range"), F.count("score").alias("_n")).select(
        *by, "dimension", "range", ((F.col("_n") >= 2) & (F.col("range") > most)).alias("conflict")
    )


def debate_messages(evaluations: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, dimension, message) of dimensions in conflict; papers without any are in consensus and have no row."""
    rows = debate_needed(evaluations, by).where("conflict")
    return rows.select(*by, "dimension", F.format_string("Scores for %s differ by %.1f", "dimension", "range").alias("message"))


def next_step(evaluations: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, step): ``debate`` where any dimension is in conflict, else ``END``."""
    return debate_needed(evaluations, by).groupBy(*by).agg(F.when(F.bool_or("conflict"), "debate").otherwise("END").alias("step"))


def agent_overall(sub_scores: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, agent, overall, confidence): mean of sub-scores, 3 without any; confidence 0.7 where a model took part."""
    return sub_scores.groupBy(*by, "agent").agg(F.coalesce(F.avg("score"), F.lit(3.0)).alias("overall"), F.when(F.bool_or("llm_involved"), 0.7).otherwise(1.0).alias("confidence"))


def lowest_per_agent(sub_scores: DataFrame, by: list[str] = BY) -> DataFrame:
    return sub_scores.groupBy(*by, "agent").agg(F.min_by("sub_id", F.struct("score", "sub_id")).alias("sub_id"), F.min("score").alias("score"))


def findings(dimensions: DataFrame, low: float = 3.5, high: float = 4.0) -> DataFrame:
    """Dimensions under ``low`` and from ``high`` on, with ``kind``."""
    kind = F.when(F.col("final_score") < low, "low").when(F.col("final_score") >= high, "high")
    return dimensions.withColumn("kind", kind).where("kind is not null")


def alerts(dimensions: DataFrame) -> DataFrame:
    """Overview alerts: low, high, and corrections by 2 or more."""
    moved = F.abs(F.col("corrected_score") - F.col("score")) >= 2
    kinds = F.array_compact(F.array(F.when(F.col("final_score") < 3, "low"), F.when(F.col("final_score") >= 4, "high"), F.when(moved, "corrected"), F.when(F.coalesce(F.col("high_disagreement"), F.lit(False)), "disagreement")))
    return dimensions.withColumn("alert", F.explode(kinds))


def radar(dimensions: DataFrame, reg: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, scores): eleven scores in the registry's order, 0 where missing."""
    papers = dimensions.select(*by).distinct()
    rows = papers.join(F.broadcast(reg.select("pos", "sub_id"))).join(dimensions.select(*by, "sub_id", "final_score"), [*by, "sub_id"], "left")  # eleven rows
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("final_score", F.lit(0.0)).alias("s"))))
    return rows.groupBy(*by).agg(F.transform(listed, lambda x: x["s"]).alias("scores"))


def deterministic_metrics(metrics: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, metric_id, value) of the registered metrics that have a value; G6 as a share of all references."""
    value = F.when(F.col("metric_id") == "G6", F.try_divide(F.col("value"), F.col("total_refs"))).otherwise(F.col("value"))
    return metrics.where(F.col("metric_id").isin(*METRICS)).select(*by, "metric_id", value.alias("value")).where("value is not null")
