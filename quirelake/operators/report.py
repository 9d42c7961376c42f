"""Reports as Markdown, one row a paper: header, evidence, assessment, findings, paragraph distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators import evidence as E
from quirelake.operators.voting import grade, threshold_note

BY = ["paper_id"]

# Notes by threshold, and whether more is better.
NOTES = {
    "C3": ([(0.10, "Low orphan rate"), (0.20, ""), (0, "High orphan rate")], False),
    "C5": ([(0.90, "Strong verification"), (0.70, ""), (0, "Many unverified refs")], True),
    "C6": ([(0.9, "Auto-fail triggered"), (0.1, "Some contradictions"), (0.05, "Very few contradictions"), (0, "")], True),
    "T2": ([(2, "Covers foundational period"), (5, ""), (0, "May miss early work")], False),
    "T4": ([(1, "No significant gap"), (3, ""), (0, "Significant temporal gap")], False),
    "T5": ([(0.7, "Well-aligned with field"), (0.4, ""), (0, "Misaligned with field trend")], True),
    "G4": ([(0.7, "Strong coverage"), (0.4, ""), (0, "Many key papers missing")], True),
    "S5": ([(0.7, "Well-organized structure"), (0.4, ""), (0, "Weak structure-content alignment")], True),
    "G6": ([(0.10, "Low isolation"), (0.25, ""), (0, "Many isolated references")], False),
}


def in_order(lines: Column, *order: str) -> Column:
    """Lines of a group in order, one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, lines.alias("line")))), lambda x: x["line"]), "\n")


def header(overall: DataFrame) -> Column:
    return F.concat_ws("\n", F.lit("# Evaluation report"), F.concat(F.lit("**Source:** "), F.col("source_path")), F.concat(F.lit("**Overall score:** "), F.format_number("overall", 2), F.lit(" / 5.00")), F.concat(F.lit("**Grade:** "), grade(F.col("overall"))))


def metric_note(metric_id: Column, value: Column, compat: bool = False) -> Column:
    out = F.lit("")
    for name, (steps, higher) in NOTES.items():
        out = F.when(metric_id == name, threshold_note(value, steps, higher, compat)).otherwise(out)
    return out


def evidence_table(metrics: DataFrame, by: list[str] = BY, compat: bool = False) -> DataFrame:
    """(by, evidence) from (by, metric_id, value)."""
    shown = F.coalesce(F.format_number("value", 3), F.lit("N/A"))
    line = F.concat(F.lit("| "), F.col("metric_id"), F.lit(" | "), shown, F.lit(" | "), metric_note(F.col("metric_id"), F.col("value"), compat), F.lit(" |"))
    return metrics.groupBy(*by).agg(F.concat_ws("\n", F.lit("## Evidence"), F.lit("| Metric | Value | Note |\n|---|---|---|"), in_order(line, "metric_id")).alias("evidence"))


def with_details(dimensions: DataFrame, details: DataFrame | None, by: list[str] = BY) -> DataFrame:
    """``dimensions`` with _value, _supported, _sample and _examples of ``details`` (by, part, value, supported, sample, examples); part is the start of a sub_id."""
    if details is None:
        none = {"_value": "double", "_supported": "long", "_sample": "long", "_examples": "array<string>"}
        return dimensions.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    some = details.select(*by, F.col("part").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("value", "supported", "sample", "examples")])
    return dimensions.withColumn("_p", F.substring("sub_id", 1, 2)).join(some, [*by, "_p"], "left").drop("_p")


def assessment_table(dimensions: DataFrame, by: list[str] = BY, details: DataFrame | None = None) -> DataFrame:
    """(by, assessment) from (by, agent, sub_id, final_score, source, sd, reasoning); with ``details``, the evidence beside each score."""
    badge = F.when(F.col("sd") > 1, " (high variance)").otherwise("")
    beside = F.concat(F.lit(" "), E.evidence_line(F.col("sub_id"), F.col("_value"), F.col("_supported"), F.col("_sample")), F.lit(" |"))
    line = F.concat(F.lit("| "), F.col("agent"), F.lit(" | "), F.col("sub_id"), F.lit(" | "), F.format_number("final_score", 1), badge, F.lit(" | "), F.col("source"), F.lit(" |"), F.lit("") if details is None else beside)
    top = "| Agent | Dimension | Score | Source |\n|---|---|---|---|" if details is None else "| Agent | Dimension | Score | Source | Evidence |\n|---|---|---|---|---|"
    lowest = F.concat(F.lit("Lowest: "), F.min_by("sub_id", F.struct("final_score", "sub_id")))
    return with_details(dimensions, details, by).groupBy(*by).agg(F.concat_ws("\n", F.lit("## Assessment"), F.lit(top), in_order(line, "agent", "sub_id"), lowest).alias("assessment"))


def findings_text(dimensions: DataFrame, low: float = 3.5, high: float = 4.0, by: list[str] = BY, details: DataFrame | None = None) -> DataFrame:
    """(by, findings): low dimensions with advice, weakest first; then high ones with what supports them, strongest first."""
    score = F.format_number("final_score", 1)
    weak = F.col("final_score") < low
    text = F.when(weak, E.recommendation(F.col("sub_id"), F.col("_examples"), F.col("_value"))).otherwise(E.strength(F.col("sub_id"), F.col("_value")))
    line = F.concat(F.lit("- "), F.col("sub_id"), F.lit(" ("), score, F.lit("): "), text)
    rows = with_details(dimensions.where((F.col("final_score") < low) | (F.col("final_score") >= high)), details, by)
    rows = rows.withColumns({"_part": F.when(weak, 0).otherwise(1), "_rank": F.when(weak, F.col("final_score")).otherwise(-F.col("final_score"))})
    return rows.groupBy(*by).agg(F.concat_ws("\n", F.lit("## Key findings"), in_order(line, "_part", "_rank", "sub_id")).alias("findings"))


def paragraph_table(rollup: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, distribution) from a paragraph rollup."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), cell("paragraph_index"), F.lit(" | "), cell("citations"), F.lit(" | "), cell("uniq"), F.lit(" |"))
    return rollup.groupBy(*by).agg(F.concat_ws("\n", F.lit("## Citation distribution"), F.lit("| Paragraph | Citations | References |\n|---|---|---|"), in_order(line, "paragraph_index")).alias("distribution"))


def report(papers: DataFrame, metrics: DataFrame, dimensions: DataFrame, overall: DataFrame, by: list[str] = BY, details: DataFrame | None = None) -> DataFrame:
    """(by, report): the parts of every paper joined; a part without rows is left out. ``details`` as in ``with_details``."""
    rows = papers.join(overall, by, "left")
    rows = rows.withColumn("_head", header(rows))
    for part in (evidence_table(metrics, by), assessment_table(dimensions, by, details), findings_text(dimensions, by=by, details=details)):
        rows = rows.join(part, by, "left")
    return rows.select(*by, F.concat_ws("\n\n", "_head", "evidence", "assessment", "findings").alias("report"))


def run_summary(papers: DataFrame, metrics: DataFrame, dimensions: DataFrame, overall: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row a paper: metrics and scores as maps, overall score and grade."""
    as_map = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    m = metrics.where("value is not null").groupBy(*by).agg(as_map("metric_id", "value").alias("deterministic_metrics"))
    d = dimensions.groupBy(*by).agg(as_map("sub_id", "final_score").alias("dimension_scores"), F.count_if(F.col("source") == "corrected").alias("corrections"))
    return papers.join(m, by, "left").join(d, by, "left").join(overall, by, "left")


def shortened(columns: dict[str, str], most: int = 2000, listed: int = 3) -> dict[str, Column]:
    """For logs: texts cut to ``most`` characters, lists over five to their length and first rows. ``columns`` are name and type."""
    out: dict[str, Column] = {}
    for name, kind in columns.items():
        if kind == "string":
            out[name] = F.substring(name, 1, most)
        elif kind.startswith("array"):
            out[name] = F.when(F.size(name) > 5, F.to_json(F.struct(F.size(name).alias("length"), F.slice(name, 1, listed).alias("preview")))).otherwise(F.to_json(name))
    return out
