"""Evidence for judges: contexts of sub-dimensions, rubrics as text, evidence lines and advice of the report, and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

BY = ["paper_id"]

# Sentences of the report by the start of a sub-dimension's id.
ADVICE = {
    "V1": "Verify unverified references.", "V2": "Review citation-claim alignment.", "E1": "Review foundational coverage.", "E4": "Add comparative analysis, method limitations, and open questions.",
    "R1": "Improve temporal coverage.", "R2": "Balance information across sections.", "R3": "Improve structural organization.", "R4": "Review writing quality issues.",
}
OTHER_ADVICE, STRENGTH = "Review and improve this aspect.", "Good overall performance"
STRENGTHS = {"V4": "No internal contradictions detected", "E3": "Technical descriptions are accurate"}


def _lines(part: Column, *order: str | Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("_line")))), lambda x: x["_line"]), "\n")


def citation_check(text: Column, listed: Column | None = None) -> Column:
    """Struct of total_citations, unique_citations, cited_numbers and invalid_citations (cited but not ``listed``; none without a list)."""
    numbers = T.citation_numbers(text)
    invalid = F.array().cast("array<int>") if listed is None else F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, F.filter(numbers, lambda n: ~F.array_contains(listed, n))).otherwise(F.array().cast("array<int>"))
    return F.struct(
        F.size(numbers).alias("total_citations"), F.size(F.array_distinct(numbers)).alias("unique_citations"), numbers.alias("cited_numbers"), invalid.alias("invalid_citations"), F.lit(listed is not None).alias("has_reference_list")
    )


def bib_entries(rows: DataFrame) -> DataFrame:
    """Entries with trimmed texts (null as empty); an empty key gives way to the title."""
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    trimmed = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in texts})
    return trimmed.withColumn("key", F.coalesce(F.nullif(F.col("key"), F.lit("")), F.col("title")))


def metric_with_extra(evidence: Column, path: str, extra: list[str]) -> Column:
    """Struct of the number at a dotted path of a variant and, as ``extra``, a map of its siblings that are there."""
    parent = path.rpartition(".")[0]
    at = lambda name: F.try_variant_get(evidence, "$." + (f"{parent}." if parent else "") + name, "string")
    found = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*map(at, extra))), lambda _, v: v.isNotNull()) if extra else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.try_variant_get(evidence, f"$.{path}", "double").alias("value"), found.alias("extra"))


def agent_settings(agents: DataFrame, settings: DataFrame, default: str = "default") -> DataFrame:
    """(agent, ...): each agent's row of ``settings``, column by column the default's where it has none."""
    names = [c for c in settings.columns if c != "agent"]
    base = settings.where(F.col("agent") == default).select(*[F.col(c).alias(f"_d_{c}") for c in names]).limit(1)
    joined = agents.select("agent").join(settings, "agent", "left").join(F.broadcast(base), F.lit(True), "left")  # one row
    return joined.select("agent", *[F.coalesce(c, f"_d_{c}").alias(c) for c in names])


def section_table(paragraphs: DataFrame, citations: DataFrame, exclude: tuple[str, ...] = ("title", "abstract"), by: list[str] = BY) -> DataFrame:
    """(by, section_index, paragraph_count, citation_count, unique_references, paragraph_indices) of sections of other kinds, empty ones too."""
    kept = paragraphs.where(~F.coalesce(F.col("kind"), F.lit("")).isin(*exclude)).select(*by, "section_index").distinct()
    sums = citations.groupBy(*by, "section_index").agg(
        F.array_sort(F.collect_set("paragraph_index")).alias("paragraph_indices"), F.count(F.lit(1)).alias("citation_count"), F.count_distinct("ref_key").alias("unique_references")
    )
    rows = kept.join(sums, [*by, "section_index"], "left")
    indices = F.coalesce("paragraph_indices", F.array().cast(dict(sums.dtypes)["paragraph_indices"]))
    return rows.select(
        *by, "section_index", F.size(indices).alias("paragraph_count"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.coalesce("unique_references", F.lit(0)).alias("unique_references"), indices.alias("paragraph_indices")
    )


def block_font_size(spans: Column) -> Column:
    """Mean size of a block's spans; null without any."""
    return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + s["size"], lambda acc: acc / F.nullif(F.size(spans), F.lit(0)))


def heading_text(text: Column, font_size: Column, threshold: Column, candidates: Column) -> Column:
    """The heading that a block's text is, else null: large enough, of a heading's form, and a candidate where there are three or more of these."""
    heading = T.heading_text(text)
    known = (F.coalesce(F.size(candidates), F.lit(0)) < 3) | F.array_contains(candidates, heading)
    return F.when((threshold.isNull() | (font_size >= threshold)) & T.is_heading(heading) & known, heading)


def scaled_trend(trend: DataFrame, survey: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, year, scaled): a trend brought to the height of the survey's largest year."""
    top = survey.groupBy(*by).agg(F.max("cnt").alias("_top"))
    high = trend.groupBy(*by).agg(F.max("cnt").alias("_high")).join(top, by)
    return trend.join(high, by).select(*by, "year", F.coalesce(F.try_divide(F.col("cnt") * F.col("_top"), F.col("_high")), F.lit(0.0)).alias("scaled"))


def partial_verify_rate(validations: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, rate): the share of the validations made so far that are valid."""
    return validations.groupBy(*by).agg(F.avg(F.coalesce(F.col("is_valid"), F.lit(False)).cast("int")).alias("rate"))


def covered_candidates(candidates: DataFrame, missing: DataFrame, by: list[str] = BY) -> DataFrame:
    """Candidates whose title is not among the missing ones."""
    return candidates.join(missing.select(*by, "title"), [*by, "title"], "left_anti")


def first_queries(keywords: DataFrame, results: DataFrame, queries: int = 5, top: int = 10, by: list[str] = BY) -> DataFrame:
    """The first ``top`` results of each of a paper's first ``queries`` keywords."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    asked = keywords.withColumn("_k", rank(*by)).where(F.col("_k") <= queries).select(*by, "keyword")
    return results.join(asked, [*by, "keyword"], "left_semi").withColumn("_k", rank(*by, "keyword")).where(F.col("_k") <= top).drop("_k")


def shown_nodes(validations: DataFrame, refs: DataFrame, edges: DataFrame, most: int | None = None, by: list[str] = BY) -> DataFrame:
    """(by, id): keys of validations, of references and of edge ends, the first ``most`` of a paper in order."""
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("id"))
    ids = validations.select(*by, F.col("key").alias("id")).union(refs.select(*by, F.col("key").alias("id"))).union(ends).where("coalesce(id, '') <> ''").distinct()
    if most is None:
        return ids
    return ids.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_k") <= most).drop("_k")


def degrees_among(nodes: DataFrame, edges: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, id, in_deg, out_deg) over the edges both of whose ends are shown."""
    inside = edges.join(nodes.withColumnRenamed("id", "src"), [*by, "src"], "left_semi").join(nodes.withColumnRenamed("id", "dst"), [*by, "dst"], "left_semi")
    ends = inside.select(*by, F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(inside.select(*by, "dst", F.lit(1), F.lit(0)))
    sums = ends.groupBy(*by, "id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    return nodes.join(sums, [*by, "id"], "left").fillna(0, ["in_deg", "out_deg"])


def common_references(left: DataFrame, right: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, key): keys that both have."""
    return left.select(*by, "key").intersect(right.select(*by, "key"))


def required(value: Column, default: float = -1.0) -> Column:
    """The number, or ``default`` where it is missing or none."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default))


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one's where both have a key."""
    blank = F.coalesce
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    kept = F.map_filter(blank(left, empty), lambda k, _: ~F.array_contains(F.map_keys(blank(right, empty)), k))
    return F.map_concat(kept, blank(right, empty))


def rubric_text(rubrics: DataFrame, by: list[str] = ["agent"]) -> DataFrame:
    """(agent, rubric) from (agent, pos, sub_id, name, description, score, text): scores from the highest down."""
    line = F.concat(F.lit("- **"), F.col("score").cast("string"), F.lit("**: "), F.col("text"))
    parts = rubrics.groupBy(*by, "pos", "sub_id", "name", "description").agg(_lines(line, (-F.col("score")).alias("_o")).alias("scores"))
    part = F.concat(F.lit("### "), F.col("sub_id"), F.lit(": "), F.col("name"), F.lit("\n"), F.col("description"), F.lit("\n\n"), F.col("scores"), F.lit("\n"))
    return parts.groupBy(*by).agg(F.concat(F.lit("## Scoring Rubric\n\n"), _lines(part, "pos")).alias("rubric"))


def dispatch(reg: DataFrame, metrics: DataFrame, definitions: DataFrame, c6: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, agent, sub_id, name, metrics, preset): what each sub-dimension's judge gets, metrics as (metric_id, value, definition) in
    order; ``preset`` is the score that holds without a judge: 1 for V2 where C6 failed."""
    wanted = reg.select("agent", "sub_id", "name", F.explode_outer("metric_ids").alias("metric_id"))
    papers = c6.select(*by, "auto_fail")
    rows = papers.join(F.broadcast(wanted)).join(metrics, [*by, "metric_id"], "left").join(F.broadcast(definitions), "metric_id", "left")  # the registry's rows
    listed = F.filter(F.array_sort(F.collect_list(F.struct("metric_id", "value", "definition"))), lambda x: x["metric_id"].isNotNull())
    preset = F.when((F.col("sub_id") == "V2") & F.coalesce(F.col("auto_fail"), F.lit(False)), 1.0)
    return rows.groupBy(*by, "agent", "sub_id", "name", "auto_fail").agg(listed.alias("metrics")).select(*by, "agent", "sub_id", "name", "metrics", preset.alias("preset"))


def context_text(rows: DataFrame, most: int = 5) -> Column:
    """A judge's context as text, from sub_id, name, description, rubric, metrics, items (array of texts) and warnings; long lists show their first ``most``."""
    number = lambda v: F.coalesce(v.cast("string"), F.lit("None"))
    block = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(lines, "\n"), F.lit("\n")))
    metric = F.transform("metrics", lambda m: F.concat(F.lit("- "), m["metric_id"], F.lit(": "), number(m["value"]), F.lit(" ("), F.coalesce(m["definition"], F.lit("")), F.lit(")")))
    shown = F.transform(F.slice("items", 1, most), lambda i: F.concat(F.lit("  - "), i))
    items = F.when(F.size("items") > most, F.concat(F.array(F.concat(F.lit("- items: "), F.size("items").cast("string"), F.lit(f" items (showing first {most})"))), shown)).otherwise(
        F.when(F.size("items") > 0, F.array(F.concat(F.lit("- items: "), F.array_join("items", ", ")))).otherwise(F.array().cast("array<string>"))
    )
    rubric = F.when(F.coalesce(F.col("rubric"), F.lit("")) != "", F.concat(F.lit("## Rubric\n"), F.col("rubric"), F.lit("\n")))
    head = F.concat(F.lit("Sub-dimension: "), F.col("sub_id"), F.lit(" - "), F.col("name"), F.lit("\nDescription: "), F.coalesce("description", F.lit("")), F.lit("\n"))
    return F.concat_ws("\n", head, rubric, block("Evidence Metrics", metric), block("Supplementary Data", items), block("Warnings", F.transform("warnings", lambda w: F.concat(F.lit("- "), w))))


def combined_reasoning(votes: DataFrame, by: list[str] = BY, key: str = "sub_id") -> DataFrame:
    """(by, key, reasoning): the first within half a point of the median, else the first; with a note of all scores where there are several."""
    med = votes.groupBy(*by, key).agg(F.median("score").alias("_med"), F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("_all"), F.min_by("reasoning", "pos").alias("_first"))
    near = votes.join(med.select(*by, key, "_med"), [*by, key]).where(F.abs(F.col("score") - F.col("_med")) < 0.5).groupBy(*by, key).agg(F.min_by("reasoning", "pos").alias("_near"))
    scores = F.array_join(F.transform("_all", lambda x: x["score"].cast("string")), ", ")
    note = F.concat(F.lit("\n\n[Based on "), F.size("_all").cast("string"), F.lit(" model evaluations with majority voting. Scores: ["), scores, F.lit("]]"))
    base = F.coalesce("_near", "_first")
    return med.join(near, [*by, key], "left").select(*by, key, F.when(F.size("_all") > 1, F.concat(base, note)).otherwise(base).alias("reasoning"))


def evidence_line(sub_id: Column, value: Column, supported: Column, sample: Column) -> Column:
    """The evidence shown beside a score: a metric with two digits, or supported claims; N/A for none (0 counts as none)."""
    out = F.lit("N/A")
    for prefix, metric in (("V1", "C5"), ("E1", "G4"), ("E2", "S5"), ("R1", "T5"), ("R2", "S3"), ("R3", "S5")):
        out = F.when(F.contains(sub_id, F.lit(prefix)) & (F.coalesce(value, F.lit(0.0)) != 0), F.concat(F.lit(f"{metric}="), F.format_string("%.2f", value))).otherwise(out)
    both = (F.coalesce(sample, F.lit(0)) != 0) & (F.coalesce(supported, F.lit(0)) != 0)
    return F.when(F.contains(sub_id, F.lit("V2")) & both, F.format_string("%d/%d supported", supported, sample)).otherwise(out)


def recommendation(sub_id: Column, examples: Column, value: Column) -> Column:
    """Advice for a low sub-dimension; up to three examples (references, notes, titles) or the metric's value make it concrete."""
    out = F.lit(OTHER_ADVICE)
    for prefix, sentence in ADVICE.items():
        out = F.when(F.startswith(sub_id, F.lit(prefix)), sentence).otherwise(out)
    some = F.coalesce(F.size(examples), F.lit(0)) > 0
    cut = lambda n: F.array_join(F.transform(F.slice(examples, 1, 3), lambda e: F.substring(e, 1, n)), "; ")
    has = F.coalesce(value, F.lit(0.0)) != 0
    begins = lambda p: F.startswith(sub_id, F.lit(p))
    return (
        F.when(begins("V1") & some, F.concat(F.lit("Verify unverified references, particularly: "), F.array_join(F.slice(examples, 1, 3), ", ")))
        .when(begins("V2") & some, F.concat(F.lit("Review flagged citation-claim contradictions: "), cut(50)))
        .when(begins("E1") & some, F.concat(F.lit("Consider adding key papers: "), cut(30)))
        .when(begins("R1") & has, F.format_string("Improve temporal coverage; current trend alignment is T5=%.2f.", value))
        .when(begins("R2") & has, F.format_string("Balance citation distribution across sections (current Gini=%.2f).", value))
        .otherwise(out)
    )


def strength(sub_id: Column, value: Column) -> Column:
    """What supports a high sub-dimension."""
    out = F.lit(STRENGTH)
    for prefix, sentence in STRENGTHS.items():
        out = F.when(F.startswith(sub_id, F.lit(prefix)), sentence).otherwise(out)
    return (
        F.when(F.startswith(sub_id, F.lit("V1")) & (value >= 0.9), F.format_string("Strong verification rate (C5=%.2f)", value))
        .when(F.startswith(sub_id, F.lit("R1")) & (value >= 0.7), F.format_string("Well-aligned with field trend (T5=%.2f)", value))
        .otherwise(out)
    )


def low_verification(metrics: DataFrame, below: float = 0.3, by: list[str] = BY) -> DataFrame:
    """(by, value) of papers whose C5 is so low that references may be invented."""
    return metrics.where((F.col("metric_id") == "C5") & (F.col("value") < below)).select(*by, "value")


def reached_step(files: DataFrame, steps: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, step): the highest step whose file (steps: step, path) is there; 0 for none."""
    found = files.join(F.broadcast(steps), "path", "left")  # one row a step
    return found.groupBy(*by).agg(F.coalesce(F.max("step"), F.lit(0)).alias("step"))
