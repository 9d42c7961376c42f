"""The evaluation in one place: extract, link, verify, measure, score, report, for all papers of a job.

Each step takes and returns DataFrames; nothing runs before a result is written or collected, but for
the sizes that the graph operators count.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.config import Config, GraphConfig
from quirelake.functions import text as T
from quirelake.operators import coverage as C
from quirelake.operators import evidence as E
from quirelake.operators import graph as G
from quirelake.operators import judging as J
from quirelake.operators import linkage as L
from quirelake.operators import paragraphs as P
from quirelake.operators import report as R
from quirelake.operators import temporal as Y
from quirelake.operators import voting as V
from quirelake.sources import readers as S

BY = ["paper_id"]


@dataclass
class Extraction:
    parts: DataFrame
    sections: DataFrame
    citations: DataFrame
    references: DataFrame


def extract(papers: DataFrame) -> Extraction:
    """Sections, citations and references of papers (paper_id, text); citations are linked, and the reference list itself holds none.

    References and citations are each read from the text and written once, as linking takes both several times."""
    parts = S.paragraphs(papers)
    references = G._cut(L.normalised_references(S.references(papers)), "references")
    body = G._cut(S.citations(parts.where(F.coalesce(T.section_kind(F.col("section_title")), F.lit("main")) != "references")), "citations")
    return Extraction(parts, S.sections(parts), link(body, references), references)


def link(citations: DataFrame, references: DataFrame, compat: bool = False) -> DataFrame:
    """Citations with ref_key and ref_candidates: numbers by number, names by name and year."""
    numeric = L.link_numeric(citations.where("kind = 'numeric'"), references).withColumn("ref_candidates", F.array_compact(F.array("ref_key")))
    named = L.link_author_year(citations.where("kind = 'author_year'"), references, compat=compat)
    return numeric.unionByName(named, allowMissingColumns=True)


def verify(references: DataFrame, metadata: DataFrame, priority: DataFrame, fold=T.ascii_fold) -> DataFrame:
    """References with is_valid, confidence and the comparison against the best metadata row of each."""
    compared = L.verify(L.to_verify(references), metadata, priority, fold=fold)
    found = compared.select(*BY, "key", "source", "comparison", F.col("comparison.is_match").alias("is_valid"), F.col("comparison.confidence").alias("confidence"))
    return references.drop("source", "comparison", "is_valid", "confidence").join(found, [*BY, "key"], "left")


def temporal(references: DataFrame, baseline: DataFrame, as_of_year: int) -> DataFrame:
    return Y.temporal_metrics(references.withColumn("year", T.year_int(F.col("year"))), baseline, as_of_year)


def structural(extraction: Extraction) -> DataFrame:
    """S1 to S4 over the sections of kinds other than title, abstract and references."""
    sections = P.without_kinds(extraction.sections)
    kinds = extraction.sections.select(*BY, "section_index", "kind")
    cited = P.without_kinds(extraction.citations.drop("kind").join(kinds, [*BY, "section_index"], "left")).withColumn("section", F.col("section_title"))
    paragraphs = extraction.parts.where("not is_heading").groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))
    return P.structural_metrics(sections.withColumn("section", F.col("section_title")), P.section_counts(cited), paragraphs)


@dataclass
class GraphReport:
    nodes: DataFrame
    edges: DataFrame
    degrees: DataFrame
    ranks: DataFrame
    components: DataFrame
    clusters: DataFrame
    stats: DataFrame
    warnings: DataFrame


def analyze_graph(references: DataFrame, edges: DataFrame, as_of_year: int, config: GraphConfig | None = None, canonical: DataFrame | None = None) -> GraphReport:
    """Nodes, edges and measures of every paper's graph, from references (paper_id, key, year) and edges (paper_id, src, dst)."""
    config = config or GraphConfig()
    nodes = G.canonical_nodes(references, canonical)
    kept, resolution = G.resolve_edges(edges, nodes, canonical)
    deg = G.degrees(nodes, kept)
    ranks = G.pagerank(nodes, kept, config.damping, config.rounds)
    comps = G.weak_components(nodes, kept)
    if config.clustering == "authority":
        clusters = G.authority_clusters(nodes, kept, deg, ranks, k_max=config.top_clusters)
    elif config.clustering == "louvain":
        clusters = G.louvain_clusters(nodes, kept, config.seed)
    elif config.clustering == "spectral":
        clusters = G.spectral_clusters(nodes, kept, config.top_clusters, config.seed)
    elif config.clustering == "cocitation":
        found = G.cocitation_clusters(nodes, kept, config.cocitation_threshold)
        clusters = G.renumbered(found.withColumnRenamed("component", "cluster"))
    else:
        raise ValueError(f"unknown clustering {config.clustering!r}")
    counted = comps.groupBy(*BY, "component").agg(F.count(F.lit(1)).alias("size")).groupBy(*BY).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("lcc"))
    lag, recent = G.citation_lag(kept, nodes), G.recency(nodes, as_of_year, config.recency_windows)
    core = G.top_k(ranks, "pr", config.core).select(*BY, "id").join(nodes, [*BY, "id"])
    core = G.recency(core, as_of_year).select(*BY, F.col("r2").alias("core_r2"), F.col("r5").alias("core_r5"))
    stats = (
        G.density(deg).join(counted, BY, "left").join(resolution.select(*BY, F.col("ratio").alias("unresolved_ratio")), BY, "left")
        .join(lag.select(*BY, F.col("p50").alias("lag_p50"), F.col("p90").alias("lag_p90"), "neg_ratio"), BY, "left").join(recent, BY, "left").join(core, BY, "left")
        .withColumn("betweenness_done", F.lit(config.compute_betweenness)).withColumn("lcc_fraction", F.try_divide(F.col("lcc"), F.col("n")))
    )
    return GraphReport(nodes, kept, deg, ranks, comps, clusters, stats, G.graph_warnings(stats))


def section_alignment(extraction: Extraction, clusters: DataFrame, compat: bool = False) -> DataFrame:
    """S5: agreement of the sections that cite references with the clusters that hold them."""
    counts = P.section_counts(extraction.citations.withColumn("section", F.col("section_title")))
    sections = G.section_of_reference(counts, compat=compat)
    labels = sections.join(clusters.select(*BY, F.col("id").alias("ref_key"), "cluster"), [*BY, "ref_key"])
    return G.label_agreement(labels, "section", "cluster")


def coverage(candidates: DataFrame, references: DataFrame, threshold: float = 0.85, method: str = "ratio") -> tuple[DataFrame, DataFrame]:
    """G4: matched candidates, and the rate a paper."""
    kept = C.first_titles(candidates, ["pos"])
    matched = C.match_candidates(kept, references, threshold, method)
    return matched, C.coverage(matched)


def metrics(extraction: Extraction, times: DataFrame, structure: DataFrame, graph: GraphReport, alignment: DataFrame, judged: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """(paper_id, c3, c5, c6_rate, c6_auto_fail, t1, ..., s5, g1, ..., g6): one row a paper, null where not computed."""
    refs = extraction.references
    rows = refs.select(*BY).distinct()
    rows = rows.join(P.orphan_rate(refs, extraction.citations).select(*BY, F.col("rate").alias("c3")), BY, "left")
    c5 = P.verify_rate(refs).select(*BY, F.col("rate").alias("c5")) if "is_valid" in refs.columns else rows.select(*BY).withColumn("c5", F.lit(None).cast("double"))
    rows = rows.join(c5, BY, "left")
    null = F.lit(None).cast("double")
    if judged is None:
        rows = rows.withColumns({"c6_rate": null, "c6_auto_fail": F.lit(False)})
    else:
        rows = rows.join(judged.select(*BY, F.col("contradiction_rate").alias("c6_rate"), F.col("auto_fail").alias("c6_auto_fail")), BY, "left")
    rows = rows.join(times.select(*BY, F.col("t1_span").alias("t1"), F.col("t2_gap").alias("t2"), F.col("t3_ratio").alias("t3"), F.col("t4_gap").alias("t4"), F.col("t5_corr").alias("t5")), BY, "left")
    rows = rows.join(structure.select(*BY, "s1", "s2", F.col("s3_gini").alias("s3"), "s4"), BY, "left").join(alignment.select(*BY, F.col("nmi").alias("s5")), BY, "left")
    g = graph.stats.select(*BY, F.col("density").alias("g1"), F.col("components").alias("g2"), F.col("lcc_fraction").alias("g3"), F.col("isolates").alias("g6"), F.try_divide(F.col("isolates"), F.col("n")).alias("g6_ratio"))
    clusters = graph.clusters.where("cluster is not null").groupBy(*BY).agg(F.count_distinct("cluster").alias("g5"))
    rows = rows.join(g, BY, "left").join(clusters, BY, "left")
    return rows.withColumn("g4", null) if covered is None else rows.join(covered.select(*BY, F.col("rate").alias("g4")), BY, "left")


def long_metrics(wide: DataFrame) -> DataFrame:
    """(paper_id, metric_id, value)."""
    names = [c for c in wide.columns if c not in (*BY, "c6_auto_fail", "g6_ratio")]
    rows = F.array(*[F.struct(F.lit(c.split("_")[0].upper()).alias("metric_id"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(*BY, F.explode(rows).alias("m")).select(*BY, "m.metric_id", "m.value")


def score(wide: DataFrame, votes: DataFrame | None = None, config: Config | None = None, judge: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(paper_id, agent, sub_id, final_score, source, sd, reasoning), and (paper_id, overall, grade).

    Rules score what they can; votes (paper_id, sub_id, model, pos, score) of at least two models correct the other
    sub-dimensions, by their median. ``judge`` may score the rest as a Column over the registry's rows.
    """
    config = config or Config()
    spark = wide.sparkSession
    reg = V.registry(spark)
    ruled = V.rubric_scores(wide)
    every = wide.select(*BY, "c6_auto_fail").join(F.broadcast(reg))  # the registry's eleven rows
    base = every.join(ruled, [*BY, "sub_id"], "left")
    if judge is not None:
        base = base.withColumn("score", F.coalesce("score", judge))
    stats = V.vote_stats(votes) if votes is not None else ruled.where("false").select(*BY, "sub_id", F.lit(None).cast("double").alias("med"), F.lit(None).cast("double").alias("sd"))
    voted = V.targets(reg, wide.select(*BY, F.col("c6_auto_fail").alias("auto_fail"))).where("votes").select(*BY, "sub_id")
    fixed = stats.join(voted, [*BY, "sub_id"], "left_semi").select(*BY, "sub_id", F.col("med").alias("corrected_score"), "sd")
    out = base.join(fixed, [*BY, "sub_id"], "left").withColumn("final_score", F.coalesce("corrected_score", "score")).where("final_score is not null")
    out = out.withColumns({"source": F.when(F.col("corrected_score").isNotNull(), "corrected").otherwise("original"), "sd": F.coalesce("sd", F.lit(0.0)), "reasoning": F.lit("")})
    dims = out.select(*BY, "agent", "sub_id", "final_score", "source", "sd", "reasoning", "score", "corrected_score", "risk")
    return dims, V.weighted_overall(dims, config.weight_table(spark) if config.weights else None)


def details(references: DataFrame, wide: DataFrame, matched: DataFrame | None = None, judgments: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(paper_id, part, value, supported, sample, examples) beside the scores: V1 with C5 and references that weren't verified, V2 with
    judged pairs and notes of contradictions, E1 with G4 and key papers that are missing, E2 and R3 with S5, R1 with T5, R2 with S3."""
    texts = lambda rows, text, order: rows.groupBy(*BY).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, text))), 1, most), lambda x: x[text]).alias("examples"))
    named = [("V1", texts(references.where("not is_valid"), "key", "pos"))] if "is_valid" in references.columns else []
    if matched is not None:
        named.append(("E1", texts(matched.where("ref_key is null"), "title", "pos")))
    if judgments is not None:
        named.append(("V2", texts(judgments.where("judgment = 'contradict'"), "note", "pos")))
    rows = F.array(*[F.struct(F.lit(part).alias("part"), F.col(c).cast("double").alias("value")) for part, c in (("V1", "c5"), ("V2", "c6_rate"), ("E1", "g4"), ("E2", "s5"), ("R1", "t5"), ("R2", "s3"), ("R3", "s5"))])
    out = wide.select(*BY, F.explode(rows).alias("d")).select(*BY, "d.part", "d.value")
    if judgments is None:
        out = out.withColumns({"supported": F.lit(None).cast("long"), "sample": F.lit(None).cast("long")})
    else:
        counts = judgments.groupBy(*BY).agg(F.count_if(F.col("judgment") == "support").alias("supported"), F.count(F.lit(1)).alias("sample")).withColumn("part", F.lit("V2"))
        out = out.join(counts, [*BY, "part"], "left")
    if not named:
        return out.withColumn("examples", F.lit(None).cast("array<string>"))
    examples = reduce(DataFrame.unionByName, [rows.withColumn("part", F.lit(part)) for part, rows in named])
    return out.join(examples, [*BY, "part"], "left")


def report(papers: DataFrame, wide: DataFrame, dimensions: DataFrame, overall: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """(paper_id, report); G6 is shown as a share."""
    shown = long_metrics(wide.withColumn("g6", F.coalesce("g6_ratio", F.col("g6"))))
    return R.report(papers.select(*BY, "source_path"), shown, dimensions, overall, details=beside)


def contexts(wide: DataFrame, beside: DataFrame, definitions: DataFrame) -> DataFrame:
    """(paper_id, agent, sub_id, context, preset): the text that a judge of each sub-dimension gets. ``definitions`` (metric_id, definition) are the registry's."""
    spark = wide.sparkSession
    rows = E.dispatch(V.registry(spark), long_metrics(wide), definitions, wide.select(*BY, F.col("c6_auto_fail").alias("auto_fail")), BY)
    warned = V.evidence_warnings(wide).groupBy(*BY, "agent").agg(F.sort_array(F.collect_list("code")).alias("warnings"))
    rows = rows.join(warned, [*BY, "agent"], "left").withColumn("part", F.substring("sub_id", 1, 2)).join(beside.select(*BY, "part", F.col("examples").alias("items")), [*BY, "part"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"description": F.lit(""), "rubric": F.lit(""), "warnings": F.coalesce("warnings", none), "items": F.coalesce("items", none)})
    return rows.select(*BY, "agent", "sub_id", E.context_text(rows).alias("context"), "preset")


@dataclass
class Evaluation:
    extraction: Extraction
    graph: GraphReport
    metrics: DataFrame
    votes: DataFrame | None
    dimensions: DataFrame
    overall: DataFrame
    reports: DataFrame


def evaluate(
    papers: DataFrame, as_of_year: int, metadata: DataFrame | None = None, baseline: DataFrame | None = None, targets: DataFrame | None = None, candidates: DataFrame | None = None,
    judgments: DataFrame | None = None, models: list[str] | None = None, judge: J.Judge | None = None, definitions: DataFrame | None = None, config: Config | None = None,
) -> Evaluation:
    """Papers (paper_id, source_path, text) in, a report for each out.

    ``metadata`` (paper_id, key, source, pos, title, authors, year) verifies references, ``baseline`` (year, cnt) is the field's trend,
    ``targets`` (paper_id, source, target_id, tokens) say whom references cite, ``candidates`` (paper_id, pos, title, doi) are key
    papers, ``judgments`` (paper_id, pos, judgment, note) those of cited claims; what isn't given is null in the metrics. ``judge`` is
    asked by every one of ``models`` for each sub-dimension that rules leave open. References, citations, graph measures, metrics and
    votes are written once, so that no plan holds more than one step.
    """
    config = config or Config()
    spark = papers.sparkSession
    found = extract(papers)
    references = found.references
    if metadata is not None:
        priority = spark.createDataFrame([(s.name, s.priority) for s in config.sources], "source string, priority int")
        checked = L.verify(L.to_verify(references, config.verify_limit), metadata, priority)
        checked = checked.select(*BY, "key", "source", "comparison", F.col("comparison.is_match").alias("is_valid"), F.col("comparison.confidence").alias("confidence"))
        references = references.drop("source", "comparison", "is_valid", "confidence").join(checked, [*BY, "key"], "left")
    found = Extraction(*[G._cut(rows, name) for rows, name in ((found.parts, "parts"), (found.sections, "sections"), (found.citations, "citations"), (references, "references"))])
    none = lambda schema: spark.createDataFrame([], schema)
    times = G._cut(temporal(found.references, none("year int, cnt long") if baseline is None else baseline, as_of_year), "times")
    edges = none("paper_id string, src string, dst string")
    if targets is not None:
        ids = F.struct("doi", "arxiv_id", F.lit("").alias("openalex_id"), F.lit("").alias("semantic_scholar_id"))
        edges = L.real_edges(found.references.select(*BY, "key", T.identity_tokens(ids).alias("tokens")), targets)[0]
    graph = analyze_graph(found.references.withColumn("year", T.year_int(F.col("year"))), G._cut(edges, "edges"), as_of_year, config.graph)
    graph = replace(graph, clusters=G._cut(graph.clusters, "clusters"), stats=G._cut(graph.stats, "stats"))
    matched = covered = None
    if candidates is not None:
        matched, covered = coverage(candidates, found.references, config.coverage_threshold)
        matched = G._cut(matched, "matched")
        covered = C.coverage(matched)
    judged = None if judgments is None else P.alignment_rates(judgments, config.contradiction_threshold)
    wide = G._cut(metrics(found, times, structural(found), graph, section_alignment(found, graph.clusters), judged, covered), "metrics")
    beside = details(found.references, wide, matched, judgments)
    votes = None
    if judge is not None and models:
        asked = V.targets(V.registry(spark), wide.select(*BY, F.col("c6_auto_fail").alias("auto_fail"))).where("votes").select(*BY, "sub_id")
        texts = contexts(wide, beside, none("metric_id string, definition string") if definitions is None else definitions).where("preset is null")
        votes = G._cut(J.judge_votes(texts.drop("preset").join(asked, [*BY, "sub_id"], "left_semi"), models, judge), "votes")
    dimensions, overall = score(wide, votes, config)
    dimensions = G._cut(dimensions, "dimensions")
    overall = V.weighted_overall(dimensions, config.weight_table(spark) if config.weights else None)
    return Evaluation(found, graph, wide, votes, dimensions, overall, report(papers, wide, dimensions, overall, beside))
