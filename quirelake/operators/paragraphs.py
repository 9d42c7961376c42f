"""Where citations stand: sections, paragraphs, their overlap, and the structural metrics S1 to S4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.graph import _cut, _once, exchanged

BY = ["paper_id"]
EXCLUDED = ("title", "abstract", "references")


def without_kinds(rows: DataFrame, kinds: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Rows whose section kind is not among ``kinds``; a null kind stays."""
    return rows.where(F.col("kind").isNull() | ~F.col("kind").isin(*kinds))


def section_counts(citations: DataFrame, by: list[str] = BY, compat: bool = False) -> DataFrame:
    """(by, section, ref_key, cnt); ``compat`` keeps null keys and sections as groups."""
    rows = citations if compat else citations.where("ref_key is not null and section is not null")
    return rows.groupBy(*by, "section", "ref_key").agg(F.count(F.lit(1)).alias("cnt"))


def gini(values: DataFrame, value: str, by: list[str] = BY) -> DataFrame:
    """(by, gini) of positive values, in [0, 1]; 0 without any."""
    kept = values.where(F.col(value) > 0)
    ranked = kept.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    n, total = F.count(F.lit(1)), F.sum(F.col(value).cast("double"))
    raw = 2 * F.sum(F.col("_i") * F.col(value)) / (n * total) - (n + 1) / n
    found = ranked.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("gini"))
    return values.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("gini", F.lit(0.0)).alias("gini"))


def structural_metrics(sections: DataFrame, counts: DataFrame, paragraphs: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, s1, s2, s3_gini, s4): sections, citations a paragraph, Gini of section totals, share of sections without citation.

    ``sections`` (by, section) are all of them, ``counts`` (by, section, ref_key, cnt), ``paragraphs`` (by, n).
    """
    totals = counts.groupBy(*by, "section").agg(F.sum("cnt").alias("total"))
    all_ = sections.select(*by, "section").distinct().join(totals, [*by, "section"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    rates = all_.groupBy(*by).agg(F.count(F.lit(1)).alias("s1"), F.sum("total").alias("c"), F.avg((F.col("total") == 0).cast("int")).alias("s4"))
    return rates.join(gini(all_, "total", by), by).join(paragraphs, by, "left").select(
        *by, "s1", F.round(F.coalesce(F.try_divide(F.col("c"), F.col("n")), F.lit(0.0)), 3).alias("s2"), F.round("gini", 3).alias("s3_gini"), F.round("s4", 3).alias("s4")
    )


def paragraph_rollup(citations: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row a paragraph: linked and missing citations, distinct references, validity, lines and pages."""
    valid = F.col("is_valid")
    return citations.groupBy(*by, "paragraph_index").agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(F.col("ref_key").isNotNull()).alias("linked"), F.count_if(F.col("ref_key").isNull()).alias("missing"),
        F.count_distinct("ref_key").alias("uniq"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count_if(valid.isNull() & F.col("ref_key").isNotNull()).alias("unknown"),
        F.min("line").alias("min_line"), F.max("line").alias("max_line"), F.min("page").alias("min_page"), F.max("page").alias("max_page"),
    )


def paragraph_top_refs(citations: DataFrame, k: int = 8, by: list[str] = BY) -> DataFrame:
    """(by, paragraph_index, rk, ref_key, cnt): the k references cited most, by (-cnt, ref_key)."""
    per = citations.where("ref_key is not null").groupBy(*by, "paragraph_index", "ref_key").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy(*by, "paragraph_index").orderBy(F.desc("cnt"), "ref_key")
    return per.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def adjacent_overlap(citations: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, left_p, right_p, jaccard, shared) of the reference sets of consecutive paragraphs; 0 for two empty sets."""
    sets = citations.groupBy(*by, "paragraph_index").agg(F.collect_set("ref_key").alias("refs"))
    order = Window.partitionBy(*by).orderBy("paragraph_index")
    pairs = sets.withColumn("right_p", F.lead("paragraph_index").over(order)).withColumn("next", F.lead("refs").over(order)).where("right_p is not null")
    shared, union = F.size(F.array_intersect("refs", "next")), F.size(F.array_union("refs", "next"))
    return pairs.select(
        *by, F.col("paragraph_index").alias("left_p"), "right_p", F.round(F.coalesce(F.try_divide(shared, union), F.lit(0.0)), 4).alias("jaccard"), shared.alias("shared")
    )


def reference_dispersion(citations: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, ref_key, paragraphs, citations, dispersion): the share of the paper's paragraphs that cite it."""
    total = citations.groupBy(*by).agg(F.count_distinct("paragraph_index").alias("all"))
    per = citations.where("ref_key is not null").groupBy(*by, "ref_key").agg(F.count_distinct("paragraph_index").alias("paragraphs"), F.count(F.lit(1)).alias("citations"))
    return per.join(total, by).select(*by, "ref_key", "paragraphs", "citations", F.round(F.col("paragraphs") / F.col("all"), 4).alias("dispersion"))


def distribution_summary(citations: DataFrame, sections: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row a paper: paragraphs, citations, distinct references and their means."""
    para = citations.groupBy(*by, "paragraph_index").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("ref_key").alias("u"))
    means = para.groupBy(*by).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("c").alias("citations"), F.round(F.avg("c"), 2).alias("avg_citations"), F.round(F.avg("u"), 2).alias("avg_unique"))
    refs = citations.groupBy(*by).agg(F.count_distinct("ref_key").alias("refs"))
    listed = sections.groupBy(*by).agg(F.count_distinct("section").alias("sections"))
    return means.join(refs, by).join(listed, by, "left").withColumn("avg_per_section", F.round(F.try_divide(F.col("citations"), F.col("sections")), 2))


def nearest_smaller(headings: Column) -> Column:
    """array<(section_index, parent_index, root_index)> of ordered headings array<(section_index, level, ...)>.

    A fold: the stack holds the open sections, their levels rising; a heading closes those not below its own level, so that what
    is left ends with its parent and begins with its root.
    """
    stack, out = "array<struct<level:int,section_index:int>>", "array<struct<section_index:int,parent_index:int,root_index:int>>"
    start = F.struct(F.array().cast(stack).alias("stack"), F.array().cast(out).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        left = F.filter(acc["stack"], lambda s: s["level"] < h["level"])
        parent, root = F.get(left, F.size(left) - 1)["section_index"], F.coalesce(F.get(left, F.lit(0))["section_index"], h["section_index"])
        placed = F.struct(h["section_index"].alias("section_index"), parent.alias("parent_index"), root.alias("root_index"))
        opened = F.struct(h["level"].alias("level"), h["section_index"].alias("section_index"))
        return F.struct(F.concat(left, F.array(opened)).cast(stack).alias("stack"), F.concat(acc["out"], F.array(placed)).cast(out).alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def automatic_numbers(headings: Column) -> Column:
    """array<string> of ordered headings array<(section_index, level, kind, given)>.

    A given number resets the counters and a given letter the letters; an appendix gets the next letter; any other heading counts
    at its level, and levels that were skipped show as 1.
    """
    start = F.struct(F.array().cast("array<int>").alias("counters"), F.lit(0).alias("letter"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        given, appendix = h["given"], F.coalesce(h["kind"] == "appendix", F.lit(False))
        digits = F.coalesce(given.rlike("^[0-9]"), F.lit(False))
        room = F.slice(F.concat(acc["counters"], F.array_repeat(F.lit(0), h["level"])), F.lit(1), h["level"])
        counted = F.transform(room, lambda c, i: c + (i == h["level"] - 1).cast("int"))
        counters = F.when(digits, F.transform(F.split(given, r"\."), lambda c: c.try_cast("int"))).when(given.isNotNull() | appendix, acc["counters"]).otherwise(counted)
        letter = F.when(digits, acc["letter"]).when(given.isNotNull(), F.ascii(given) - 64).when(appendix, acc["letter"] + 1).otherwise(acc["letter"])
        shown = F.array_join(F.transform(counted, lambda c: F.greatest(F.lit(1), c).cast("string")), ".")
        number = F.when(given.isNotNull(), given).when(appendix, F.char(F.lit(64) + letter)).otherwise(shown)
        return F.struct(counters.cast("array<int>").alias("counters"), letter.cast("int").alias("letter"), F.concat(acc["out"], F.array(number)).cast("array<string>").alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def section_hierarchy(sections: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, section_index, parent_index, root_index, number): the nearest earlier section of a smaller level, its root, and an automatic number.

    Both are folds over a paper's headings in order; a null level counts as 1.
    """
    heading = F.struct(
        F.col("section_index").cast("int").alias("section_index"), F.coalesce(F.col("level").cast("int"), F.lit(1)).alias("level"), F.col("kind").cast("string").alias("kind"),
        T.section_prefix(F.col("section_title"))["number"].alias("given"),
    )
    listed = sections.groupBy(*by).agg(F.array_sort(F.collect_list(heading)).alias("headings"))
    joined = F.zip_with(
        nearest_smaller(F.col("headings")), automatic_numbers(F.col("headings")),
        lambda p, n: F.struct(p["section_index"].alias("section_index"), p["parent_index"].alias("parent_index"), p["root_index"].alias("root_index"), n.alias("number")),
    )
    return listed.select(*by, F.inline(joined))


def parent_sections(sections: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, section_index, parent_index): the nearest earlier section of a smaller level."""
    heading = F.struct(F.col("section_index").cast("int").alias("section_index"), F.coalesce(F.col("level").cast("int"), F.lit(1)).alias("level"))
    listed = sections.groupBy(*by).agg(F.array_sort(F.collect_list(heading)).alias("headings"))
    return listed.select(*by, F.inline(nearest_smaller(F.col("headings")))).drop("root_index")


def section_rollup(citations: DataFrame, hierarchy: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, section_index, citations, uniq, paragraphs): each section with all below it, at any depth.

    Sections are joined to ancestors twice as far away in each round, until none has one, then summed once. Sections on a
    cycle of parents are below each other: no distance in a paper exceeds its number of sections, so the rounds end.
    """
    hierarchy = _once(hierarchy, "hierarchy")
    longest = hierarchy.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]
    ids = lambda a: [F.col(f"{a}.{k}").alias(k) for k in by]
    every = hierarchy.select(*by, F.col("section_index").alias("leaf"), F.col("section_index").alias("ancestor"))
    jump = _cut(hierarchy.where("parent_index is not null").select(*by, F.col("section_index").alias("low"), F.col("parent_index").alias("high")), "sections")
    for _ in range(longest.bit_length()):
        if jump.isEmpty():
            break
        up = every.alias("e").join(jump.alias("j"), [*same("e", "j"), F.col("e.ancestor") == F.col("j.low")]).select(*ids("e"), "leaf", F.col("high").alias("ancestor"))
        every = _cut(every.union(up).distinct(), "ancestors")
        twice = jump.alias("a").join(jump.alias("b"), [*same("a", "b"), F.col("a.high") == F.col("b.low")])
        jump = _cut(twice.select(*ids("a"), F.col("a.low").alias("low"), F.col("b.high").alias("high")), "sections")
    own = citations.select(*by, F.col("section_index").alias("leaf"), "ref_key", "paragraph_index")
    return every.join(own, [*by, "leaf"]).groupBy(*by, F.col("ancestor").alias("section_index")).agg(
        F.count(F.lit(1)).alias("citations"), F.count_distinct("ref_key").alias("uniq"), F.count_distinct("paragraph_index").alias("paragraphs")
    )


def orphan_rate(refs: DataFrame, citations: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, total, uncited, rate): C3, references that no citation names."""
    cited = citations.where("ref_key is not null").select(*by, F.col("ref_key").alias("key")).distinct().withColumn("_c", F.lit(1))
    return refs.join(exchanged(cited), [*by, "key"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_c").isNull()).alias("uncited"), F.avg(F.col("_c").isNull().cast("int")).alias("rate")
    )


def verify_rate(refs: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, total, verified, rate): C5, the share with ``is_valid`` true."""
    return refs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_valid")).alias("verified"), F.avg(F.coalesce(F.col("is_valid"), F.lit(False)).cast("int")).alias("rate"))


def alignment_rates(judgments: DataFrame, fail_at: float = 0.05, by: list[str] = BY) -> DataFrame:
    """(by, support, contradict, insufficient, contradiction_rate, auto_fail): C6."""
    is_ = lambda j: F.count_if(F.col("judgment") == j)
    sums = judgments.groupBy(*by).agg(is_("support").alias("support"), is_("contradict").alias("contradict"), is_("insufficient").alias("insufficient"))
    rate = F.coalesce(F.try_divide(F.col("contradict"), F.col("support") + F.col("contradict")), F.lit(0.0))
    return sums.select("*", F.round(rate, 4).alias("contradiction_rate"), (rate >= fail_at).alias("auto_fail"))


def alignment_pairs(citations: DataFrame, refs: DataFrame, by: list[str] = BY) -> DataFrame:
    """C6 pairs: citations with a sentence and a key, the reference's title and abstract, and whether it has one."""
    kept = citations.where("ref_key is not null and coalesce(sentence, '') <> ''")
    found = refs.select(*by, F.col("key").alias("ref_key"), F.col("title").alias("ref_title"), F.coalesce("abstract", F.lit("")).alias("abstract"))
    joined = kept.join(found, [*by, "ref_key"], "left").withColumn("abstract", F.coalesce("abstract", F.lit("")))
    return joined.withColumn("has_abstract", F.col("abstract") != "")


def batches(rows: DataFrame, size: int, order: list[str], by: list[str] = BY) -> DataFrame:
    """``rows`` with batch_id, consecutive groups of ``size``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("batch_id", F.floor((n - 1) / size).cast("int"))


def contradictions(judgments: DataFrame, most: int = 50, by: list[str] = BY) -> DataFrame:
    """The first ``most`` contradictions of a paper, in list order."""
    order = Window.partitionBy(*by).orderBy("pos")
    return judgments.where("judgment = 'contradict'").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= most)


def example_sentences(column: Column, most: int = 3) -> Column:
    return F.slice(F.array_sort(F.collect_list(column)), 1, most)
