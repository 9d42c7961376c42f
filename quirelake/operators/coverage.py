"""Key-paper coverage (G4) and literature search: unions of sources, first-seen titles, top lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirelake.operators.titles import near_keys, word_key

BY = ["paper_id"]


def title_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def first_titles(rows: DataFrame, order: list, by: list[str] = BY) -> DataFrame:
    """The first row of each title, blanks dropped."""
    kept = rows.where("coalesce(trim(title), '') <> ''").withColumn("_t", title_key(F.col("title")))
    return kept.withColumn("_rk", F.row_number().over(Window.partitionBy(*by, "_t").orderBy(*order))).where("_rk = 1").drop("_rk", "_t")


def match_candidates(candidates: DataFrame, refs: DataFrame, threshold: float = 0.85, method: str = "ratio", by: list[str] = BY) -> DataFrame:
    """``candidates`` (by, pos, title, doi) with match_type (doi, title or null) and ref_key, the first reference that matches.

    ``ratio``: titles of a token-sort ratio of at least ``threshold``, met by their parts (``titles.near_keys``), not pair by pair;
    ``by=[]`` compares all rows of both tables. ``substring``: one title holds the other.
    """
    doi = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    by_doi = refs.withColumn("_d", doi(F.col("doi"))).where("_d is not null").groupBy(*by, "_d").agg(F.min_by("key", "pos").alias("doi_key"))
    rows = candidates.withColumn("_d", doi(F.col("doi"))).join(by_doi, [*by, "_d"], "left").drop("_d")
    c = candidates.select(*by, F.col("pos").alias("_c"), F.col("title").alias("_ct"))
    r = refs.where("coalesce(title, '') <> ''").select(*by, F.col("pos").alias("_r"), F.col("key").alias("_k"), F.col("title").alias("_rt"))
    if method == "substring":
        pairs = c.join(r, by).where("contains(lower(_ct), lower(_rt)) or contains(lower(_rt), lower(_ct))")
    else:
        c, r = c.withColumn("key", word_key(F.col("_ct"))), r.withColumn("key", word_key(F.col("_rt")))
        near = near_keys(c, r, threshold, by)
        first = r.select(*by, F.col("key").alias("right_key"), "_r", "_k").join(near, [*by, "right_key"]).groupBy(*by, F.col("left_key").alias("key")).agg(F.min(F.struct("_r", "_k")).alias("_b"))
        pairs = c.join(first, [*by, "key"]).select(*by, "_c", "_b._r", "_b._k")
    best = pairs.groupBy(*by, F.col("_c").alias("pos")).agg(F.min_by("_k", "_r").alias("title_key"))
    return rows.join(best, [*by, "pos"], "left").select(
        *candidates.columns, F.when(F.col("doi_key").isNotNull(), "doi").when(F.col("title_key").isNotNull(), "title").alias("match_type"), F.coalesce("doi_key", "title_key").alias("ref_key")
    )


#: Items, and characters of them all, that one automaton in every task may hold.
AUTOMATON_ITEMS, AUTOMATON_CHARS = 50_000, 2_000_000


def _scanned(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id) by one scan of ``documents``; the items, which the caller has counted, are gathered into one automaton."""
    patterns: dict[str, list] = {}
    for r in items.select("item_id", F.lower(F.trim("text")).alias("pattern")).where("pattern is not null").collect():
        patterns.setdefault(r.pattern, []).append(r.item_id)
    everywhere = patterns.pop("", [])
    shared = items.sparkSession.sparkContext.broadcast(patterns)
    kinds = [to_arrow_type(d.schema[c].dataType) for d, c in ((items, "item_id"), (documents, "doc_id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for pattern, ids in shared.value.items():
            automaton.add_word(pattern, (pattern, ids))
        automaton.make_automaton()
        for batch in batches:
            found, where = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met = dict(hit for _, hit in automaton.iter(text)) if len(automaton) else {}
                ids = [i for some in met.values() for i in some] + everywhere
                found += ids
                where += [doc] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(found, kinds[0]), pa.array(where, kinds[1])], names=["item_id", "doc_id"])

    schema = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((items, "item_id"), (documents, "doc_id")))
    return documents.where("text is not null").select("doc_id", F.lower("text").alias("text")).mapInArrow(run, schema)


def contained_items(items: DataFrame, documents: DataFrame, words: int = 8, most: int = AUTOMATON_ITEMS, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(item_id, doc_id) of documents that contain an item's text, whatever the case; an empty item is in every text.

    Up to ``most`` items of ``chars`` characters in all, which are counted, one automaton finds them in a single
    scan, and no text is exchanged. Of more items, those of two words or fewer are scanned for in parts of that size;
    the others meet documents at runs of ``words`` words, one run of the item and every run of the document (items
    shorter than a run: all their words, against runs of that length), and only pairs that met are compared.
    """

    def runs(t: Column, k: int) -> Column:
        """Hashes of all runs: k shifted copies side by side, so that the words are split a fixed number of times."""
        shifted = [F.slice(t, i, F.greatest(F.size(t) - k + 1, F.lit(0))).alias(f"w{i}") for i in range(1, k + 1)]
        return F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(F.concat_ws(" ", *[z[f"w{i}"] for i in range(1, k + 1)])))

    def size(rows: DataFrame) -> float:
        """Automata that hold all of them."""
        n, long = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
        return max(n / most if most else n, (long or 0) / chars if chars else long or 0)

    if size(items) <= 1:
        return _scanned(items, documents)
    split = lambda c: F.split(F.trim(F.lower(c)), r"\s+")
    inner = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))  # noqa: E731  the ends may be parts of longer words
    keyed = items.withColumn("_w", inner(split(F.col("text")))).withColumn("_k", F.least(F.size("_w"), F.lit(words)))
    lengths = [r[0] for r in keyed.where("text is not null").select("_k").distinct().collect()]  # at most ``words`` + 1 numbers
    found = []
    for k in lengths:
        some = keyed.where(F.col("_k") == k)
        if k == 0:
            parts = math.ceil(2 * size(some)) if most and chars else 1
            found += [_scanned(some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i), documents) for i in range(parts)]
            continue
        a = some.select("item_id", F.xxhash64(F.array_join(F.slice("_w", F.lit(1), F.lit(k)), " ")).alias("_h"))
        b = documents.select("doc_id", F.explode(F.array_distinct(runs(split(F.col("text")), k))).alias("_h"))
        met = a.join(b, "_h").select("item_id", "doc_id").distinct()
        met = met.join(items, "item_id").join(documents.select("doc_id", F.col("text").alias("_dt")), "doc_id").where(F.contains(F.lower("_dt"), F.lower(F.trim("text"))))
        found.append(met.select("item_id", "doc_id"))
    return reduce(DataFrame.union, found)


def coverage(matched: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, candidates, matched, rate): 0 without candidates."""
    return matched.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"), F.count("ref_key").alias("matched"), F.avg(F.col("ref_key").isNotNull().cast("int")).alias("rate"))


def suspicious(matched: DataFrame, cache: DataFrame, least: int = 10, by: list[str] = BY) -> DataFrame:
    """Matched references cited fewer than ``least`` times; unknown to the cache counts as 0, known without a count is left out."""
    known = cache.select(*by, F.col("key").alias("ref_key"), "citation_count", F.lit(True).alias("_in"))
    joined = matched.where("ref_key is not null").join(known, [*by, "ref_key"], "left")
    count = F.when(F.col("_in").isNull(), 0).otherwise(F.col("citation_count"))
    return joined.withColumn("cnt", count).where("cnt < 10" if least == 10 else F.col("cnt") < least)


# Literature


def normalised_literature(rows: DataFrame, source: str) -> DataFrame:
    """Any source's columns as the literature schema; a text of authors splits at commas."""
    has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    kinds = dict(rows.dtypes)
    authors = has("authors", "array<string>") if kinds.get("authors", "array<string>").startswith("array") else F.filter(F.transform(F.split("authors", ","), lambda s: F.trim(s)), lambda a: a != "")
    year = F.coalesce(has("year", "string"), F.substring(has("published", "string"), 1, 4))
    return rows.select(
        F.lit(source).alias("source"), has("title", "string").alias("title"), authors.alias("authors"), year.alias("year"), has("doi", "string").alias("doi"), has("arxiv_id", "string").alias("arxiv_id"),
        F.coalesce(has("url", "string"), has("abs_url", "string")).alias("url"), has("abstract", "string").alias("abstract"), has("citation_count", "long").alias("citation_count"),
        F.coalesce(has("venue", "string"), has("container_title", "string"), has("journal_ref", "string")).alias("venue"), has("pos", "int").alias("pos"),
    )


def merge_sources(sources: list[DataFrame], strategy: str = "union", priority: DataFrame | None = None) -> DataFrame:
    """``union``: all rows. ``weighted_union``: with the source's priority as ``rank``. ``first_wins``: those of the first source that has any."""
    numbered = [s.withColumn("_ord", F.lit(i)) for i, s in enumerate(sources)]
    rows = numbered[0]
    for s in numbered[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    if strategy == "union":
        return rows.drop("_ord")
    if strategy == "weighted_union":
        return rows.drop("_ord").join(priority.select("source", F.col("priority").alias("rank")), "source", "left").orderBy("rank", "pos")
    if strategy == "first_wins":
        first = rows.agg(F.min("_ord").alias("_first"))
        return rows.join(F.broadcast(first)).where("_ord = _first").drop("_ord", "_first")  # one number
    raise ValueError(f"unknown strategy {strategy!r}")


def search_result(rows: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """By (-citation_count, pos), nulls as 0: first-seen titles, numbered rk, at most ``limit``."""
    by = by or []
    order = [F.desc(F.coalesce("citation_count", F.lit(0))), "source", "pos"]
    kept = first_titles(rows, order, by)
    if not by:
        return kept.orderBy(*order).limit(limit)
    return kept.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rk") <= limit)


def top_cited(rows: DataFrame, k: int = 30) -> DataFrame:
    fill = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "year", "venue", "doi", "url", "abstract")}
    return search_result(rows, k).withColumns(fill | {"citation_count": F.coalesce("citation_count", F.lit(0))})


def sources_by_priority(config: DataFrame, concurrent: bool | None = None) -> DataFrame:
    rows = config.where("enabled")
    return (rows if concurrent is None else rows.where(F.col("concurrent") == concurrent)).orderBy("priority", "source")
