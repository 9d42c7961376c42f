"""Sources: Markdown papers, reference lists in TEI, layout and block JSON, stored artifacts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

TEI = (
    "`_xml:id` string, analytic struct<title:string,author:array<struct<persName:struct<surname:string,forename:string>>>>, "
    "monogr struct<title:string,author:array<struct<persName:struct<surname:string,forename:string>>>,imprint:struct<date:struct<_when:string,_VALUE:string>>>, idno string, note string"
)
BLOCK = "struct<type:string,text:string,lines:array<struct<spans:array<struct<text:string,size:double,flags:int>>>>>"
LAYOUT = f"pages array<struct<number:int,blocks:array<{BLOCK}>>>"


def paper_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, source_path, sha256, size, mtime, text): whole files, text of Markdown only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.lower("path").endswith(".md"), F.decode("content", "UTF-8"))
    return files.select(paper_id(F.col("content")).alias("paper_id"), F.col("path").alias("source_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), text.alias("text"))


def paragraphs(papers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, pos, text, is_heading, section_index, paragraph_index, section_title): blocks between blank lines, counted in order."""
    by = by or ["paper_id"]
    rows = papers.select(*by, F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "block")).withColumn("block", F.trim("block")).where("block <> ''")
    rows = rows.withColumn("is_heading", F.startswith("block", F.lit("#")))
    order = Window.partitionBy(*by).orderBy("pos")
    rows = rows.withColumn("section_index", F.sum(F.col("is_heading").cast("int")).over(order)).withColumn("paragraph_index", F.sum((~F.col("is_heading")).cast("int")).over(order) - 1)
    title = F.last(F.when(F.col("is_heading"), T.heading_text(F.col("block"))), ignorenulls=True).over(order)
    return rows.withColumn("section_title", title).withColumnRenamed("block", "text")


def sections(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, section_index, section_title, level, kind): one row a heading; a first section of kind main is the title."""
    by = by or ["paper_id"]
    rows = parts.where("is_heading").select(*by, "section_index", "section_title", T.section_level(F.col("section_title")).alias("level"), T.section_kind(F.col("section_title")).alias("kind"))
    return rows.withColumn("kind", F.when((F.col("section_index") == 1) & (F.col("kind") == "main"), "title").otherwise(F.col("kind")))


def citations(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each citation of a body paragraph: marker, kind, number or author and year, sentence, place, section."""
    by = by or ["paper_id"]
    body = parts.where("not is_heading").select(*by, "section_index", "section_title", "paragraph_index", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))
    found = body.select("*", F.posexplode(T.sentence_citations(F.col("sentence"))).alias("citation_index", "c"))
    return found.select(*by, "section_index", "section_title", "paragraph_index", "sentence_index", "citation_index", "sentence", "c.marker", "c.kind", F.col("c.number").alias("reference_number"), "c.author", "c.year")


def references(papers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, pos, key, reference_number, title, author, year, doi, arxiv_id, raw) from the text's reference list."""
    by = by or ["paper_id"]
    rows = papers.select(*by, F.posexplode(T.split_entries(T.reference_block(F.col("text")))).alias("pos", "entry"))
    parsed = rows.select(*by, "pos", T.parsed_entry(F.col("entry")).alias("p")).select(*by, "pos", "p.*")
    return parsed.withColumn("key", F.concat(F.lit("ref_"), F.coalesce("reference_number", F.col("pos") + 1).cast("string")))


def longer_list(candidates: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Of several backends' reference lists (by, backend, ord, ...) the first in order, unless it has under ``least`` rows: then the longest."""
    sizes = candidates.groupBy(*by, "backend", "ord").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.when(F.col("_n") >= least, 0).otherwise(1), F.when(F.col("_n") >= least, F.col("ord")).otherwise(-F.col("_n")), "ord")
    chosen = sizes.groupBy(*by).agg(F.min_by("backend", order).alias("backend"))
    return candidates.join(chosen, [*by, "backend"], "left_semi")


def title_and_abstract(text: Column) -> Column:
    """(title, abstract): the first heading or bold line of the first ten, and what follows a short ABSTRACT line up to the next heading."""
    title = F.regexp_extract(F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n"), r"(?m)^(?:#\s+(.+)|\*\*(.+)\*\*)\s*$", 0)
    abstract = F.regexp_extract(text, r"(?is)(?:^|\n)[#*\s]*abstract[*:.\s]*\n+(.*?)(?=\n\s*(?:#|\*\*)|\z)", 1)
    return F.struct(T.heading_text(title).alias("title"), T.collapse(abstract).alias("abstract"))


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """References of TEI files: the title of the article, the book, or the note; authors ``Surname, Forename``; the year of the date."""
    rows = spark.read.format("xml").schema(TEI).option("rowTag", "biblStruct").load(path).withColumn("_file", F.input_file_name())
    name = lambda a: F.concat_ws(", ", a["persName"]["surname"], a["persName"]["forename"])
    date = F.col("monogr.imprint.date")
    year = F.coalesce(F.nullif(F.substring(date["_when"], 1, 4), F.lit("")), F.nullif(T.entry_year(date["_VALUE"]), F.lit("")))
    return rows.select(
        "_file", F.coalesce(F.col("`_xml:id`"), F.lit("ref")).alias("key"), F.coalesce(T.blank_to_null(F.col("analytic.title")), T.blank_to_null(F.col("monogr.title")), T.blank_to_null(F.col("note"))).alias("title"),
        F.array_join(F.transform(F.coalesce("analytic.author", "monogr.author"), name), " and ").alias("author"), year.alias("year"), T.doi_norm(F.col("idno")).alias("doi"),
    )


def tei_header(xml: Column) -> Column:
    return F.struct(
        F.xpath_string(xml, F.lit("//*[local-name()='titleStmt']/*[local-name()='title']")).alias("title"), F.trim(F.xpath_string(xml, F.lit("//*[local-name()='abstract']"))).alias("abstract"),
        F.xpath(xml, F.lit("//*[local-name()='keywords']//*[local-name()='term']/text()")).alias("keywords"),
    )


def layout_headings(layout: Column) -> Column:
    """Headings of layout JSON: blocks of a heading type, and bold spans of 4 to 99 characters that begin with a capital or a mark."""
    pages = F.from_json(layout, LAYOUT)["pages"]
    blocks = F.flatten(F.transform(pages, lambda p: F.coalesce(p["blocks"], F.array().cast(f"array<{BLOCK}>"))))
    spans = lambda b: F.flatten(F.transform(b["lines"], lambda x: x["spans"]))
    whole = lambda b: F.coalesce(b["text"], F.array_join(F.transform(spans(b), lambda s: s["text"]), " "))
    bold = lambda b: F.transform(F.filter(spans(b), lambda s: (s["flags"].bitwiseAND(16) != 0) & (F.length(F.trim(s["text"])) > 3) & (F.length(F.trim(s["text"])) < 100) & F.trim(s["text"]).rlike("^[A-Z#]")), lambda s: s["text"])
    found = F.flatten(F.transform(blocks, lambda b: F.when(F.lower(b["type"]).rlike("^(heading|h[1-6])$"), F.array(whole(b))).otherwise(F.coalesce(bold(b), F.array().cast("array<string>")))))
    return F.array_distinct(F.filter(F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"^#+\s*", ""))), lambda h: h != ""))


def block_tree(rows: DataFrame, json: str = "json") -> DataFrame:
    """(all columns, ord, block_type, markdown) of nested ``children``, parents before children, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json as decoder

        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                stack, n = [decoder.loads(r[json])], 0
                while stack:
                    node = stack.pop()
                    if node.get("block_type") != "Page" and (node.get("markdown") or "").strip():
                        out.append({**r, "ord": n, "block_type": node.get("block_type"), "markdown": node["markdown"]})
                        n += 1
                    stack += reversed(node.get("children") or [])
            yield pd.DataFrame(out, columns=[*batch.columns, "ord", "block_type", "markdown"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, ord int, block_type string, markdown string")


def tree_headings(tree: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, heading): distinct section headers in order."""
    rows = tree.where("block_type = 'SectionHeader'").withColumn("heading", F.trim(F.regexp_replace("markdown", r"^[#\-\s]+", "")))
    return rows.groupBy(*by, "heading").agg(F.min("ord").alias("ord"))


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def body_font(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, size): the font size that most text has."""
    return spans.groupBy(*by, "size").agg(F.sum(F.length("text")).alias("_n")).groupBy(*by).agg(F.max_by("size", F.struct("_n", -F.col("size"))).alias("size"))


def merged_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of a page joined to paragraphs: a block continues the one before where its gap is small, its indent alike and that one
    doesn't end a sentence; (by, paragraph, text) in reading order."""
    order = Window.partitionBy(*by).orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    joins = (F.col("y0") - before("y1") <= 0.8 * F.col("size")) & (F.abs(F.col("x0") - before("x0")) <= 12) & ~F.coalesce(F.trim(before("text")).rlike("[.!?:]$"), F.lit(True))
    rows = blocks.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("paragraph", F.sum("_new").over(order))
    listed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy(*by, "paragraph").agg(F.array_join(F.transform(listed, lambda b: F.trim(b["text"])), " ").alias("text"))
