"""Layout scan: pages of positioned blocks to paragraphs, headings, sentences and citations with page and line, in one plan.

A page holds blocks, a block lines, a line spans of one font size each. Nothing but columns: lines stay arrays
within their block, paragraphs are gaps and islands over a paper's blocks in order, places are running sums of
lengths. Blocks are read once, written to the shared folder, and exchanged once, by paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.graph import _cut

SPAN = "struct<text:string,size:double>"
LINE = f"struct<bbox:array<double>,spans:array<{SPAN}>>"
PAGES = f"struct<pages:array<struct<number:int,blocks:array<struct<type:string,bbox:array<double>,lines:array<{LINE}>>>>>>"
FLAT_LINE = "struct<text:string,size:double,bbox:array<double>,start:int,end:int,line:int>"
PIECE = "struct<text:string,start:int,end:int>"

#: Block types that hold text, points above the body's size for a heading, gaps and indents that still join.
TEXT_TYPES = ("0", "text")
HEADING_POINTS = 1.5
OVERLAP, GAP_LINES, LINE_HEIGHT, INDENT = -2.0, 1.6, 10.0, 10.0
_ENDED = r"[.!?]['\"”’)]*$"
_WORD = r"[A-Za-z][A-Za-z'\-]*"


def _mean(sizes: Column) -> Column:
    real = F.filter(sizes, lambda s: s > 0)
    return F.when(F.size(real) > 0, F.aggregate(real, F.lit(0.0), lambda a, s: a + s) / F.size(real)).otherwise(0.0)


def _line(x: Column) -> Column:
    spans = F.coalesce(x["spans"], F.array().cast(f"array<{SPAN}>"))
    text = F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return F.struct(text.alias("text"), _mean(F.transform(spans, lambda s: s["size"])).alias("size"), F.when(F.size(x["bbox"]) == 4, x["bbox"]).alias("bbox"))


def blocks(papers: DataFrame, layout: str = "layout", by: list[str] | None = None) -> DataFrame:
    """(by, page_pos, page, block, bbox, spans, lines) of text blocks, of a span its size and how long its text is; a page without a number has its place's, a text that is no layout gives none."""
    by = by or ["paper_id"]
    pages = papers.select(*by, F.posexplode(F.from_json(layout, PAGES)["pages"]).alias("page_pos", "p"))
    rows = pages.select(*by, "page_pos", F.coalesce("p.number", F.col("page_pos") + 1).alias("page"), F.posexplode("p.blocks").alias("block", "b")).where(F.col("b.type").isin(*TEXT_TYPES))
    lines = F.coalesce(F.col("b.lines"), F.array().cast(f"array<{LINE}>"))
    spans = F.flatten(F.filter(F.transform(lines, lambda x: x["spans"]), lambda s: s.isNotNull()))
    return rows.select(*by, "page_pos", "page", "block", F.when(F.size("b.bbox") == 4, F.col("b.bbox")).alias("bbox"), F.transform(spans, lambda s: F.struct(s["size"].alias("size"), F.length(s["text"]).alias("long"))).alias("spans"), F.transform(lines, _line).alias("lines"))


def body_size(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, body): the size, to one place, of most characters; of several, the one met first. Counted map-side by paper and size."""
    spans = rows.select(*by, "page_pos", "block", F.posexplode("spans").alias("span", "s")).where("s.size > 0 and s.long > 0")
    counted = spans.groupBy(*by, F.bround("s.size", 1).alias("_size")).agg(F.sum("s.long").alias("_n"), F.min(F.struct("page_pos", "block", "span")).alias("_at"))
    return counted.groupBy(*by).agg(F.min_by("_size", F.struct(-F.col("_n"), "_at")).alias("body"))


def heading(text: Column, size: Column, body: Column, allowed: Column | None = None) -> Column:
    """The heading that a text set in ``size`` is, or null. Of ``allowed`` headings, if three or more are known, it must be one."""

    def formed(name: Column) -> Column:
        words = F.regexp_extract_all(name, F.lit(_WORD), F.lit(0))
        capitals = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
        looks = (
            F.lower(name).rlike("^(references|bibliography)") | name.rlike(r"^\d+(\.\d+)*\s+\S") | ((name == F.upper(name)) & (name != F.lower(name)))
            | ((F.size(words) > 0) & (capitals >= 0.6 * F.size(words)))
        )
        fits = (name != "") & (F.length(name) <= 80) & ~F.endswith(name, F.lit(".")) & looks
        if allowed is not None:
            fits &= F.coalesce((F.size(allowed) < 3) | F.array_contains(allowed, name), F.lit(True))
        return F.when(fits, name)

    def named(lines: Column) -> Column:
        first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
        whole = F.when(first.rlike(r"^(\d+(\.\d+)*|[A-Z])$") & second.isNotNull(), F.concat_ws(" ", first, second)).otherwise(first)
        return T.collapse(F.regexp_replace(F.regexp_replace(whole, r"^#+", ""), r"\*\*(.+?)\*\*", "$1"))

    # Few texts are set so large; what is made of one is made once, as an array of one that the next step goes over.
    lines = F.filter(F.transform(F.split(text, "\n"), T.collapse), lambda x: x != "")
    found = F.transform(F.transform(F.array(lines), named), formed)
    return F.when(body.isNull() | (size >= body + HEADING_POINTS), F.get(found, F.lit(0)))


def _placed(lines: Column) -> Column:
    """Lines that aren't blank with their places in the text that line breaks join them to."""
    kept = F.filter(lines, lambda x: F.trim(x["text"]) != "")
    start = F.struct(F.array().cast(f"array<{FLAT_LINE}>").alias("lines"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["text"])
        row = F.struct(x["text"].alias("text"), x["size"].alias("size"), x["bbox"].alias("bbox"), acc["at"].alias("start"), end.alias("end"), (F.size(acc["lines"]) + 1).alias("line"))
        return F.struct(F.concat(acc["lines"], F.array(row)).alias("lines"), (end + 1).alias("at"))

    return F.aggregate(kept, start, step, lambda acc: acc["lines"])


def paragraphs(papers: DataFrame, layout: str = "layout", by: list[str] | None = None, headings: str | None = None) -> DataFrame:
    """(by, page, paragraph_index, text, lines, heading, section_index, section_title): every paragraph in order, blank ones counted but left out.

    A block joins the one before it on its page if neither is a heading, the gap between them is small, their left
    edges are close, and the one before doesn't end a sentence or this one begins with a small letter.
    ``headings`` names a column of headings known from elsewhere. A null or broken layout gives no rows.
    """
    by = by or ["paper_id"]
    rows = _cut(blocks(papers, layout, by), "blocks")
    rows = rows.repartition(*by).join(body_size(rows, by), by, "left")
    allowed = None
    if headings is not None:
        rows = rows.join(papers.select(*by, F.col(headings).alias("_allowed")), by, "left")
        allowed = F.col("_allowed")
    first = F.coalesce(F.get("lines", F.lit(0))["text"], F.lit(""))
    last = F.coalesce(F.get("lines", F.size("lines") - 1)["text"], F.lit(""))
    boxed = F.get(F.filter("lines", lambda x: x["bbox"].isNotNull()), F.lit(0))["bbox"]
    box = F.coalesce("bbox", F.array(*[F.lit(0.0)] * 4))
    height = F.coalesce(F.get(boxed, F.lit(3)) - F.get(boxed, F.lit(1)), F.lit(0.0))
    rows = rows.select(
        *by, "page_pos", "page", "block", "body", *(["_allowed"] if headings is not None else []), "lines",
        heading(first, _mean(F.transform("spans", lambda s: s["size"])), F.col("body"), allowed).isNotNull().alias("_headed"), F.get(box, F.lit(0)).alias("_x0"), F.get(box, F.lit(1)).alias("_y0"),
        F.get(box, F.lit(3)).alias("_y1"), F.when(height > 0, height).otherwise(LINE_HEIGHT).alias("_height"), F.trim(last).rlike(_ENDED).alias("_ended"), first.rlike(r"^\p{Ll}").alias("_small"),
    )
    page = Window.partitionBy(*by, "page_pos").orderBy("block")
    before = lambda c: F.lag(c).over(page)
    gap = F.col("_y0") - before("_y1")
    joins = (
        ~before("_headed") & ~F.col("_headed") & (gap >= OVERLAP) & (gap <= GAP_LINES * before("_height"))
        & (F.abs(F.col("_x0") - before("_x0")) <= INDENT) & (~before("_ended") | F.col("_small"))
    )
    rows = rows.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    rows = rows.withColumn("paragraph_index", F.sum("_new").over(Window.partitionBy(*by).orderBy("page_pos", "block")).cast("int"))
    extra = [F.first("body").alias("body")] + ([F.first("_allowed").alias("_allowed")] if headings is not None else [])
    whole = rows.groupBy(*by, "paragraph_index").agg(F.min("page").alias("page"), F.sort_array(F.collect_list(F.struct("block", "lines"))).alias("_b"), *extra)
    whole = whole.where(F.exists("_b", lambda b: F.exists(b["lines"], lambda x: F.trim(x["text"]) != "")))
    whole = whole.withColumn("lines", _placed(F.flatten(F.transform("_b", lambda b: b["lines"])))).withColumn("text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    whole = whole.withColumn("heading", heading(F.col("text"), F.array_max(F.transform("lines", lambda x: x["size"])), F.col("body"), allowed))
    order = Window.partitionBy(*by).orderBy("paragraph_index")
    whole = whole.withColumn("section_index", F.count("heading").over(order).cast("int")).withColumn("section_title", F.last("heading", ignorenulls=True).over(order))
    return whole.select(*by, "page", "paragraph_index", "text", "lines", "heading", F.nullif("section_index", F.lit(0)).alias("section_index"), "section_title")


def sections(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, section_index, section_title, page, paragraph_index, level, kind); a first one on page 1 of kind main without a number is the title."""
    by = by or ["paper_id"]
    kind = T.section_kind(F.col("section_title"))
    title = (F.col("section_index") == 1) & (F.col("page") == 1) & (kind == "main") & ~F.col("section_title").rlike(r"^\d+(\.\d+)*\b")
    return parts.where("heading is not null").select(
        *by, "section_index", "section_title", "page", "paragraph_index", T.section_level(F.col("section_title")).alias("level"), F.when(title, "title").otherwise(kind).alias("kind")
    )


def placed_sentences(text: Column) -> Column:
    """(text, start, end) of each sentence: blanks collapsed, places those of the text as it is; an abbreviation ends none."""
    cut = F.split(F.regexp_replace(F.translate(text, "\x01", " "), rf"({T.SENTENCE_END})", "$1\x01"), "\x01")
    # An abbreviation lies within one piece, so whether a sentence goes on is each piece's own matter.
    whole = F.transform(F.transform(cut, lambda p: F.struct(p.alias("raw"), T.collapse(p).alias("text"))), lambda p: F.struct(
        p["text"].alias("text"), F.length(p["raw"]).alias("long"), F.length(F.regexp_replace(p["raw"], r"\s+$", "")).alias("shown"), T.ends_with_abbreviation(p["text"]).alias("open")
    ))
    start = F.struct(F.array().cast(f"array<{PIECE}>").alias("out"), F.lit(0).alias("at"), F.lit(False).alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        before, end = F.get(acc["out"], F.size(acc["out"]) - 1), acc["at"] + piece["shown"]
        row = F.struct(piece["text"].alias("text"), acc["at"].alias("start"), end.alias("end"))
        longer = F.struct(F.concat_ws(" ", before["text"], piece["text"]).alias("text"), before["start"].alias("start"), end.alias("end"))
        out = F.when(acc["open"], F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(longer))).otherwise(F.concat(acc["out"], F.array(row)))
        return F.struct(out.alias("out"), (acc["at"] + piece["long"]).alias("at"), piece["open"].alias("open"))

    return F.filter(F.aggregate(whole, start, step, lambda acc: acc["out"]), lambda s: s["text"] != "")


def citations(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Citations of body paragraphs with the page, the paragraph, and number and box of the line in which their sentence begins."""
    by = by or ["paper_id"]
    marked = lambda c: F.col(c).rlike(r"[\[(]")
    body = parts.where(F.col("heading").isNull() & marked("text")).select(*by, "page", "paragraph_index", "section_index", "section_title", "lines", F.posexplode(placed_sentences(F.col("text"))).alias("sentence_index", "s"))
    found = body.where(marked("s.text")).select("*", F.posexplode(T.sentence_citations(F.col("s.text"))).alias("citation_index", "c"))
    a, b = F.col("s.start"), F.col("s.end")
    at = F.get(F.filter("lines", lambda x: ((x["start"] <= a) & (a < x["end"])) | ((a <= x["start"]) & (x["start"] < b))), F.lit(0))
    return found.select(
        *by, "page", "paragraph_index", F.coalesce(at["line"], F.lit(0)).alias("line_in_paragraph"), at["bbox"].alias("bbox"), "section_index", "section_title", "sentence_index", "citation_index",
        F.col("s.text").alias("sentence"), "c.marker", "c.kind", F.col("c.number").alias("reference_number"), "c.author", "c.year",
    )
