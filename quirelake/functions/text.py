r"""Text functions as Column expressions: markers, sentences, reference entries, identifiers, names, similarity.

All are built in and stay within generated code but ``ascii_fold``, for which Spark has no function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, headings, abbreviations and rewriting rules that results depend on.
MARKER = r"\[(?:[0-9]+(?:[-,]\s*[0-9]+)*)\]"
LISTED = r"(?m)^\[(\d+)\]\s+(.+)$"
HEADINGS = ("references", "bibliography", "literature cited")
ENTRY_STARTS = (r"^\[\d+\]\s+", r"^\d+\.\s+", r"^\d+\)\s+")
AUTHOR_YEAR_START = r"^[A-Z].{0,160}\b(19|20)\d{2}\b"
INLINE = r"([A-Z][A-Za-z'`\-]+(?:\s+(?:et al\.|and|&)\s+[A-Z][A-Za-z'`\-]+)*)\s*\((\d{4}[a-z]?)\)"
PAREN = r"\(([^)]*\b(?:19|20)\d{2}[a-z]?\b[^)]*)\)"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
ABBREVIATIONS = ("et al.", "fig.", "figs.", "eq.", "eqs.", "cf.", "e.g.", "i.e.", "vs.", "dr.", "mr.", "ms.", "prof.")
LATEX_WRAPPERS = ("textbf", "textit", "emph", "textrm", "texttt", "textsf", "textsc", "text", "mathrm", "mathbf", "mathit", "url")
LATEX_CHARS = (
    (r"\&", "&"), (r"\%", "%"), (r"\$", "$"), (r"\#", "#"), (r"\_", "_"), (r"\{", "{"), (r"\}", "}"), (r"\~", "~"), (r"\^", "^"),
    ("``", '"'), ("''", '"'), ("`", "'"), ("'", "'"), ("--", "-"), ("---", "-"),
)
# Fixed values.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "what", "which", "who", "whom", "whose", "where", "when",
    "why", "how",
)


_none = lambda kind: F.array().cast(f"array<{kind}>")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def year_int(c: Column) -> Column:
    """An all-digit year as a number, else null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


# Citation markers


def markers(text: Column) -> Column:
    """Distinct numeric markers in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)))


def marker_numbers(marker: Column) -> Column:
    """``[1, 3-5]`` to 1, 3, 4, 5; ranges that count down and malformed parts give nothing."""
    low = lambda p: F.substring_index(p, "-", 1).try_cast("int")
    high = lambda p: F.substring_index(p, "-", -1).try_cast("int")
    numbers = lambda p: (
        F.when(p.rlike(r"^\d+-\d+$") & (low(p) <= high(p)), F.sequence(low(p), F.greatest(low(p), high(p)))).when(p.rlike(r"^\d+$"), F.array(p.try_cast("int"))).otherwise(_none("int"))
    )
    return F.flatten(F.transform(F.split(F.regexp_replace(marker, r"[\[\]\s]", ""), ","), numbers))


def citation_numbers(text: Column) -> Column:
    """Sorted distinct numbers of all markers."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(markers(text), marker_numbers))))


def contexts(text: Column, marker: Column, around: int = 100) -> Column:
    """``...`` + up to ``around`` characters on both sides of every occurrence + ``...``."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), marker, F.lit(r"\E")), -1)
    width = F.length(marker)
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p)) + (i - 1) * width
    cut = lambda i: F.concat(
        F.lit("..."), F.substring(text, F.greatest(before(i) - around, F.lit(0)) + 1, F.least(before(i), F.lit(around)) + width + around), F.lit("...")
    )
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), cut)).otherwise(_none("string"))


# Sentences


def ends_with_abbreviation(sentence: Column) -> Column:
    longest = max(map(len, ABBREVIATIONS))
    return F.lower(F.substring(F.rtrim(sentence), -longest, longest)).rlike(f"(?:{'|'.join(a.replace('.', chr(92) + '.') for a in ABBREVIATIONS)})\\z")


def sentences(text: Column) -> Column:
    """Sentences with blanks collapsed; an abbreviation at the end of a piece doesn't end a sentence."""
    pieces = F.filter(F.transform(F.split(text, SENTENCE_END), collapse), lambda s: s != "")
    join = lambda acc, s: F.when(
        (F.size(acc) > 0) & F.coalesce(ends_with_abbreviation(F.get(acc, F.size(acc) - 1)), F.lit(False)),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.get(acc, F.size(acc) - 1), s))),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(pieces, _none("string"), join)


def author_year_part(part: Column, fallback: Column) -> Column:
    """(author, year) of ``Author, 2020`` or of a bare year after an author; null where neither fits."""
    author = F.regexp_extract(part, r"^(.+?)[,\s]+((?:19|20)\d{2}[a-z]?)", 1)
    year = F.regexp_extract(part, r"^(.+?)[,\s]+((?:19|20)\d{2}[a-z]?)", 2)
    bare = F.regexp_extract(part, r"^\s*((?:19|20)\d{2}[a-z]?)\s*$", 1)
    return (
        F.when(author != "", F.struct(F.trim(author).alias("author"), year.alias("year")))
        .when((bare != "") & (F.coalesce(fallback, F.lit("")) != ""), F.struct(fallback.alias("author"), bare.alias("year")))
    )


CITATION = "array<struct<marker:string,kind:string,number:int,author:string,year:string>>"


def sentence_citations(sentence: Column) -> Column:
    """Citations of a sentence: numeric ones (one for each number), ``Author (2020)``, then parenthesised author-year parts."""
    null, text = F.lit(None), lambda c: c.cast("string")
    numeric = F.flatten(F.transform(
        F.regexp_extract_all(sentence, F.lit(MARKER), F.lit(0)),
        lambda m: F.transform(marker_numbers(m), lambda n: F.struct(F.concat(F.lit("["), text(n), F.lit("]")).alias("marker"), F.lit("numeric").alias("kind"), n.alias("number"), text(null).alias("author"), text(null).alias("year"))),
    ))
    whole = F.regexp_extract_all(sentence, F.lit(INLINE), F.lit(0))
    row = lambda m, a, y: F.struct(m.alias("marker"), F.lit("author_year").alias("kind"), null.cast("int").alias("number"), a.alias("author"), y.alias("year"))
    inline = F.transform(whole, lambda m: row(m, F.regexp_extract(m, INLINE, 1), F.regexp_extract(m, INLINE, 2)))
    none = _none("struct<author:string,year:string>")

    def parts(inside: Column) -> Column:
        step = lambda acc, p: F.concat(acc, F.array_compact(F.array(author_year_part(F.trim(p), F.get(acc, F.size(acc) - 1)["author"]))))
        found = F.aggregate(F.split(inside, ";"), none, step)
        return F.transform(found, lambda f: row(F.concat(F.lit("("), inside, F.lit(")")), f["author"], f["year"]))

    paren = F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit(PAREN), F.lit(1)), parts))
    # Most sentences hold no parenthesis, so no author either.
    named = F.when(F.contains(sentence, F.lit("(")), F.concat(inline, paren).cast(CITATION)).when(sentence.isNotNull(), F.array().cast(CITATION))
    return F.concat(numeric.cast(CITATION), named)


def author_key(author: Column, compat: bool = False) -> Column:
    """The last word of the first author. ``compat`` cuts at "and" inside names too."""
    text = F.replace(F.regexp_replace(F.lower(author), r"et al\.?", ""), F.lit("&"), F.lit("and"))
    first = F.element_at(F.split(text, "and" if compat else r"\band\b"), 1)
    words = F.regexp_extract_all(first, F.lit("[a-z]+"), F.lit(0))
    return F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))


def author_year_key(author: Column, year: Column, compat: bool = False) -> Column:
    key, y = author_key(author, compat), F.trim(year)
    return F.when((key != "") & (F.coalesce(y, F.lit("")) != ""), F.concat_ws("|", key, y)).otherwise("")


# Identifiers


def doi_norm(doi: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", ""))


def arxiv_norm(arxiv: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(arxiv), r"(?i)^arxiv:\s*", ""), r"v\d+$", ""))


def openalex_norm(openalex: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(openalex), r"(?i)^https?://(api\.)?openalex\.org/(works/)?", ""), r"(?i)^openalex:", ""))


def identity_tokens(row: Column, key: Column | None = None) -> Column:
    """``kind:value`` tokens of a struct with doi, arxiv_id, openalex_id and semantic_scholar_id, and of a key."""
    token = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{kind}:"), c))
    tokens = [] if key is None else [token("key", F.trim(key))]
    tokens += [token("doi", doi_norm(row["doi"])), token("arxiv", arxiv_norm(row["arxiv_id"])), token("openalex", openalex_norm(row["openalex_id"])), token("s2", F.trim(row["semantic_scholar_id"]))]
    return F.array_distinct(F.array_compact(F.array(*tokens)))


# Reference lists


def is_reference_start(line: Column) -> Column:
    found = line.rlike(AUTHOR_YEAR_START)
    for pattern in ENTRY_STARTS:
        found = found | line.rlike(pattern)
    return found


def reference_block(text: Column) -> Column:
    """Lines after a references heading; else from the first entry at 60 % of the lines or later, or the first at all; else the last 30 %."""
    named = "|".join(HEADINGS)
    heading = lambda s: s.rlike(rf"(?i)^\s*#*\s*({named})[:\s]*$") | ((F.length(F.trim(s)) <= 40) & s.rlike(rf"(?i)\b({named})\b"))

    def begin(lines: Column) -> Column:
        n = F.size(lines)
        at = F.array_min(F.transform(lines, lambda s, i: F.when(heading(s), i)))
        starts = F.array_compact(F.transform(lines, lambda s, i: F.when(is_reference_start(F.trim(s)), i)))
        late = F.array_min(F.filter(starts, lambda i: i >= F.floor(n * 0.6).cast("int")))
        return F.coalesce(at + 1, late, F.array_min(starts), F.floor(n * 0.7).cast("int"))

    # Arrays of one, so that lines and their place are made once.
    placed = F.transform(F.array(F.split(text, "\n")), lambda lines: F.struct(lines.alias("lines"), begin(lines).alias("begin")))
    rest = F.transform(placed, lambda x: F.array_join(F.slice(x["lines"], x["begin"] + 1, F.greatest(F.size(x["lines"]) - x["begin"], F.lit(0))), "\n"))
    return F.get(rest, F.lit(0))


def split_entries(block: Column) -> Column:
    """Reference entries; lines that start none continue the one before."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    step = lambda acc, s: F.when(is_reference_start(s) | (F.size(acc) == 0), F.concat(acc, F.array(s))).otherwise(
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.get(acc, F.size(acc) - 1), s)))
    )
    return F.aggregate(lines, _none("string"), step)


_INDEX = r"^(?:\[(\d+)\]|(\d+)[.)])\s+"


def reference_number(entry: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(entry, _INDEX, 1)), blank_to_null(F.regexp_extract(entry, _INDEX, 2))).try_cast("int")


def without_index(entry: Column) -> Column:
    return F.trim(F.regexp_replace(entry, _INDEX, ""))


def entry_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b(?:19|20)\d{2}\b", 0)


def entry_doi(text: Column) -> Column:
    found = F.coalesce(
        F.nullif(F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit("")), F.regexp_extract(text, r"(?i)doi\.org/([^\s\"<>]+)", 1)
    )
    return F.regexp_replace(found, r"[).,;]+$", "")


def entry_arxiv(text: Column) -> Column:
    tries = (r"(?i)arxiv:\s*([a-z\-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?", r"\b(\d{4}\.\d{4,5})(?:v\d+)?\b", r"\b([a-z\-]+(?:\.[A-Z]{2})?/\d{7})\b")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in tries], F.lit(""))


def entry_title(text: Column) -> Column:
    """The longest quoted span; else what follows the year up to a full stop; else the second part, the first, or 200 characters."""
    quoted = F.regexp_extract_all(text, F.lit(r"[\"“”]([^\"“”]+)[\"“”]"), F.lit(1))
    longest = F.aggregate(quoted, F.lit(""), lambda acc, q: F.when(F.length(q) > F.length(acc), q).otherwise(acc))
    after = F.trim(F.regexp_extract(text, r"\(?\b(?:19|20)\d{2}\b\)?[).,;:\- ]*([^.]+)", 1))
    parts = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda p: p != "")
    return F.coalesce(blank_to_null(longest), blank_to_null(after), F.get(parts, 1), F.get(parts, 0), F.substring(text, 1, 200))


def entry_authors(text: Column) -> Column:
    head = F.when(entry_year(text) != "", F.regexp_replace(F.call_function("substring_index", text, entry_year(text), F.lit(1)), r"\($", "")).otherwise(text)
    parts = F.filter(F.transform(F.split(head, r"\."), lambda s: F.trim(s)), lambda p: p != "")
    return F.coalesce(F.get(parts, 0), F.trim(head))


def parsed_entry(entry: Column) -> Column:
    body = without_index(entry)
    return F.struct(
        reference_number(entry).alias("reference_number"), entry_title(body).alias("title"), entry_authors(body).alias("author"), entry_year(body).alias("year"),
        entry_doi(body).alias("doi"), entry_arxiv(body).alias("arxiv_id"), entry.alias("raw"),
    )


def listed_references(text: Column) -> Column:
    """``[n] text`` lines as (number, text), in order."""
    pair = lambda line: F.struct(F.regexp_extract(line, LISTED, 1).try_cast("int").alias("number"), F.trim(F.regexp_extract(line, LISTED, 2)).alias("text"))
    return F.transform(F.regexp_extract_all(text, F.lit(LISTED), F.lit(0)), pair)


# Sections


def section_kind(title: Column, otherwise: str | None = "main") -> Column:
    lowered = F.lower(F.coalesce(title, F.lit("")))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(lowered, w))
    return (
        F.when(has("abstract"), "abstract").when(has("introduction"), "introduction").when(has("conclusion"), "conclusion")
        .when(has("references", "bibliography"), "references").when(has("appendix", "appendices"), "appendix").otherwise(F.lit(otherwise))
    )


def section_level(title: Column) -> Column:
    number = F.rtrim(F.regexp_extract(F.trim(title), r"^(\d+(?:\.\d+)*)", 1))
    return F.when(number == "", 1).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


def section_prefix(title: Column) -> Column:
    """(number, label): a leading ``1.2`` or single capital letter, and the rest."""
    number = F.regexp_extract(F.trim(title), r"^((?:\d+(?:\.\d+)*)|[A-Z])[.)]?\s+(.+)$", 1)
    label = F.regexp_extract(F.trim(title), r"^((?:\d+(?:\.\d+)*)|[A-Z])[.)]?\s+(.+)$", 2)
    return F.struct(F.nullif(number, F.lit("")).alias("number"), F.when(number != "", label).otherwise(F.trim(title)).alias("label"))


def section_label(label: Column) -> Column:
    return F.coalesce(blank_to_null(collapse(label)), F.lit("Unknown"))


def heading_text(text: Column) -> Column:
    """Heading marks, bold marks and doubled blanks removed; a lone number line joins the next."""
    joined = F.regexp_replace(text, r"^(\s*\d+(?:\.\d+)*\.?)\s*\n", "$1 ")
    return collapse(F.regexp_replace(F.regexp_replace(joined, r"^\s*#+\s*|\s*#+\s*$", ""), r"\*\*|__", ""))


def is_heading(text: Column) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike("[A-Za-z]"))
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    return (
        (F.length(F.trim(text)) > 0) & (F.length(F.trim(text)) <= 80) & ~F.endswith(F.trim(text), F.lit("."))
        & (F.lower(F.trim(text)).isin(*HEADINGS) | text.rlike(r"^\s*\d+(\.\d+)*\.?\s+\S") | ((letters != "") & (letters == F.upper(letters))) | ((F.size(words) > 0) & (capital >= 0.6 * F.size(words))))
    )


def markdown_headings(text: Column) -> Column:
    """Distinct headings in order, marks stripped."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"\s*#+\s*$", ""))), lambda h: h != ""))


# Names, normal forms, similarity


def latex_norm(text: Column) -> Column:
    out = text
    for name in LATEX_WRAPPERS:
        out = F.regexp_replace(out, rf"\\{name}\{{([^}}]*)\}}", "$1")
    out = F.regexp_replace(out, r"\\href\{[^}]*\}\{([^}]*)\}", "$1")
    for mark, letters in (("'", "aeiouAEIOU"), ("`", "aeiouAEIOU"), (r"\^", "aeiouAEIOU"), ('"', "aeiouAEIOU"), ("~", "nNaAoO")):
        out = F.regexp_replace(out, rf"\\{mark}\{{?([{letters}])\}}?", "$1")
    out = F.regexp_replace(out, r"\\c\{([cC])\}", "$1")
    for found, put in LATEX_CHARS:
        out = F.replace(out, F.lit(found), F.lit(put))
    return F.regexp_replace(out, r"[{}]", "")


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what is not ASCII; in Arrow batches."""
    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return fold(text)


def comparable(text: Column, fold=ascii_fold) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(latex_norm(text))), r"\s+", " "), r"[^\w\s]", ""))


def name_norm(name: Column) -> Column:
    """``Last, First`` to ``first last``, lower case, no punctuation."""
    plain = F.trim(name)
    turned = F.when(F.contains(plain, F.lit(",")), F.concat_ws(" ", F.trim(F.get(F.split(plain, ",", 2), 1)), F.trim(F.get(F.split(plain, ",", 2), 0)))).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(turned), r"[^\w\s]", ""), r"\s+", " "))


def author_list(authors: Column) -> Column:
    return F.filter(F.transform(F.split(authors, r"\s+and\s+"), lambda s: F.trim(s)), lambda a: a != "")


def comma_list(authors: Column) -> Column:
    return F.filter(F.transform(F.split(authors, ","), lambda s: F.trim(s)), lambda a: a != "")


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda w: w != "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def names_match(a: Column, b: Column) -> Column:
    x, y = F.split(a, " "), F.split(b, " ")
    first, last = lambda w: F.get(w, 0), lambda w: F.get(w, F.size(w) - 1)
    return (last(x) == last(y)) | ((first(x) == last(y)) & (last(x) == first(y)))


def author_similarity(left: Column, right: Column) -> Column:
    """Mean over the left names of their best match on the right: 1 where names match, else word Jaccard."""
    best = lambda a: F.coalesce(F.array_max(F.transform(right, lambda b: F.when(names_match(a, b), 1.0).otherwise(word_jaccard(a, b)))), F.lit(0.0))
    total = F.aggregate(F.transform(left, best), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(total / F.greatest(F.size(left), F.lit(1)))


def compare_metadata(title: Column, authors: Column, year: Column, found_title: Column, found_authors: Column, found_year: Column, fold=ascii_fold) -> Column:
    """The comparison struct: similarities, matches, confidence, issues. ``authors`` are ``A and B``, ``found_authors`` an array."""
    a, b = comparable(title, fold), comparable(found_title, fold)
    jaccard = word_jaccard(a, b)
    title_sim = F.when((F.length(a) < 100) & (F.length(b) < 100), F.greatest(jaccard, edit_similarity(a, b))).otherwise(jaccard)
    names = lambda c: F.transform(c, name_norm)
    author_sim = author_similarity(names(author_list(authors)), names(found_authors))
    same_year = F.trim(F.coalesce(year, F.lit(""))) == F.trim(F.coalesce(found_year, F.lit("")))
    title_match, author_match = title_sim >= 0.8, author_sim >= 0.6
    issues = F.array_compact(F.array(
        F.when(~title_match, F.format_string("Title mismatch (similarity: %.2f)", title_sim)), F.when(~author_match, F.format_string("Author mismatch (similarity: %.2f)", author_sim)),
        F.when(~same_year, F.format_string("Year mismatch: %s vs %s", year, found_year)),
    ))
    return F.struct(
        title_match.alias("title_match"), title_sim.alias("title_similarity"), author_match.alias("author_match"), author_sim.alias("author_similarity"),
        same_year.alias("year_match"), (title_match & author_match).alias("is_match"),
        (0.5 * title_sim + 0.3 * author_sim + 0.2 * F.when(same_year, 1.0).otherwise(0.5)).alias("confidence"), issues.alias("issues"),
    )


# Keywords, replies, abstracts


def keyword_bigrams(text: Column, stopwords=STOPWORDS, most: int | None = 5) -> Column:
    """Distinct pairs of adjacent words, neither a stopword, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.arrays_zip(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b")))
    kept = F.transform(F.filter(pairs, lambda p: ~p["a"].isin(*stopwords) & ~p["b"].isin(*stopwords)), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    found = F.coalesce(F.array_distinct(kept), _none("string"))
    return F.slice(found, 1, most) if most else found


def reply_keywords(reply: Column, most: int = 5) -> Column:
    """A JSON array, a fenced one, else a list split at commas, semicolons and line ends."""
    bare = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    listed = F.from_json(bare, "array<string>")
    split = F.transform(F.split(reply, r"[,;\n]"), lambda k: F.trim(F.regexp_replace(k, r"^[\s\-*\"']+|[\s\"']+$", "")))
    return F.slice(F.filter(F.coalesce(listed, split), lambda k: F.coalesce(F.trim(k), F.lit("")) != ""), 1, most)


def reply_score(reply: Column, low: float = 0.0, high: float = 5.0, default: float = 5.0) -> Column:
    """The last ``score: x`` or ``rating: x`` of a reply, held to the range."""
    found = F.regexp_extract_all(F.lower(reply), F.lit(r"(?:balance|bias score|score|rating)\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    value = F.get(found, F.size(found) - 1).try_cast("double")
    return F.when(value.isNull(), default).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), value)))


def reply_object(reply: Column) -> Column:
    """The JSON object of a reply as a variant: the whole, a fenced block, or from the first brace to the last."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))


def sub_dimension_reply(reply: Column) -> Column:
    """(score, reasoning): the JSON score held to 1..5, else the first ``score: x``, else 3."""
    v = reply_object(reply)
    loose = F.regexp_extract(F.lower(reply), r"score\W{0,4}([1-5](?:\.[0-9]+)?)", 1).try_cast("double")
    score = F.coalesce(F.try_variant_get(v, "$.score", "double"), loose, F.lit(3.0))
    return F.struct(F.least(F.lit(5.0), F.greatest(F.lit(1.0), score)).alias("score"), F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), reply).alias("reasoning"))


def pair_judgment(reply: Column, number: Column) -> Column:
    """(judgment, note) of the line about pair ``number``; insufficient where there is none."""
    lines = F.filter(F.split(reply, "\n"), lambda s: F.regexp_like(F.lower(s), F.concat(F.lit(r"\bpair\s*"), number.cast("string"), F.lit(r"\b"))))
    line = F.lower(F.get(lines, 0))
    judged = F.when(F.contains(line, F.lit("contradict")), "contradict").when(F.contains(line, F.lit("insufficient")), "insufficient").when(F.contains(line, F.lit("support")), "support").otherwise("insufficient")
    return F.struct(judged.alias("judgment"), F.regexp_extract(F.coalesce(F.get(lines, 0), F.lit("")), r"\(([^)]*)\)", 1).alias("note"))


def alignment_prompt(marker: Column, sentence: Column, abstract: Column, number: Column) -> Column:
    return F.format_string("Pair %d %s\nClaim: %s\nAbstract: %s", number, marker, F.substring(sentence, 1, 300), F.substring(abstract, 1, 500))


def abstract_from_index(index: Column) -> Column:
    """An inverted index (word to positions) back to text; of several words at a place the last stands."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    placed = F.array_sort(entries, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    last = F.filter(placed, lambda e, i: ~F.coalesce(F.get(placed, i + 1)["p"] == e["p"], F.lit(False)))
    return F.array_join(F.transform(last, lambda e: e["w"]), " ")


def scholar_hit(html: Column) -> Column:
    """(title, year, authors, cited_by) of a result block."""
    text = lambda tag: F.regexp_replace(F.regexp_extract(html, tag, 1), r"<[^>]+>", "")
    byline = text(r"(?s)<div class=\"gs_a\">(.*?)</div>")
    return F.struct(
        F.trim(F.regexp_replace(text(r"(?s)<h3[^>]*>(.*?)</h3>"), r"^\s*(\[[A-Z]+\]\s*)+", "")).alias("title"), entry_year(byline).alias("year"),
        F.trim(F.regexp_replace(F.substring_index(byline, " - ", 1), "…", "")).alias("authors"), F.regexp_extract(html, r"Cited by (\d+)", 1).try_cast("int").alias("cited_by"),
    )


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"href=\"([^\"]+)\""), F.lit(1))


def page_in_range(page: Column, ranges: str, compat: bool = False) -> Column:
    """Whether a page number is in ``1-10`` or ``1,3,5``. ``compat`` compares the numbers of a range as text."""
    test = F.lit(False)
    for part in (p.strip() for p in ranges.split(",")):
        low, dash, high = part.partition("-")
        if not dash:
            test = test | (page == int(part))
        elif compat:
            test = test | page.cast("string").between(low, high)
        else:
            test = test | page.between(int(low), int(high))
    return test
