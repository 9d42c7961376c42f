import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T


def one(spark, column, text="", **more):
    cols = {"text": text, **more}
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return frame.select(column.alias("x")).first()["x"]




def test_markers(spark):
    assert one(spark, T.markers(F.col("text")), "Deep nets [1] work [2, 3] and [4-6].") == ["[1]", "[2, 3]", "[4-6]"]
    assert one(spark, T.markers(F.col("text")), "[1] a [1] b [1]") == ["[1]"]
    assert one(spark, T.citation_numbers(F.col("text")), "[1], [2-5], [7, 9, 10]") == [1, 2, 3, 4, 5, 7, 9, 10]
    assert one(spark, T.citation_numbers(F.col("text")), "[5-3]") == []


def test_contexts(spark):
    got = one(spark, T.contexts(F.col("text"), F.lit("[1]"), 3), "abcdef[1]ghijkl[1]m")
    assert got == ["...def[1]ghi...", "...jkl[1]m..."]


def test_sentences_keep_abbreviations(spark):
    assert one(spark, T.sentences(F.col("text")), "As shown by Smith et al. It works. See Fig. 2 for more. Done!") == ["As shown by Smith et al. It works.", "See Fig. 2 for more.", "Done!"]


def test_sentence_citations(spark):
    got = one(spark, T.sentence_citations(F.col("text")), "Smith and Lee (2020) agree [1, 2] (Brown, 2018; 2019b).")
    found = [(r["kind"], r["number"], r["author"], r["year"]) for r in got]
    assert ("numeric", 1, None, None) in found and ("numeric", 2, None, None) in found
    assert ("author_year", None, "Smith and Lee", "2020") in found
    assert ("author_year", None, "Brown", "2018") in found and ("author_year", None, "Brown", "2019b") in found


@pytest.mark.parametrize("author, key", [("Smith et al.", "smith"), ("Anderson & Lee", "anderson"), ("J. Doe and A. Roe", "doe")])
def test_author_key(spark, author, key):
    assert one(spark, T.author_key(F.col("text")), author) == key


def test_author_key_compat_cuts_inside_names(spark):
    assert one(spark, T.author_key(F.col("text"), compat=True), "Anderson") == ""


def test_references(spark):
    text = "# T\n\nBody [1].\n\n# References\n[1] A. Vaswani. Attention Is All You Need. NeurIPS,\n 2017.\n[2] J. Devlin. \"BERT: Pre-training\". 2018."
    entries = one(spark, T.split_entries(T.reference_block(F.col("text"))), text)
    assert len(entries) == 2 and entries[0].endswith("2017.")
    got = one(spark, F.transform(T.split_entries(T.reference_block(F.col("text"))), T.parsed_entry), text)
    assert [r["reference_number"] for r in got] == [1, 2] and got[0]["year"] == "2017" and got[1]["title"] == "BERT: Pre-training"


def test_reference_block_fallbacks(spark):
    body = "\n".join(["x"] * 7 + ["[1] A. B. 2001."] + ["y"] * 2)
    assert one(spark, T.reference_block(F.col("text")), body).startswith("[1]")
    assert one(spark, T.reference_block(F.col("text")), "\n".join("abcdefghij")) == "h\ni\nj"


def test_names_and_comparison(spark):
    row = spark.range(1).select(
        T.compare_metadata(F.lit("Deep {L}earning"), F.lit("Smith, John and Doe, Jane"), F.lit("2020"), F.lit("Deep Learning"), F.array(F.lit("John Smith"), F.lit("Jane Doe")), F.lit("2020")).alias("c")
    ).first()["c"]
    assert row["title_match"] and row["author_match"] and row["year_match"] and row["confidence"] == pytest.approx(1.0) and row["issues"] == []


def test_latex_and_fold(spark):
    assert one(spark, T.latex_norm(F.col("text")), r"\emph{Caf\'e} \textbf{na\"{i}ve} r\^{o}le") == "Cafe naive role"
    assert one(spark, T.ascii_fold(F.col("text")), "Éco ﬁn ñ") == "Eco fin n"


def test_inverted_index(spark):
    index = F.create_map(F.lit("hello"), F.array(F.lit(0)), F.lit("world"), F.array(F.lit(1), F.lit(2)))
    assert one(spark, T.abstract_from_index(index)) == "hello world world"


def test_keywords(spark):
    assert one(spark, T.reply_keywords(F.col("text")), '["a","b"]') == ["a", "b"]
    assert one(spark, T.reply_keywords(F.col("text")), '```json\n["a", "b"]\n```') == ["a", "b"]
    assert one(spark, T.reply_keywords(F.col("text")), "deep nets, graphs; text") == ["deep nets", "graphs", "text"]
    assert one(spark, T.keyword_bigrams(F.col("text")), "graph neural networks for the graph neural networks") == ["graph neural", "neural networks"]


def test_replies(spark):
    assert one(spark, T.reply_score(F.col("text")), "Score: 9") == 5.0 and one(spark, T.reply_score(F.col("text")), "nothing") == 5.0
    assert one(spark, T.sub_dimension_reply(F.col("text")), '```json\n{"score": 4, "reasoning": "ok"}\n```').asDict() == {"score": 4.0, "reasoning": "ok"}
    reply = "Pair 10: contradict (no)\nPair 1: support (yes)"
    assert one(spark, T.pair_judgment(F.col("text"), F.lit(1)), reply).asDict() == {"judgment": "support", "note": "yes"}


def test_headings(spark):
    assert one(spark, T.markdown_headings(F.col("text")), "# A #\ntext\n## B\n# A\n") == ["A", "B"]
    assert one(spark, T.is_heading(F.col("text")), "2.1 Related work") and not one(spark, T.is_heading(F.col("text")), "this is a plain sentence that ends.")
    assert one(spark, T.section_level(F.col("text")), "2.1.3 Details") == 3
    assert one(spark, T.section_prefix(F.col("text")), "2.1 Details").asDict() == {"number": "2.1", "label": "Details"}


def test_page_ranges(spark):
    assert one(spark, T.page_in_range(F.lit(9), "1-10")) and not one(spark, T.page_in_range(F.lit(9), "1-10", compat=True))
    assert one(spark, T.page_in_range(F.lit(3), "1,3,5"))


def test_scholar(spark):
    html = '<div class="gs_ri"><h3 class="gs_rt">[PDF] Deep <b>nets</b></h3><div class="gs_a">J Doe, A Roe - NeurIPS, 2019</div><a>Cited by 42</a></div>'
    assert one(spark, T.scholar_hit(F.col("text")), html).asDict() == {"title": "Deep nets", "year": "2019", "authors": "J Doe, A Roe", "cited_by": 42}


def test_reference_block_places(spark):
    block = lambda t: spark.createDataFrame([(t,)], "t string").select(T.reference_block(F.col("t")).alias("b")).first()["b"]
    assert block("a\n## References:\n[1] x") == "[1] x" and block("User preferences\nb\nMore\nand\nReferences\n[1] x") == "[1] x"
    assert block("a\nb\n[1] x\nc\n[2] y") == "[2] y" and block("a\n[1] x\nb\nc\nd\ne") == "[1] x\nb\nc\nd\ne"
    assert block("a\nb\nc\nd") == "c\nd" and block("") == ""
