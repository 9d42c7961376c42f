"""Evidence operators and list trims on small rows."""

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import coverage as C
from quirelake.operators import evidence as E
from quirelake.operators import paragraphs as P


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def test_items_keep_digits_and_lose_blanks(spark):
    block = "  [1] A. Foo. One. 2010\n   continued 10 \n[2] B. Bar. Two. 2011 "
    assert one(spark, T.split_entries(F.col("t")), "t string", block) == ["[1] A. Foo. One. 2010 continued 10", "[2] B. Bar. Two. 2011"]
    assert one(spark, T.parsed_entry(F.col("t")), "t string", "No year here.  Title part 0. More.")["title"] == "Title part 0"
    assert one(spark, T.author_list(F.col("t")), "t string", " Ann One0 and  Bob Two1 ") == ["Ann One0", "Bob Two1"]


def test_citation_check(spark):
    got = one(spark, E.citation_check(F.col("t"), F.col("l")), "t string, l array<int>", "a [1], b [3-4] and [1].", [1, 4])
    assert (got["total_citations"], got["cited_numbers"], got["invalid_citations"], got["has_reference_list"]) == (3, [1, 3, 4], [3], True)
    assert one(spark, E.citation_check(F.col("t")), "t string", "none")["total_citations"] == 0


def test_small_values(spark):
    assert one(spark, F.array(E.required(F.col("t")), E.required(F.lit("2.5"))), "t string", None) == [-1.0, 2.5]
    assert one(spark, E.merged_maps(F.col("a"), F.col("b")), "a map<string,string>, b map<string,string>", {"x": "1", "y": "2"}, {"y": "3"}) == {"x": "1", "y": "3"}
    assert one(spark, E.block_font_size(F.col("s")), "s array<struct<size:double>>", [(10.0,), (14.0,)]) == 12.0
    found = one(spark, E.metric_with_extra(F.parse_json("j"), "a.c5", ["total", "none"]), "j string", '{"a": {"c5": 0.5, "total": 7}}')
    assert found["value"] == 0.5 and found["extra"] == {"total": "7"}
    heads = lambda size, known: one(spark, E.heading_text(F.col("t"), F.lit(size), F.lit(11.0), F.col("c")), "t string, c array<string>", "2 Method", known)
    assert heads(12.0, []) == "2 Method" and heads(10.0, []) is None and heads(12.0, ["a", "b", "c"]) is None and heads(12.0, ["a", "b", "2 Method"]) == "2 Method"


def test_entries_and_settings(spark):
    got = E.bib_entries(spark.createDataFrame([(" ", " A title ", None), ("k ", "x", "1999 ")], "key string, title string, year string")).collect()
    assert [tuple(r) for r in got] == [("A title", "A title", ""), ("k", "x", "1999")]
    settings = spark.createDataFrame([("default", "m0", "u0"), ("reader", "m1", None)], "agent string, model string, url string")
    got = E.agent_settings(spark.createDataFrame([("reader",), ("expert",)], "agent string"), settings).collect()
    assert {tuple(r) for r in got} == {("reader", "m1", "u0"), ("expert", "m0", "u0")}


def test_dispatch_and_texts(spark):
    reg = spark.createDataFrame([("verifier", "V2", "alignment", ["C6"]), ("verifier", "V4", "consistency", [])], "agent string, sub_id string, name string, metric_ids array<string>")
    metrics = spark.createDataFrame([("p", "C6", 0.1)], "paper_id string, metric_id string, value double")
    got = {r.sub_id: r for r in E.dispatch(reg, metrics, spark.createDataFrame([("C6", "rate")], "metric_id string, definition string"), spark.createDataFrame([("p", True)], "paper_id string, auto_fail boolean")).collect()}
    assert got["V2"].preset == 1.0 and got["V4"].preset is None and got["V4"].metrics == [] and got["V2"].metrics[0]["value"] == 0.1
    rubric = E.rubric_text(spark.createDataFrame([("a", 1, "V1", "n", "d", 1, "bad"), ("a", 1, "V1", "n", "d", 5, "good")], "agent string, pos int, sub_id string, name string, description string, score int, text string")).first()["rubric"]
    assert rubric == "## Scoring Rubric\n\n### V1: n\nd\n\n- **5**: good\n- **1**: bad\n"
    row = spark.createDataFrame([("V1", "n", "d", "", [("C5", 0.5, "share")], list("abcdefg"), ["w"])], "sub_id string, name string, description string, rubric string, metrics array<struct<metric_id:string,value:double,definition:string>>, items array<string>, warnings array<string>")
    text = row.select(E.context_text(row).alias("x")).first()["x"]
    assert "- C5: 0.5 (share)" in text and "- items: 7 items (showing first 5)\n  - a" in text and "  - f" not in text and text.endswith("## Warnings\n- w\n")
    assert one(spark, E.recommendation(F.lit("E1"), F.col("e"), F.lit(None).cast("double")), "e array<string>", ["x" * 40, "y"]) == f"Consider adding key papers: {'x' * 30}; y"
    assert one(spark, E.strength(F.lit("V1"), F.col("v")), "v double", 0.95) == "Strong verification rate (C5=0.95)"


def test_rows(spark):
    keys = spark.createDataFrame([("p", "a"), ("p", "b")], "paper_id string, key string")
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "a", "d")], "paper_id string, src string, dst string")
    nodes = E.shown_nodes(keys, keys, edges, 3)
    assert sorted((r.id, r.in_deg, r.out_deg) for r in E.degrees_among(nodes, edges).collect()) == [("a", 0, 1), ("b", 1, 1), ("c", 1, 0)]
    steps = spark.createDataFrame([(1, "x.json"), (3, "y.json")], "step int, path string")
    files = spark.createDataFrame([("p", "x.json"), ("p", "y.json"), ("q", "z")], "paper_id string, path string")
    assert {r.paper_id: r.step for r in E.reached_step(files, steps).collect()} == {"p": 3, "q": 0}
    words = spark.createDataFrame([("p", i, f"k{i}") for i in range(7)], "paper_id string, pos int, keyword string")
    found = spark.createDataFrame([("p", f"k{i}", j) for i in range(7) for j in range(4)], "paper_id string, keyword string, pos int")
    assert E.first_queries(words, found, 5, 2).count() == 10
    assert E.low_verification(spark.createDataFrame([("p", "C5", 0.1), ("q", "C5", 0.5)], "paper_id string, metric_id string, value double")).count() == 1
    titles = spark.createDataFrame([("p", "a"), ("p", "b")], "paper_id string, title string")
    assert [r.title for r in E.covered_candidates(titles, titles.where("title = 'a'")).collect()] == ["b"]


def test_titles_without_a_common_word_match(spark):
    c = spark.createDataFrame([("p", 0, "graph networks", None), ("p", 1, "nothing like it", None)], "paper_id string, pos int, title string, doi string")
    r = spark.createDataFrame([("p", 0, "k", "graphs network", None)], "paper_id string, pos int, key string, title string, doi string")
    assert {x.pos: x.ref_key for x in C.match_candidates(c, r).collect()} == {0: "k", 1: None}


def test_rollup_of_a_deep_chain(spark):
    chain = spark.createDataFrame([("p", i, i - 1 if i else None) for i in range(11)], "paper_id string, section_index int, parent_index int")
    cited = spark.createDataFrame([("p", i, f"r{i}", i) for i in range(11)], "paper_id string, section_index int, ref_key string, paragraph_index int")
    assert {r.section_index: (r.citations, r.uniq) for r in P.section_rollup(cited, chain).collect()} == {i: (11 - i, 11 - i) for i in range(11)}
