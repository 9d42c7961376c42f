"""Steps that several others read are written once; sentences that an abbreviation ends, and their citations."""

from pyspark.sql import functions as F

from quirelake import engine
from quirelake.functions import text as T
from quirelake.operators import paragraphs as P
from quirelake.sources import layout


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_steps_are_written_once(spark):
    """What several steps read is not made again by each: no plan holds the parse or the fold that it comes from."""
    papers = spark.createDataFrame([("p", "# A\n\nB [1].\n\n## References\n\n[1] C. Title. 2000.")], "paper_id string, text string")
    found = engine.extract(papers)
    assert "aggregate(" not in optimized(found.references) and "aggregate(" not in optimized(found.citations) and found.citations.first().ref_key == "ref_1"
    assert "from_json" not in optimized(layout.paragraphs(spark.createDataFrame([("p", "{}")], "paper_id string, layout string")))
    rows = spark.createDataFrame([("p", 1, 1, "main", "x")], "paper_id string, section_index int, level int, kind string, section_title string")
    cited = spark.createDataFrame([("p", 1, "r", 1)], "paper_id string, section_index int, ref_key string, paragraph_index int")
    assert "aggregate(" not in optimized(P.section_rollup(cited, P.section_hierarchy(rows)))


def test_abbreviations_and_citations_of_odd_sentences(spark):
    rows = ["", "et al.", "ET AL.  ", "in Fig.", "x e.g.\n", "no", "al.", None, "A (B, 2001; 2002b; C 1999) [1, 3-4]", "Kipf (2017) and (see 2001)", "[2]"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = {r.i: (r.a, None if r.c is None else [(c.marker, c.author, c.year) for c in r.c]) for r in df.select("i", T.ends_with_abbreviation(F.col("s")).alias("a"), T.sentence_citations(F.col("s")).alias("c")).collect()}
    assert [got[i][0] for i in range(len(rows))] == [False, True, True, True, False, False, False, None, False, False, False]
    assert [m for m, _, _ in got[8][1]] == ["[1]", "[3]", "[4]"] + ["(B, 2001; 2002b; C 1999)"] * 3 and [(a, y) for _, a, y in got[8][1][3:]] == [("B", "2001"), ("B", "2002b"), ("C", "1999")]
    assert [(a, y) for _, a, y in got[9][1]] == [("Kipf", "2017"), ("see", "2001")] and got[10][1] == [("[2]", None, None)] and got[7][1] is None and got[0][1] == []


def test_tables_that_grow_with_the_papers_are_not_broadcast(spark):
    """However small the files that they were written to are."""
    papers = spark.createDataFrame([("p", "# A\n\nB [1]. C (2000).\n\n## References\n\n[1] C. Title. 2000.")], "paper_id string, text string")
    found = engine.extract(papers)
    rates = P.orphan_rate(found.references, found.citations)
    assert [(r.total, r.uncited) for r in rates.collect()] == [(1, 0)]
    assert "Broadcast" not in rates._jdf.queryExecution().executedPlan().toString()
