import json

import pytest
from pyspark.sql import functions as F

from quirelake.sources import metadata as M
from quirelake.sources import readers as S
from quirelake.sources.sinks import ResultStore
from quirelake.streaming.votes import windowed_votes

PAPER = """# A survey

Intro text [1]. More text.

## 1 Introduction

Deep nets work [1, 2]. Smith (2020) agrees.

## References

[1] A. Vaswani. Attention is all you need. 2017.
[2] J. Devlin. BERT. 2018.
"""


@pytest.fixture
def papers(spark, tmp_path):
    (tmp_path / "a.md").write_text(PAPER)
    (tmp_path / "b.md").write_text("# Only a title\n")
    return S.read_papers(spark, str(tmp_path))


def test_markdown(papers):
    assert papers.count() == 2
    parts = S.paragraphs(papers)
    sections = {r.section_title: (r.kind, r.level) for r in S.sections(parts).collect()}
    assert sections == {"A survey": ("title", 1), "1 Introduction": ("introduction", 1), "References": ("references", 1), "Only a title": ("title", 1)}
    cited = [(r.section_title, r.paragraph_index, r.reference_number, r.author) for r in S.citations(parts).where("section_title <> 'References'").collect()]
    assert sorted(cited, key=str) == sorted([("A survey", 0, 1, None), ("1 Introduction", 1, 1, None), ("1 Introduction", 1, 2, None), ("1 Introduction", 1, None, "Smith")], key=str)
    refs = S.references(papers).where("year <> ''").orderBy("pos").collect()
    assert [(r.key, r.year) for r in refs] == [("ref_1", "2017"), ("ref_2", "2018")]


def test_title_and_abstract(spark):
    row = spark.createDataFrame([("# Deep nets\n\n**Abstract**\n\nWe survey\nnets.\n\n# 1 Intro\nx",)], "text string").select(S.title_and_abstract(F.col("text")).alias("t")).first()["t"]
    assert row.asDict() == {"title": "Deep nets", "abstract": "We survey nets."}


def test_tei(spark, tmp_path):
    tei = """<TEI><listBibl><biblStruct xml:id="b0"><analytic><title>Attention</title><author><persName><forename>A</forename><surname>Vaswani</surname></persName></author></analytic>
    <monogr><title>NeurIPS</title><imprint><date when="2017-06">2017</date></imprint></monogr></biblStruct><biblStruct xml:id="b1"><monogr><title>A book</title><imprint><date>in 1999</date></imprint></monogr></biblStruct></listBibl></TEI>"""
    (tmp_path / "x.xml").write_text(tei)
    got = {r.title: (r.year, r.author) for r in S.read_tei(spark, str(tmp_path / "x.xml")).collect()}
    assert got["Attention"] == ("2017", "Vaswani, A") and got["A book"][0] == "1999"


def test_layout_and_blocks(spark):
    layout = {"pages": [{"number": 1, "blocks": [{"type": "heading", "text": "Intro", "lines": []}, {"type": "text", "lines": [{"spans": [{"text": "Method", "size": 12, "flags": 16}, {"text": "plain", "size": 10, "flags": 0}]}]}]}]}
    assert spark.createDataFrame([(json.dumps(layout),)], "j string").select(S.layout_headings(F.col("j")).alias("h")).first()["h"] == ["Intro", "Method"]
    tree = {"block_type": "Page", "markdown": "x", "children": [{"block_type": "SectionHeader", "markdown": "## Intro", "children": []}, {"block_type": "Text", "markdown": "body"}, {"block_type": "SectionHeader", "markdown": "# Intro"}]}
    rows = S.block_tree(spark.createDataFrame([("p", json.dumps(tree))], "paper_id string, json string"))
    assert [r.markdown for r in rows.orderBy("ord").collect()] == ["## Intro", "body", "# Intro"]
    assert [r.heading for r in S.tree_headings(rows, ["paper_id"]).collect()] == ["Intro"]


def test_service_rows(spark):
    def row(f, item):
        return spark.createDataFrame([(json.dumps(item),)], "j string").select(f(F.col("j")).alias("r")).first()["r"]

    c = row(M.crossref, {"title": ["T"], "author": [{"given": "A", "family": "B"}], "created": {"date-parts": [[2019, 1]]}, "published-online": {"date-parts": [[2018]]}, "DOI": "10.1/x"})
    assert (c.title, c.authors, c.year) == ("T", ["A B"], "2018")
    o = row(M.openalex, {"id": "https://openalex.org/w1", "title": "T", "abstract_inverted_index": {"hello": [0], "world": [1]}, "referenced_works": ["https://openalex.org/W2"]})
    assert (o.openalex_id, o.abstract, o.targets) == ("W1", "hello world", ["W2"])
    s = row(M.semantic_scholar, {"paperId": "p", "title": "T", "references": [{"paperId": "q"}, {"paperId": None, "externalIds": None}]})
    assert [t.semantic_scholar_id for t in s.reference_targets] == ["q"]
    assert row(M.dblp, {"title": "T.", "authors": {"author": {"text": "A"}}}).authors == ["A"]
    assert row(M.dblp, {"title": "T.", "authors": {"author": [{"text": "A"}, {"text": "B"}]}}).asDict()["title"] == "T"


def test_retry_and_pace():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert M.Retry(sleep=waits.append)(flaky) == (True, "ok") and waits == [0.5, 1.0]
    ok, error = M.Retry(sleep=waits.append)(lambda: 1 / 0)
    assert not ok and isinstance(error, ZeroDivisionError)
    now, slept = [0.0], []
    pace = M.Pace(3.0, clock=lambda: now[0], sleep=slept.append)
    pace.wait(), pace.wait()
    assert slept == [3.0]


def test_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    one = lambda p, v: spark.createDataFrame([(p, v)], "paper_id string, v int")
    store.save(one("a", 1), "validation"), store.save(one("b", 2), "validation"), store.save(one("a", 3), "validation")
    assert {(r.paper_id, r.v) for r in store.load("validation").collect()} == {("a", 3), ("b", 2)}
    change = lambda s, t: spark.createDataFrame([("a", s, "f")], "paper_id string, status string, source_path string").withColumn("updated_at", F.to_timestamp(F.lit(t)))
    store.update_index(change("running", "2024-01-01")), store.update_index(change("done", "2024-01-02"))
    store.compact_index()
    assert [r.status for r in store.index().collect()] == ["done"]
    with pytest.raises(ValueError):
        store.save(one("a", 1), "nothing")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1.0, "2024-01-01 00:10:00"), ("x", 5.0, "2024-01-01 00:20:00"), ("x", 1.0, "2024-01-01 05:00:00")], "sub_id string, score double, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_votes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("votes_out").start()
    q.processAllAvailable()
    q.stop()
    assert {r.n: r.high_disagreement for r in spark.table("votes_out").collect()} == {2: True, 1: None}


def test_a_failed_query_is_a_row_with_its_error(spark, tmp_path, monkeypatch):
    """One query works, one has no replies, one fails for good: none is lost without a word."""
    import sys

    (tmp_path / "replies_for_tests.py").write_text("def fetch(query):\n    if query == 'bad':\n        raise ValueError('no such field')\n    return ['{}', '[]'] if query == 'good' else []\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "replies_for_tests.py"))
    M.register(spark)
    rows = spark.read.format("metadata_service").options(module="replies_for_tests", function="fetch", queries="good\nbad\nnone", attempts="2", interval="0.01").load().collect()
    sys.modules.pop("replies_for_tests", None)
    assert sorted(map(tuple, rows), key=str) == [("bad", None, None, "ValueError: no such field"), ("good", 0, "{}", None), ("good", 1, "[]", None)]


def test_a_worker_has_one_pace_for_a_service():
    assert M.worker_pace("m", "f", 0.5) is M.worker_pace("m", "f", 0.5) is not M.worker_pace("m", "g", 0.5)
