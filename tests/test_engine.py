import json

import pytest

from quirelake import config, engine
from quirelake.sources import readers as S

PAPER = """# A survey of nets

## 1 Introduction

Nets work [1, 2]. More nets [2].

## 2 Methods

Graphs help [3].

## References

[1] A. Vaswani. Attention is all you need. 2017.
[2] J. Devlin. BERT models. 2018.
[3] T. Kipf. Graph networks. 2019.
[4] X. Nobody. Uncited work. 2001.
"""


def test_extraction_and_link(spark, tmp_path):
    (tmp_path / "a.md").write_text(PAPER)
    ex = engine.extract(S.read_papers(spark, str(tmp_path)))
    assert engine.P.orphan_rate(ex.references, ex.citations).first()["rate"] == pytest.approx(0.25)


def test_config(tmp_path, monkeypatch, spark):
    monkeypatch.setenv("LIMIT_NAME", "louvain")
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"sources": {"a": True, "b": {"priority": 1}, "c": False}, "graph": {"clustering": "${LIMIT_NAME}", "recency_windows": [3]}, "weights": {"V1_x": 2.0}, "merge": "${NOT_SET:union}", "unknown": 1}))
    c = config.load(str(path))
    assert c.graph.clustering == "louvain" and c.graph.recency_windows == (3,) and c.merge == "union"
    assert [(r.source, r.enabled) for r in c.source_table(spark).collect()] == [("a", True), ("b", True), ("c", False)]
    assert config.load() == config.Config()
    with pytest.raises(ValueError):
        engine.analyze_graph(spark.createDataFrame([("p", "k", 1)], "paper_id string, key string, year int"), spark.createDataFrame([("p", "k", "k")], "paper_id string, src string, dst string"), 2020, config.GraphConfig(clustering="none"))


def judge(model, context, attempt):
    if model == "flaky" and attempt == 1:
        raise ValueError("busy")
    if model == "broken":
        raise RuntimeError("down")
    return "Score: 3" if "R2" in context else "rating = 4"


def test_papers_to_reports(spark):
    """Two papers at once, one of them without a reference list, through every step."""
    bare = "# Bare notes\n\n## 1 Introduction\n\nNothing is cited here.\n"
    papers = spark.createDataFrame([("p", "a.md", PAPER), ("q", "b.md", bare)], "paper_id string, source_path string, text string")
    refs = engine.extract(papers).references
    meta = [(r.paper_id, r.key, "index", 0, r.title, [r.author], r.year) for r in refs.collect() if r.paper_id == "p" and r.reference_number != 4]
    metadata = spark.createDataFrame(meta, "paper_id string, key string, source string, pos int, title string, authors array<string>, year string")
    keys = {r.reference_number: r.key for r in refs.collect()}
    title = next(r.title for r in refs.collect() if r.reference_number == 1)
    targets = spark.createDataFrame([("p", keys[2], "t1", ["doi:10.1/x"]), ("p", keys[3], "t2", [])], "paper_id string, source string, target_id string, tokens array<string>")
    candidates = spark.createDataFrame([("p", 0, title.upper(), None), ("p", 1, "A missing classic", None)], "paper_id string, pos int, title string, doi string")
    judgments = spark.createDataFrame([("p", 0, "support", ""), ("p", 1, "contradict", "claims too much")], "paper_id string, pos int, judgment string, note string")
    baseline = spark.createDataFrame([(2017, 10), (2018, 20), (2019, 30)], "year int, cnt long")
    settings = config.Config(sources=(config.Source("index", priority=1),))
    got = engine.evaluate(papers, 2020, metadata, baseline, targets, candidates, judgments, ["calm", "flaky", "broken"], judge, config=settings)
    wide = {r.paper_id: r for r in got.metrics.collect()}
    assert set(wide) == {"p", "q"} and (wide["q"].c3, wide["q"].c5) == (1.0, 0.0)  # without a list the last lines are taken for it
    w = wide["p"]
    assert w.c3 == pytest.approx(0.25) and w.c5 == pytest.approx(0.75) and w.g4 == pytest.approx(0.5) and w.c6_rate == pytest.approx(0.5) and w.c6_auto_fail
    assert w.t1 == 18 and w.g2 == 4 and w.g6_ratio == 1.0
    votes = got.votes.collect()
    assert {(v.model, v.attempts, v.score is None, v.error) for v in votes if v.paper_id == "p"} == {("calm", 1, False, None), ("flaky", 2, False, None), ("broken", 3, True, "RuntimeError: down")}
    assert "V2" not in {v.sub_id for v in votes if v.paper_id == "p"} and {v.score for v in votes if v.sub_id == "R2" and v.model != "broken"} == {3.0}
    scores = {r.sub_id: (r.final_score, r.source) for r in got.dimensions.collect() if r.paper_id == "p"}
    assert scores["V1"] == (3.0, "original") and scores["V2"] == (1.0, "original") and scores["R2"] == (3.0, "corrected") and scores["R4"] == (4.0, "corrected")
    reports = {r.paper_id: r.report for r in got.reports.collect()}
    assert set(reports) == {"p", "q"} and "**Source:** b.md" in reports["q"]
    text = reports["p"]
    for part in ("C5=0.75", "1/2 supported", "G4=0.50", "Verify unverified references, particularly: " + keys[4], "Review flagged citation-claim contradictions: claims too much", "Consider adding key papers: A missing classic"):
        assert part in text
    grade = got.overall.where("paper_id = 'p'").first()["grade"]
    assert grade in "ABCDF" and f"**Grade:** {grade}" in text


def test_votes_of_odd_targets(spark):
    targets = spark.createDataFrame([("p", "a", None), ("p", "b", "x")], "paper_id string, sub_id string, context string")
    got = engine.J.judge_votes(targets, ["m", "n"], lambda model, text, attempt: None if model == "n" else f"score: {len(text)}", attempts=1).collect()
    assert sorted((r.sub_id, r.model, r.score, r.error) for r in got) == [("a", "m", 0.0, None), ("a", "n", 5.0, None), ("b", "m", 1.0, None), ("b", "n", 5.0, None)]
    assert engine.J.judge_votes(targets, [], lambda *a: "").count() == 0
