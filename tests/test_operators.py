import math

import pytest

from quirelake.operators import coverage as C
from quirelake.operators import graph as G
from quirelake.operators import linkage as L
from quirelake.operators import paragraphs as P
from quirelake.operators import report as R
from quirelake.operators import temporal as Y
from quirelake.operators import voting as V


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def refs(spark, years, paper="p"):
    return spark.createDataFrame([(paper, y) for y in years], "paper_id string, year int")


def test_year_statistics(spark):
    assert rows(Y.year_counts(refs(spark, [2020, 2021, 2021, None])), "year", "cnt") == [("2020", 1), ("2021", 2), ("unknown", 1)]
    assert rows(Y.year_buckets(refs(spark, [2018, 2019, 2020, 2021, 2022]), 2), "start_year", "cnt") == [(2018, 2), (2020, 2), (2022, 1)]
    assert rows(Y.year_buckets(refs(spark, [2000, 2007]), 3), "start_year", "cnt") == [(2000, 1), (2003, 0), (2006, 1)]
    assert rows(Y.year_trend(refs(spark, [2020, 2021, 2021, 2022])), "year", "delta", "pct", "ma") == [(2020, None, None, None), (2021, 1, 100.0, None), (2022, -1, -50.0, 4 / 3)]
    assert rows(Y.top_years(refs(spark, [2020, 2020, 2021, 2022, 2022, 2022]), 2), "year", "cnt", "share") == [(2020, 2, 2 / 6), (2022, 3, 0.5)]
    with pytest.raises(ValueError):
        Y.year_buckets(refs(spark, [2000]), 0)


def test_temporal_metrics(spark):
    base = spark.createDataFrame([(2020, 10), (2021, 20), (2022, 40), (2015, 5)], "year int, cnt long")
    got = Y.temporal_metrics(refs(spark, [2020] * 2 + [2021] * 4 + [2022] * 5), base, 2022).first()
    assert (got.t1_span, got.t2_gap, got.t4_gap, got.t5_corr, got.status) == (2, 5, 1, 0.929, "success")
    none = Y.temporal_metrics(refs(spark, [None, None]), base, 2022).first()
    assert (none.t1_span, none.t5_corr, none.status) == (None, None, "no_valid_years")
    flat = Y.temporal_metrics(refs(spark, [2020, 2021, 2022]), base, 2022).first()
    assert flat.t5_corr is None


def test_gini(spark):
    values = lambda v: spark.createDataFrame([("p", x) for x in v], "paper_id string, v int")
    gini = lambda v: P.gini(values(v), "v").first()["gini"]
    assert gini([10, 10, 10, 10]) == 0 and gini([0, 0, 0]) == 0
    assert gini([40, 10, 5, 1]) == pytest.approx(402 / 224 - 5 / 4)


def test_hierarchy_and_rollup(spark):
    s = spark.createDataFrame([("p", 1, "Intro", 1, "main"), ("p", 2, "1.1 Setup", 2, "main"), ("p", 3, "Deep", 3, "main"), ("p", 4, "Next", 1, "main"), ("p", 5, "Appendix", 1, "appendix")], "paper_id string, section_index int, section_title string, level int, kind string")
    h = P.section_hierarchy(s)
    assert rows(h, "section_index", "parent_index", "root_index", "number") == [(1, None, 1, "1"), (2, 1, 1, "1.1"), (3, 2, 1, "1.1.1"), (4, None, 4, "2"), (5, None, 5, "A")]
    assert rows(P.parent_sections(s), "section_index", "parent_index") == [(1, None), (2, 1), (3, 2), (4, None), (5, None)]
    cit = spark.createDataFrame([("p", 2, "a", 0), ("p", 3, "a", 1), ("p", 4, "b", 2)], "paper_id string, section_index int, ref_key string, paragraph_index int")
    assert rows(P.section_rollup(cit, h), "section_index", "citations", "uniq") == [(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1)]


def test_alignment(spark):
    j = spark.createDataFrame([("p", k) for k in ["support"] * 80 + ["contradict"] * 10 + ["insufficient"] * 10], "paper_id string, judgment string")
    got = P.alignment_rates(j).first()
    assert got.contradiction_rate == 0.1111 and got.auto_fail
    edge = spark.createDataFrame([("p", k) for k in ["support"] * 19 + ["contradict"]], "paper_id string, judgment string")
    assert P.alignment_rates(edge).first().auto_fail


def graph(spark, edges, years):
    e = spark.createDataFrame([("p", a, b) for a, b in edges], "paper_id string, src string, dst string")
    n = spark.createDataFrame([("p", k, y) for k, y in years.items()], "paper_id string, id string, year int")
    return n, e


def test_small_graph(spark):
    n, e = graph(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("X", "A"), ("A", "A")], {"A": 2020, "B": 2021, "C": None})
    edges, stats = G.resolve_edges(e.where("src <> dst"), n)
    assert stats.first()["ratio"] == 0.25 and edges.count() == 3
    d = G.density(G.degrees(n, edges)).first()
    assert (d.n, d.m, d.isolates, d.density) == (3, 3, 0, 0.5)
    assert rows(G.weak_components(n, edges), "id", "component") == [("A", "A"), ("B", "A"), ("C", "A")]


def test_lag_and_warnings(spark):
    n, e = graph(spark, [("A", "B"), ("B", "A")], {"A": 2020, "B": 2022})
    lag = G.citation_lag(e, n).first()
    assert (lag.p50, lag.neg_ratio) == (-2, 0.5)
    s = spark.createDataFrame([("p", 2, 1, 0, 0.0, 0.0, 0.5, 3, False)], "paper_id string, n int, components int, isolates int, missing_ratio double, unresolved_ratio double, neg_ratio double, median_age int, betweenness_done boolean")
    assert rows(G.graph_warnings(s), "code") == [("BETWEENNESS_SKIPPED",), ("NEGATIVE_CITATION_LAG_HIGH",)]


def brute_pagerank(ids, edges, d=0.85, rounds=30):
    out = {i: [b for a, b in edges if a == i] for i in ids}
    r = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        new = dict.fromkeys(ids, (1 - d) / len(ids) + d * sum(r[i] for i in ids if not out[i]) / len(ids))
        for i in ids:
            for b in out[i]:
                new[b] += d * r[i] / len(out[i])
        r = new
    return r


@pytest.mark.parametrize("small", [100, 0])
def test_pagerank_and_components_both_ways(spark, small):
    n, e = graph(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("E", "F")], dict.fromkeys("ABCDEFG", 2000))
    got = {r.id: r.pr for r in G.pagerank(n, e, small_edges=small, rounds=5).collect()}
    want = brute_pagerank("ABCDEFG", [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("E", "F")], rounds=5)
    assert sum(got.values()) == pytest.approx(1) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert rows(G.weak_components(n, e, small_edges=small), "id", "component") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "A"), ("E", "E"), ("F", "E"), ("G", "G")]


def test_centres(spark):
    ids = [f"P{i}" for i in range(10)]
    n, e = graph(spark, [(f"P{i}", "P0") for i in range(1, 10)] + [("P9", "P1")], dict.fromkeys(ids, 2000))
    deg = G.degrees(n, e)
    ranks = G.pagerank(n, e)
    assert rows(G.centres(deg, ranks), "centre") == [("P0",)]
    assert {r.cluster for r in G.authority_clusters(n, e, deg, ranks).collect()} == {0}


def test_elbow(spark):
    values = lambda v: spark.createDataFrame([("p", x) for x in v], "paper_id string, deg int")
    assert G.elbow_k(values([50, 40, 30, 10, 5, 3, 2, 2, 1, 1]), 2, 8).first()["k"] == 4
    assert G.elbow_k(values([5] * 5), 2, 8).first()["k"] == 2
    assert G.elbow_k(values([]), 2, 8).collect() == []


def test_betweenness_and_clusters(spark):
    n, e = graph(spark, [("A", "B"), ("B", "C"), ("A", "D"), ("D", "C")], dict.fromkeys("ABCD", 2000))
    assert rows(G.betweenness(e), "id", "betweenness") == [("A", 0.0), ("B", 0.5), ("C", 0.0), ("D", 0.5)]
    assert rows(G.cocitation_pairs(e, 1), "a", "b", "weight") == [("B", "D", 1)]
    two, cliques = graph(spark, [(a, b) for part in ("ABC", "XYZ") for a in part for b in part if a < b] + [("C", "X")], dict.fromkeys("ABCXYZ", 2000))
    for found in (G.louvain_clusters(two, cliques), G.spectral_clusters(two, cliques, topk=2)):
        label = {r.id: r.cluster for r in found.collect()}
        assert label["A"] == label["B"] == label["C"] != label["X"] and label["X"] == label["Y"] == label["Z"]


@pytest.mark.parametrize("a, b, nmi, ari", [("1122", "1122", 1, 1), ("1122", "1111", 0, 0), ("1122", "1212", 0, -0.5), ("1111", "1111", 1, 1)])
def test_agreement(spark, a, b, nmi, ari):
    labels = spark.createDataFrame([("p", x, y) for x, y in zip(a, b, strict=True)], "paper_id string, la string, lb string")
    got = G.label_agreement(labels, "la", "lb").first()
    assert got.nmi == pytest.approx(nmi, abs=1e-9) and got.ari == pytest.approx(ari, abs=1e-9)


def test_real_edges(spark):
    r = spark.createDataFrame([("p", "a", ["key:a"]), ("p", "b", ["key:b", "openalex:W456"]), ("p", "c", ["doi:10.1000/c"])], "paper_id string, key string, tokens array<string>")
    t = spark.createDataFrame([("p", "a", 0, ["openalex:W456"]), ("p", "a", 1, ["doi:10.1000/c"]), ("p", "a", 2, ["doi:none"])], "paper_id string, source string, target_id int, tokens array<string>")
    edges, stats = L.real_edges(r, t)
    assert rows(edges, "src", "dst") == [("a", "b"), ("a", "c")]
    s = stats.first()
    assert (s.n_edges, s.resolved, s.unresolved, s.status) == (2, 2, 1, "ok")


def test_links(spark):
    r = spark.createDataFrame([("p", "r1", 1, 0, "Smith, J", "2020"), ("p", "r1b", 1, 1, "Lee", "2019"), ("p", "r2", 2, 2, "Anderson, B", "2018")], "paper_id string, key string, reference_number int, pos int, author string, year string")
    c = spark.createDataFrame([("p", 1), ("p", 2), ("p", 9)], "paper_id string, reference_number int")
    assert rows(L.link_numeric(c, r), "reference_number", "ref_key") == [(1, "r1b"), (2, "r2"), (9, None)]


def test_coverage(spark):
    c = spark.createDataFrame([("p", 0, "Graph neural networks", "10.1/A"), ("p", 1, "Deep residual learning", None), ("p", 2, "Unknown", None)], "paper_id string, pos int, title string, doi string")
    r = spark.createDataFrame([("p", 0, "k0", "Something else", "10.1/a"), ("p", 1, "k1", "Learning deep residual", None)], "paper_id string, pos int, key string, title string, doi string")
    m = C.match_candidates(c, r)
    assert rows(m, "pos", "match_type", "ref_key") == [(0, "doi", "k0"), (1, "title", "k1"), (2, None, None)]
    assert C.coverage(m).first()["rate"] == pytest.approx(2 / 3)
    cache = spark.createDataFrame([("p", "k0", 5), ("p", "k1", 5000)], "paper_id string, key string, citation_count long")
    assert rows(C.suspicious(m, cache), "ref_key", "cnt") == [("k0", 5)]


def test_votes(spark):
    v = lambda s: spark.createDataFrame([("p", "d", f"m{i}", i, float(x)) for i, x in enumerate(s)], "paper_id string, sub_id string, model string, pos int, score double")
    got = V.vote_stats(v([2, 4, 5])).first()
    assert got.med == 4 and got.sd == pytest.approx(1.5275, abs=1e-4) and got.high_disagreement
    assert V.vote_stats(v([2])).collect() == []
    assert V.majority_vote(v([7, 7, 8, 7])).first()["mode_score"] == 7
    assert V.without_extremes_rows(v([2, 5, 6, 7, 9])).count() == 5
    assert V.without_extremes_rows(v([1, 1, 1, 1, 1, 50])).count() == 5
    conf = lambda s: V.combined_vote(v(s)).first()["confidence"]
    assert conf([7, 7, 7]) == 1 and conf([7]) == 0.75


def test_overall(spark):
    d = spark.createDataFrame([("p", "V1", 4.0)], "paper_id string, sub_id string, final_score double")
    got = V.weighted_overall(d).first()
    assert (got.overall, got.grade) == (4.0, "B")


def test_debate(spark):
    e = spark.createDataFrame([("p", "x", 9.0), ("p", "x", 5.0), ("q", "x", 9.0), ("q", "y", 5.0)], "paper_id string, dimension string, score double")
    assert rows(V.next_step(e), "paper_id", "step") == [("p", "debate"), ("q", "END")]


def test_report(spark):
    papers = spark.createDataFrame([("p", "a.md")], "paper_id string, source_path string")
    metrics = spark.createDataFrame([("p", "C3", 0.05), ("p", "C5", 0.95)], "paper_id string, metric_id string, value double")
    dims = spark.createDataFrame([("p", "verifier", "V1", 2.0, "original", 0.0, ""), ("p", "expert", "E1", 4.5, "original", 1.5, "")], "paper_id string, agent string, sub_id string, final_score double, source string, sd double, reasoning string")
    overall = spark.createDataFrame([("p", 3.25)], "paper_id string, overall double")
    text = R.report(papers, metrics, dims, overall).first()["report"]
    assert "**Grade:** C" in text and "Low orphan rate" in text and "Strong verification" in text and "(high variance)" in text and "- V1 (2.0)" in text
