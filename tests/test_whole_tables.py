"""Queries that take their whole table, against brute force and their SQL."""

from collections import Counter, defaultdict, deque

import __spark_entry__ as entry
import duckdb
import numpy as np
import pytest

from quirelake.operators import graph as G
from quirelake.operators import linkage as L
from quirelake.plans.analog import EDGES_SQL

SMALL = "/root/testdata/sf0.001"


def documents():
    return duckdb.connect().execute(f"SELECT doc_id, source || ':' || lang, 'n:' || n_chars FROM '{SMALL}/documents.parquet'").fetchall()


def pairs_of(rows):
    """Ordered pairs of keys that share a class in either place."""
    return {(k, m) for k, *a in rows for m, *b in rows if k != m and any(x is not None and x == y for x, y in zip(a, b, strict=True))}


def test_token_edge_classes_cover_all_documents(spark):
    got = [tuple(r) for r in entry.queries()["token_edge_classes"](spark, SMALL).select("doc_id", "class_a", "class_b", "links").collect()]
    docs = documents()
    want = pairs_of(docs)
    assert sorted(r[0] for r in got) == sorted(d[0] for d in docs)
    assert pairs_of([r[:3] for r in got]) == want
    assert {r[0]: r[3] for r in got} == {d[0]: sum(1 for p in want if p[0] == d[0]) for d in docs}


def test_token_edge_classes_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute("select doc_id, class_a, class_b, links from (" + entry.oracle_sql()["token_edge_classes"] + ")").fetchall()
    got = entry.queries()["token_edge_classes"](spark, SMALL).select("doc_id", "class_a", "class_b", "links").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_classes_of_nulls(spark):
    rows = [(1, "x", "n"), (2, "x", None), (3, None, "n"), (4, None, None), (5, "x", "n"), (6, "y", "m")]
    got = L.token_classes(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, 1, 3), (2, 1, None, 2), (3, None, 1, 2), (4, None, None, 0), (5, 1, 1, 3), (6, 6, 6, 0)]


def part_edges():
    """All edges between parts, and all parts, ids as text."""
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    edges = con.execute(f"WITH {EDGES_SQL} SELECT src::VARCHAR, dst::VARCHAR FROM edges").fetchall()
    return edges, [r[0] for r in con.execute("SELECT p_partkey::VARCHAR FROM part").fetchall()], con


def components_of(edges, nodes):
    near, found = defaultdict(set), {}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for v in sorted(nodes):
        if v not in found:
            queue = deque([v])
            found[v] = v
            while queue:
                for w in near[queue.popleft()]:
                    if w not in found:
                        found[w] = v
                        queue.append(w)
    return found


def brandes(edges):
    """One search for each node."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    score = dict.fromkeys({v for e in edges for v in e}, 0.0)
    for s in score:
        paths, depth, before, order, queue = defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v] if v in out else ():
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        owed = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                owed[v] += paths[v] / paths[w] * (1 + owed[w])
            if w != s:
                score[w] += owed[w]
    return score


def test_betweenness_of_the_whole_graph(spark):
    edges, nodes, _ = part_edges()
    comp = components_of(edges, nodes)
    largest = Counter(comp.values()).most_common(1)[0][0]
    want = brandes([e for e in edges if comp[e[0]] == largest])
    got = {r["id"]: r["betweenness"] for r in entry.queries()["betweenness"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-5)


def test_betweenness_in_several_shares(spark):
    g = np.random.default_rng(3)
    papers = {p: [(str(a), str(b)) for a, b in g.integers(0, n, (m, 2))] for p, n, m in (("p", 40, 60), ("q", 25, 300))}
    papers["chain"] = [(f"{i:03}", f"{i + 1:03}") for i in range(150)]
    df = spark.createDataFrame([(p, a, b) for p, edges in papers.items() for a, b in edges], "paper_id string, src string, dst string")
    got = {(r["paper_id"], r["id"]): r["betweenness"] for r in G.betweenness(df, sources=7).collect()}
    assert got == pytest.approx({(p, v): x for p, edges in papers.items() for v, x in brandes(edges).items()})


def test_betweenness_with_a_hub_in_many_groups(spark, monkeypatch):
    """A node that half of all links meet at, and so little work to a group that there are as many as the cores allow."""
    monkeypatch.setattr(G, "SEARCH_STEPS", 100)
    g = np.random.default_rng(5)
    edges = {(str(a), str(b)) for a, b in g.integers(0, 900, (2500, 2)) if a != b} | {("7", str(i)) for i in range(0, 900, 2) if i != 7} | {(str(i), "7") for i in range(1, 900, 2) if i != 7}
    df = spark.createDataFrame([("p", a, b) for a, b in sorted(edges)], "paper_id string, src string, dst string")
    dealt = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *args: dealt.append(args[0]) or repartition(self, *args))
    got = {r["id"]: r["betweenness"] for r in G.betweenness(df).collect()}
    assert got == pytest.approx(brandes(sorted(edges)))
    assert max(dealt) >= 4 * spark.sparkContext.defaultParallelism


def test_clusters_of_the_whole_graph(spark):
    edges, nodes, _ = part_edges()
    linked = {v for e in edges for v in e}
    got = {r["id"]: r["cluster"] for r in entry.queries()["louvain_clusters"](spark, SMALL).collect()}
    assert got.keys() == set(nodes)
    und = {tuple(sorted(e)) for e in edges}
    held = Counter()
    for e in und:
        held.update(got[v] for v in e)
    inside = sum(got[a] == got[b] for a, b in und) / len(und)
    assert inside - sum((x / 2 / len(und)) ** 2 for x in held.values()) > 0.05
    got = {r["id"]: r["cluster"] for r in entry.queries()["authority_clusters"](spark, SMALL).collect()}
    assert got.keys() == linked


def test_whole_graph_components_warnings_and_drawing(spark):
    edges, nodes, con = part_edges()
    sizes = Counter(Counter(components_of(edges, nodes).values()).values())
    assert {r["size"]: r["cnt"] for r in entry.queries()["components_hist"](spark, SMALL).collect()} == dict(sizes)
    year = dict(con.execute("SELECT l_partkey::VARCHAR, min(year(o_orderdate)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1").fetchall())
    lags = [year[a] - year[b] for a, b in edges if a in year and b in year]
    want = {"BETWEENNESS_SKIPPED"}
    want |= {"NEGATIVE_CITATION_LAG_HIGH"} if sum(x < 0 for x in lags) / len(lags) > 0.05 else set()
    want |= {"MANY_COMPONENTS"} if sum(sizes.values()) > max(10, len(nodes) // 20) else set()
    want |= {"ISOLATES_HIGH"} if len(set(nodes) - {v for e in edges for v in e}) / len(nodes) > 0.05 else set()
    assert {r["code"] for r in entry.queries()["graph_warnings"](spark, SMALL).collect()} == want
    assert entry.queries()["mermaid"](spark, SMALL).first()["diagram"] == con.execute(entry.oracle_sql()["mermaid"]).fetchone()[0]
