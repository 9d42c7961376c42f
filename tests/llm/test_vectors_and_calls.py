import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm.common import connected_components
from quirelake.llm.cover_tree import CoverTree, dual_links, near_duplicates, unit
from quirelake.llm.tool_calls import CALLS, RESULTS, SCHEMAS, link_tool_calls, parse_messages, turns_as_calls


def vectors(n=260, seed=0, groups=6, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    x = np.concatenate([base[rng.integers(groups, size=n // 2)] + rng.normal(scale=0.12, size=(n // 2, dim)), rng.normal(size=(n - n // 2, dim))])
    x[10] = x[11] = x[12]
    return x.astype(np.float32)


def brute(x, labels, threshold=0.93):
    u = unit(list(x))
    link = (u @ u.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    part = np.arange(len(x))
    while True:
        new = np.array([min([part[i], *part[link[i]]]) for i in range(len(x))])
        if (new == part).all():
            return link.sum(1), part
        part = new


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_dual_traversal_counts_every_link(seed):
    x = unit(list(vectors(seed=seed)))
    tree = CoverTree(x)
    for a, b in zip(tree.levels, tree.levels[1:], strict=False):
        assert set(a) <= set(b)
    count, _, left, right = dual_links(tree, tree, np.ones(len(x)), np.ones(len(x)), True)
    want, part = brute(x, np.zeros(len(x)))
    assert (count == want).all()
    assert all(part[a] == part[b] for a, b in zip(left, right, strict=True))


@pytest.mark.parametrize("cell_rows", [2048, 20])
def test_near_duplicates(spark, cell_rows):
    x = vectors()
    labels = np.arange(len(x)) % 2
    labels[10:13] = 1
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell_rows).collect()}
    count, part = brute(x, labels)
    assert got == {i: (int(c), int(p), i == p) for i, (c, p) in enumerate(zip(count, part, strict=True))}


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1, "x"), (1, [], 1, "x"), (2, [0.0, 0.0], 1, "x"), (3, [1.0, None], 1, "x"), (4, [nan, 1.0], 1, "x"), (5, [inf, 1.0], 1, "x"), (6, [1.0, 0.0], None, "x"), (7, [1.0, 0.0], 1, "x"), (8, [2.0, 0.0], 1, "x"), (9, [1.0, 0.0, 0.0], 1, "x"), (None, [1.0, 0.0], 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got[7] == (1, 7, True) and got[8] == (1, 7, False)
    assert all(got[i] == (0, i, True) for i in (0, 1, 2, 3, 4, 5, 6, 9)) and len(got) == len(rows)
    assert near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_paths_and_stars(spark, few):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 5)], "src long, dst long"), few=few).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(40)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long"), few=few).count() == 0


def test_trees_save_distances():
    """Tight groups far apart: the bounds leave a small part of the pairs to compare, and the links are those of all pairs."""
    rng = np.random.default_rng(5)
    x = unit((np.repeat(rng.normal(size=(40, 16)), 25, axis=0) + rng.normal(size=(1000, 16)) * 0.02).tolist())
    work, tree = Counter(), CoverTree(x)
    count, _, u, v = dual_links(tree, tree, np.ones(len(x)), np.ones(len(x)), True, work=work)
    gram = x @ x.T
    assert work["distances"] < len(x) ** 2 / 4
    assert (count == (gram >= 0.93).sum(1) - 1).all() and (gram[u, v] >= 0.93 - 1e-9).all()


def test_vectors_in_double_precision(spark):
    """Two doubles that floats can't tell apart stand on either side of the threshold."""
    angle = np.arccos(0.93)
    rows = [(1, [1.0, 0.0], "a"), (2, [float(np.cos(angle - 1e-12)), float(np.sin(angle - 1e-12))], "a"), (3, [1.0, 0.0], "b"), (4, [float(np.cos(angle + 1e-12)), float(np.sin(angle + 1e-12))], "b")]
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


TOOLS = {"search": {"q": ("string", True), "k": ("integer", False)}}


def link(spark, messages, tools=TOOLS):
    df = spark.createDataFrame([(1, i, r, t if isinstance(t, str) or t is None else json.dumps(t)) for i, (r, t) in enumerate(messages)], "conv_id long, turn long, role string, text string")
    return {r.call_id: r for r in link_tool_calls(*parse_messages(df), tools).collect()}


def call(id_, args, name="search", after=()):
    return {"tool_calls": [{"id": id_, "name": name, "arguments": args if isinstance(args, str) or args is None else json.dumps(args), "depends_on": list(after)}]}


def test_linking(spark):
    got = link(spark, [
        ("assistant", call("a", {"q": "x", "k": 2})), ("tool", {"tool_call_id": "a", "content": "r"}), ("assistant", call("b", {"k": "no", "q": "x"})), ("assistant", call("c", "not json")),
        ("assistant", call("d", {}, "other")), ("assistant", call("e", {"q": "x", "z": 1})), ("assistant", call("f", {"q": "x"}, after=["missing"])), ("assistant", call("g", {"q": None})),
        ("tool", {"tool_call_id": "lost", "content": "r"}), ("assistant", call("h", {"q": "z"})), ("user", None), ("assistant", "plain"),
    ])
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "bad_arguments", "c": "bad_json", "d": "unknown_tool", "e": "bad_arguments", "f": "bad_dependency", "g": "bad_arguments", "lost": "orphan", "h": "unanswered"}
    assert got["a"].json == '{"arguments":{"k":2,"q":"x"},"id":"a","name":"search","result":"r"}'
    assert all(json.loads(r.json)["id"] == k for k, r in got.items())


def test_topological_order(spark):
    got = link(spark, [("assistant", call("a", {"q": "1"}, after=["c"])), ("assistant", call("b", {"q": "2"}, after=["a"])), ("assistant", call("c", {"q": "3"})), ("assistant", call("d", {"q": "4"}, after=["e"])), ("assistant", call("e", {"q": "5"}, after=["d"]))])
    assert (got["c"].level, got["a"].level, got["b"].level) == (0, 1, 2)
    assert got["d"].status == got["e"].status == "cycle"
    backward = link(spark, [("assistant", call("a", {"q": "1"})), ("assistant", call("b", {"q": "2"}, after=["a"]))])
    assert (backward["a"].level, backward["b"].level) == (0, 1) and backward["a"].turn < backward["b"].turn


@pytest.mark.parametrize("seed", range(2))
def test_levels_by_brute_force(spark, seed):
    """Random dependencies, forward and backward, some in cycles, some on calls that don't exist; a long chain beside them."""
    rng = random.Random(seed)
    rows = [(c, t, 0, f"k{t}", "search", '{"q":"x"}', [f"k{rng.randrange(14)}" for _ in range(rng.choice([0, 0, 1, 2]))]) for c in (1, 2, None) for t in range(12)]
    rows += [(3, t, 0, f"k{t}", "search", '{"q":"x"}', [f"k{t + 1}"] if t < 40 else []) for t in range(41)]
    got = {(r.conv_id, r.call_id): (r.level, r.status) for r in link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), TOOLS).collect()}
    needs = {(r[0], r[3]): [(r[0], d) for d in r[6]] for r in rows}

    def level(k, path=()):
        if k in path:
            return None
        below = [level(d, (*path, k)) for d in needs[k] if d in needs]
        return None if None in below else max(below, default=-1) + 1

    for k in needs:
        want = "bad_dependency" if any(d not in needs for d in needs[k]) else "cycle" if level(k) is None else "unanswered"
        assert got[k] == (level(k), want), k


def test_odd_calls(spark):
    """Null and repeated identifiers, null conversations, null and very long arguments, clashing columns, empty tables."""
    long = json.dumps({"q": "y" * 300_000})
    rows = [
        (1, 0, 0, None, "search", '{"q":"1"}', None), (1, 0, 0, None, "search", '{"q":"1"}', None), (1, 1, 0, None, "search", None, ["a"]), (1, 2, 0, "a", "search", '{"q":"2"}', [None]),
        (1, 2, 1, "a", "search", '{"q":"3"}', []), (None, 0, 0, "a", None, '{"q":"4"}', []), (None, None, None, "b", "search", long, ["a", "a"]), (2, 0, 0, "", "search", "", []),
    ]
    answers = [(1, 3, None, "lost"), (1, 3, None, "lost"), (1, 9, "a", "late"), (1, 4, "a", None), (None, 1, "b", "r"), (2, 0, "", "")]
    clash = {c: F.lit("z") for c in ("call", "needs", "level", "_rt", "_answer", "json")}
    calls, results = spark.createDataFrame(rows, CALLS), spark.createDataFrame(answers, RESULTS)
    got = link_tool_calls(calls.withColumns(clash), results.withColumns(clash), TOOLS).collect()
    shown = sorted(((r.conv_id, r.call_id, r.level, r.turn, r.status) for r in got), key=str)
    assert shown == sorted([
        (1, None, 0, 0, "unanswered"), (1, None, 0, 0, "unanswered"), (1, None, 1, 1, "bad_json"), (1, "a", 0, 2, "bad_dependency"), (None, "a", 0, 0, "unknown_tool"), (None, "b", 1, None, "ok"),
        (2, "", 0, 0, "bad_json"), (1, None, None, 3, "orphan"), (1, None, None, 3, "orphan"),
    ], key=str)
    assert link_tool_calls(calls.where("false"), results.where("false"), TOOLS).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (None, 0, "user", ""), (2, 5, "assistant", "x"), (1, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.status for r in link_tool_calls(*turns_as_calls(df), SCHEMAS).collect()}
    assert got == {"1:0": "ok", "1:2": "bad_arguments", "none:0": "unanswered", "2:4": "orphan"}
    assert link_tool_calls(*turns_as_calls(df.where("false")), SCHEMAS).count() == 0
