import random
import re
from itertools import permutations

import pytest

from quirelake.llm.filter_audit import filter_audit, order_steps

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    rank = lambda d: (d is None, d or 0)
    failed = []
    for d, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = any((u or "") == t and rank(o) < rank(d) for o, u, _ in rows)
        failed.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in failed}:
        for order in permutations("ABCDE"):
            left = [r for r in failed if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total = sum(r[0] == part and f in r[1] for r in failed)
                single = sum(r[0] == part and r[1] == {f} for r in failed)
                out[part, "".join(order), step] = [len(left), len(gone), total - len(gone), single, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(docs, labels):
    rows = filter_audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows) and all(r.filter == r.filter_order[r.step - 1] for r in rows)
    return found


def texts(n=120, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(["Alpha", "beta", "gamma"]) if rng.random() < 0.7 else f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 199, 200, 260]))]
        text = rng.choice(rows)[1] if rows and rng.random() < 0.3 else "  ".join(words) + rng.choice(["", "#", " |\x0b"])
        rows.append((i * 7 % n, text, rng.choice(["en", "fr", None])))
    return rows


def test_all_orders_against_plain_python(spark):
    rows = texts()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == brute(rows, labels)


def test_nulls_ties_and_repeats(spark):
    rows = [
        (None, "same text", "en"), (None, "same text", "en"), (3, "same text", None), (3, "same text", "fr"), (3, "same text", "fr"), (9, "same text", ""), (4, None, "en"), (5, "", "en"),
        (None, None, None), (6, "ÉÀ" * 3000 + " A" * 250, "en"), (7, "\t\n", "en"), (8, "x" * 100_000, "en"), (None, "alone", "de"),
    ]
    labels = [(3, 1, None), (3, 0, 1), (None, 1, 1), (9, None, None), (77, 1, 1), (6, 1, 0)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA + ", n int, digest string")
    assert result(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a", "en")], SCHEMA), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit(docs.where("false"), labels).count() == 0
    assert {r[:6] for r in result(docs, labels.where("false")).values()} == {(0, 1, 0, 1, 0, 0), (0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0)}


@pytest.mark.parametrize("step", order_steps()[:7])
def test_steps_add_one_filter(step):
    assert step["after"] == step["before"] | step["alone"] and step["filter"] == step["filter_order"][step["step"] - 1]
