import random

import pytest

from quirelake.operators.coverage import contained_items


def corpus(seed=6):
    rng = random.Random(seed)
    words = ["Deep", "nets", "éTé", "of", "graphs", "and", "a", "b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 14]))) for i in range(60)] + [(100, None), (101, "  Nets of  "), (102, "ets"), (103, "deep"), (104, "Deep")]
    documents = [(i, text(rng.choice([0, 3, 40, 90])).replace(" ", rng.choice([" ", "  "]), 3)) for i in range(50)] + [(90, None), (91, "no"), (91, "nets of")]
    return items, documents


def brute(items, documents):
    return sorted((i, d) for i, t in items if t is not None for d, x in documents if x is not None and t.strip(" ").lower() in x.lower())


@pytest.mark.parametrize("most", [50_000, 65, 20, 0])
def test_contained_items_against_plain_python(spark, most):
    """One automaton, and runs of words with short items in parts of a size or in one."""
    items, documents = corpus()
    got = contained_items(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(documents, "doc_id long, text string").repartition(3), most=most)
    pairs = {(r.item_id, r.doc_id) for r in got.collect()}
    assert pairs == set(brute(items, documents)) and len(pairs) > 100
    assert got.dtypes == [("item_id", "int"), ("doc_id", "bigint")]


def test_one_scan_and_no_exchange(spark):
    items, documents = corpus()
    got = contained_items(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(documents, "doc_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_empty_items_and_tables(spark):
    items, documents = spark.createDataFrame([(1, " "), (2, "x")], "item_id string, text string"), spark.createDataFrame([(7, "ax"), (8, ""), (9, None)], "doc_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in contained_items(items, documents).collect()) == [("1", 7), ("1", 8), ("2", 7)]
    assert contained_items(items.where("false"), documents).count() == 0 and contained_items(items, documents.where("false")).count() == 0
