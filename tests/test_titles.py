import random

import pytest

from quirelake.operators import coverage as C
from quirelake.operators import titles as T


def subsequence(x, y):
    """The plain table."""
    row = [0] * (len(y) + 1)
    for a in x:
        last = row
        row = [0]
        for j, b in enumerate(y):
            row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
    return row[-1]


def ratio(x, y):
    return 200.0 * subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0


def some_titles(rng, n):
    """Titles with edits of one another, of 0 to some 70 characters, copies and other alphabets among them."""
    letters = "abcdeé日\U0001f600"
    made = []
    for _ in range(n):
        if made and rng.random() < 0.7:
            t = list(rng.choice(made))
            for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
                at = rng.randrange(len(t) + 1)
                if rng.random() < 0.5:
                    t.insert(at, rng.choice(letters + " "))
                elif at < len(t):
                    del t[at]
            made.append("".join(t))
        else:
            made.append(" ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 9))))
    return made


def key(t):
    return " ".join(sorted(t.lower().split()))


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        x, y = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2))
        assert T.common_subsequence(x, y) == subsequence(x, y)


@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.93, 1.0])
def test_near_keys_are_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    made = some_titles(rng, 150)
    rows = [(rng.choice("pq"), t) for t in made] + [("p", None), ("q", ""), ("q", "  ")]
    df = spark.createDataFrame(rows, "paper_id string, title string")
    keys = df.select("paper_id", T.word_key(df["title"]).alias("key"))
    left, right = keys.where("length(key) % 2 = 0 or key is null"), keys.where("length(key) % 3 <> 1")
    want = {(p, key(t)) for p, t in rows if t is not None}
    some = {(p, a, b, ratio(a, b)) for p, a in want for q, b in want if p == q and len(a) % 2 == 0 and len(b) % 3 != 1 and ratio(a, b) >= threshold * 100}
    got = [tuple(r) for r in T.near_keys(left, right, threshold, ["paper_id"]).collect()]
    assert len(got) == len(set(got)) and set(got) == some and len(some) > 20
    every = {(a, b, ratio(a, b)) for _, a in want for _, b in want if a < b and ratio(a, b) >= threshold * 100}
    got = [tuple(r) for r in T.near_key_pairs(keys, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == every


def test_similar_titles(spark):
    rows = [(1, "Deep nets"), (2, "deep  NETS"), (3, "deep net"), (4, "nets dep"), (5, None), (6, ""), (7, "other")]
    got = {r.id: (r.n_near, r.nearest) for r in T.similar_titles(spark.createDataFrame(rows, "id int, title string")).collect()}
    assert got == {1: (2, "deep net"), 2: (2, "deep net"), 3: (2, "deep nets"), 4: (2, "deep nets"), 5: (0, None), 6: (0, None), 7: (0, None)}
    empty = spark.createDataFrame([], "id int, title string")
    assert T.similar_titles(empty).isEmpty()


def test_threshold_must_leave_parts(spark):
    with pytest.raises(ValueError):
        T.near_key_pairs(spark.createDataFrame([("a",)], "key string"), 0.5)


def test_match_candidates_over_a_corpus(spark):
    """Without ``by`` the candidates of one table meet the references of another, the first in place on ties."""
    rng = random.Random(3)
    made = some_titles(rng, 120)
    c, r = made[:60], made[60:]
    got = C.match_candidates(
        spark.createDataFrame([(i, t, None) for i, t in enumerate(c)], "pos int, title string, doi string"),
        spark.createDataFrame([(i, f"k{i}", t, None) for i, t in enumerate(r)], "pos int, key string, title string, doi string"),
        by=[],
    )
    first = lambda t: next((f"k{i}" for i, x in enumerate(r) if x and ratio(key(t), key(x)) >= 85), None)
    assert {x.pos: x.ref_key for x in got.collect()} == {i: first(t) for i, t in enumerate(c)}


def test_keys_too_long_to_count(spark, monkeypatch):
    """Keys of more characters than a count holds are not bounded by their characters, so none is lost."""
    monkeypatch.setattr(T, "BITS", 4)
    rng = random.Random(9)
    made = sorted({key(t) for t in some_titles(rng, 80)})
    want = {(a, b) for a in made for b in made if a < b and ratio(a, b) >= 85}
    assert any(len(a) > 16 for a, _ in want)
    assert {(r.left_key, r.right_key) for r in T.near_key_pairs(spark.createDataFrame([(k,) for k in made], "key string")).collect()} == want


def test_blocks_lose_no_pair_and_bound_what_a_group_holds(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rng = random.Random(8)
    made = sorted({key(t) for t in some_titles(rng, 120)})
    keys = spark.createDataFrame([(k,) for k in made], "key string")
    sizes = T._blocked([keys], [], True).groupBy("_a", "_b").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < len(made) // 2
    got = sorted((r.left_key, r.right_key) for r in T.near_key_pairs(keys).collect())
    assert got == [(a, b) for a in made for b in made if a < b and ratio(a, b) >= 85]
