"""Each operator on documents against brute force, and on odd and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm.boosted_trees import BoostedTrees, quality_scores, statistics
from quirelake.llm.exact_dedup import DigestIndex, exact_duplicates
from quirelake.llm.mixing import poisson_mix
from quirelake.llm.packing import op7_tokenizer, pack
from quirelake.llm.pu_toxicity import NonNegativePU, toxicity_scores
from quirelake.llm.rolling_windows import remove_repeats, with_ties, NO_ID
from quirelake.llm.token_groups import shingle_components
from tests.llm.conftest import ODD


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def corpus(n=120, seed=3):
    """Prose with exact and near copies, shared passages and frequent words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    docs, base = [], [rng.choice(vocabulary) for _ in range(90)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        elif kind == 1:
            at = rng.randrange(30)
            text = [rng.choice(vocabulary) for _ in range(60)]
            text[at:at] = passage
        elif kind == 2 and docs:
            text = rng.choice(docs)[1].split()
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        docs.append((i, " ".join(text)))
    return docs


# Exact dedup


def test_exact_duplicates(spark):
    docs = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (4, "a b "), (7, None), (8, "")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {5: (3, 3, False), 3: (3, 3, True), 9: (3, 3, False), 4: (4, 1, True), 7: (7, 2, True), 8: (7, 2, False)}


def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    DigestIndex(spark, path, 4).add(make([(1, "a"), (2, "b")])).collect()
    spark.sql(f"DROP TABLE {DigestIndex(spark, path, 4).name}")  # as in a new session
    again = DigestIndex(spark, path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(make([(10, "a"), (11, "c"), (12, "c")])).collect()}
    assert got == {10: (1, False), 11: (11, True), 12: (11, False)}
    assert again.rows().where("entry").count() == 3 and again.rows().agg({"n_rows": "sum"}).first()[0] == 5
    again.drop()


def test_exact_odd(odd, empty):
    assert exact_duplicates(odd).count() == len(ODD) and exact_duplicates(empty).count() == 0
    kept = [r.doc_id for r in exact_duplicates(odd).where("kept").collect()]
    assert kept.count(4) == 2 and 7 not in kept


# Substring dedup


def brute_repeats(rows, width):
    """Rows by any identity that sorts."""
    first, texts = {}, {d: words(t) for d, t in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - width + 1):
            first.setdefault(tuple(texts[d][i : i + width]), (d, i))
    out = {}
    for d, w in texts.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (d, i):
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("width", [3, 20])
def test_repeats(spark, width):
    rows = [*corpus(), (500, "again " * 70)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, buckets=64).collect()}
    assert got == brute_repeats(rows, width)


def test_repeats_odd(odd, empty):
    got = remove_repeats(odd, 2).collect()
    assert len(got) == len(ODD) and remove_repeats(empty).count() == 0
    assert sorted(r.n_removed for r in got if r.doc_id == 4) == [0, 2] and [r.n_removed for r in got if r.doc_id == 7] == [2]
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id is None) == [(11, 0)]


def run(letter, n):
    return " ".join(f"{letter}{i}" for i in range(n))


@pytest.mark.parametrize("shared", [5, None])
def test_rows_that_share_an_id_lose_only_what_repeats(spark, shared):
    rows = [(0, run("a", 30)), (shared, run("b", 60)), (shared, f"{run('c', 20)} {run('a', 30)} {run('d', 10)}")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_text[:2]) for r in got) == [(30, 0, "a0"), (60, 0, "b0"), (60, 30, "c0")]


@pytest.mark.parametrize("shared", [5, None])
def test_equal_rows_of_one_id_keep_one(spark, shared):
    rows = [(shared, run("a", 30))] * 5 + [(shared, run("b", 25))] * 3
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(25, 0), (25, 25), (25, 25), (30, 0), *[(30, 30)] * 4]


def test_shared_ids_against_plain_python(spark):
    """Ids for several rows each and none for many; the order among such rows is read from the numbers given to them."""
    texts = [t for _, t in corpus(120, 8)]
    rows = [(None if i % 5 == 0 else i % 17, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tied = with_ties(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")).collect()
    assert len({(r.doc_id, r.tie) for r in tied}) == len(rows)
    want = brute_repeats([((r.doc_id, r.tie), r.text) for r in tied], 20)
    assert Counter((r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, 20, buckets=64).collect()) == Counter(want.values())


# N-gram Jaccard join


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("seed", [3, 11])
def test_components(spark, seed):
    rows = [*corpus(90, seed), (900, "A b C"), (901, "a B c"), (902, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components_odd(odd, empty):
    got = shingle_components(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (4, 7)} == {4}
    assert [r.component_id for r in got if r.doc_id in (1, 2, 3)] and shingle_components(empty).count() == 0


# Mixing


def test_mix_means_and_determinism(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"), F.lit("text").alias("text"))
    out = poisson_mix(docs, {"big": 1.0, "small": 3.0})
    sizes = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(sizes["big"] - 1000) < 150 and abs(sizes["small"] - 3000) < 250
    again = poisson_mix(docs.repartition(7), {"big": 1.0, "small": 3.0})
    assert out.exceptAll(again).isEmpty() and again.exceptAll(out).isEmpty()
    large = poisson_mix(docs, {"big": 1.0, "small": 3.0}, epochs=40.0).groupBy("source").count().collect()
    assert all(abs(r["count"] - 40 * (1000 if r.source == "big" else 3000)) < 3500 for r in large)


def test_mix_odd(odd, empty):
    got = poisson_mix(odd, epochs=3.0).collect()
    counts = Counter((r.doc_id, r.text) for r in got)
    assert counts[(4, "one two")] % 2 == 0 and poisson_mix(empty).count() == 0


# Packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i, t, f"s{i % 3}") for i, t in corpus(60)] + [(70, None, None), (70, "again", "s0"), (71, "long " * 3000, "s1")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), op7_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(op7_tokenizer())
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, _ in rows)
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, list(np.frombuffer(bytes(r.ids), "<u4"))))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert Counter((d, tuple(x for _, ids in sorted(p) for x in ids)) for (d, _), p in pieces.items()) == want
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == max(sequences)


def test_windows_keep_shares(spark):
    rows = [(i, "alpha beta gamma delta " * 20, "a" if i % 4 else "b") for i in range(2000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), op7_tokenizer())
    source = {i: s for i, _, s in rows}
    shares = defaultdict(Counter)
    for r in got.collect():
        shares[r.sequence_id // 16][source[r.doc_id]] += r.length
    for w in list(shares)[:-1]:
        assert abs(shares[w]["b"] / sum(shares[w].values()) - 0.25) < 0.02


def test_packing_odd(odd, empty):
    assert {r.doc_id for r in pack(odd, op7_tokenizer()).collect()} == {r[0] for r in ODD} and pack(empty, op7_tokenizer()).count() == 0


# Classifiers


def labelled(n=600, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, rude = rng.random() < 0.3, rng.random() < 0.2
        text = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(30, 90))]
        if bad:
            text = [w + "###" for w in text]
        if rude:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["nasty", "vile"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(rude)))
    return docs, labels


@pytest.mark.parametrize("score, column", [(quality_scores, 1), (toxicity_scores, 2)])
def test_held_out_accuracy(spark, score, column):
    docs, labels = labelled()
    out = score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {r[0]: r[column] for r in labels}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_classifiers_odd(spark, odd, empty, score):
    some = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 1, 0), (7, None, None), (8, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(odd, some).count() == len(ODD) and score(empty, some).count() == 0
    assert score(odd, some.where("false")).count() == len(ODD)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert BoostedTrees().fit(x[:5], np.ones(5)).predict(x[:2]).min() > 0.9


def test_statistics_of_odd_texts():
    assert statistics(None) == statistics("  ") and len(statistics("a")) == len(statistics("b c\nb c"))


@pytest.mark.parametrize("prior", [0.05, 0.9])
def test_risk_and_gradient_by_finite_differences(prior):
    """Both branches: a small prior leaves the negative part above zero, a large one takes it below."""
    rng = np.random.default_rng(2)
    n_p, n_u, width = 7, 11, 5
    rows = [sorted(rng.choice(width, 2, replace=False).tolist()) for _ in range(n_p + n_u)]
    columns, owners = np.array(rows).reshape(-1), np.repeat(np.arange(n_p + n_u), 2)
    model, w = NonNegativePU(width, prior), rng.normal(size=width + 1)
    w[:-1] += 1.5 if prior > 0.5 else 0

    def plain(w):
        z = [sum(w[c] for c in r) + w[-1] for r in rows]
        loss = lambda x: float(np.log1p(np.exp(-x)))
        plus, minus = prior * sum(loss(x) for x in z[:n_p]) / n_p, sum(loss(-x) for x in z[n_p:]) / n_u - prior * sum(loss(-x) for x in z[:n_p]) / n_p
        return plus, minus

    value, sound, gradient = model.risk(w, columns, owners, n_p, n_u)
    plus, minus = plain(w)
    assert sound == (minus >= 0) and abs(value - plus - max(0.0, minus)) < 1e-12
    stepped = (lambda w: sum(plain(w))) if sound else (lambda w: -plain(w)[1])
    for k in range(width + 1):
        e = np.eye(width + 1)[k] * 1e-6
        assert abs((stepped(w + e) - stepped(w - e)) / 2e-6 - gradient[k]) < 1e-6


def test_risk_finds_hidden_positives():
    rng = np.random.default_rng(1)
    positive = [[0, int(rng.integers(1, 20))] for _ in range(200)]
    unlabelled = [[0, 5] for _ in range(100)] + [[int(rng.integers(1, 20))] for _ in range(900)]
    model = NonNegativePU(20, 0.1).fit(positive, unlabelled)
    assert model.score([[0]])[0] > 0.5 > model.score([[3]])[0]


def test_hash_of_kept_text(spark):
    got = remove_repeats(spark.createDataFrame([(1, "a  b")], "doc_id long, text string")).first()
    assert hashlib.sha256(got.kept_text.encode()).hexdigest() == hashlib.sha256(b"a b").hexdigest()
