import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import class_ngrams as cn
from quirelake.llm.class_ngrams import class_scores, fit_classes, gain, is_training, likelihood, word_counts

SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def trains(d):
    return zlib.crc32(str("" if d is None else d).encode()) % 7 != 2


def counted(rows):
    return Counter(t for d, text in rows if trains(d) for t in tokens(text))


def brute_base(rows):
    c = counted(rows)
    n, v = sum(c.values()), len(c)
    return [(d, not trains(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows]


def corpus(n=240, seed=2):
    """Two languages of alternating parts of speech: what follows depends on the class of the word before."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = "ab"[i % 2]
        text = [f"{lang}{'nv'[k % 2]}{min(rng.randrange(60), rng.randrange(60))}{'xyz'[k % 2]}" for k in range(rng.randrange(4, 60))]
        rows.append((i, " ".join(text) + rng.choice(["", " Rare%d" % i, "\tA B"])))
    return rows


def found(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("known", [0, 20, 100_000])
def test_counts_and_base_score(spark, known):
    """Words whose counts every task holds, words that meet theirs in the exchange, and both."""
    rows = corpus()
    got = class_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), known=known, rounds=1)
    assert found(got) == sorted(brute_base(rows), key=str)


def test_one_class_gives_the_base_score(spark):
    got = class_scores(spark.createDataFrame(corpus(), SCHEMA), classes=1).collect()
    assert all(abs(r.score - r.base_score) < 1e-6 for r in got)


@pytest.fixture
def fitted(spark):
    rows = spark.createDataFrame(corpus(), SCHEMA).select(is_training(F.col("doc_id")).alias("training"), F.col("text").cast("binary").alias("text")).repartition(3)
    return rows, *fit_classes(rows, word_counts(rows), classes=8, words=100, known=50, rounds=8)


def test_model_against_plain_python(spark, fitted):
    """Transitions and emissions from the classes alone; they sum to 1 after every class; the scores are theirs."""
    rows, (_, model, history) = corpus(), fitted
    assert max(history) > history[0] and len(set(model.classes[1:100].tolist())) > 3
    c, pairs = counted(rows), Counter()
    for d, t in rows:
        if trains(d):
            k = [0, *(model.class_of(w) for w in tokens(t))]
            pairs.update(zip(k[:-1], k[1:], strict=True))
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[model.class_of(w)] += k
        v[model.class_of(w)] += 1
    total = sum(n.values())
    before = Counter()
    for (a, _), k in pairs.items():
        before[a] += k
    step = lambda a, b: (pairs[a, b] + (n[b] + 1) / (total + 8)) / (before[a] + 1)
    emit = lambda w: (c[w] + 1) / (n[model.class_of(w)] + v[model.class_of(w)] + 1)
    for a in range(8):
        assert abs(sum(step(a, b) for b in range(8)) - 1) < 1e-9
        assert abs(sum(10 ** (model.log_transition[a, model.class_of(w)]) * emit(w) for w in c) + sum(step(a, b) / (n[b] + v[b] + 1) for b in range(8)) - 1) < 1e-9
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for r in class_scores(docs, classes=8, words=100, known=50, rounds=8).collect():
        words = tokens(rows[r.doc_id][1])
        k = [0, *(model.class_of(w) for w in words)]
        want = sum(math.log10(step(a, b) * emit(w)) for a, b, w in zip(k[:-1], k[1:], words, strict=True))
        assert abs(r.score - want) < 1e-6 and abs(r.perplexity - 10 ** (-want / len(words))) < 1e-6 * r.perplexity


def test_held_out_texts_gain(spark):
    got = class_scores(spark.createDataFrame(corpus(), SCHEMA)).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_gathered_pairs_are_those_of_the_texts(spark, monkeypatch):
    """In small batches and large ones."""
    monkeypatch.setattr(cn, "BATCH_TOKENS", 500)
    units = {b"": 0, b"an1x": 1, b"av2y": 2}
    rows = corpus()
    got = {}
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("text").cast("binary").alias("text")).repartition(3)
    for r in docs.select("text").mapInArrow(cn.unit_pairs(units, 3), "bucket int, kind byte, payload binary").collect():
        for key, n in zip(*cn._unpacked(bytes(r.payload)), strict=True):
            got[r.kind, int(key)] = got.get((r.kind, int(key)), 0) + int(n)
    of = lambda w: units.get(w, 3 + cn.ending(w))
    want = Counter()
    for _, t in rows:
        k = [0, *map(of, tokens(t))]
        for a, b in zip(k[:-1], k[1:], strict=True):
            want[0, b * cn.UNITS + a] += 1
            want[1, a * cn.UNITS + b] += 1
    assert got == want
    merged = Counter()
    for r in cn.gathered_pairs(docs, units, 3).collect():
        for kind, payload in ((0, r.lefts), (1, r.rights)):
            merged.update({(kind, int(k)): int(n) for k, n in zip(*cn._unpacked(bytes(payload)), strict=True)})
    assert merged == want


def test_gain_is_the_difference_of_likelihoods():
    rng = np.random.default_rng(0)
    bigrams, classes, size = rng.integers(0, 6, (12, 12)).astype(float), rng.integers(1, 5, 12), 5

    def table(k):
        out = np.zeros((size, size))
        np.add.at(out, (k[:, None], k[None, :]), bigrams)
        return out

    for u in range(12):
        others = np.arange(12) != u
        left, right = (np.bincount(classes[others], x[others], size) for x in (bigrams[:, u], bigrams[u]))
        rest = table(classes)
        rest[:, classes[u]] -= left
        rest[classes[u], :] -= right
        rest[classes[u], classes[u]] -= bigrams[u, u]
        rises = gain(rest, left, right, bigrams[u, u])
        for b in range(size):
            moved = classes.copy()
            moved[u] = b
            assert abs(rises[b] - rises[classes[u]] - (likelihood(table(moved)) - likelihood(table(classes)))) < 1e-8


def test_odd_texts(spark, odd, empty):
    assert class_scores(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = class_scores(odd)
    assert found(got) == sorted(brute_base(rows), key=str) and all(math.isfinite(r.score) for r in got.collect())


def test_no_training_documents(spark):
    rows = [(i, "a b") for i in range(60) if not trains(i)]
    got = class_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
