import random
import re
import zlib
from collections import Counter

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from quirelake.llm.spelling import near_pairs, spelling_variants

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    """By trying every edit of the longer word."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(words):
    """Words bucketed by all their deletions: a plainer exact search."""
    buckets, near = {}, {w: set() for w in words}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            buckets.setdefault(v, set()).add(w)
    for group in buckets.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    return near


def brute(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near, form = brute_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed=3):
    rng, rows = random.Random(seed), []
    stems = ["abcdefg", "abcdefgh", "àbcdÉfgh", "aaaaaaaa", "Banalités", "xbcdefg", "zzzzzzzzzzzzz"]
    weights = [400, 30, 60, 300, 200, 3, 90]
    for i in range(400):
        text = []
        for _ in range(40):
            w = rng.choices(stems, weights)[0]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice("abéÿ") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abéÀ") + w[at + 1 :]])
            text.append(w + rng.choice(["", ".", "2", "-"]))
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("group", [2, 24, 10_000])
def test_variants_against_plain_python(spark, group):
    """Every group halved down to one code point, the usual size, and none halved."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert found(spelling_variants(docs, group=group)) == want
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] and v[1] != v[0] for v in want.values())


def test_one_hot_segment(spark):
    """All words share their first half and length; few are one edit apart."""
    rng = random.Random(1)
    words = sorted({"hotword" + "".join(rng.choice("abcdef") for _ in range(7)) for _ in range(3000)})
    pairs = near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    near = brute_near(words)
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == {tuple(sorted((a, b))) for a in words for b in near[a]}


def test_whole_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = found(entry.queries()["op13_spelling_variants"](spark, SMALL))
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_texts(spark, odd, empty):
    assert found(spelling_variants(odd)) == {}
    assert spelling_variants(empty).count() == 0
    rows = [(None, "Ünknown WORDING wording"), (None, "wording wordings"), (1, None), (1, ""), (2, "wordings " * 40), (2, "wordings " * 40), (3, "y" * 60_000 + " " + "y" * 60_000), (4, "y" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert found(spelling_variants(docs)) == brute(rows)
