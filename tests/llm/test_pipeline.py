"""Every stage of corpus_pipeline and the whole of it against plain Python, with odd tables."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quirelake.llm.packing import op7_tokenizer
from quirelake.llm.pu_toxicity import toxicity_scores

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, row string, digest string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", "c", "d") for i, t, s in rows], SCHEMA)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def keep_least(rows):
    """Of each near-duplicate component of rows (doc_id, text) the one with the least id, nulls last."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(a)
    return sorted((rows[min(g, key=lambda x: (rows[x][0] is None, rows[x][0] or 0, x))] for g in groups.values()), key=str)


def same_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_copies_go_row_by_row(spark):
    rows = [(1, "a", "s"), (2, "b", "s"), (2, "a", "s"), (None, "a", "s"), (None, "z  z", "s"), (7, None, "t"), (8, "", "t"), (9, "q\tq", "t"), (9, "q q", "t"), (3, "z z", None)]
    got = pairs(P.drop_copies(spark, make(spark, rows), SMALL))
    assert [(i, same_text(t)) for i, t in got] == sorted([(1, "a"), (2, "b"), (3, "z z"), (7, ""), (9, "q q")], key=str)
    assert P.drop_copies(spark, make(spark, rows), SMALL).columns == make(spark, rows).columns


def test_near_copies_go_row_by_row(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base, "s"), (3, base + " more", "s"), (3, "other words stand here alone now", "s"), (None, base + " end", "s"), (4, None, "s"), (6, "", "t"), (4, "x " * 9000, "t"), (None, "y", None)]
    rows += [(20 + i, " ".join(f"w{k if k % 9 else 900 + i}" for k in range(60)), "t") for i in range(12)]
    make(spark, rows).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    assert pairs(P.drop_near_copies(spark, docs, SMALL)) == keep_least([(i, t) for i, t, _ in rows])


def test_toxic_rows_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clashing = docs.withColumns({"score": F.lit("a"), "Predicted": F.lit("b")})
    scores = toxicity_scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in scores.where("predicted = 0").collect()}
    got = P.drop_toxic(spark, clashing, SMALL)
    assert got.columns == clashing.columns and {r.doc_id for r in got.collect()} == want


def test_mix_keeps_columns(spark):
    docs = make(spark, [(i, "w " * (i % 7), f"src{i % 3}") for i in range(300)])
    got = P.mix(spark, docs, SMALL)
    assert got.columns == docs.columns and got.count() > 0


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_empty_and_odd(spark, tmp_path, stage):
    rows = [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "word " * 20000, "s"), (2, "x" * 9000, None), (None, "a b", "t")]
    make(spark, rows).write.parquet(f"file://{tmp_path}/odd")
    docs = spark.read.parquet(f"file://{tmp_path}/odd")
    assert stage(spark, docs.where("false"), SMALL).count() == 0
    assert stage(spark, docs, SMALL).count() > 0


def test_whole_pipeline(spark):
    """Packing's pieces give back the tokens of what a plain run of the stages before it leaves."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = {r.doc_id for r in toxicity_scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 0").collect()}
    rows, seen, kept = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean), set(), []
    for i, t in rows:
        if same_text(t) not in seen:
            seen.add(same_text(t))
            kept.append((i, t))
    left = keep_least(kept)
    mixed = Counter(r.doc_id for r in P.mix(spark, docs.where(F.col("doc_id").isin([i for i, _ in left])), SMALL).collect())
    tokenizer, texts = Tokenizer.from_file(op7_tokenizer()), dict(left)
    want = Counter()
    for i, n in mixed.items():
        want[(i, tuple(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1]))] += n
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in P.run(spark, SMALL).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    got = Counter()
    for i, found in pieces.items():
        parts = defaultdict(list)
        for r in found:
            parts[r.start].append(tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()))
        tokens = next(t for (d, t) in want if d == i)
        assert all(tokens[s : s + len(p)] == p for s, ps in parts.items() for p in ps)
        assert sum(r.length for r in found) == len(tokens) * want[(i, tokens)]
        got[(i, tokens)] = want[(i, tokens)]
    assert got == want
    assert all(sum(n for _, n in s) == 2048 for k, s in sequences.items() if k != max(sequences))


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"] and os.path.exists(P.__file__)
