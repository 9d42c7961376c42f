import pytest
from pyspark.sql import functions as F

from quirelake.llm.histogram_shard import histogram_shards


def check(out, shards):
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}, rows


def test_even_bytes_and_groups(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word ', id % 1500), cast(1 + id % 7 as int))").alias("text"))
    sizes, rows = check(histogram_shards(docs), 8)
    total = sum(sizes.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.05 * total / 8
    place = {}
    for r in rows:
        place.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in place.values())


def test_hot_group_is_cut(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes, _ = check(histogram_shards(docs), 8)
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, ""), (2, None), (2, None), (3, "é" * 5000), (4, "x")]])
def test_defined_cases(spark, rows):
    docs = spark.createDataFrame([(a, b, 7, "z") for a, b in rows], "doc_id long, text string, shard int, size string")
    sizes, out = check(histogram_shards(docs), 8)
    assert len(out) == len(rows)
    assert sorted(r["size"] for r in out) == sorted(len((b or "").encode()) + 1 for _, b in rows)


def test_against_a_plain_sharder(spark):
    """Sizes, checksums, gapless slots and near-equal bytes, with columns called like the work's own."""
    import zlib
    from collections import defaultdict

    texts = [None, "", "ü", "same text"] + [f"text {i} " + "x" * (i * 37 % 400) for i in range(3000)]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(5000 + i, "same text", "kept") for i in range(900)]
    made = spark.createDataFrame(rows, "doc_id long, text string, _k1 string").withColumn("_start", F.lit("a")).withColumn("_Row", F.lit("b")).withColumn("size", F.lit("c"))
    got = histogram_shards(made, 8).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert len(got) == len(rows) and {(r["_k1"], r["_start"], r["_Row"]) for r in got} == {("kept", "a", "b")}
    shards, total = defaultdict(list), sum(r.size for r in got)
    for r in got:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(8))
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 8) <= 0.03 * total / 8
