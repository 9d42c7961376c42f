"""Titles alike up to inserted and deleted characters, over a corpus: the pairs whose ratio reaches a threshold, all of them.

The ratio of two titles is 200 * longest common subsequence / sum of lengths, taken of their lower-cased words in
order (code points of UTF-8, joined by one space). Random or short words share so many short parts that a join by parts
meets a third of all pairs, so pairs are compared outright, by blocks: keys are dealt to blocks of about ``BLOCK`` by
hash, and two blocks are one group. There a product of matrices counts the characters that two keys have in common,
whatever their order, which bounds the subsequence; that of the pairs left is taken in words of 64 bits, many pairs at
once, and of longer keys in wide integers. A group's memory depends on ``BLOCK``, not on the table; no pair is lost.

Equal keys are one row on each side, so copies of a title meet nothing twice.

Null titles are near none; titles without words have the empty key and are near each other only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quirelake.operators.graph import _cut

#: Kept away from the bounds, so that rounding never makes a bound narrower.
EPS = 1e-9


def word_key(title: Column) -> Column:
    """Lower-cased words in order, joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(title)), r"\s+"), lambda w: w != "")), " ")


def common_subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence; one wide integer holds a row, a bit for each place of ``x``."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    row = every = (1 << len(x)) - 1
    for c in y:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & every
    return len(x) - row.bit_count()


@F.pandas_udf(DoubleType())
def key_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """200 * longest common subsequence / sum of lengths of two keys; 100 for two empty ones, null beside a null."""
    for left, right in batches:
        yield pd.Series([None if x is None or y is None else 200.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(left, right, strict=True)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return key_ratio(word_key(a), word_key(b))


#: Characters are counted by code point modulo BUCKETS; of one bucket up to 2 ** BITS are told apart, the others count as alike.
BUCKETS, BITS = 64, 4
#: Keys of a block; two blocks are compared in one group.
BLOCK = 2048
#: Pairs whose subsequence is taken at once.
PAIRS = 1 << 16


def _counts(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A column for the first, second, ... last character told apart of each bucket, 1 where a key has so many, and how many more each key has."""
    deep = 1 << BITS
    n = np.zeros((len(codes), BUCKETS), np.int64)
    rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    np.add.at(n, (rows, np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.int64) % BUCKETS), 1)
    steps = (n[:, :, None] > np.arange(deep)).reshape(len(codes), -1).astype(np.float32)
    return steps, np.maximum(n - deep, 0).sum(1)


def _subsequences(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a[i]`` and ``b[j]``, ``a`` of at most 64 characters: ``common_subsequence``, a pair in a word."""
    every = np.unique(np.concatenate([*a, *b]))
    places = np.zeros((len(a), len(every)), np.uint64)
    for row, c in zip(places, a, strict=True):
        np.bitwise_or.at(row, np.searchsorted(every, c), np.uint64(1) << np.arange(len(c), dtype=np.uint64))
    long = np.array([len(c) for c in b])
    text = np.zeros((len(b), max(long.max(), 1)), np.int64)
    for row, c in zip(text, b, strict=True):
        row[: len(c)] = np.searchsorted(every, c)
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        left, right = i[at : at + PAIRS], j[at : at + PAIRS]
        row = np.full(len(left), ~np.uint64(0))
        for k in range(long[right].max()):
            met = row & np.where(k < long[right], places[left, text[right, k]], np.uint64(0))
            row = (row + met) | (row - met)
        out[at : at + PAIRS] = np.bitwise_count(~row)
    return out


def _near_in_block(left: list[str], right: list[str], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks whose ratio may reach the threshold: all that do, by their lengths, characters and, up to 64 of them, subsequence."""
    codes = [[np.frombuffer(k.encode("utf-32-le", "surrogatepass"), np.uint32) for k in side] for side in (left, right)]
    x, y = (np.array([len(c) for c in side]) for side in codes)
    (p, more_p), (q, more_q) = _counts(codes[0]), _counts(codes[1])
    used = np.flatnonzero(p.any(0) & q.any(0))
    least = np.ceil(threshold * (x[:, None] + y) / 2 - EPS)
    near = p[:, used] @ q[:, used].T + np.minimum(more_p[:, None], more_q) >= least
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    short = np.flatnonzero((x[i] <= 64) & (y[j] > 0))
    if len(short):
        fine = np.ones(len(i), bool)
        a, at_a = np.unique(i[short], return_inverse=True)
        b, at_b = np.unique(j[short], return_inverse=True)
        fine[short] = _subsequences([codes[0][v] for v in a], [codes[1][v] for v in b], at_a, at_b) >= least[i[short], j[short]]
        i, j = i[fine], j[fine]
    return i, j


def _blocked(sides: list[DataFrame], by: list[str], mirror: bool) -> DataFrame:
    """(by, _side, key, _a, _b): the keys of one or two sides dealt to blocks by hash, and a row for each pair of blocks that they are in."""
    keys = sides[0].withColumn("_side", F.lit(0)) if mirror else sides[0].withColumn("_side", F.lit(0)).unionByName(sides[1].withColumn("_side", F.lit(1)))
    keys = _cut(keys, "keys")
    n = keys.groupBy(*by).agg(*[F.ceil(F.count_if(F.col("_side") == s) / BLOCK).cast("int").alias(f"_n{s}") for s in (0, 1)])
    keys = keys.join(n, by) if by else keys.crossJoin(F.broadcast(n))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("_side") == 0, F.col("_n0")).otherwise(F.col("_n1"))).cast("int")
    keys = keys.withColumn("_k", block)
    upto = lambda n: F.filter(F.sequence(F.lit(0), n - 1), lambda v: v < n)
    if mirror:
        pairs = F.transform(upto(F.col("_n0")), lambda v: F.struct(F.least(v, "_k").alias("a"), F.greatest(v, "_k").alias("b")))
    else:
        pairs = F.when(F.col("_side") == 0, F.transform(upto(F.col("_n1")), lambda v: F.struct(F.col("_k").alias("a"), v.alias("b")))).otherwise(
            F.transform(upto(F.col("_n0")), lambda v: F.struct(v.alias("a"), F.col("_k").alias("b")))
        )
    return keys.select(*by, "_side", "key", "_k", F.explode(pairs).alias("_p")).select(*by, "_side", "key", "_k", F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"))


def _met(sides: list[DataFrame], threshold: float, by: list[str], mirror: bool) -> DataFrame:
    """(by, left_key, right_key) of the pairs that may reach the threshold, each once."""
    blocked = _blocked(sides, by, mirror)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part["_a"].iloc[0], part["_b"].iloc[0]
        first = part["_k"] == a if mirror else part["_side"] == 0
        left = part.loc[first, "key"].tolist()
        same = mirror and a == b
        right = left if same else part.loc[~first, "key"].tolist()
        i, j = _near_in_block(left, right, threshold, same) if left and right else ([], [])
        frame = pd.DataFrame({"left_key": [left[v] for v in i], "right_key": [right[v] for v in j]}, dtype="object")
        for at, k in enumerate(by):
            frame.insert(at, k, part[k].iloc[0])
        return frame

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sides[0].select(*by).schema)
    tasks = max(200, 4 * blocked.sparkSession.sparkContext.defaultParallelism)
    return blocked.repartition(tasks, *by, "_a", "_b").groupBy(*by, "_a", "_b").applyInPandas(run, f"{keys}left_key string, right_key string")


def near_keys(left: DataFrame, right: DataFrame, threshold: float = 0.85, by: list[str] | None = None) -> DataFrame:
    """(by, left_key, right_key, ratio): pairs of a ``key`` (see ``word_key``) of each side whose ratio is at least 100 * threshold."""
    _check(threshold)
    by = by or []
    a, b = (side.select(*by, "key").where("key is not null").distinct() for side in (left, right))
    return _reaching(_met([a, b], threshold, by, False), threshold)


def near_key_pairs(keys: DataFrame, threshold: float = 0.85, by: list[str] | None = None) -> DataFrame:
    """(by, left_key, right_key, ratio): different keys of one table, each pair once, ``left_key < right_key``."""
    _check(threshold)
    by = by or []
    every = keys.select(*by, "key").where("key is not null").distinct()
    met = _met([every], threshold, by, True)
    return _reaching(met.select(*by, F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key")), threshold)


def _reaching(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.withColumn("ratio", key_ratio("left_key", "right_key")).where(F.col("ratio") >= threshold * 100)


def _check(threshold: float) -> None:
    if not 0.5 < threshold <= 1:
        raise ValueError("a threshold above 0.5 and up to 1 is needed")


def similar_titles(rows: DataFrame, threshold: float = 0.85, by: list[str] | None = None) -> DataFrame:
    """``rows`` (by, title, ...) with n_near (other keys within the threshold), nearest (the key of greatest ratio, the least
    on ties) and nearest_ratio. Rows of one key get the same; pairs stay pairs of keys, which are written once."""
    by = by or []
    keyed = rows.withColumn("_key", word_key(F.col("title")))
    keys = _cut(keyed.select(*by, F.col("_key").alias("key")).where("key is not null").distinct(), "title-keys")
    pairs = near_key_pairs(keys, threshold, by)
    other = F.array(*[F.struct(F.col(a).alias("_key"), F.col(b).alias("near")) for a, b in (("left_key", "right_key"), ("right_key", "left_key"))])
    each = pairs.select(*by, "ratio", F.explode(other).alias("_o")).select(*by, "_o._key", "_o.near", "ratio")
    found = each.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("ratio")).alias("r"), "near")).alias("_b"))
    joined = keyed.join(found, [*by, "_key"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_b.near").alias("nearest"), (-F.col("_b.r")).alias("nearest_ratio"))
