"""Sharding by histogram sort, with DataFrame operations only.

The sort key of a row is (60-bit hash of the text, 60-bit hash of the id). Exact bytes below
candidate boundaries are counted across partitions: the first round cuts the whole key space
into equal bins, each later round cuts only the bins that still hold a splitter, until every
splitter meets its tolerance. Then the rows are exchanged once, by key range.

The driver sees only bin sums: at most 2**bits of them in the first round, and 2**bits for each
unsettled splitter later; both depend on the shard and range counts, never on the rows.

Law ``bytes``: shard sizes are near equal. Equal texts share a hash, so they stay together unless
their group is larger than ``group_tolerance`` of a shard; such a group is cut by the id's hash.

Defined cases: null text has size 1 and the crc of the empty text; a null id sorts by its own hash;
rows that repeat an id and a text are ordered arbitrarily among themselves; an empty table gives
no rows; further columns pass through unless their names are those of the results, which then
replace them.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import free_names, literal_table, materialize, table, unsigned_crc32

#: Bits of each of the two hashes, and the bits that one round of probes resolves.
KEY_BITS, ROUND_BITS = 60, 12
#: Bytes of text that one exchanged key range should hold, and the least and most ranges of a shard.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 256 << 20, 8, 2048
#: Columns that the work adds for a while; those of the documents that are called so are renamed meanwhile.
OWN_NAMES = {"_k1", "_k2", "_range", "_row", "_start", "_head", "_base", "_within"}


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _hash60(column: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 64 - KEY_BITS)


class Splitters:
    """Boundaries (k1, k2) found by rounds of exact counts over ``keys`` (k1, k2, size).

    A target is a number of bytes that should lie below its splitter. Its bin is cut into
    2**bits bins a round until the bin is within tolerance or holds one text only.
    """

    def __init__(self, keys: DataFrame, targets: list[float], tolerances: list[float], group_tolerance: float, bits: int = ROUND_BITS):
        self.keys, self.bits = keys, bits
        self.targets, self.tolerances, self.group_tolerance = targets, tolerances, group_tolerance
        self.found: list[tuple[int, int]] = [(0, 0)] * len(targets)

    def _counts(self, bins: set[int], level: int, width: int) -> dict[int, list[tuple[int, int, bool]]]:
        """For each open bin its sub-bins in order: first key, bytes, whether it holds one text only."""
        parent = F.shiftleft(F.shiftright("k1", KEY_BITS - level), KEY_BITS - level) if level else F.lit(0).cast("bigint")
        rows = self.keys.withColumn("bin", parent)
        if level:
            wanted = literal_table(self.keys.sparkSession, [{"bin": b} for b in sorted(bins)], "bin:bigint")
            rows = rows.join(F.broadcast(wanted), "bin", "left_semi")  # at most one row for each splitter
        low = F.shiftleft(F.shiftright("k1", KEY_BITS - width), KEY_BITS - width)
        sums = rows.groupBy("bin", low.alias("low")).agg(F.sum("size").alias("bytes"), (F.min("k1") == F.max("k1")).alias("one"))
        out: dict = {}
        for r in sums.collect():
            out.setdefault(r.bin, []).append((r.low, r.bytes, r.one))
        for found in out.values():
            found.sort()
        return out

    def search(self) -> list[tuple[int, int]]:
        level, open_ = 0, {i: (0, 0) for i in range(len(self.targets))}  # splitter -> first key of its bin, bytes below it
        while open_:
            width = min(level + self.bits, KEY_BITS)
            counts = self._counts({b for b, _ in open_.values()}, level, width)
            still, hot = {}, {}
            for i, (bin_, below) in open_.items():
                target, done = self.targets[i], below
                for low, size, one in counts[bin_]:
                    if done + size >= target:
                        break
                    done += size
                if size <= self.tolerances[i] or one and size <= self.group_tolerance:
                    nearer = target - done <= done + size - target
                    self.found[i] = (low if nearer else low + (1 << (KEY_BITS - width)), 0)
                elif one:
                    hot.setdefault((low, done), []).append(i)
                else:
                    still[i] = (low, done)
            for (low, below), splitters in hot.items():
                self._cut_group(low, low + (1 << (KEY_BITS - width)) - 1, below, splitters)
            level, open_ = width, still
        return self.found

    def _cut_group(self, low: int, high: int, below: int, splitters: list[int]) -> None:
        """Splitters within one hot group of equal texts: the same search over the hashes of its ids."""
        group = self.keys.where(F.col("k1").between(low, high))
        k1 = group.agg(F.min("k1")).first()[0]
        inner = Splitters(
            group.select(F.col("k2").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "size"),
            [self.targets[i] - below for i in splitters], [self.tolerances[i] for i in splitters], float("inf"), self.bits,
        ).search()
        for i, (k2, _) in zip(splitters, inner, strict=True):
            self.found[i] = (k1, k2)


def histogram_shards(
    documents: DataFrame,
    shards: int = 8,
    text: str = "text",
    doc_id: str = "doc_id",
    tolerance: float = 0.001,
    group_tolerance: float = 0.02,
    seed: int = 42,
) -> DataFrame:
    """``documents`` with size, text_crc32, shard (from 0) and slot (gapless from 0 within the shard, in key order).

    ``tolerance`` and ``group_tolerance`` are shares of a shard's bytes. A splitter is settled when the
    bin that holds it is within tolerance, or cannot be cut (one text, in groups within their tolerance).
    """
    spark = documents.sparkSession
    clashing = [c for c in documents.columns if c.lower() in OWN_NAMES]
    if clashing:
        apart = dict(zip(clashing, free_names(documents, *[f"kept{c}" for c in clashing]), strict=True))
        renamed = {"text": apart.get(text, text), "doc_id": apart.get(doc_id, doc_id)}
        out = histogram_shards(documents.withColumnsRenamed(apart), shards, **renamed, tolerance=tolerance, group_tolerance=group_tolerance, seed=seed)
        return out.withColumnsRenamed({v: k for k, v in apart.items()})
    rows = documents.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard").withColumns(
        {"_k1": _hash60(F.col(text), seed), "_k2": _hash60(F.col(doc_id), seed + 1), "size": text_bytes(F.col(text)), "text_crc32": unsigned_crc32(F.col(text))}
    )
    keys = materialize(rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return rows.drop("_k1", "_k2").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")})
    per = min(MOST_RANGES, max(LEAST_RANGES, -(-total // (RANGE_BYTES * shards))))
    n = per * shards
    targets = [total * i / n for i in range(1, n)]
    tight, loose = max(1.0, tolerance * total / shards), max(1.0, 0.25 * total / n)
    bits = max(ROUND_BITS, (8 * n - 1).bit_length())
    found = Splitters(
        keys, targets, [tight if i % per == 0 else loose for i in range(1, n)], group_tolerance * total / shards, bits
    ).search()
    for i in range(1, len(found)):
        found[i] = max(found[i], found[i - 1])

    ranged = _with_range(rows, found, bits)
    counted = _with_range(keys.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), found, bits).groupBy("_range").count()
    sums = {r[0]: r[1] for r in counted.collect()}
    first, offset = [], 0
    for r in range(n):
        offset = 0 if r % per == 0 else offset
        first.append(offset)
        offset += sums.get(r, 0)
    starts = literal_table(spark, [{"_range": r, "shard": r // per, "_start": first[r]} for r in range(n)], "_range:int,shard:int,_start:bigint")
    order = Window.partitionBy("_range").orderBy("_k1", "_k2")
    return (
        ranged.withColumn("_row", F.row_number().over(order)).join(F.broadcast(starts), "_range")  # one row for each range
        .withColumn("slot", F.col("_start") + F.col("_row") - 1)
        .drop("_range", "_row", "_start", "_k1", "_k2")
    )


def _with_range(rows: DataFrame, found: list[tuple[int, int]], bits: int) -> DataFrame:
    """``rows`` (_k1, _k2, ...) with _range, the number of splitters at or below the key.

    A table with one row for each value of the key's first bits (2**bits rows, which the number of
    ranges sets) holds the splitters below that value and those within it.
    """
    shift = KEY_BITS - bits
    heads = [a >> shift for a, _ in found]
    within: dict[int, list[tuple[int, int]]] = {}
    for head, splitter in zip(heads, found, strict=True):
        within.setdefault(head, []).append(splitter)
    heads_rows = [{"_head": h, "_base": bisect_left(heads, h), "_within": [{"a": a, "b": b} for a, b in within.get(h, [])]} for h in range(1 << bits)]
    lookup = literal_table(rows.sparkSession, heads_rows, "_head:bigint,_base:int,_within:array<struct<a:bigint,b:bigint>>")
    at_or_below = lambda s: (F.col("_k1") > s["a"]) | ((F.col("_k1") == s["a"]) & (F.col("_k2") >= s["b"]))
    return (
        rows.withColumn("_head", F.shiftright("_k1", shift)).join(F.broadcast(lookup), "_head")
        .withColumn("_range", (F.col("_base") + F.size(F.filter("_within", at_or_below))).cast("int"))
        .drop("_head", "_base", "_within")
    )


def op1_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op1_histogram_shard": op1_histogram_shard}
SQL: dict[str, str] = {}
