r"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words, counted in Spark.

Within a batch of documents each hash keeps its earliest place only, and its other places are
settled there; so a window reaches the exchange once for each batch at most, however often it
occurs. Places travel packed by hash bucket. In each bucket the earliest place of a hash stays and
the others are repeats. Repeats return packed by document, merge into maximal intervals, and the
words outside them remain.

Places are compared by (doc_id, tie, word position). Windows are told apart by 48 bits of hash beside
the bucket, 60 bits with the least number of buckets and more with more documents.

Ties tell rows apart that share a doc_id, or have none: where there are such ids, their rows alone are
written once with a number in an order that their texts decide. It travels above the 30 bits of the position (a text of 2 GB has fewer words).

Defined cases: null and empty texts have no words; texts shorter than a window stay whole; rows that
repeat a doc_id are documents of their own, in an order that their texts decide, and of equal rows one
comes first; a null doc_id comes after all others, as does the id 2**63 - 1, which counts as null; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import SALTS, materialize, table
from quirelake.llm.words import WordNumbers, split_words, window_hashes

WINDOW = 20
#: Words packed at a time, places returned at a time, least and most buckets, and bytes of the input's files for one bucket.
BATCH_WORDS, BATCH_PLACES, LEAST_BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 1_500_000, 1_000_000, 1 << 12, 1 << 20, 8 << 20
NO_ID = (1 << 63) - 1
#: Parts of the rows of one shared id that are numbered apart.
TIE_PARTS = 4096
#: Bits of a place that hold the word position; the tie is above them.
POSITION_BITS = 30
HASH_BYTES = 6
ROWS = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("payload", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("spans", pa.binary())])


def bucket_count(documents: DataFrame) -> int:
    """A power of two that grows with the size of the files that ``documents`` reads."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (min(size, 1 << 50) // BUCKET_BYTES).bit_length()))


def _planes(values: np.ndarray, count: int) -> list[np.ndarray]:
    return [(values >> np.uint64(8 * k)).astype(np.uint8) for k in range(count)]


def _joined(planes: np.ndarray) -> np.ndarray:
    out = np.zeros(planes.shape[1], np.uint64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.uint64) << np.uint64(8 * k)
    return out


def _pack(docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None) -> bytes:
    """Places as byte planes (those of zeros cost next to nothing once compressed): steps of docs, starts, hashes.

    The first byte is the number of planes of starts: 4, or 8 where there are ties.
    """
    steps, width = np.diff(docs, prepend=np.int64(0)).view(np.uint64), 8 if (starts >> POSITION_BITS).any() else 4
    planes = _planes(steps, 8) + _planes(starts.astype(np.uint64), width) + (_planes(hashes, HASH_BYTES) if hashes is not None else [])
    return bytes([width]) + np.concatenate(planes).tobytes()


def _unpack(payload: bytes, hashed: bool) -> tuple[np.ndarray, ...]:
    end = 8 + payload[0]
    planes = np.frombuffer(payload, np.uint8, offset=1).reshape(end + HASH_BYTES * hashed, -1)
    places = np.cumsum(_joined(planes[:8]).view(np.int64)), _joined(planes[8:end]).astype(np.int64)
    return (*places, _joined(planes[end:])) if hashed else places


def _repeats(docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hash, doc, start); in that order, which places repeat an earlier one and which begin a hash."""
    order = np.lexsort((starts, docs, hashes))
    d, s, h = docs[order], starts[order], hashes[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return order, (d != d[first]) | (s != s[first]), new


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    if len(keys):
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield from zip(edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _returned(docs: np.ndarray, starts: np.ndarray, buckets: int) -> list[tuple]:
    """Repeated places packed by a fold of their documents and ties."""
    fold = ((docs + (starts >> POSITION_BITS) * 0x2545F4914F6CDD1D) * 0x5851F42D4C957F2D >> 40) & (buckets - 1)
    order = np.lexsort((starts, docs, fold))
    docs, starts, fold = docs[order], starts[order], fold[order]
    return [(int(fold[a]), 1, _pack(docs[a:b], starts[a:b])) for a, b in _runs(fold)]


def window_places(width: int, buckets: int):
    """Batches of (doc_id, tie, text) to ROWS: kind 0 the places by hash bucket, kind 1 those settled here."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        ids: list[int] = []
        ties: list[int] = []
        hashes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            n = [len(h) for h in hashes]
            h, d = np.concatenate(hashes), np.repeat(np.array(ids, np.int64), n)
            s = np.concatenate([np.arange(k) + (tie << POSITION_BITS) for k, tie in zip(n, ties, strict=True)])
            order, again, new = _repeats(d, s, h)
            settled, kept = order[again], order[new]
            rows = _returned(d[settled], s[settled], buckets)
            d, s, h = d[kept], s[kept], h[kept]
            bucket = (h >> shift).astype(np.int64)
            order = np.lexsort((s, d, bucket))
            d, s, h, bucket = d[order], s[order], h[order], bucket[order]
            rows += [(int(bucket[a]), 0, _pack(d[a:b], s[a:b], h[a:b])) for a, b in _runs(bucket)]
            ids.clear(), ties.clear(), hashes.clear()
            return _batch(rows, ROWS)

        held = 0
        for batch in batches:
            for doc, tie, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = split_words(raw)
                if len(words) >= width:
                    ids.append(doc)
                    ties.append(tie)
                    hashes.append(window_hashes(numbers.of(words), width))
                    held += len(words)
                    if held >= BATCH_WORDS:
                        yield flush()
                        held = 0
        if ids:
            yield flush()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Payloads of each (key, kind), from rows sorted by them."""
    now, payloads = None, []
    for batch in batches:
        for key, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (key, kind) != now:
                if payloads:
                    yield *now, payloads
                now, payloads = (key, kind), []
            payloads.append(payload)
    if payloads:
        yield *now, payloads


def settle(buckets: int):
    """Sorted ROWS to rows of kind 1: all repeated places, packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for key, kind, payloads in _grouped(batches):
            if kind:
                yield _batch([(key, 1, p) for p in payloads], ROWS)
                continue
            d, s, h = (np.concatenate(x) for x in zip(*(_unpack(p, True) for p in payloads), strict=True))
            order, again, _ = _repeats(d, s, h)
            found.append((d[order[again]], s[order[again]]))
            held += len(found[-1][0])
            if held >= BATCH_PLACES:
                yield _batch(_returned(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets), ROWS)
                found, held = [], 0
        if held:
            yield _batch(_returned(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets), ROWS)

    return run


def merge_spans(width: int):
    """Sorted ROWS of kind 1 to one row a document: its maximal intervals of repeated words, as int32 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, payloads in _grouped(batches):
            d, s = (np.concatenate(x) for x in zip(*(_unpack(p, False) for p in payloads), strict=True))
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            ties, s = s >> POSITION_BITS, s & (1 << POSITION_BITS) - 1
            other = (d[1:] != d[:-1]) | (ties[1:] != ties[:-1])
            cut = np.flatnonzero(np.append(True, other | (s[1:] > s[:-1] + width)))
            lows, highs = s[cut], s[np.append(cut[1:], len(s)) - 1] + width
            rows = np.cumsum(np.append(0, other))[cut]  # which (doc, tie) of this payload
            yield _batch([(int(d[cut[a]]), int(ties[cut[a]]), np.stack([lows[a:b], highs[a:b]], 1).astype("<i4").tobytes()) for a, b in _runs(rows)], SPANS)

    return run


def with_ties(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with a number ``tie``: 0, or where rows share a doc_id, or have none, their place in the order of texts.

    Rows without shared ids are not written anywhere; those with them are, once, as equal rows have no order of their own.
    The order is that of hashes of the texts, counted by (doc_id, part of the hashes) and by (text, salt), so that no task holds a hot id or text.
    """
    shared = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where(f"times > 1 OR doc_id = {NO_ID}").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return rows.withColumn("tie", F.lit(0).cast("bigint"))
    theirs = rows.join(shared, "doc_id", "left_semi").withColumn("hash", F.xxhash64("text")).withColumn("part", F.pmod("hash", F.lit(TIE_PARTS)))
    theirs = materialize(theirs.withColumn("row", F.monotonically_increasing_id()), "shared-rows", codec="zstd")
    numbered = theirs.select("doc_id", "part", "hash", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"), "row")
    order = ["doc_id", "part", "hash", "salt"]
    groups = numbered.groupBy(order).count().withColumn("within", F.sum("count").over(Window.partitionBy("doc_id", "part").orderBy("hash", "salt")) - F.col("count"))
    parts = groups.groupBy("doc_id", "part").agg(F.sum("count").alias("size"))
    parts = parts.select("doc_id", "part", (F.sum("size").over(Window.partitionBy("doc_id").orderBy("part")) - F.col("size")).alias("before"))
    before = groups.join(parts, ["doc_id", "part"]).select(*order, (F.col("before") + F.col("within")).alias("before"))
    place = F.row_number().over(Window.partitionBy(order).orderBy("row")) - 1
    ties = materialize(numbered.withColumn("place", place).join(before, order).select("row", (F.col("before") + F.col("place")).alias("tie")), "ties")
    placed = theirs.join(ties, "row").select("doc_id", "text", "tie")
    return rows.join(shared, "doc_id", "left_anti").withColumn("tie", F.lit(0).cast("bigint")).unionByName(placed)


def repeated_spans(rows: DataFrame, width: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_id, tie, spans) of rows (doc_id not null, text, tie) with words in a window that also starts earlier."""
    buckets = buckets or bucket_count(rows)
    schema = "key long, kind byte, payload binary"
    places = rows.select("doc_id", "tie", F.col("text").cast("binary").alias("text")).mapInArrow(window_places(width, buckets), schema)
    back = places.repartition("key", "kind").sortWithinPartitions("key", "kind").mapInArrow(settle(buckets), schema)
    return back.repartition("key").sortWithinPartitions("key").mapInArrow(merge_spans(width), "doc_id long, tie long, spans binary")


def remove_repeats(documents: DataFrame, width: int = WINDOW, buckets: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans) for every row; spans are the removed word intervals."""
    rows = with_ties(documents.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text")))
    spans = repeated_spans(rows, width, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, raw, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = split_words(raw)
                pairs = np.frombuffer(packed or b"", "<i4").reshape(-1, 2).tolist()
                kept, at = [], 0
                for low, high in pairs:
                    kept += words[at:low]
                    at = max(at, min(high, len(words)))
                kept += words[at:]
                out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), pairs))
            yield _batch(out, RESULT)

    joined = rows.join(spans, ["doc_id", "tie"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, spans array<array<int>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])


def op10_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_rolling_windows": op10_rolling_windows}
SQL: dict[str, str] = {}
