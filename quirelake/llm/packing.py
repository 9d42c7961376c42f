"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of documents, cut into packets of at most one sequence. A window hands every
source its share of the window's tokens as credit; a packet leaves in the first window in which its
source's credit, with what earlier windows left over, covers it. As credit only ever adds up, that
window is known from the packet's place in its queue: ceil(end / quantum) - 1. So deficits carry over
windows and over partitions by two-level prefix sums, and no task runs through a queue alone. The
packets in window order form one stream, which is cut into sequences; only the last has padding.

Defined cases: a null text is empty and still has the end token; null sources are one queue; rows
that repeat a doc_id are documents of their own; shares default to those of the queues' tokens, so
that all queues end together; with other weights a queue that ends leaves its share of the windows
to the others (weights of sources not named are 0 credit until all others end: they follow last);
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import shared_path, table
from quirelake.llm.tokens import kept_tokenizer

SEQUENCE, WINDOW_SEQUENCES, END = 2048, 16, 1
TEXTS_AT_ONCE, QUEUE_BUCKET_ROWS, ROUND_GROUP = 256, 2000, 1024
TOKENS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def tokenize(documents: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """(uid, doc_id, source, n, ids) for every row, written once: ids as little-endian uint32, or uint16 where the vocabulary fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_tokenizer(tokenizer_path)
        last = tokenizer.packed([end])
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = [tokenizer.encoded(x) + last for x in part.column(3).to_pylist()]
                n = pa.array([len(x) // tokenizer.width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), n, pa.array(ids, pa.binary())], schema=TOKENS)

    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    path = shared_path(documents.sparkSession, "tokens")
    schema = "uid long, doc_id long, source string, n long, ids binary"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(schema).parquet(path)


def drr_schedule(tokens: DataFrame, weights: dict[str, float] | None = None, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES) -> DataFrame:
    """(uid, packet_start, packet_length, window, stream_start) for every packet of tokens (uid, source, n)."""
    rows = tokens.count()
    buckets = min(1 << 16, max(64, rows // QUEUE_BUCKET_ROWS))
    docs = tokens.select("uid", F.coalesce("source", F.lit("\0")).alias("source"), "n").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n").alias("tokens"))
    queue = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("first", F.coalesce(F.sum("tokens").over(queue), F.lit(0)))
    queues = sums.groupBy("source").agg(F.sum("tokens").alias("size"))
    weight = F.col("size").cast("double")
    if weights is not None:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    queues = queues.withColumn("weight", weight)
    total = queues.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    quanta = queues.join(F.broadcast(total)).select(  # one row of totals
        "source", (F.col("weight") / F.greatest("all_weight", F.lit(1e-300)) * sequence * window_sequences).alias("quantum"), "all_size"
    )
    starts = starts.join(quanta, "source").drop("tokens")
    inside = Window.partitionBy("source", "bucket").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.join(starts, ["source", "bucket"]).withColumn("begin", F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    packets = placed.select(
        "uid", "source", "begin", "n", "quantum", "all_size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / sequence))).alias("k")
    ).select(
        "uid", "source", (F.col("k") * sequence).alias("packet_start"), F.least(F.lit(sequence), F.col("n") - F.col("k") * sequence).alias("packet_length"),
        (F.col("begin") + F.col("k") * sequence).alias("queue_start"), "quantum", "all_size",
    )
    end = F.col("queue_start") + F.col("packet_length")
    # Sources without credit come after the last window that any credit can fill.
    packets = packets.withColumn("window", F.when(F.col("quantum") > 0, F.ceil(end / F.col("quantum")) - 1).otherwise(F.lit(1 << 62) + F.floor(F.col("queue_start") / (sequence * window_sequences))))
    packets = packets.select("uid", "source", "packet_start", "packet_length", "queue_start", "window").withColumn("group", F.floor(F.col("window") / ROUND_GROUP))
    per = packets.groupBy("group", "window").agg(F.sum("packet_length").alias("tokens"))
    groups = per.groupBy("group").agg(F.sum("tokens").alias("tokens"))
    over_groups = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row for each ROUND_GROUP windows
    groups = groups.select("group", F.coalesce(F.sum("tokens").over(over_groups), F.lit(0)).alias("group_start"))
    within = Window.partitionBy("group").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    windows = per.join(groups, "group").select("window", (F.col("group_start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("window_start"))
    inner = Window.partitionBy("window").orderBy("source", "queue_start").rowsBetween(Window.unboundedPreceding, -1)
    return packets.join(windows, "window").select(
        "uid", "packet_start", "packet_length", "window", (F.col("window_start") + F.coalesce(F.sum("packet_length").over(inner), F.lit(0))).alias("stream_start")
    )


def pack(documents: DataFrame, tokenizer_path: str, weights: dict[str, float] | None = None, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    tokens = tokenize(documents, tokenizer_path, end)
    packets = drr_schedule(tokens, weights, sequence, window_sequences)
    last = F.floor((F.col("stream_start") + F.col("packet_length") - 1) / sequence)
    cut = packets.withColumn("seq", F.explode(F.sequence(F.floor(F.col("stream_start") / sequence), last)))
    low = F.greatest("stream_start", F.col("seq") * sequence)
    high = F.least(F.col("stream_start") + F.col("packet_length"), (F.col("seq") + 1) * sequence)
    piece = F.struct((F.col("packet_start") + low - F.col("stream_start")).alias("start"), (high - low).alias("length"), "seq", (low - F.col("seq") * sequence).alias("offset"))
    plans = cut.select("uid", piece.alias("piece")).groupBy("uid").agg(F.collect_list("piece").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                out = []
                for doc, n, raw, pieces in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS_AT_ONCE).columns), strict=True):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    out += [(doc, p["start"], p["length"], n, p["seq"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

    joined = tokens.select("uid", "doc_id", "n", "ids").join(plans, "uid").select("doc_id", "n", "ids", "pieces")
    return joined.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op7_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), op7_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_drr_packing": op7_drr_packing}
SQL: dict[str, str] = {}
