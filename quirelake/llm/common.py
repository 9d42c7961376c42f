"""What the training-data operators share: shared storage, hot-group-safe grouping, components.

Everything here is distributed; nothing gathers an unbounded set of rows in one task or on the driver.
"""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key are dealt over so many partial groups before they meet.
SALTS = 64
#: Links of at most so many rows fit one task, and node tables of at most so many a broadcast (16 bytes a row).
FEW_LINKS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where all run in one JVM (tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a written table at once, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with shuffles_removed(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing unfinished reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, read from one JSON literal in the JVM."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 on division by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all the links (a, b) of one task: the roots of both ends of a link meet at the lesser one, until none differ."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not found:
        return
    ends = np.concatenate([x for pair in found for x in pair[:1]] + [pair[1] for pair in found])
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(node, component) for every endpoint; component is the least node reachable.

    Up to ``few`` different links, which are counted, one task settles them (16 bytes a link). Beyond,
    large-star and small-star rewiring alternate: each round sums neighbour minima with a map-side
    combine and joins them back, so that a hot centre is a skewed join that Spark splits. Each round is
    written to the shared folder; their number grows with the logarithm of the longest path. Both give
    the same rows. Self loops and repeated links are allowed; no edges give no rows.
    """
    links = edges.select(F.greatest(src, dst).cast("bigint").alias("a"), F.least(src, dst).cast("bigint").alias("b"))
    first = pairs = materialize(links.where("a is not null and b is not null").distinct(), "edges")
    if pairs.count() <= few:
        return pairs.coalesce(1).mapInArrow(_least_reachable, "node long, component long")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    pairs = pairs.where("a <> b")
    before = None
    for _ in range(rounds):
        # Large star: every larger neighbour goes to the least of the neighbourhood.
        both = pairs.union(pairs.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialize(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: every smaller neighbour, and the node itself, goes to the least of them.
        lesser = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(lesser, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rewired = materialize(moved.union(lesser.select("a", F.col("m").alias("b"))).distinct(), "pairs")
        release(least, large, lesser, *([pairs] if before else []))
        pairs = rewired
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components of {first.written_at} did not settle within {rounds} rounds")
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(least, nodes["node"] == least["a"], "left").select("node", F.coalesce("m", "node").alias("component"))
