r"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct 5-word shingles as 64-bit numbers. Equal sets are one node. Two
sets link when 100 * intersection >= 75 * union. In one order of all shingles (frequent ones, as
counted in a sample of documents, last) linked sets share one of the first n - ceil(0.75 n) + 1
shingles of each, their prefixes. A shingle's remainder in a set is the number of shingles from its
place on; where two sets first meet, neither remainder is less than their intersection.

1. Prefixes. One pass over the texts writes every set's size, node and prefix. The nodes that share
   a prefix shingle are a posting.
2. Groups. A posting's lead is the node that holds the shingle earliest for its size: edits make rare
   shingles, which come first, so the text that copies were made from leads. Each node is compared
   with the leads that most of its postings name, at most ``LEADS`` of them; links make groups.
3. Matrix. For every group the union of the shingles that its members index is stored, as rows
   (shingle, group) with the members' largest remainder and sizes. A node's overlap with a group is
   bounded by them; only groups of other nodes that can reach the threshold are opened, and only
   members that can reach it at that shingle are compared.

Every pair is compared on prefixes first, which must share as many shingles as a link needs, and then
on whole sets. Members of one group are not compared again: they are in one component already. So a
group of copies costs pairs in proportion to its size, and no link between groups is lost: the third
step reaches every pair that the second left out.

Defined cases: words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; fewer words than a shingle make one
shingle of them all; null and empty texts and those without words have an empty set and link with
nothing; rows that repeat a doc_id are documents of their own that share the id; a null doc_id counts
after all others; an empty table gives no rows; further columns are ignored. Shingles, and sets, are
equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import FEW_LINKS, connected_components, materialize, release, table
from quirelake.llm.words import WordNumbers, split_words, window_hashes

WIDTH, PERCENT = 5, 75
#: One document in so many is sampled for frequent shingles; those seen so often there, and at most so many, are ordered last.
SAMPLE_STEP, SEEN, MOST_FREQUENT = 8, 2, 500_000
LEADS, MAP_BITS, SALTS, ROWS_AT_ONCE = 2, 24, 64, 500
#: Nodes that a task remembers so as to give the prefix of a set once.
NODES_KNOWN = 200_000
NO_ID = (1 << 63) - 1


def shingle_set(raw: bytes | None, numbers: WordNumbers, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    words = split_words(raw, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return window_hashes(numbers.of(words), len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(numbers.of(words), width))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1


def _sets(batch: pa.RecordBatch, numbers: WordNumbers) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            yield doc, shingle_set(raw, numbers)


def _table(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = WordNumbers()
    for batch in batches:
        found, nodes = [], set()
        for _, s in _sets(batch, numbers):
            if len(s) and (node := node_of(s)) not in nodes:  # copies count once a batch
                nodes.add(node)
                found.append(s)
        if found:
            token, seen = np.unique(np.concatenate(found), return_counts=True)
            yield _table("token long, seen long", token=token.view(np.int64), seen=seen)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles of the sample and the order class of each; at most MOST_FREQUENT."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_STEP)) == 0)
    counts = sample.mapInArrow(_sample_counts, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= SEEN)
    counts = materialize(counts, "frequent")
    total, least = 0, SEEN
    levels = counts.groupBy(F.floor(F.log2("seen")).alias("level")).count().orderBy(F.desc("level")).collect()  # one row for each power of two
    for r in levels:
        total += r["count"]
        if total > MOST_FREQUENT:
            least = 1 << (r.level + 1)
            break
    kept = counts.where(F.col("seen") >= least).toPandas()
    token = kept["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(2 * np.log2(np.maximum(kept["seen"].to_numpy(float), 1)), 62).astype(np.uint64)[order] + np.uint64(1)


PREFIXES = "doc_id long, n_shingles long, node long, prefix array<long>"


def _prefixes(frequent):
    """One row a document; its prefix in order, as order class and 58 bits of the hash, null where the task gave the same set's before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, given = WordNumbers(), set()
        known, classes = frequent.value

        def prefix(s: np.ndarray) -> np.ndarray:
            rank = s >> np.uint64(6)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                hit = known[at] == s
                rank[hit] |= classes[at[hit]] << np.uint64(58)
            p = prefix_length(len(s))
            return np.sort(np.partition(rank, p - 1)[:p] if p < len(rank) else rank)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                sizes, nodes, found = [], [], []
                for _, s in _sets(part, numbers):
                    node = node_of(s) if len(s) else None
                    sizes.append(len(s)), nodes.append(node)
                    found.append(None if node is None or node in given else prefix(s))
                    if found[-1] is not None:
                        if len(given) >= NODES_KNOWN:
                            given.clear()
                        given.add(node)
                ends = np.cumsum([0] + [0 if f is None else len(f) for f in found])
                flat = np.concatenate([np.zeros(0, np.uint64)] + [f for f in found if f is not None]).view(np.int64)
                blank = pa.array(np.array([f is None for f in found]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=blank)
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "prefix"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, node): those of tokens with several nodes."""
    schema = "token long, node long, n long, rest long"
    held = None  # the last row, and whether its token had others before
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        several = False
        if held:
            rows = [np.append(x, y) for x, y in zip(held[0], rows, strict=True)]
            several = held[1]
        t, v = rows[:2]
        new = np.append(True, (t[1:] != t[:-1]) | (v[1:] != v[:-1]))
        t, v, n, rest = (x[new] for x in rows)
        start = np.append(True, t[1:] != t[:-1])
        shared = ~start | np.append(~start[1:], False)
        shared[0] |= several
        held = ([x[-1] for x in (t, v, n, rest)], bool(shared[-1]))
        m = shared[:-1]
        yield _table(schema, token=t[:-1][m], node=v[:-1][m], n=n[:-1][m], rest=rest[:-1][m])
    if held and held[1]:
        yield _table(schema, **{c: [x] for c, x in zip(("token", "node", "n", "rest"), held[0], strict=True)})


def _within(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can link."""
    return (x * 100 >= y * PERCENT) & (y * 100 >= x * PERCENT)


def _needed(x: Column, y: Column) -> Column:
    """Least intersection with which sets of sizes x and y link."""
    return F.ceil((x + y) * PERCENT / (100 + PERCENT))


def _least_common(x: Column, y: Column) -> Column:
    """Least number of shared prefix shingles with which sets of sizes x and y can link.

    A link needs 75 (x + y) / 175 common shingles; beyond the prefixes there are at most
    ceil(0.75 max(x, y)) - 1 of them.
    """
    return _needed(x, y) - F.ceil(F.greatest(x, y) * PERCENT / 100) + 1


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS)) + 1


def _bitmap(ids: DataFrame) -> DataFrame:
    """(bucket, bits): 2**MAP_BITS bits, set for the hashes of the doc_ids; the same size for any number of them."""
    places = ids.select(_place().alias("p"))
    return places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """The rows whose doc_id has its bit set: all of the ids that made the bitmap, and a few others."""
    at = F.bitmap_bit_position(_place())
    placed = rows.withColumns({"bucket": F.bitmap_bucket_number(_place()), "at": at.cast("int")})
    byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
    return placed.join(F.broadcast(bitmap), "bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, at % 8)")) != 0).select(rows.columns)


class TokenGroupJoin:
    """The join over (doc_id, text as binary); doc_id not null."""

    def __init__(self, docs: DataFrame):
        self.docs, self.spark = docs, docs.sparkSession

    def _common(self, pairs: DataFrame, found: DataFrame, value: str) -> DataFrame:
        """The pairs and, as ``common``, how many shingles both ends share at most; found: (node, at_a, at_b, value)."""
        ends = [found.where(f"at_{k}").select(F.col("node").alias(k), F.col(value).alias(v)) for k, v in (("a", "x"), ("b", "y"))]
        both = pairs.join(ends[0], "a").select("a", "n", "x", "b", "m").join(ends[1], "b")
        blurred = F.size("x") - F.size(F.array_distinct("x"))  # numbers that stand for several shingles
        return both.select("a", "n", "b", "m", (F.size(F.array_intersect("x", "y")) + blurred).alias("common"))

    def _holders(self, pairs: DataFrame, name: str) -> DataFrame:
        """(node, at_a, at_b, doc_id): a document with a prefix for every node of the pairs."""
        ends = pairs.select(F.posexplode(F.array("a", "b")).alias("end", "node"))
        ends = ends.groupBy("node").agg(F.bool_or(F.col("end") == 0).alias("at_a"), F.bool_or(F.col("end") == 1).alias("at_b"))
        return materialize(self.classes.select("node", F.col("holder").alias("doc_id")).join(ends, "node"), f"holders-{name}")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, n, b, m) of nodes that link: (src, dst)."""
        holders = self._holders(pairs, f"{name}-prefixes")
        # 31 bits of a prefix shingle do here: shingles that they don't tell apart only let more pairs through.
        short = F.transform("prefix", lambda t: F.pmod(t, F.lit((1 << 31) - 1)).cast("int"))
        prefixes = _marked(self.prefixes.where("prefix is not null").select("doc_id", "node", "prefix"), _bitmap(holders))
        prefixes = prefixes.select("doc_id", "node", short.alias("prefix")).join(holders, ["node", "doc_id"])
        prefixes = materialize(prefixes.dropDuplicates(["node"]).drop("doc_id"), f"prefixes-{name}")
        near = self._common(pairs, prefixes, "prefix").where(F.col("common") >= _least_common(F.col("n"), F.col("m")))
        near = materialize(near.drop("common"), f"near-{name}")
        release(holders, prefixes)
        holders = self._holders(near, f"{name}-sets")

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sets of the holders and of a few others, whose bits they share; each set once a task, as far as it remembers."""
            numbers, given = WordNumbers(), set()
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    out = {node_of(s): s for _, s in _sets(batch.slice(at, ROWS_AT_ONCE), numbers) if len(s)}
                    new = {k: s for k, s in out.items() if k not in given}
                    if len(given) >= NODES_KNOWN:
                        given.clear()
                    given.update(new)
                    if new:
                        lists = pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0, *map(len, new.values())]), pa.int32()), pa.array(np.concatenate(list(new.values())).view(np.int64))
                        )
                        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), lists], names=["node", "shingles"])

        sets = _marked(self.docs, _bitmap(holders)).mapInArrow(extract, "node long, shingles array<long>").join(holders.drop("doc_id"), "node")
        sets = materialize(sets.dropDuplicates(["node"]), f"sets-{name}")
        linked = self._common(near, sets, "shingles").where(F.col("common") * (100 + PERCENT) >= (F.col("n") + F.col("m")) * PERCENT)
        links = materialize(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), f"links-{name}")
        release(near, holders, sets)
        return links

    def lead_pairs(self, shared: DataFrame) -> DataFrame:
        """(a, n, b, m): every node and the leads that most of its postings name."""
        earliest = F.struct(F.col("rest") / F.col("n"), -F.col("node"))
        leads = shared.groupBy("token").agg(F.max_by(F.struct("node", "n", "rest"), earliest).alias("l"))
        leads = leads.select("token", F.col("l.node").alias("b"), F.col("l.n").alias("m"), F.col("l.rest").alias("lead_rest"))
        met = shared.join(leads, "token").where("node <> b").where(_within(F.col("n"), F.col("m")))
        votes = met.groupBy(F.col("node").alias("a"), "n", "b", "m").agg(
            F.count(F.lit(1)).alias("votes"), F.max(F.least("rest", "lead_rest")).alias("bound")
        )
        best = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
        return votes.where(F.col("bound") >= _needed(F.col("n"), F.col("m"))).withColumn("k", F.row_number().over(best)).where(F.col("k") <= LEADS).select("a", "n", "b", "m")

    def matrix_pairs(self, shared: DataFrame, groups: DataFrame) -> DataFrame:
        """(a, n, b, m): nodes of different groups that the groups' unions, and then the members, don't rule out.

        The smaller set of a pair (of equal ones that with the lesser node) indexes its shingles up
        to the place where sets of its own size could still link; the larger one asks.
        """
        few = groups.count() <= FEW_LINKS
        placed = shared.join(F.broadcast(groups) if few else groups, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
        members = placed.where(F.col("rest") >= _needed(F.col("n"), F.col("n"))).withColumnsRenamed({"node": "b", "n": "m", "rest": "m_rest"})
        matrix = members.groupBy("token", F.col("grp").alias("other")).agg(F.max("m_rest").alias("most_rest"), F.min("m").alias("least"), F.max("m").alias("most"))
        n = F.col("n")
        needed = _needed(n, F.greatest(F.col("least"), F.ceil(n * PERCENT / 100)))
        met = placed.join(matrix, "token").where("grp <> other and least <= n").where(n * PERCENT <= F.col("most") * 100)
        met = met.where((F.col("most_rest") >= needed) & (F.col("rest") >= needed)).select("token", F.col("node").alias("a"), "n", "rest", F.col("other").alias("grp"))
        opened = met.join(members, ["token", "grp"]).where("m < n or (m = n and b < a)").where(_within(n, F.col("m")))
        return opened.where(F.least("rest", "m_rest") >= _needed(n, F.col("m"))).select("a", "n", "b", "m").distinct()

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row."""
        frequent = self.spark.sparkContext.broadcast(frequent_shingles(self.docs))
        self.prefixes = materialize(self.docs.mapInArrow(_prefixes(frequent), PREFIXES), "prefixes")
        frequent.destroy()
        known = self.prefixes.where("node is not null").select("node", "doc_id", F.when(F.col("prefix").isNotNull(), F.col("doc_id")).alias("holder"))
        self.classes = materialize(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("holder").alias("holder")), "classes")
        tokens = self.prefixes.where("prefix is not null").select("node", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("place", "token"))
        tokens = tokens.select("token", "node", "n", (F.col("n") - F.col("place")).alias("rest")).repartition("token").sortWithinPartitions("token", "node")
        shared = materialize(tokens.mapInArrow(_postings, "token long, node long, n long, rest long"), "postings")
        first = materialize(self.lead_pairs(shared), "first")
        links = self.verified(first, "first")
        groups = materialize(connected_components(links), "groups")
        pairs = materialize(self.matrix_pairs(shared, groups), "second")
        release(first, shared, groups)
        if not pairs.isEmpty():
            links = links.union(self.verified(pairs, "second"))
        named = connected_components(links).join(self.classes.select("node", "doc_id"), "node")
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        classes = self.classes.join(named.join(least, "component").select("node", "component_id"), "node", "left").select(
            "node", F.coalesce("component_id", "doc_id").alias("component_id")
        )
        salted = self.prefixes.select("doc_id", "n_shingles", "node", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        seen = salted.where("node is not null").select("node", "salt").distinct().join(classes, "node")
        return salted.join(seen, ["node", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_components(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    docs = documents.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = TokenGroupJoin(docs).run()
    blank = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(blank("doc_id"), "n_shingles", blank("component_id"))


def op8_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_groups": op8_token_groups}
SQL: dict[str, str] = {}
