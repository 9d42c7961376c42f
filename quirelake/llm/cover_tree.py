"""Embedding near-dedup: cover trees and dual traversal, giving exact threshold pairs.

Vectors of one label are compared by cosine in double precision, which on unit vectors is a
Euclidean radius. Equal vectors count once, with their number. A label with more vectors than
``CELL_ROWS`` is dealt to cells around pivots (the top of its cover tree, chosen on a bounded
sample); cells around which no pair can lie within the radius are never compared, and a hot cell
is dealt to blocks by hash. Each remaining pair of blocks is one task: a cover tree is built over each
block, its levels nested and their radii halving, and the two are traversed together. A node pair
whose centres are farther apart than both covering radii and the threshold is dropped; one whose farthest
members must be within the threshold is counted whole; else its children are paired. A task returns a
count for each vector and a spanning forest of its links, never all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a
null label, link with nothing and are kept; vectors of different lengths don't link; rows that
repeat a vec_id are vectors of their own with one id; a null vec_id links like any other and its result
has the id null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import connected_components, materialize, table

THRESHOLD = 0.93
#: Vectors of a block at most on average, pivots in all, and sampled vectors for choosing them.
CELL_ROWS, MOST_PIVOTS, SAMPLE = 2048, 512, 20_000
#: Slack for the rounding of sums in double precision.
EPS = 1e-9
NO_ID = (1 << 63) - 1
#: Cells of at most so many rows are broadcast (some 50 bytes a row).
FEW_CELLS = 100_000


class CoverTree:
    """A cover tree over unit vectors: ``levels[i]`` holds nested centres at radius 2 / 2**i.

    ``parent[i]`` numbers, for every centre of level i, its centre in level i - 1; ``reach[i]`` is the
    exact covering radius, the greatest distance from a centre to a point below it. The last level
    holds every point, with reach 0.
    """

    def __init__(self, x: np.ndarray, levels: int = 8):
        n = len(x)
        self.x = x
        owner = np.zeros(n, np.int64)  # position in the present level of the centre that covers each point
        self.levels, self.parent, self.reach, self.owner = [np.array([0])], [np.zeros(1, np.int64)], [], []
        distance = self._distance(x, x[:1])[:, 0]
        self.owner.append(owner)
        self.reach.append(np.array([distance.max(initial=0.0)]))
        radius = 2.0
        while len(self.levels[-1]) < n and len(self.levels) < levels:
            radius /= 2
            centres, parents, new_owner, d_new = [], [], np.full(n, -1), np.full(n, np.inf)
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(len(self.levels[-1]) + 1))
            for p, old in enumerate(self.levels[-1]):
                members = order[edges[p] : edges[p + 1]]
                # Nesting: the old centre first; then every point farther than the radius from all chosen becomes one.
                gap = self._distance(x[members], x[old : old + 1])[:, 0]
                here = np.full(len(members), len(centres))
                best = gap.copy()
                centres.append(old), parents.append(p)
                while True:
                    far = int(best.argmax())
                    if best[far] <= radius:
                        break
                    gap = self._distance(x[members], x[members[far]][None])[:, 0]
                    gap[far] = 0.0
                    closer = gap < best
                    here[closer], best[closer] = len(centres), gap[closer]
                    centres.append(members[far]), parents.append(p)
                new_owner[members], d_new[members] = here, best
            reach = np.zeros(len(centres))
            np.maximum.at(reach, new_owner, d_new)
            owner = new_owner
            self.levels.append(np.array(centres)), self.parent.append(np.array(parents)), self.reach.append(reach), self.owner.append(owner)
        if len(self.levels[-1]) < n or self.reach[-1].max(initial=0) > 0:
            self.levels.append(np.arange(n)), self.parent.append(owner), self.reach.append(np.zeros(n)), self.owner.append(np.arange(n))

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def dual_links(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, same: bool, threshold: float = THRESHOLD, pairs_at_once: int = 1 << 21, work: Counter | None = None):
    """Weighted link counts of the points of both trees and links that span them (positions in a, in b).

    Distances are taken for the node pairs that survive the level above. Once an eighth of all pairs
    survive, one matrix product is cheaper than as many single ones and gives them all. With ``same`` the
    trees are one: each pair counts once and a point doesn't link with itself. ``work`` counts distances.
    """
    radius = np.sqrt(max(2 - 2 * threshold, 0.0))
    work = Counter() if work is None else work
    product: list[np.ndarray] = []

    def cosines(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not product and 8 * len(i) >= len(a.x) * len(b.x):
            product.append(a.x @ b.x.T)
            work["distances"] += len(a.x) * len(b.x)
        if product:
            return product[0][i, j]
        work["distances"] += len(i)
        at_once = max(1, (1 << 21) // a.x.shape[1])
        parts = [np.einsum("ij,ij->i", a.x[i[k : k + at_once]], b.x[j[k : k + at_once]]) for k in range(0, len(i), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0)

    count_a, count_b = np.zeros(len(a.x)), np.zeros(len(b.x))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    # Members of every node, by level: sorted by owner.
    depth = max(len(a.levels), len(b.levels))

    def at(tree: CoverTree, level: int) -> int:
        return min(level, len(tree.levels) - 1)

    def members(tree: CoverTree, level: int):
        owner = tree.owner[level]
        order = np.argsort(owner, kind="stable")
        return order, np.searchsorted(owner[order], np.arange(len(tree.levels[level]) + 1))

    def children(tree: CoverTree, level: int):
        """For level -> level + 1: child positions sorted by parent, and bounds."""
        if level + 1 >= len(tree.levels):
            n = len(tree.levels[-1])
            return np.arange(n), np.arange(n + 1)
        parent = tree.parent[level + 1]
        order = np.argsort(parent, kind="stable")
        return order, np.searchsorted(parent[order], np.arange(len(tree.levels[level]) + 1))

    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    cache: dict = {}
    while stack:
        level, i, j = stack.pop()
        if len(i) > pairs_at_once:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        la, lb = at(a, level), at(b, level)
        ca, cb = a.levels[la][i], b.levels[lb][j]
        cosine = cosines(ca, cb)
        d = np.sqrt(np.maximum(2 - 2 * cosine, 0))
        slack = a.reach[la][i] + b.reach[lb][j]
        if level >= depth - 1:  # points
            hit = cosine >= threshold
            if same:
                hit &= ca != cb
            ca, cb = ca[hit], cb[hit]
            np.add.at(count_a, ca, weight_b[cb])
            if not same:
                np.add.at(count_b, cb, weight_a[ca])
            links.append((ca, cb))
            continue
        keep = d <= radius + slack + EPS
        whole = keep & (d + slack <= radius - EPS)
        if same:
            whole &= ca != cb  # a node with itself is opened further
        if whole.any():
            key = ("m", level)
            if key not in cache:
                cache[key] = members(a, la), members(b, lb)
            (oa, ea), (ob, eb) = cache[key]
            sum_a, sum_b = np.add.reduceat(np.append(weight_a[oa], 0), ea[:-1]), np.add.reduceat(np.append(weight_b[ob], 0), eb[:-1])
            wi, wj = i[whole], j[whole]
            more_a = np.bincount(wi, sum_b[wj], len(a.levels[la]))
            count_a += more_a[a.owner[la]]
            if not same:
                more_b = np.bincount(wj, sum_a[wi], len(b.levels[lb]))
                count_b += more_b[b.owner[lb]]
            for p, q in zip(wi, wj, strict=True):  # a star on each side spans the whole pair
                pa, pb = oa[ea[p] : ea[p + 1]], ob[eb[q] : eb[q + 1]]
                links.append((np.append(pa, np.full(len(pb), pa[0])), np.append(np.full(len(pa), pb[0]), pb)))
        go = keep & ~whole
        i, j = i[go], j[go]
        if not len(i):
            continue
        key = ("c", level)
        if key not in cache:
            cache[key] = children(a, level), children(b, level)
        (oa, ea), (ob, eb) = cache[key]
        na, nb = ea[i + 1] - ea[i], eb[j + 1] - eb[j]
        size = na * nb
        for low in _slices(size, pairs_at_once):
            s, t = i[low], j[low]
            m, k = size[low], nb[low]
            first = np.repeat(np.cumsum(m) - m, m)
            inside = np.arange(m.sum()) - first
            width = np.repeat(k, m)
            stack.append((level + 1, oa[np.repeat(ea[s], m) + inside // width], ob[np.repeat(eb[t], m) + inside % width]))
    left = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.int64)
    right = np.concatenate([y for _, y in links]) if links else np.zeros(0, np.int64)
    return count_a, count_b, left, right


def _slices(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs whose sizes sum to about ``limit`` at most."""
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield slice(at, upto)
        at = upto


def spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest."""
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(left.tolist(), right.tolist(), strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` centres of a cover tree: each the point farthest from those before."""
    chosen = [0]
    best = CoverTree._distance(x, x[:1])[:, 0]
    while len(chosen) < min(count, len(x)) and best.max() > 0:
        far = int(best.argmax())
        chosen.append(far)
        best = np.minimum(best, CoverTree._distance(x, x[far : far + 1])[:, 0])
    return x[chosen]


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(vectors: DataFrame, cell_rows: int) -> DataFrame:
    """``vectors`` (rep, label, width, embedding, weight) with a block, and the pairs of blocks to compare: (pair, label, width, low, high)."""
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    sizes = vectors.groupBy("label", "width").count()
    large = sizes.where(F.col("count") > cell_rows).orderBy(F.desc("count")).limit(MOST_PIVOTS // 2).collect()
    pivots: dict = {}
    if large:
        wanted = spark.createDataFrame([(r.label, r.width) for r in large], "label string, width int").coalesce(1)
        share = min(1.0, SAMPLE / sum(r["count"] for r in large))
        sample = vectors.join(F.broadcast(wanted), ["label", "width"], "left_semi").where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
        sampled = sample.select("label", "width", "embedding").toPandas()  # SAMPLE rows on average, whatever the input
        budget = MOST_PIVOTS
        for r in large:
            part = sampled[(sampled["label"] == r.label) & (sampled["width"] == r.width)]
            count = min(-(-r["count"] // cell_rows), budget)
            if len(part) and count > 1:
                pivots[r.label, r.width] = choose_pivots(unit(part["embedding"].tolist()), count)
                budget -= count
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, gap = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for (label, width), part in batch.reset_index(drop=True).groupby(["label", "width"]):
                centres = shared.value.get((label, width))
                if centres is not None:
                    d = CoverTree._distance(unit(part["embedding"].tolist()), centres)
                    cell[part.index], gap[part.index] = d.argmin(1), d.min(1)
            yield batch.assign(cell=cell, gap=gap)

    placed = materialize(vectors.mapInPandas(assign, f"rep long, label string, width int, embedding {kind}, weight long, cell long, gap double"), "cells")
    cells = placed.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("reach"))
    cells = materialize(cells.withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("int")), "cell-sizes")
    blocks = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block", F.col("cell") * (1 << 20) + F.col("part"))
    a, b = blocks.alias("a"), blocks.alias("b")
    reachable = F.lit(True)
    pairs = a.join(b, ["label", "width"]).where("a.block <= b.block").select(
        "label", "width", F.col("a.block").alias("low"), F.col("b.block").alias("high"), F.col("a.cell").alias("ca"), F.col("b.cell").alias("cb"), (F.col("a.reach") + F.col("b.reach")).alias("reach")
    )
    if pivots:
        # Cells whose pivots are too far apart for what their vectors reach hold no pair. MOST_PIVOTS bounds the rows.
        near = [
            (label, width, i, j, float(d[i, j]))
            for (label, width), c in pivots.items() for d in [CoverTree._distance(c, c)] for i in range(len(c)) for j in range(len(c))
        ]
        gaps = spark.createDataFrame(near, "label string, width int, ca long, cb long, apart double")
        pairs = pairs.join(gaps, ["label", "width", "ca", "cb"], "left").where(F.col("apart").isNull() | (F.col("apart") <= F.col("reach") + float(np.sqrt(2 - 2 * THRESHOLD)) + EPS))
    pairs = pairs.select("label", "width", "low", "high")
    dealt = cells.select("label", "width", "cell", "blocks")
    sized = placed.join(F.broadcast(dealt) if cells.count() <= FEW_CELLS else dealt, ["label", "width", "cell"])
    blocked = sized.withColumn("block", F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("rep"), F.col("blocks")))
    return blocked.select("rep", "label", "width", "embedding", "weight", "block"), pairs


def near_links(vectors: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """From distinct vectors (rep, label, width, embedding, weight): rows (rep, n, other) with partial link counts (other null) or a link that spans."""
    blocked, pairs = _cells(vectors, cell_rows)
    pairs = materialize(pairs.withColumn("pair", F.xxhash64("label", "width", "low", "high")), "pairs")
    sides = pairs.select("label", "width", F.col("low").alias("block"), "pair", F.lit(0).alias("side"), (F.col("low") == F.col("high")).alias("same")).union(
        pairs.where("low <> high").select("label", "width", F.col("high"), "pair", F.lit(1), F.lit(False))
    )
    work = blocked.join(sides, ["label", "width", "block"]).select("pair", "side", "same", "rep", "embedding", "weight")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable")
        left, right = part[part["side"] == 0], part[part["side"] == 1]
        same = bool(part["same"].iloc[0])
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "n": [], "other": []})
        a = CoverTree(unit(left["embedding"].tolist()))
        b = a if same else CoverTree(unit(right["embedding"].tolist()))
        ids_a, ids_b = left["rep"].to_numpy(), right["rep"].to_numpy()
        count_a, count_b, u, v = dual_links(a, b, left["weight"].to_numpy(float), right["weight"].to_numpy(float), same)
        hit_a, hit_b = np.flatnonzero(count_a), np.flatnonzero(count_b)
        tree = spanning(ids_a[u], ids_b[v])
        rep = np.concatenate([ids_a[hit_a], ids_b[hit_b], np.array([x for x, _ in tree], np.int64)])
        n = np.concatenate([count_a[hit_a], count_b[hit_b], np.zeros(len(tree))]).astype(np.int64)
        other = pd.array([None] * (len(hit_a) + len(hit_b)) + [y for _, y in tree], "Int64")
        return pd.DataFrame({"rep": rep, "n": n, "other": other})

    return work.groupBy("pair").applyInPandas(compare, "rep long, n long, other long")


def near_duplicates(vectors: DataFrame, cell_rows: int = CELL_ROWS, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = materialize(
        vectors.select(F.coalesce(F.col(vec_id).cast("bigint"), F.lit(NO_ID)).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(kind).alias("embedding"))
        .withColumn("fine", F.col("label").isNotNull() & F.coalesce(
            (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(x == x, F.lit(False)) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)))
        .withColumn("key", F.when(F.col("fine"), F.sha2(F.concat_ws("|", "label", F.to_json(F.transform("embedding", lambda x: x + zero))), 256))),
        "vectors",
    )
    fine = rows.where("fine")
    firsts = fine.groupBy("key").agg(F.min_by(F.struct("label", "embedding", "vec_id"), "vec_id").alias("r"), F.count(F.lit(1)).alias("group_size"))
    # Two classes may share a least id only where rows repeat a vec_id; a number of their own keeps them apart.
    distinct = materialize(
        firsts.select("key", F.xxhash64("key").alias("rep"), F.col("r.label").alias("label"), F.size("r.embedding").alias("width"), F.col("r.embedding").alias("embedding"), F.col("group_size").alias("weight"), F.col("r.vec_id").alias("least")),
        "distinct",
    )
    found = materialize(near_links(distinct.select("rep", "label", "width", "embedding", "weight"), cell_rows), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    named = parts.join(distinct.select(F.col("rep").alias("node"), "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = (
        distinct.select("key", "rep", "weight", "least").join(counts, "rep", "left")
        .join(named.join(least, "component").select(F.col("node").alias("rep"), "component_id"), "rep", "left")
        .select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    # Copies reach their class over (key, salt); classes are joined to one row for each class and salt.
    salts = 64
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    seen = salted.where("fine").groupBy("key", "salt").agg(F.count(F.lit(1)).alias("_n")).select("key", "salt").join(classes, "key")
    out = salted.join(seen, ["key", "salt"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    blank = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(blank("vec_id"), "n_links", blank("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_cover_tree": op4_cover_tree}
SQL = {
    "op4_cover_tree": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS w FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN l ON r.w = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.w) AS component_id, e.vec_id = min(r.w) AS kept
FROM embeddings e JOIN reach r ON r.node = e.vec_id GROUP BY e.vec_id
"""
}
