"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed on the executors and written once. Trees are fitted in
numpy on the driver from a bounded sample of labelled rows (``MAX_LABELLED``), flattened into arrays
and traversed for whole batches at a time.

Defined cases: null and empty texts have all statistics 0 and get a score like any other; null
labels and labels of unknown documents are ignored; of several labels of a document the mean counts,
1 from one half; a null doc_id takes part in no fit; rows that repeat get equal scores; without
labels of both classes the score is the share of ones (0.5 without any); an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import held_out, materialize, table

#: Labelled rows to fit on at most, taken in hash order of their ids.
MAX_LABELLED = 20_000
FEATURES = (
    "log_words", "mean_word", "distinct_words", "top_word", "repeat_word", "repeat_pair", "upper", "digit", "punct", "symbol", "bang",
    "bar", "other", "lines", "distinct_lines", "line_words", "sentence", "one_char", "compress", "word_end_symbol", "upper_words", "distinct_tail",
)
_CLASS = bytearray(256)  # of each byte: 1 upper, 2 lower, 3 digit, 4 blank, 5 common punctuation, 6 !, 7 |, 8 other symbols, 9 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 9 if _b > 127 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _b in b" \t\n\r\x0b\x0c" else 5 if _c in ".,;:'\"?-()" else 6 if _c == "!" else 7 if _c == "|" else 8
_CLASS = bytes(_CLASS)
CHUNK = 1 << 15


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    kinds = np.bincount(np.frombuffer(raw.translate(_CLASS), np.uint8), minlength=10) / size
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = raw.count(b". ") + raw.count(b".\n") + 1
    packed = len(zlib.compress(raw, 1)) if size <= CHUNK else sum(len(zlib.compress(raw[i : i + CHUNK], 1)) for i in range(0, size, CHUNK))
    ends = sum(c for w, c in counts.items() if _CLASS[w[-1]] >= 6 and w[-1] < 128)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    single = sum(c for w, c in counts.items() if len(w) == 1)
    same = sum(map(bytes.__eq__, words, words[1:]))
    once = sum(c == 1 for c in counts.values())
    return [
        np.log1p(n), size / n, len(counts) / n, top / n, same / n, pairs / n, kinds[1], kinds[3], kinds[5], kinds[8], kinds[6],
        kinds[7], kinds[9], np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines), n / sentences, single / n, packed / size,
        ends / n, upper / n, once / len(counts),
    ]


def document_statistics(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, f array<float>) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "f": [[float(x) for x in statistics(t)] for t in batch["text"]]})

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, f array<float>")


class BoostedTrees:
    """Binary log-loss boosting on at most 64 bins a feature; trees of fixed depth in flat arrays.

    Node k of a tree has the children 2k+1 and 2k+2; ``feature`` and ``threshold`` hold the inner
    nodes of all trees, ``leaf`` the values of their last level.
    """

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base = 0.0
        self.feature = np.zeros((0, 0), np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        share = float(y.mean()) if n else 0.5
        self.base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        inner = (1 << self.depth) - 1
        if n == 0 or share in (0.0, 1.0):
            self.feature, self.threshold, self.leaf = np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1))
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")).astype(np.float32) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], 1)  # bin b: edge[b-1] < value <= edge[b]
        flat = binned + np.arange(width) * self.bins
        margin = np.full(n, self.base)
        feature, threshold, leaf = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            f_tree, t_tree = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            for level in range(self.depth):
                first, k = (1 << level) - 1, 1 << level
                at = ((node - first) * width * self.bins)[:, None] + flat
                shape = (k, width, self.bins)
                size = k * width * self.bins
                gs = np.bincount(at.ravel(), np.repeat(g, width), size).reshape(shape).cumsum(2)
                hs = np.bincount(at.ravel(), np.repeat(h, width), size).reshape(shape).cumsum(2)
                cs = np.bincount(at.ravel(), minlength=size).reshape(shape).cumsum(2)
                gt, ht, ct = gs[:, :1, -1:], hs[:, :1, -1:], cs[:, :1, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(cs < self.least) | (ct - cs < self.least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                for i in range(k):
                    j, b = divmod(int(best[i]), self.bins)
                    if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                        f_tree[first + i], t_tree[first + i] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(n), f_tree[node]] > t_tree[node])
            last = node - inner
            values = -np.bincount(last, g, inner + 1) / (np.bincount(last, h, inner + 1) + self.l2) * self.rate
            margin += values[last]
            feature.append(f_tree), threshold.append(t_tree), leaf.append(values)
        self.feature, self.threshold, self.leaf = np.stack(feature), np.stack(threshold), np.stack(leaf)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: every tree steps all rows down one level at a time."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            margin += leaf[node - len(f)]
        return 1 / (1 + np.exp(-margin))


def training_labels(labels: DataFrame, column: str, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, y) of at most ``limit`` labelled rows outside the held-out fold, in hash order of the ids."""
    rows = labels.where(F.col(column).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def quality_scores(documents: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3, limit: int = MAX_LABELLED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``."""
    stats = materialize(document_statistics(documents, text, doc_id), "statistics")
    chosen = materialize(training_labels(labels, column, limit), "labels")
    sample = stats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("f", "y").toPandas()  # at most ``limit`` rows
    x = np.array(sample["f"].tolist(), np.float32).reshape(len(sample), len(FEATURES))
    state = documents.sparkSession.sparkContext.broadcast(vars(BoostedTrees().fit(x, sample["y"].to_numpy(float))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = BoostedTrees()
        vars(model).update(state.value)
        for batch in batches:
            x = np.array(batch["f"].tolist(), np.float32).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.predict(x)})

    scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_boosted_quality": op3_boosted_quality}
SQL: dict[str, str] = {}
