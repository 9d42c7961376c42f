r"""LM scoring by Brown class-based bigrams: P(w | v) = P(class w | class v) * P(w | class w).

Exchange clustering assigns every word to a class. The units it moves are the ``WORDS`` most frequent
words and ``ENDINGS`` groups of words by their last three bytes; a rarer or unseen word takes the class
of its ending's group, so that the class of any token can be told beside the text. The counts of
neighbouring units are gathered once from the whole corpus: at most UNITS squared of them however large it
is, spread over buckets of units. Each round sums them to class contexts, and one of ``TURNS`` shares of the units, in parallel,
each move to the class that raises the likelihood of the class bigrams most; the best assignment of all rounds
stays. The driver sees class tables and the classes of units only, both of fixed size.

Emissions are (c + 1) / (n + V + 1) over the class's n tokens and V known words; the 1 is for any
unseen word of the class, so the probabilities after any class sum to 1. With one class the score is
the base score. Transitions are (n(c, d) + q(d)) / (n(c) + 1) with q the share of class d, add-one.

Counts of the ``KNOWN`` most frequent words go to every task; each other word has a share of at most
some 1 / KNOWN of all tokens and meets its count in one exchange, as (row, word, occurrences).

Tokens: words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, then one end, which also stands before the
first word. Training documents are those whose crc32 of doc_id as text, mod ``FOLDS``, is not ``HELD_OUT``.

Defined cases: null and empty texts are one end; a null doc_id counts as empty text for the fold; rows that
repeat a doc_id are documents of their own; without training documents N and V are 0 and classes are
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import materialize, release, table
from quirelake.llm.words import split_words

FOLDS, HELD_OUT = 7, 2
#: Units of the clustering (together a power of two, below 2**16), classes, rounds, turns in which units move, and words whose counts every task holds.
WORDS, ENDINGS, CLASSES, ROUNDS, TURNS, KNOWN = 12_288, 4_096, 64, 12, 2, 200_000
UNITS = WORDS + ENDINGS
#: Buckets that units are dealt to, tokens packed at a time, different words counted or remembered at a time, and rows taken from a batch at a time.
BUCKETS, BATCH_TOKENS, MEMORY, SLICE = 128, 1_500_000, 200_000, 1_000
#: The end token, which no word equals, and the class that it has to itself.
END, END_CLASS = b"", 0


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))


def is_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


# Word counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, training) to (word, n, n_all): occurrences in training documents and in all."""
    counts = (Counter(), Counter())

    def passed_on() -> pa.RecordBatch:
        held, train = counts
        words = list(train.keys() | held.keys())
        n = [train[w] for w in words]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array([k + held[w] for w, k in zip(words, n, strict=True)], pa.int64())], names=["word", "n", "n_all"])
        for c in counts:
            c.clear()
        return out

    for batch in sliced(batches):
        for raw, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            into = counts[training]
            into.update(split_words(raw, lower=True))
            into[END] += 1
            if len(counts[0]) + len(counts[1]) >= MEMORY:
                yield passed_on()
    if counts[0] or counts[1]:
        yield passed_on()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, n_all) of rows (text binary, training): the end token is the empty word."""
    counted = rows.select("text", "training").mapInArrow(_count_words, "word binary, n long, n_all long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


# Neighbouring units


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers and their counts as byte planes, most of them zeros: 4 of steps, 8 of counts."""
    steps = np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return np.concatenate([steps.ravel(), counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()]).tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(payload, np.uint8).reshape(12, -1)
    steps = np.ascontiguousarray(planes[:4].T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64), np.ascontiguousarray(planes[4:].T).view("<i8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[cut], np.add.reduceat(counts, cut) if len(cut) else counts


def unit_pairs(units: dict[bytes, int], words: int = WORDS):
    """Batches of training texts to (bucket, kind, payload): counts of neighbouring units, under the second unit (kind 0)
    and under the first (kind 1). A number in a payload is unit * UNITS + neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = array("H", [units[END]])
        memory: dict[bytes, int] = dict(units)

        def passed_on() -> pa.RecordBatch:
            ids = np.array(held, np.uint32)  # numbers of pairs stay below UNITS squared, 2**28
            del held[:-1]
            rows = []
            for kind, (one, other) in enumerate(((ids[1:], ids[:-1]), (ids[:-1], ids[1:]))):
                keys, counts = np.unique(one * UNITS + other, return_counts=True)
                bucket = (keys // UNITS % BUCKETS).astype(np.uint8)
                order = np.argsort(bucket, kind="stable")
                keys, counts, bucket = keys[order], counts[order], bucket[order]
                for a, b in zip(*(np.searchsorted(bucket, np.arange(BUCKETS, dtype=np.uint8), side) for side in ("left", "right")), strict=True):
                    if b > a:
                        rows.append((int(bucket[a]), kind, _packed(keys[a:b], counts[a:b])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.binary()), strict=True)], names=["bucket", "kind", "payload"])

        for batch in sliced(batches):
            for raw in batch.column(0).to_pylist():
                for w in split_words(raw, lower=True):
                    u = memory.get(w)
                    if u is None:
                        if len(memory) >= MEMORY:
                            memory = dict(units)
                        u = memory[w] = words + ending(w)
                    held.append(u)
                held.append(units[END])
                if len(held) >= BATCH_TOKENS:
                    yield passed_on()
        if len(held) > 1:
            yield passed_on()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads sorted by bucket to one row of each, both kinds: what waits is summed before it outgrows what is there."""
    now, sums, waiting, size = None, {}, {}, 0

    def settle() -> None:
        nonlocal size
        for kind, parts in waiting.items():
            sums[kind] = _summed(*(np.concatenate(x) for x in zip(*parts, *([sums[kind]] if kind in sums else []), strict=True)))
        waiting.clear()
        size = 0

    def row() -> pa.RecordBatch:
        settle()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([_packed(*sums[kind])], pa.binary()) for kind in (0, 1))], names=["bucket", "lefts", "rights"])

    for batch in batches:
        for bucket, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now:
                if now is not None:
                    yield row()
                now = bucket
                sums.clear()
            part = _unpacked(payload)
            waiting.setdefault(kind, []).append(part)
            size += len(part[0])
            if size >= max(BATCH_TOKENS // 4, sum(len(keys) for keys, _ in sums.values())):
                settle()
    if now is not None:
        yield row()


def gathered_pairs(training: DataFrame, units: dict[bytes, int], words: int = WORDS) -> DataFrame:
    """(bucket, lefts, rights): counts of neighbouring units over the whole of ``training`` (text binary), one row a bucket."""
    spread = training.select("text").mapInArrow(unit_pairs(units, words), "bucket int, kind byte, payload binary")
    return spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged, "bucket int, lefts binary, rights binary")


# Exchange


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(transitions: np.ndarray) -> float:
    """Of the class bigrams, but for what no assignment changes (the words' own counts)."""
    return float(_xlogx(transitions).sum() - _xlogx(transitions.sum(0)).sum() - _xlogx(transitions.sum(1)).sum())


def gain(transitions: np.ndarray, left: np.ndarray, right: np.ndarray, own: float) -> np.ndarray:
    """By how much the likelihood rises when a unit outside all classes joins each: ``left`` and ``right`` are its neighbours
    before and after by class, without itself; ``own`` is how often it follows itself."""
    before, after = np.flatnonzero(left), np.flatnonzero(right)
    rise = lambda table, add: _xlogx(table + add) - _xlogx(table)
    # Column b gains left, row b gains right; the cell (b, b) gains both, and own.
    total = rise(transitions[before, :], left[before, None]).sum(0) + rise(transitions[:, after], right[None, after]).sum(1)
    cell = np.diagonal(transitions)
    total += rise(cell, left + right + own) - rise(cell, left) - rise(cell, right)
    size_in, size_out = left.sum() + own, right.sum() + own
    # The sizes of classes lack this unit's own tokens only: its neighbours count, whatever class it joins.
    return total - rise(transitions.sum(0) + right, size_in) - rise(transitions.sum(1) + left, size_out)


def moves(classes: np.ndarray, transitions: np.ndarray, size: int, turn: int):
    """Rows of gathered_pairs to (unit, class) of the units of this turn that move, to one of ``size`` classes."""

    def contexts(payload: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Units, their neighbours by class, and how often each is its own neighbour, which the second leaves out."""
        keys, counts = _unpacked(payload)
        one, other = keys // UNITS, keys % UNITS
        here, at = np.unique(one, return_inverse=True)
        same = one == other
        sums = np.bincount(at[~same] * CLASSES + classes[other[~same]], counts[~same].astype(float), len(here) * CLASSES)
        return here, sums.reshape(-1, CLASSES), dict(zip(one[same].tolist(), counts[same].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for payloads in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (units, lefts, own), (_, rights, _) = map(contexts, payloads)  # every unit has neighbours on both sides
                for u, left, right in zip(units.tolist(), lefts, rights, strict=True):
                    now = int(classes[u])
                    if now == END_CLASS or zlib.crc32(b"%d" % u) % TURNS != turn:
                        continue
                    rest, itself = transitions.copy(), float(own.get(u, 0))
                    rest[:, now] -= left
                    rest[now, :] -= right
                    rest[now, now] -= itself
                    rises = gain(rest, left, right, itself)
                    rises[END_CLASS] = rises[size:] = -np.inf
                    best = int(rises.argmax())
                    if rises[best] > rises[now] + 1e-9:
                        out.append((u, best))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int32()), pa.array([c for _, c in out], pa.int32())], names=["unit", "class"])

    return run


def class_table(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Class bigrams under an assignment: at most CLASSES squared sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                keys, counts = _unpacked(payload)
                np.add.at(sums, classes[keys // UNITS].astype(np.int64) * CLASSES + classes[keys % UNITS], counts)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(sums[cells], pa.int64())], names=["cell", "n"])

    found = pairs.select("rights").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES * CLASSES)
    for r in found:
        out[r.cell] = r.n
    return out.reshape(CLASSES, CLASSES)


def exchange(pairs: DataFrame, classes: np.ndarray, size: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The best assignment met, its class bigrams, and the likelihood of each round."""
    best, history, still = None, [], 0
    for k in range(rounds + 1):
        transitions = class_table(pairs, classes)
        history.append(likelihood(transitions))
        if best is None or history[-1] > best[0]:
            best = history[-1], classes, transitions
        if k == rounds:
            break
        moved = pairs.mapInArrow(moves(classes, transitions, size, k % TURNS), "unit int, class int").collect()  # at most UNITS rows
        still = 0 if moved else still + 1
        if still == TURNS:
            break
        classes = classes.copy()
        for r in moved:
            classes[r.unit] = r["class"]
    return best[1], best[2], history


# The model and its scores


class ClassModel:
    """What every task needs: units, classes, logarithms of transitions and class sizes, counts of frequent words."""

    def __init__(self, units: dict[bytes, int], classes: np.ndarray, known: dict[bytes, int], words: int = WORDS):
        self.units, self.classes, self.known, self.words = units, classes, known, words
        self.log_transition, self.log_size = np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES)

    def class_of(self, word: bytes) -> int:
        u = self.units.get(word)
        return int(self.classes[self.words + ending(word) if u is None else u])

    def fit(self, transitions: np.ndarray, tokens: np.ndarray, vocabulary: np.ndarray, classes: int) -> ClassModel:
        """Tokens and known words of each class; ``classes``: how many there are."""
        share = (tokens + 1) / (tokens.sum() + classes)
        share[classes:] = 1  # never met
        self.log_transition = np.log10((transitions + share) / (transitions.sum(1, keepdims=True) + 1))
        self.log_size = np.log10(tokens + vocabulary + 1)
        return self


def _class_sizes(counts: DataFrame, model: ClassModel) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and different training words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            at = np.array([model.class_of(w) for w in batch.column(0).to_pylist()], np.int64)
            np.add.at(n, at, batch.column(1).to_numpy())
            v += np.bincount(at, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(n), pa.array(v)], names=["class", "n", "v"])

    sizes = counts.where("n > 0").select("word", "n").mapInArrow(run, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        n[r["class"]], v[r["class"]] = r.n, r.v
    return n, v


def most_frequent(counts: DataFrame, column: str, most: int) -> list:
    """At most ``most`` rows (word, n) with the largest ``column``, all down to a threshold: an eighth of an octave that bins of
    the counts tell, so that no task orders all words."""
    binned = counts.where(F.col(column) > 0).withColumn("bin", F.floor(F.log2(column) * 8).cast("int"))
    least, held = None, 0
    for r in sorted(binned.groupBy("bin").count().collect(), reverse=True):  # at most 8 * 63 bins
        held += r["count"]
        if held > most:
            break
        least = r.bin
    if least is None:
        return []
    return sorted(binned.where(F.col("bin") >= least).select(F.col(column).alias("size"), "word", "n").collect(), key=lambda r: (-r.size, bytes(r.word)))


def fit_classes(rows: DataFrame, counts: DataFrame, classes: int = CLASSES, words: int = WORDS, known: int = KNOWN, rounds: int = ROUNDS) -> tuple[ClassModel, list[float]]:
    """The model from rows (text binary, training) and their word counts; also the likelihood of each round."""
    frequent = most_frequent(counts.where("word <> X''"), "n", words - 1)
    units = {END: 0} | {bytes(r.word): k for k, r in enumerate(frequent, 1)}
    # At the start words are dealt by rank and endings by number; the end has class 0 to itself, unless it is the only class.
    start = np.arange(UNITS) % max(1, classes - 1) + min(1, classes - 1)
    start[0] = END_CLASS
    top = most_frequent(counts, "n_all", known)
    pairs = materialize(gathered_pairs(rows.where("training"), units, words), "unit-pairs")
    found, transitions, history = exchange(pairs, start.astype(np.uint8), classes, rounds if classes > 2 else 0)
    release(pairs)
    model = ClassModel(units, found, {bytes(r.word): r.n for r in top}, words)
    return model.fit(transitions, *_class_sizes(counts, model), classes), history


_PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_classes double, rare array<struct<word: binary, k: long>>"


def _token_parts(shared):
    """Rows (row, doc_id, training, text) to what can be told of them beside the text, and the words whose counts are elsewhere."""
    plain = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("log_classes", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ClassModel = shared.value
        # Of each word of a bounded memory: class, count (-1: elsewhere).
        memory: dict[bytes, tuple[int, int]] = {}
        for batch in sliced(batches):
            out, rare_words, rare_times, ends = [], [], [], [0]
            for row, doc, training, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = split_words(raw, lower=True)
                words.append(END)
                places, counts, rare = array("B", [END_CLASS]), array("q"), Counter()
                for w in words:
                    hit = memory.get(w)
                    if hit is None:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        hit = memory[w] = model.class_of(w), model.known.get(w, -1)
                    places.append(hit[0])
                    counts.append(hit[1])
                    if hit[1] < 0:
                        rare[w] += 1
                at, n = np.array(places, np.int64), np.array(counts)
                log_classes = model.log_transition[at[:-1], at[1:]].sum() - model.log_size[at[1:]].sum()
                out.append((row, doc, not training, len(words), int((n > 0).sum()), float(np.log10(n[n > 0] + 1.0).sum()), float(log_classes)))
                rare_words += rare.keys()
                rare_times += rare.values()
                ends.append(len(rare_words))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), plain, strict=True)]
            met = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], names=["word", "k"])
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), met)], names=[*plain.names, "rare"])

    return run


def class_scores(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", classes: int = CLASSES, words: int = WORDS, known: int = KNOWN, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row; scores are log10 probabilities."""
    spark = documents.sparkSession
    ids = F.col(doc_id).cast("bigint")
    rows = documents.select(ids.alias("doc_id"), is_training(ids).alias("training"), F.col(text).cast("binary").alias("text"))
    counts = materialize(word_counts(rows), "word-counts")
    total, vocabulary = (int(x or 0) for x in counts.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first())
    model, _ = fit_classes(rows, counts, classes, words, known, rounds)
    shared = spark.sparkContext.broadcast(model)  # UNITS classes, KNOWN counts, CLASSES squared transitions
    parts = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "training", "text").mapInArrow(_token_parts(shared), _PARTS), "token-parts", codec="zstd")
    rare = parts.select("row", F.inline("rare"))
    met = rare.join(counts.where("n > 0").select("word", "n"), "word").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_counts"), F.sum("k").alias("rare_known")
    )
    joined = parts.drop("rare").join(met, "row", "left")
    log_counts = F.col("log_counts") + F.coalesce("rare_counts", F.lit(0.0))
    score = log_counts + F.col("log_classes")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.lit(float(np.log10(total + vocabulary + 1)))).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op12_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op12_class_ngrams": op12_class_ngrams}
#: The clustering is iterative and DuckDB has no crc32; tests hold counts, base score and model against plain Python.
SQL: dict[str, str] = {}
