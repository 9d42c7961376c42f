r"""Spelling variant grouping: an even-partition pigeonhole join within one edit.

A word of l code points is cut into two segments, the first of l // 2. If two words are one edit
apart, one segment of the shorter (or equal) word is whole in the other: the first at the same
position, the second shifted by the difference of their lengths. So each word is indexed by its two
segments (with its length) and probes, with its own segments, words of its length, and, with
substrings at the shifted positions, words one shorter. What is left between a matching start and a
matching end is the hole that the edit must lie in.

A segment that many words share is cut further by the same rule: the hole is halved, which adds half
of what is left to the key, until a group holds at most ``GROUP`` words or its hole is one code point
(then the alphabet bounds it). So no group is joined with itself while it is large, and no pair is
lost. Candidates are verified to be one edit apart and deduplicated.

Words: maximal runs ``[A-Za-zÀ-ÿ]+``, A-Z lower-cased; where 31 divides the crc32 of
``<doc_id>:<run>``, the run loses its code point crc32 % length (a planted misspelling). Words are the
results of at least ``LEAST_LENGTH`` code points with at least ``LEAST_COUNT`` occurrences.

A word's form is its near word of largest n (ties: the least in code-point order) if that n is at least
``RATIO`` times its own; its root is where forms lead. n grows tenfold with each form, so chains are
short and cannot close.

Defined cases: null texts have no runs; a null doc_id counts as empty text before the colon; rows that
repeat a doc_id or a text all count; runs of any length are taken whole; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import materialize, release, table

LEAST_LENGTH, LEAST_COUNT, RATIO, DROPPED = 7, 2, 10, 31
#: Words of one segment group before its hole is halved.
GROUP = 24
#: Different words counted in a task before they are passed on.
MEMORY = 1_000_000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def document_words(prefix: bytes, text: bytes) -> list[str]:
    """The words of one text, misspelt where the checksum says so; ``prefix`` is ``<doc_id>:``."""
    start, found = zlib.crc32(prefix), []
    for run in _RUN.findall(text.lower().decode()):  # bytes.lower() turns A-Z only
        h = zlib.crc32(run.encode(), start)
        if h % DROPPED:
            found.append(run)
        elif len(run) > LEAST_LENGTH:
            at = h % len(run)
            found.append(run[:at] + run[at + 1 :])
    return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def passed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for prefix, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update(document_words(prefix, text))
            if len(counts) >= MEMORY:
                yield passed_on()
    if counts:
        yield passed_on()


def word_counts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n) of the words that occur often enough; counted in each task before the exchange."""
    prefix = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).cast("binary")
    rows = documents.where(F.col(text).isNotNull()).select(prefix.alias("prefix"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _entry(length: Column, low: Column, high: Column, longer: int) -> Column:
    """One index or probe entry: the word's rest outside the hole [low, high) of an indexed word of ``length``.

    ``longer`` 1: as probe of words one shorter, whose end starts one later in this word.
    """
    start = F.substring(F.col("word"), F.lit(1), low)
    end = F.substring(F.col("word"), high + 1 + longer, length - high)
    key = F.concat_ws("|", length, low, high, start, end)
    return F.struct(key.alias("key"), length.alias("length"), low.alias("low"), high.alias("high"), F.lit(longer).alias("longer"))


def segment_entries(words: DataFrame) -> DataFrame:
    """(word, n, key, length, low, high, longer): each word's two segments, as index and as probe of equal or shorter words."""
    entries = []
    for longer in (0, 1):
        length = F.length("word") - longer
        middle = (length / 2).cast("int")
        entries += [_entry(length, F.lit(0), middle, longer), _entry(length, middle, length, longer)]
    return words.select("word", "n", F.inline(F.array(*entries)))


def halved(entries: DataFrame) -> DataFrame:
    """The same entries with each hole in two."""
    parts = []
    for longer in (0, 1):
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        parts.append(F.array(_entry(F.col("length"), F.col("low"), middle, longer), _entry(F.col("length"), middle, F.col("high"), longer)))
    return entries.select("word", "n", F.inline(F.when(F.col("longer") == 0, parts[0]).otherwise(parts[1])))


def _verified(entries: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): candidates of a segment that are one edit apart; of equal lengths each pair once."""
    indexed = entries.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    probes = entries.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    near = F.levenshtein("a", "b", 1) == 1
    return indexed.join(probes, "key").where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & near).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words`` (word, n; distinct words) exactly one edit apart, once."""
    entries, found, levels = segment_entries(words), [], []
    while True:
        entries = materialize(entries, "entries")
        levels.append(entries)
        # Large groups whose hole can still be cut; the others are joined as they are.
        sizes = entries.where("high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group)
        large = materialize(sizes.select("key"), "large")
        levels.append(large)
        if large.isEmpty():
            found.append(materialize(_verified(entries), "near"))
            break
        found.append(materialize(_verified(entries.join(large, "key", "left_anti")), "near"))
        entries = halved(entries.join(large, "key", "left_semi"))
    release(*levels)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = materialize(pairs.distinct(), "pairs")
    release(*found)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: links are doubled until none leads further, written after each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = materialize(word_counts(documents, text, doc_id), "words")
    pairs = near_pairs(words, group)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    grouped = words.join(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "word", "left")
    is_form = -F.col("best.minus") >= RATIO * F.col("n")
    named = materialize(
        grouped.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
        ), "variants",
    )
    release(pairs, words)
    led = roots(named.where("form is not null"))
    return named.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
#: DuckDB has no crc32, so SQL cannot tell which runs lose a code point; tests hold the query against plain Python.
SQL: dict[str, str] = {}
