"""Quality filter by importance resampling.

Two generative models over hashed n-grams, one of target texts (labelled good) and one of
the raw corpus, give every document the log of its importance weight: the log ratio of its
probabilities. Adding Gumbel noise to the log weights and taking the k largest sums samples
k documents without replacement in proportion to the weights.

N-grams are single words, word pairs, and pairs of word shapes (letter case, digits, signs,
and whether the word repeats the one before).

The target model is fitted on a bounded sample of labelled documents (``TARGET_DOCS``); the
raw model counts every document. ``k`` is the number of documents whose sum reaches the
middle between labelled good and labelled bad documents (leaving out a share of ``LOSS`` of
either at the border; where they overlap, the good ones' border). It is found by exact
counts, so the sample is the same for every partitioning. A model knows the texts that it was
fitted on, so the weights that give the border are those under target models of the other
folds: each text of the target sample, with its equals, is in one of ``FOLDS``.

Defined cases: a null or empty text has no n-grams and the weight one (log zero). Noise is a
hash of the id and the length, so runs agree and repeated rows share a fate; a null id has a
hash like any other. Without labelled good documents every document stays.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows_decided import text_digest
from .stored import stored
from .word_hashes import REMEMBERED, WordHashes, mixed, multipliers

#: Powers of two.
WORD_BUCKETS = 1 << 14
SHAPE_BUCKETS = 1 << 10
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
TARGET_DOCS = 20_000
LOSS = 0.001
FOLDS = 10
SMOOTHING = 1.0
#: Texts are hashed together until they have so many words.
WORDS_AT_ONCE = 1 << 18
FACTORS = multipliers(4)


class _Marks(dict):
    """The mark of a character, by its number, as ``str.translate`` looks it up."""

    def __missing__(self, number: int) -> str:
        c = chr(number)
        self[number] = mark = "0" if c in "0123456789" else "a" if c.islower() else "A" if c.isupper() else c
        return mark


def _shape(marks: str) -> str:
    """Marks of a word without repeats."""
    return "".join(mark for mark, _ in groupby(marks))


class _Words(dict):
    """Numbers of words; ``words`` and ``shapes`` hold the two hashes of each number."""

    def __init__(self) -> None:
        super().__init__()
        self.words, self.shapes = array("Q"), array("Q")
        # Words have few marks between them, so shapes are remembered by marks.
        self._marks, self._shape_hashes = _Marks(), WordHashes(_shape)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.words)
        self.words.append(xxhash.xxh64_intdigest(word.lower()))
        self.shapes.append(self._shape_hashes[word.translate(self._marks)])
        return number


@lru_cache(maxsize=1)
def _known() -> _Words:
    return _Words()


def _buckets(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Buckets of all n-grams of the texts, some texts at a time, and the n-grams of each."""
    if len(_known()) >= REMEMBERED:
        _known.cache_clear()
    known, numbers, size = _known(), [], 0
    for text in texts:
        split = (text or "").split()
        numbers.append(np.fromiter(map(known.__getitem__, split), dtype=np.int64, count=len(split)))
        size += len(split)
        if size >= WORDS_AT_ONCE:
            yield _joined(known, numbers)
            numbers, size = [], 0
            # Numbers are given anew only where none is in use.
            if len(known) >= REMEMBERED:
                _known.cache_clear()
                known = _known()
    if numbers:
        yield _joined(known, numbers)


def _joined(known: _Words, numbers: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Word, pair and shape pair of every word that has one before it, text after text."""
    sizes = np.array([len(n) for n in numbers], dtype=np.int64)
    every = np.concatenate(numbers)
    words, shapes = np.array(known.words, dtype=np.uint64)[every], np.array(known.shapes, dtype=np.uint64)[every]
    first = np.zeros(len(every) + 1, dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    first = first[:-1]
    before, own_before = np.roll(words, 1), np.roll(shapes, 1)
    repeats = ~first & (words == before)
    shapes = shapes + repeats.astype(np.uint64)
    own_before = own_before + np.roll(repeats, 1).astype(np.uint64)
    out = np.empty((len(every), 3), dtype=np.int64)
    out[:, 0] = words & np.uint64(WORD_BUCKETS - 1)
    out[:, 1] = mixed(before * FACTORS[0] + words * FACTORS[1]) & np.uint64(WORD_BUCKETS - 1)
    out[:, 2] = (mixed(own_before * FACTORS[2] + shapes * FACTORS[3]) & np.uint64(SHAPE_BUCKETS - 1)) + np.uint64(WORD_BUCKETS)
    # The first word of a text is in no pair.
    there = np.ones((len(every), 3), dtype=bool)
    there[first, 1:] = False
    return out[there], (3 * sizes - 2 * (sizes > 0)).tolist()


def buckets_of(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a text."""
    return np.concatenate([found for found, _ in _buckets([text])])


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the ratio of smoothed probabilities; words and shapes are models of their own."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        smooth = [counts[part] + SMOOTHING for counts in (target, raw)]
        out[part] = np.log(smooth[0] / smooth[0].sum()) - np.log(smooth[1] / smooth[1].sum())
    return out


def _counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in each fold of ``docs``; one partial count per task, fold and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDS * BUCKETS, dtype=np.int64)
        for batch in batches:
            folds, end = batch.column("fold").to_numpy(zero_copy_only=False), 0
            for found, own in _buckets(batch.column("text").to_pylist()):
                total += np.bincount(np.repeat(folds[end : end + len(own)], own) * BUCKETS + found, minlength=FOLDS * BUCKETS)
                end += len(own)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select("text", "fold").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(FOLDS * BUCKETS)
    for row in rows.collect():  # at most FOLDS * BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out.reshape(FOLDS, BUCKETS)


def _weights(docs: DataFrame, ratios: np.ndarray, others: np.ndarray) -> DataFrame:
    """Log weights under ``ratios``, and under those of the ``others`` than the document's fold."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
            sizes, weights, held = [], [], []
            for found, own in _buckets(texts):
                logs, end = ratios[found], 0
                for size in own:
                    weights.append(float(logs[end : end + size].sum()))
                    held.append(float(others[folds[len(held)]][found[end : end + size]].sum()))
                    end += size
                sizes += own
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(weights, pa.float64()),
                    pa.array(held, pa.float64()),
                    pa.array([len(text or "") for text in texts], pa.int64()),
                ],
                ["doc_id", "text_key", "n_grams", "log_weight", "held_weight", "n_chars"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(weigh, f"doc_id {kind}, text_key string, n_grams bigint, log_weight double, held_weight double, n_chars bigint")


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise, a function of the columns."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (k from 1), by counts in ever finer bins.

    Each round counts the keys in 4096 equal bins of the interval that holds the answer.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / 4096
        if width == 0 or low + width == low:
            break
        inside = keys.filter(F.col(column).between(low, high))
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(4095))
        counts = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in counts.orderBy(F.col("bin").desc()).collect():  # at most 4096 rows
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["low"], row["high"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    loss: float = LOSS,
) -> DataFrame:
    """The documents sampled: doc_id, n_grams, log_weight, key, kept (always true)."""
    no_key = F.lit(None).cast("string")
    return _sampled(docs, labels, seed, id_column, text_column, loss, no_key).drop("text_key")


def _sampled(
    docs: DataFrame, labels: DataFrame, seed: int, id_column: str, text_column: str, loss: float, text_key: Column
) -> DataFrame:
    source = docs.select(
        F.col(id_column).alias("doc_id"), text_key.alias("text_key"), F.col(text_column).cast("string").alias("text")
    )
    source = source.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(FOLDS)))
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    wanted = F.pmod(F.xxhash64(F.lit(seed), "good_id"), F.lit(1_000_000))
    total = good.count()
    sample = good if total <= TARGET_DOCS else good.filter(wanted < int(1_000_000 * TARGET_DOCS / total))
    target = source.join(sample, source["doc_id"] == sample["good_id"], "left_semi")
    in_folds, raw = _counts(target), _counts(source.withColumn("fold", F.lit(0))).sum(axis=0)
    in_all = in_folds.sum(axis=0)
    others = np.stack([log_ratios(in_all - own, raw) for own in in_folds])
    noise = gumbel(seed, "doc_id", "n_chars")
    keyed = _weights(source, log_ratios(in_all, raw), others)
    keyed = keyed.withColumns({"key": F.col("log_weight") + noise, "held_key": F.col("held_weight") + noise})
    keyed = stored(keyed.drop("n_chars", "held_weight"), "weights")
    # Only texts of the target sample are known to the model.
    sampled = sample.select("good_id", F.lit(True).alias("sampled"))
    labelled = labels.select(F.col("doc_id").alias("good_id"), "quality").join(sampled, "good_id", "left")
    reached = keyed.join(labelled, F.col("doc_id") == F.col("good_id"))
    reached = stored(reached.withColumn("edge", F.when(F.col("sampled"), F.col("held_key")).otherwise(F.col("key"))), "labelled")
    keyed = keyed.drop("held_key")
    edges = {}
    for quality in (1, 0):
        own = reached.filter(F.col("quality") == quality)
        if n := own.count():
            edges[quality] = kth_largest(own, "edge", n - int(n * loss) if quality else int(n * loss) + 1)
    if 1 not in edges:
        return keyed.withColumn("kept", F.lit(True))
    cutoff = (edges[0] + edges[1]) / 2 if edges.get(0, np.inf) < edges[1] else edges[1]
    k = keyed.filter(F.col("key") >= cutoff).count()
    return keyed.filter(F.col("key") >= kth_largest(keyed, "key", k)).withColumn("kept", F.lit(True))


def without_rejected(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the sample holds; of rows of one id each by its own text."""
    digest = text_digest(F.col(text_column))
    kept = _sampled(docs, labels, 0, id_column, text_column, LOSS, digest)
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).distinct()
    marked = docs.withColumn("__digest", digest)
    same = [marked[id_column].eqNullSafe(kept["__kept_id"]), marked["__digest"] == kept["__kept_key"]]
    return marked.join(kept, same, "left_semi").select(*[F.col(f"`{name}`") for name in docs.columns])
