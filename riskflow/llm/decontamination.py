"""Benchmark passages in training texts by spaced-seed hashing.

Texts are sequences of words (lower case, without punctuation at their ends). A seed is a
window of words of which a fixed mask ignores some, so a replaced word under an ignored
position does no harm. Hashes of the benchmark's windows, under every mask, meet those of
the documents' windows. Every stretch that can be a leak meets under one of the masks. Around each meeting the two texts are laid side by side and the
stretch with the best score (a point for an equal word, three off for another) is taken; it
is a leak if it is long enough.

The benchmark is the smaller table. It is worked off in blocks of bounded size, each of
which goes to all tasks; documents are read once per block, whole, and never shuffled.

Defined cases: a null or empty text has no words and no leaks; items without words match
nothing; items shorter than a window must be found as a whole, those under eight words
without any replaced word. Repeated items or documents give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows_decided import text_digest
from .word_hashes import WordHashes, mixed, multipliers

SPAN = 12
BLOCK_CHARS = 4_000_000
BATCH_WORDS = 200_000
MISMATCH = 3
#: A replaced word needs three equal words before it and four after it.
WHOLE = 8
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’–—…¿¡"

# Positions kept. What ends a stretch of best score always has more points than it has off: of
# its last 12 words the last four are equal, of the four before them three at least, and two
# replaced words are the most. So one half of the middle four is equal, with the last four.
MASKS = ((4, 5, 8, 9, 10, 11), (6, 7, 8, 9, 10, 11))
FACTORS = multipliers(SPAN)
SALTS = multipliers(len(MASKS) + 1)


def _normal_word(word: str) -> str:
    return word.lower().strip(PUNCTUATION)


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes(_normal_word)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, without those that are punctuation only."""
    values = _hashes().of((text or "").split())
    return values[values != 0]


def masks_of(span: int) -> list[tuple[int, ...]]:
    """The positions that each mask keeps in windows of ``span`` words."""
    if span < WHOLE:
        return [tuple(range(span))]
    return [tuple(i - SPAN + span for i in mask if i >= SPAN - span) for mask in MASKS]


def window_hashes(words: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """Hashes of all windows, under one mask after the other."""
    count = len(words) - span + 1
    terms = [words[i : i + count] * FACTORS[i] for i in range(span)]
    for number, positions in enumerate(masks_of(span)):
        yield mixed(reduce(np.add, [terms[i] for i in positions]) ^ (SALTS[number] + np.uint64(span)))


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch of best score; the earliest of equal ones."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISMATCH))))
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.argmin(total[: end + 1]))
    return start, end


class Seeds:
    """The benchmark items of one block and the hashes of their windows."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        found = [(item, words_of(text)) for item, text in items]
        self.items = [(item, words) for item, words in found if len(words)]
        self.spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for number, (_, words) in enumerate(self.items):
            span = min(SPAN, len(words))
            for hashes in window_hashes(words, span):
                places = np.arange(len(hashes))
                rows.setdefault(span, []).append((hashes, np.full(len(hashes), number), places))
        for span, parts in rows.items():
            keys, numbers, places = (np.concatenate(column) for column in zip(*parts))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            present = np.zeros(1 << 22, dtype=bool)
            present[keys >> np.uint64(42)] = True
            self.spans[span] = (keys, numbers[order], places[order], present)

    def meetings(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in words, item number, place in the item) of equal windows."""
        for span, (keys, numbers, places, present) in self.spans.items():
            if len(words) < span:
                continue
            for hashes in window_hashes(words, span):
                near = np.flatnonzero(present[hashes >> np.uint64(42)])
                low = np.searchsorted(keys, hashes[near], side="left")
                high = np.searchsorted(keys, hashes[near], side="right")
                for at, first, last in zip(near.tolist(), low.tolist(), high.tolist()):
                    for entry in range(first, last):
                        yield at, int(numbers[entry]), int(places[entry])

    def leaks(self, words: np.ndarray, diagonals: set[tuple[int, int]]) -> list[tuple[object, int, int, int, int]]:
        """(item, first word, first word in the item, words, equal words), the best per item."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for number, shift in sorted(diagonals):
            item = self.items[number][1]
            start = max(0, shift)
            own = words[start : shift + len(item)]
            other = item[start - shift : start - shift + len(own)]
            equal = own == other
            low, high = best_stretch(equal)
            if high - low >= min(SPAN, len(item)):
                candidate = (start + low, start - shift + low, high - low, int(equal[low:high].sum()))
                if number not in best or (candidate[3], -candidate[0]) > (best[number][3], -best[number][0]):
                    best[number] = candidate
        return [(self.items[number][0], *best[number]) for number in sorted(best)]


def _leaks_in(seeds: Seeds, arrays: list[np.ndarray]) -> Iterator[tuple[int, tuple]]:
    """(index of the text, leak) over neighbouring texts, hashed as one long text."""
    ends = np.cumsum([len(words) for words in arrays])
    together = np.concatenate(arrays)
    diagonals: dict[int, set[tuple[int, int]]] = {}
    for at, number, place in seeds.meetings(together):
        index = int(np.searchsorted(ends, at, side="right"))
        start = int(ends[index]) - len(arrays[index])
        if at + min(SPAN, len(seeds.items[number][1])) <= ends[index]:
            diagonals.setdefault(index, set()).add((number, at - start - place))
    for index in sorted(diagonals):
        for leak in seeds.leaks(arrays[index], diagonals[index]):
            yield index, leak


def _block_leaks(docs: DataFrame, items: list[tuple[object, str | None]], item_type: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_arrow = pa.int64() if item_type == "bigint" else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(items)
        for batch in batches:
            ids, rows, first = batch.column("doc_id"), [], 0
            held: list[np.ndarray] = []
            size = 0
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                held.append(words)
                size += len(words)
                if size >= BATCH_WORDS or i + 1 == len(ids):
                    rows += [(first + index, *leak) for index, leak in _leaks_in(seeds, held)]
                    held, size, first = [], 0, i + 1
            columns = list(zip(*rows)) or [[], [], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], item_arrow),
                    *[pa.array(column, pa.int64()) for column in columns[2:]],
                ],
                ["doc_id", "item_id", "first_word", "item_word", "n_words", "n_equal"],
            )

    return docs.mapInArrow(
        search, f"doc_id {kind}, item_id {item_type}, first_word bigint, item_word bigint, n_words bigint, n_equal bigint"
    )


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and item found in it, with the best stretch, in words."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    items = benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text_column).cast("string").alias("text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = [
        _block_leaks(source, [tuple(row) for row in items.filter(number == block).collect()], item_type)
        for block in range(blocks)
    ]
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text nothing of the benchmark was found."""
    # What leaks is a text; an id may be null or name several.
    texts = docs.select(text_digest(F.col(text_column)).alias("__digest"), F.col(text_column).alias("__text"))
    leaking = benchmark_leaks(texts, benchmark, "__digest", "__text").select(F.col("doc_id").alias("__digest")).distinct()
    marked = docs.withColumn("__digest", text_digest(F.col(text_column)))
    return marked.join(leaking, "__digest", "left_anti").select(*[F.col(f"`{name}`") for name in docs.columns])
