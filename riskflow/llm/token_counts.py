"""Token counts of texts by byte-pair merges on ragged arrays.

A text is split at the vocabulary's special strings, then into pre-tokens (runs of letters,
digits, signs or white space). Distinct pre-tokens of a batch lie behind each other in one
array of byte symbols, a ragged array. Every round finds each sequence's lowest-ranked pair
and merges it wherever it occurs, in all sequences at once, until no sequence has a pair of
the vocabulary left. What is counted are the symbols that survive.

Long sequences would need many rounds over mostly unchanged symbols. They merge the same way,
lowest rank first at all its places, but places are kept by rank and symbols in a linked
list, so that a round touches only what it changes.

Defined cases: a null text is an empty one and has no tokens. Every row gives one row, also
where ids repeat or are null; equal rows give equal counts. An empty table gives no rows. A
text is counted whole, in parts of bounded size; memory grows with its longest pre-token
only. A special string in a text is one token. Columns other than id and text play no part,
whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import Recent

TOKEN_LIMIT = 1024
# Symbols from which on a sequence is merged by places instead of in rounds.
LONG = 256
# Characters of the texts whose pre-tokens are merged together.
BATCH_CHARS = 1 << 20
PART_TOKENS = 1 << 16

# The pre-tokens of byte-level vocabularies.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Bytes that are written as the character of the same number.
VISIBLE_BYTES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


def byte_characters() -> list[str]:
    """The character that stands for each byte: visible ones themselves, others from 256 on."""
    visible = {byte for first, last in VISIBLE_BYTES for byte in range(first, last + 1)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in visible else chr(next(others)) for byte in range(256)]


class Merges:
    """The merges of a byte-level vocabulary, by rank, over arrays of symbols."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], bytes_: np.ndarray) -> None:
        """``ranks`` maps a pair of symbols to its rank and what it becomes."""
        pairs = np.array(list(ranks), dtype=np.int64).reshape(-1, 2)
        values = np.array(list(ranks.values()), dtype=np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.none = int(values[:, 0].max(initial=-1)) + 1
        # A key above all others, so that a search always lands on a key.
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._ranks = np.append(values[order, 0], self.none)
        self._merged = np.zeros(self.none + 1, dtype=np.int64)
        self._merged[values[:, 0]] = values[:, 1]
        self._bytes = bytes_
        first, second = np.divmod(np.arange(1 << 16), 256)
        self._byte_ranks = self.ranks(bytes_[first], bytes_[second])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._ranks[at], self.none)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.minimum(lengths, 1)
        short = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        if len(short):
            counts[short] = self._in_rounds([words[i] for i in short], lengths[short])
        for i in np.flatnonzero(lengths > LONG):
            counts[i] = self._by_places(np.frombuffer(words[i], np.uint8))
        return counts

    def _start(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of bytes, and the rank of each with its right neighbour."""
        pair = data[:-1].astype(np.int64) << 8 | data[1:]
        return self._bytes[data], np.append(self._byte_ranks[pair], self.none)

    def _in_rounds(self, words: list[bytes], lengths: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(words), dtype=np.int64)
        symbols, rank = self._start(np.frombuffer(b"".join(words), np.uint8))
        word = np.repeat(np.arange(len(words)), lengths)
        # The last symbol of a word has no right neighbour.
        rank[np.cumsum(lengths) - 1] = self.none
        while len(word):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == self.none
            counts[word[starts[done]]] = sizes[done]
            if done.any():
                active = np.repeat(~done, sizes)
                symbols, rank, word = symbols[active], rank[active], word[active]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(word):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            hits = _without_overlaps(hits, hits[1:] == hits[:-1] + 1)
            symbols[hits] = self._merged[rank[hits]]
            stays = np.ones(len(word), dtype=bool)
            stays[hits + 1] = False
            # A merged symbol is the last one of its word where the right half was.
            closes = np.append(word[1:] != word[:-1], True)[hits + 1]
            places = hits - np.arange(len(hits))
            symbols, rank, word = symbols[stays], rank[stays], word[stays]
            rank[places[closes]] = self.none
            open_ = places[~closes]
            before = places[places > 0] - 1
            before = before[word[before] == word[before + 1]]
            for at in (open_, before):
                rank[at] = self.ranks(symbols[at], symbols[at + 1])
        return counts

    def _by_places(self, data: np.ndarray) -> int:
        symbols, rank = self._start(data)
        n = len(symbols)
        # Place n closes the list; its rank is never a pair's.
        symbols, rank = np.append(symbols, 0), np.append(rank, self.none)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def keep(at: np.ndarray) -> None:
            at = at[rank[at] < self.none]
            at = at[np.argsort(rank[at], kind="stable")]
            ranks, starts = np.unique(rank[at], return_index=True)
            for number, own in zip(ranks.tolist(), np.split(at, starts[1:])):
                if number not in places:
                    places[number] = []
                    heapq.heappush(waiting, number)
                places[number].append(own)

        keep(np.arange(n))
        left = n
        while waiting:
            lowest = heapq.heappop(waiting)
            hits = np.unique(np.concatenate(places.pop(lowest)))
            hits = hits[rank[hits] == lowest]
            if not len(hits):
                continue
            hits = _without_overlaps(hits, hits[1:] == after[hits[:-1]])
            gone = after[hits]
            symbols[hits] = self._merged[lowest]
            rank[gone] = self.none
            after[hits] = after[gone]
            before[after[hits]] = hits
            left -= len(hits)
            changed = np.append(hits, before[hits[before[hits] >= 0]])
            changed = np.unique(changed)
            right = after[changed]
            rank[changed] = np.where(right < n, self.ranks(symbols[changed], symbols[right]), self.none)
            keep(changed)
        return left


def _without_overlaps(hits: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of hits whose pairs share symbols in a row, every second one from the left on."""
    if not touches.any():
        return hits
    number = np.arange(len(hits))
    first = np.append(True, ~touches)
    run = np.maximum.accumulate(np.where(first, number, 0))
    return hits[(number - run) % 2 == 0]


class TokenCounter:
    """Counts the tokens that a byte-level vocabulary file gives; remembers frequent words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model, splitter = config["model"], config["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE"
            and not any(model.get(name) for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not model.get("ignore_merges")
            and config["normalizer"] is None
            and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
        )
        marked = any(t[name] for t in config["added_tokens"] for name in ("single_word", "lstrip", "rstrip", "normalized"))
        if not plain or marked:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        vocabulary = model["vocab"]
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self._merges = Merges(ranks, np.array([vocabulary[c] for c in byte_characters()], dtype=np.int64))
        special = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._pre_token = regex.compile(PRE_TOKEN)
        self._known = Recent()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals = [0] * len(texts)
        parts: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            sections = self._special.split(text) if self._special else [text]
            totals[i] += len(sections) - 1
            for section in sections:
                for words, chars in self._words(section):
                    parts.append((i, words))
                    size += chars
                    if size >= BATCH_CHARS:
                        self._add(parts, totals)
                        parts, size = [], 0
        self._add(parts, totals)
        return totals

    def _words(self, section: str) -> Iterator[tuple[list[str], int]]:
        """Pre-tokens of a section with their characters, in lists of bounded size."""
        if len(section) <= BATCH_CHARS:
            yield self._pre_token.findall(section), len(section)
            return
        found = (match[0] for match in self._pre_token.finditer(section))
        while words := list(islice(found, PART_TOKENS)):
            yield words, sum(map(len, words))

    def _add(self, parts: list[tuple[int, list[str]]], totals: list[int]) -> None:
        unknown = self._known.missing(set().union(*(words for _, words in parts)))
        fresh = self._merges.counts([word.encode() for word in unknown]).tolist()
        known = self._known.add(dict(zip(unknown, fresh)))
        for i, words in parts:
            totals[i] += sum(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = TOKEN_LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Tokens of every text, and whether they are more than ``limit``.

    Returns the id, n_bytes (of the text in UTF-8), n_tokens and over_limit. Counting needs
    no shuffle; the vocabulary file lies at the same path on every executor.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column), text.alias("__text"))
    fields = T.StructType([rows.schema[id_column], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            totals: list[int] = []
            start = 0
            while start < len(texts):
                # A few texts become Python objects at a time.
                stop, chars = start, 0
                group: list[str] = []
                while stop < len(texts) and (not group or chars < BATCH_CHARS):
                    group.append(texts[stop].as_py())
                    chars += len(group[-1])
                    stop += 1
                totals += counter.counts(group)
                start = stop
            sizes = pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            columns = [batch.column(0), sizes, pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    return rows.mapInArrow(count, fields).withColumn("over_limit", F.col("n_tokens") > limit)
