"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become pieces: token ids closed by a separator, cut only where they are longer
than a sequence. What is planned is the histogram of piece lengths, never the pieces: best
fit, longest first, puts all pieces of one length at once into the fullest sequences they
fit in. The plan is a list of runs (length, first rank, count, first sequence, offset).
Pieces then take their slot by their rank among the pieces of their length. Ranks are a
count within the task that wrote the piece plus the counts of the tasks before it, so no
task sees all pieces of a length.

Defined cases: a null text is an empty one and becomes the separator alone. Repeated rows
are pieces of their own. An empty table gives no pieces. The plan's size depends on the
sequence length only, so it may be kept whole on the driver and in each task.
"""

from __future__ import annotations

import os
import zlib
from bisect import insort
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

SEQUENCE_TOKENS = 2048
SEPARATOR = np.zeros(1, "<u4").tobytes()
CACHE_WORDS = 100_000
CACHE_CHARS = 64

#: Characters of the texts that are split together, and words whose ids are remembered.
GROUP_CHARS = 1 << 21
KEPT_WORDS = 150_000

# A run of letters and a run of signs after it are tokenized apart from each other. These
# letters have one form only, and lower case one by one.
PLAIN_WORD = r"^(?P<letters>[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
# Second bytes of those letters that a byte-level vocabulary does not write as the character of their number.
OTHER_BYTES = "\x9f\xa0\xad"


class Recent:
    """A bounded memory of two generations; what is still used moves to the younger one."""

    def __init__(self) -> None:
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Words not remembered; the others are in the younger generation from now on."""
        young, old = self._young, self._old
        unknown = []
        for word in words:
            if word not in young:
                if (ids := old.get(word)) is None:
                    unknown.append(word)
                else:
                    young[word] = ids
        return unknown

    def add(self, fresh: dict[str, bytes]) -> Mapping[str, bytes]:
        """Remember ``fresh``; returns the younger generation, which has all words asked for last."""
        young = self._young
        young.update(fresh)
        if len(young) > CACHE_WORDS:
            self._old = {word: ids for word, ids in young.items() if len(word) <= CACHE_CHARS}
            self._young = {}
        return young


class Remembered:
    """Ids of words as binary values; those of words given lately are kept, a bounded number."""

    def __init__(self, ids_of: Callable[[pa.Array], pa.Array]) -> None:
        self._ids_of = ids_of
        self._words, self._ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        at = pc.index_in(words, value_set=self._words)
        fresh = words.filter(at.is_null())
        known, ids = self._words, self._ids
        if len(fresh):
            known, ids = pa.concat_arrays([known, fresh]), pa.concat_arrays([ids, self._ids_of(fresh)])
            places = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            places[places < 0] = len(self._words) + np.arange(len(fresh))
            at = pa.array(places)
        found = ids.take(at)
        if len(known) > KEPT_WORDS:
            known, ids = words[:KEPT_WORDS], found[:KEPT_WORDS]
        short = pc.less_equal(pc.binary_length(known), CACHE_CHARS)
        self._words, self._ids = known.filter(short), ids.filter(short)
        return found


class WordIds:
    """Token ids of texts, as little-endian bytes.

    The tokenizer never merges across white space, so the ids of a text are those of its
    words in turn, and words given lately are remembered. The memory is bounded.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # For words that normalizing and splitting leave as they are.
        self._merges = Tokenizer(self._tokenizer.model)
        self._merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._written = {byte: written.pre_tokenize_str(chr(ord(byte) + 0x40))[0][0][1] for byte in OTHER_BYTES}
        self._words, self._letters, self._signs = Remembered(self._of_words), Remembered(self._of_letters), Remembered(self._encoded)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True

    def texts(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array([text.replace("\n", " ") for text in texts], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        # Binary values lie behind each other, so those of all words are the ids of all texts.
        ids = self._words.of(words.dictionary).take(words.indices)
        _, ends, data = ids.buffers()
        places = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        return [data[start:end].to_pybytes() if start < end else b"" for start, end in zip(places, places[1:])]

    def _of_words(self, words: pa.Array) -> pa.Array:
        parts = pc.extract_regex(words, PLAIN_WORD)
        plain = parts.is_valid()
        letters = pc.utf8_lower(parts.field("letters").filter(plain)).dictionary_encode()
        signs = parts.field("signs").filter(plain).dictionary_encode()
        both = [own.of(part.dictionary).take(part.indices) for own, part in ((self._letters, letters), (self._signs, signs))]
        found = pa.concat_arrays([pc.binary_join_element_wise(*both, pa.scalar(b"", pa.large_binary())), self._encoded(words.filter(pc.invert(plain)))])
        # Plain words came before the others.
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        return found.take(pa.array(np.argsort(order)))

    def _of_letters(self, words: pa.Array) -> pa.Array:
        """Words of small plain letters only, merged as one text: each ends where a token ends a word."""
        # Every byte as the character of its number, but for some.
        text = " ".join(words.to_pylist()).encode().decode("latin-1")
        for byte, character in self._written.items():
            text = text.replace(byte, character)
        ids = np.array(self._merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._ends[np.minimum(ids, len(self._ends) - 1)]) + 1
        if len(ends) != len(words):
            return self._encoded(words)
        places = np.append(0, 4 * ends)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ids)])

    def _encoded(self, words: pa.Array) -> pa.Array:
        encoded = self._tokenizer.encode_batch(words.to_pylist(), add_special_tokens=False)
        return pa.array([np.array(ids.ids, "<u4").tobytes() for ids in encoded], pa.large_binary())


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _groups(texts: pa.Array, chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts in turn, in lists of bounded size (or one text)."""
    group, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def pieces_of(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = SEQUENCE_TOKENS,
    with_ids: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, ids (if asked for).

    ``part`` is the task that made the piece, ``part_rank`` its rank there among pieces of
    its length; both are fixed once the result is stored.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _word_ids(tokenizer_path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for group in _groups(batch.column("text")):
                rows, payload = [], []
                for i, data in enumerate(words.texts(group)):
                    data += SEPARATOR
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[start : start + 4 * capacity]
                        length = len(own) // 4
                        rows.append((at + i, piece, start // 4, length, zlib.crc32(own), ranks[length]))
                        ranks[length] += 1
                        if with_ids:
                            payload.append(np.frombuffer(own, "<i4"))
                at += len(group)
                columns = np.array(rows, dtype=np.int64).T
                arrays = [
                    ids.take(pa.array(columns[0])),
                    pa.array(columns[1].astype(np.int32)),
                    *[pa.array(column) for column in columns[2:6]],
                    pa.array(np.full(len(rows), part, dtype=np.int32)),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part_rank", "part"]
                if with_ids:
                    arrays.append(pa.array(payload, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        cut,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part_rank bigint, part int"
        + (", ids array<int>" if with_ids else ""),
    )


@dataclass(frozen=True)
class Run:
    """``count`` pieces of one length, one in each of as many neighbouring sequences."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def best_fit_plan(histogram: dict[int, int], capacity: int = SEQUENCE_TOKENS) -> list[Run]:
    """Best fit, longest first, over counts of pieces by length."""
    runs: list[Run] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences (first, count)
    rooms: list[int] = []
    sequences = 0

    def release(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = next((r for r in rooms if r >= length), None)
            if room is None:
                # New sequences; each takes as many pieces of this length as it holds.
                each = capacity // length
                count = left // each or 1
                layers = min(each, left)
                for layer in range(layers):
                    runs.append(Run(length, rank, count, sequences, layer * length))
                    rank += count
                    left -= count
                release(capacity - layers * length, sequences, count)
                sequences += count
                continue
            first, count = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.remove(room)
            used = min(count, left)
            runs.append(Run(length, rank, used, first, capacity - room))
            rank += used
            left -= used
            release(room - length, first, used)
            release(room, first + used, count - used)
    return runs


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Stored ``pieces`` with ``sequence_id`` and ``offset``."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    # At most ``capacity`` rows.
    histogram = {row["length"]: row["n"] for row in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list[Run]] = {}
    for run in best_fit_plan(histogram, capacity):
        by_length.setdefault(run.length, []).append(run)
    table = {
        length: tuple(np.array(column, dtype=np.int64) for column in zip(*[(r.rank, r.sequence, r.offset) for r in runs]))
        for length, runs in by_length.items()
    }
    ranked = pieces.join(bases.drop("n"), ["part", "length"]).withColumn("part_rank", F.col("part_rank") + F.col("base"))
    columns = [name for name in pieces.columns if name not in ("part", "part_rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("part_rank").to_numpy()
            sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(rows):
                    first, sequences, offsets = table[int(lengths[rows[0]])]
                    run = np.searchsorted(first, ranks[rows], side="right") - 1
                    sequence[rows] = sequences[run] + ranks[rows] - first[run]
                    offset[rows] = offsets[run]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in columns], pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    types = {field.name: field.dataType.simpleString() for field in pieces.schema.fields}
    schema = ", ".join(f"{name} {types[name]}" for name in columns) + ", sequence_id bigint, offset bigint"
    return ranked.select(*columns, "part_rank").mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = SEQUENCE_TOKENS,
    with_ids: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every piece of every document with its place; ``ids`` too, unless told otherwise."""
    pieces = stored(pieces_of(docs, tokenizer_path, capacity, with_ids, id_column, text_column), "pieces")
    return pack(pieces, capacity)
