"""Near duplicates by exact Jaccard similarity of word shingles, found by common signatures.

A text's set holds its distinct five-word shingles, as 64-bit hashes. Two sets of sizes a and
b, a <= b, link when their similarity is 0.75 or more: then they have 3 (a + b) / 7 elements
in common, so the smaller lacks at most a / 7 of its elements in the larger, and the larger
at most b / 4 of its own in the smaller.

The domain of hashes is partitioned down to single elements, so that a signature is an
element, and the elements of all sets are put in one order. Each set gives its first
a / 4 + 1 elements as signatures, of which the first a / 7 + 1 also count where it is the
smaller of two; the first element that two linked sets have in common is among both. (Larger
partitions and enumerated subsets of them can only be bounded by the symmetric difference of
both sets, which takes more signatures and lets more pairs through; see the README for
figures.) The order puts elements last that are frequent in a sample of texts, as those of
passages that many documents share; it only decides the cost, never the result. So a passage
shared by many texts is a signature only of sets of which it is three quarters, and one of
the smaller side only where it is six sevenths, and those link with each other.

Texts of equal set are one class before anything else. Classes that share a signature meet
at one of them. Pairs are first held against sketches (the parity of the number of elements
in each part of the domain, 1024 parts or more by size; sketches differ in no more places
than sets do), which refutes most pairs that do not link; the others are verified on the
whole texts. Verified links join classes to components. Signatures whose classes are not all
in one component by then are gone through again with another class in the middle, and in the
end the smaller ones are held against the larger ones of other components, so no link is
lost and no pair within a component is looked at.

Defined cases: a null or empty text, and one of white space only, has the empty set and
links with nothing. Texts under five words have their whole sequence as one shingle. A null
id is a document that never names a component; a component of null ids only has a null name.
Rows that repeat an id are documents of their own; rows that repeat a text link with each
other. An empty table has no rows. Very long texts are read whole, one at a time. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .rows_decided import rows_decided
from .stored import stored
from .word_hashes import WordHashes, mixed, multipliers

SHINGLE = 5
SAMPLE_DOCS = 10_000
FREQUENT_IN_SAMPLE = 3
FREQUENT_LIMIT = 100_000
STAR_ROUNDS = 1
#: Elements of a set, from the first on, that tell where two sets first meet.
HEAD = 8
#: Sketches of small sets have 1024 bits; each step takes eight times as many.
SKETCH_BITS = 1 << 10
SKETCH_STEP = 8
FACTORS = multipliers(SHINGLE)
#: Elements of the texts whose profiles are handed on together.
BATCH_ELEMENTS = 1 << 18


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def shingles_of(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    # Bytes know ASCII white space and ASCII capitals only.
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = _hashes().of(words)
    count = max(1, len(hashes) - SHINGLE + 1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(min(SHINGLE, len(hashes))):
        total += hashes[i : i + count] * FACTORS[i]
    return np.unique(mixed(total + np.uint64(min(SHINGLE, len(hashes)))))


def is_link(left: np.ndarray, right: np.ndarray) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= 75 * (len(left) + len(right) - common) and common > 0


def signatures_of(elements: np.ndarray, frequent_elements: np.ndarray) -> tuple[np.ndarray, int]:
    """The signatures of a set, and how many of them, from the first on, count where it is the smaller."""
    size = len(elements)
    if not size:
        return np.zeros(0, dtype=np.uint64), 0
    if len(frequent_elements):
        at = np.minimum(np.searchsorted(frequent_elements, elements), len(frequent_elements) - 1)
        frequent = frequent_elements[at] == elements
        # Elements are sorted; a stable sort keeps them so among the rare and the frequent.
        elements = elements[np.argsort(frequent, kind="stable")]
    return elements[: size // 4 + 1], size // 7 + 1


def _print_of(elements: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh128_intdigest(elements.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _sketch(elements: np.ndarray) -> np.ndarray:
    """The parities of the counts of elements by their last bits, as 64-bit numbers."""
    bits = SKETCH_BITS
    while bits <= len(elements):
        bits *= SKETCH_STEP
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).view(np.int64)


def _folded(sketch: Column) -> Column:
    """A sketch as one with so many times fewer bits."""
    parts = F.size(sketch) / SKETCH_STEP

    def both(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y))

    slices = [F.slice(sketch, (parts * i).cast("int") + 1, parts.cast("int")) for i in range(SKETCH_STEP)]
    return reduce(both, slices)


def _profiles(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, text_key, row (a number), n_shingles, print_a, print_b, signatures, sketch.

    The text comes along for rows without an id.
    """
    kind = docs.schema["text_key"].dataType.simpleString()

    def handed_on(part: pa.RecordBatch, row: int, profiles: list[tuple]) -> pa.RecordBatch:
        sizes, prints, signatures, sketches = zip(*profiles)
        lengths = np.concatenate(([0], np.cumsum([len(s) for s in signatures]))).astype(np.int32)
        ids, texts = part.column("doc_id"), part.column("text")
        columns = [
            ids,
            part.column("text_key"),
            pa.array(np.arange(row, row + len(part))),
            pa.array(sizes, pa.int64()),
            *[pa.array([p[i] for p in prints], pa.int64()) for i in range(2)],
            pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(signatures).view(np.int64))),
            pa.array(sketches, pa.list_(pa.int64())),
            pa.array([None if i.is_valid else t.as_py() for i, t in zip(ids, texts)], pa.string()),
        ]
        names = ["doc_id", "text_key", "row", "n_shingles", "print_a", "print_b", "signatures", "sketch", "text"]
        return pa.RecordBatch.from_arrays(columns, names)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            start, held, profiles = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                elements = shingles_of(text.as_py())
                signatures, _ = signatures_of(elements, frequent)
                profiles.append((len(elements), _print_of(elements), signatures.copy(), _sketch(elements)))
                held += len(elements)
                if held >= BATCH_ELEMENTS or i + 1 == len(batch):
                    yield handed_on(batch.slice(start, len(profiles)), row, profiles)
                    row, start, held, profiles = row + len(profiles), i + 1, 0, []

    return docs.mapInArrow(
        profile,
        f"doc_id bigint, text_key {kind}, row bigint, n_shingles bigint, print_a bigint, print_b bigint, "
        "signatures array<bigint>, sketch array<bigint>, text string",
    )


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of several texts of a sample of about ``SAMPLE_DOCS`` texts, at most ``FREQUENT_LIMIT``."""
    total = docs.count()
    sample = docs
    if total > SAMPLE_DOCS:
        share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000))
        sample = docs.filter(share < round(1_000_000 * SAMPLE_DOCS / total))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_print_of(elements)[0] for elements in found], pa.int64()),
                    pa.array([elements.view(np.int64) for elements in found], pa.list_(pa.int64())),
                ],
                ["print", "elements"],
            )

    counts = (
        sample.mapInArrow(sets, "print bigint, elements array<bigint>")
        .dropDuplicates(["print"])
        .select(F.explode("elements").alias("element"))
        .groupBy("element")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= FREQUENT_IN_SAMPLE)
        .orderBy(F.col("n").desc(), "element")
        .limit(FREQUENT_LIMIT)
    )
    return np.sort(np.array([row["element"] for row in counts.collect()], dtype=np.int64).view(np.uint64))


class _Sets:
    """Sets of the texts seen last; a text is often one side of many pairs."""

    def __init__(self, kept: int = 64) -> None:
        self._kept, self._sets = kept, OrderedDict()

    def of(self, key: int, text: str) -> np.ndarray:
        if key in self._sets:
            self._sets.move_to_end(key)
        else:
            self._sets[key] = shingles_of(text)
            if len(self._sets) > self._kept:
                self._sets.popitem(last=False)
        return self._sets[key]


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) and whether their texts link."""
    pairs = stored(pairs, "pairs")
    keys = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "pair-keys")
    texts = stored(_class_texts(docs, classes, keys), "texts")
    left = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            columns = [batch.column(name) for name in ("a", "b", "text_a", "text_b")]
            keep = [
                is_link(sets.of(a.as_py(), text_a.as_py()), shingles_of(text_b.as_py()))
                for a, b, text_a, text_b in zip(*columns)
            ]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(verify, "a bigint, b bigint, linked boolean")


def _class_texts(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """The text of one document of each class in ``keys``: key, text."""
    wanted = classes.join(keys, "key")
    named = wanted.filter("text is null").select(F.col("first_id").alias("doc_id"), "key", "print_a", "print_b")
    by_id = docs.join(named, "doc_id").dropDuplicates(["doc_id", "key", "text"])
    loose = wanted.filter("text is not null").select("key", "print_a", "print_b", "text")

    def same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _print_of(shingles_of(text.as_py())) == (a.as_py(), b.as_py())
                for a, b, text in zip(*[batch.column(name) for name in ("print_a", "print_b", "text")])
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text")], ["key", "text"]).filter(pa.array(keep))

    # An id may name several texts; only one of the class's set will do.
    rows = by_id.select("key", "print_a", "print_b", "text").mapInArrow(same_set, "key bigint, text string")
    return rows.unionByName(loose.select("key", "text"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _documents(docs, id_column, text_column, F.lit(None).cast("string")).select("doc_id", "n_shingles", "component_id")


def _documents(docs: DataFrame, id_column: str, text_column: str, text_key: Column) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, label (of the component), component_id."""
    source = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), text_key.alias("text_key"), F.col(text_column).cast("string").alias("text")
    )
    profiles = stored(_profiles(source, frequent_shingles(source)), "profiles")
    prints = ["print_a", "print_b"]
    named = F.coalesce("first_id", "print_a")
    classes = stored(
        profiles.filter("n_shingles > 0")
        .groupBy(*prints)
        .agg(
            F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.first("text", ignorenulls=True).alias("text"),
            F.first("n_shingles").alias("size"),
        )
        .select(
            *prints,
            "first_id",
            "row",
            "size",
            F.when(F.col("first_id").isNull(), F.coalesce("text", F.lit(""))).alias("text"),
            # An id that names several sets cannot stand for one of them.
            F.when(F.count("*").over(Window.partitionBy(named)) == 1, named).otherwise(F.col("print_a")).alias("key"),
        ),
        "classes",
    )
    sketches = profiles.select("row", "sketch", F.slice("signatures", 1, HEAD).alias("head"))
    sketches = stored(sketches.join(classes.select("row", "key", "size"), "row").drop("row"), "sketches")
    multi = _shared_signatures(profiles, classes)
    labels = _linked(multi, source, classes, sketches)
    keys = classes.select(*prints, "key").join(labels, "key", "left").select(*prints, F.coalesce("label", "key").alias("label"))
    labelled = profiles.select("doc_id", "text_key", "n_shingles", *prints).join(keys, prints, "left").drop(*prints)
    names = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    name = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return labelled.join(names, "label", "left").withColumn("component_id", name)


def _shared_signatures(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Signatures of two classes and more: signature, key, size, place (in the set's order), n_small, pivot.

    Each class gives the signatures of one of its rows. Which class is the pivot is found by
    an aggregation, so that a signature of very many classes comes together in no task.
    """
    rows = profiles.select("row", "signatures").join(classes.select("row", "key", "size"), "row")
    each = rows.select(F.posexplode("signatures").alias("place", "signature"), "key", "size")
    # Place and size in one number, as very many rows are shuffled.
    each = each.select("signature", "key", (F.shiftleft(F.col("place").cast("bigint"), 32) + F.col("size")).alias("at"))
    place, size = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    n_small = F.floor(size / 7) + 1
    shared = each.groupBy("signature").agg(F.min("key").alias("pivot"), F.count("*").alias("n"), F.bool_or(place < n_small).alias("any_small"))
    shared = shared.filter("n > 1 and any_small").select("signature", "pivot")
    found = each.join(shared, "signature")
    columns = ["signature", "key", size.alias("size"), place.cast("int").alias("place"), n_small.alias("n_small"), "pivot"]
    return stored(found.select(*columns), "shared-signatures")


def _linked(multi: DataFrame, docs: DataFrame, classes: DataFrame, sketches: DataFrame) -> DataFrame:
    """key and label of all classes that link with another."""

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches do not refute."""
        out = pairs
        for name in ("a", "b"):
            out = out.join(sketches.select(F.col("key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("size", "sketch")]), name)
        left, right = F.col("a_sketch"), F.col("b_sketch")
        # Sets that can link are at most one step of sketches apart.
        left, right = (
            F.when(F.size(left) > F.size(right), _folded(left)).otherwise(left),
            F.when(F.size(right) > F.size(left), _folded(right)).otherwise(right),
        )
        apart = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        places = F.aggregate(apart, F.lit(0), lambda total, n: total + n)
        fits = F.expr("4 * least(a_size, b_size) >= 3 * greatest(a_size, b_size)")
        return out.filter(fits & (7 * places <= F.col("a_size") + F.col("b_size"))).select("a", "b")

    with_pivot = multi.filter("key <> pivot").select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b"))
    done = stored(_verified(possible(with_pivot.distinct()), docs, classes), "verified-pairs")
    labels = components(done.filter("linked"))
    for turn in range(STAR_ROUNDS + 1):
        tagged = multi.join(labels, "key", "left").select("signature", "key", "size", "place", "n_small", F.coalesce("label", "key").alias("label"))
        open_ones = (
            tagged.groupBy("signature")
            .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("key", "label"), F.xxhash64(F.lit(turn), "key")).alias("middle"))
            .filter("low < high")
        )
        tagged = stored(tagged.join(open_ones.select("signature", "middle"), "signature"), "open-signatures")
        if tagged.isEmpty():
            break
        if turn < STAR_ROUNDS:
            near = tagged.filter("label <> middle.label").select("key", F.col("middle.key").alias("other"))
        else:
            # Every link that is left has its smaller set among the one and its larger among the
            # other. Pairs meet at the first element in common: all the others come after it in
            # both sets, and none of the first elements of the one is among those of the other.
            tagged = tagged.join(sketches.select("key", "head"), "key").withColumn("head", F.slice("head", F.lit(1), F.col("place")))
            smaller, larger = tagged.filter("place < n_small").alias("s"), tagged.alias("l")
            near = smaller.join(larger, F.col("s.signature") == F.col("l.signature"))
            near = near.filter("s.label <> l.label and s.size <= l.size")
            near = near.filter("7 * least(s.size - s.place, l.size - l.place) >= 3 * (s.size + l.size)")
            near = near.filter(~F.arrays_overlap("s.head", "l.head"))
            near = near.select("s.key", F.col("l.key").alias("other"))
        fresh = near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
        fresh = possible(fresh).join(done, ["a", "b"], "left_anti")
        verified = stored(_verified(fresh, docs, classes), "verified-pairs")
        done = done.unionByName(verified)
        if not verified.filter("linked").isEmpty():
            labels = components(done.filter("linked"))
    return labels


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, with all its columns; rows without words all stay.

    It is the one with the smallest id, nulls last, and of rows of one id that with the
    smallest digest of its text. Of rows that repeat both, one stays.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = _documents(docs, id_column, text_column, F.sha2(text, 256)).filter("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = found.groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Components of one row have nothing to drop.
    kept = first.filter("n > 1").select("label", F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    decided = found.join(kept, "label").withColumn(
        "__kept", F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    )
    decided = decided.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    decided = decided.agg(F.first("__kept").alias("__kept"), F.count("*").alias("__copies"))
    return rows_decided(docs, decided, F.col(id_column).cast("bigint"), F.sha2(text, 256))
