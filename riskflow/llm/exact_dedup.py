"""Exact duplicates by composable polynomial fingerprints.

A normalised text is cut into chunks. Each chunk is a row of its own and hashed alone, to
polynomials modulo two primes. Hashes of neighbours combine: the hash of ``ab`` is the hash
of ``a`` shifted by the length of ``b`` plus the hash of ``b``. Rows of equal fingerprint
are then compared with the row that would stay, chunk by chunk; a row that differs after
all (a collision) is grouped by the digest of its text instead.

Defined cases: a null text is an empty one; empty texts equal each other. Of equal texts the
smallest id stays; a null id comes last. Rows that repeat id and text are rows of the group
like any other: all of them are marked as staying, and :func:`without_exact_duplicates`
keeps one. An empty table has no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows_decided import rows_decided
from .stored import stored

# Two primes below 2**31, so that a product of two residues fits a long.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525)
CHUNK_CHARS = 1 << 15
PART = 1 << 16


def normalized(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


@lru_cache(maxsize=4)
def _powers(base: int, prime: int) -> np.ndarray:
    """base**i modulo prime for i from PART - 1 down to 0."""
    out = np.ones(PART, dtype=np.uint64)
    filled = 1
    while filled < PART:
        step = pow(base, filled, prime)
        out[filled : 2 * filled] = out[:filled] * np.uint64(step) % np.uint64(prime)
        filled *= 2
    return out[::-1].copy()


def polynomial_hash(data: bytes, base: int, prime: int) -> int:
    """The bytes, each plus one, as digits of a number in ``base``, modulo ``prime``."""
    value = 0
    for start in range(0, len(data), PART):
        part = np.frombuffer(data, np.uint8, min(PART, len(data) - start), start).astype(np.uint64) + np.uint64(1)
        # Terms are below 2**40 and there are 2**16 of them.
        own = int((part * _powers(base, prime)[PART - len(part) :]).sum() % np.uint64(prime))
        value = combined(value, own, len(part), base, prime)
    return value


def combined(left: int, right: int, right_bytes: int, base: int, prime: int) -> int:
    """The hash of two neighbours from their hashes."""
    return (left * pow(base, right_bytes, prime) + right) % prime


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list[int]] = [[], [], [], [], []]
        for chunk in batch.column("chunk"):
            data = chunk.as_py().encode()
            columns[0].append(len(data))
            for i, (base, prime) in enumerate(zip(BASES, PRIMES)):
                columns[1 + 2 * i].append(polynomial_hash(data, base, prime))
                columns[2 + 2 * i].append(pow(base, len(data), prime))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(name) for name in batch.schema.names[:-1]], *[pa.array(c, pa.int64()) for c in columns]],
            [*batch.schema.names[:-1], "n_bytes", "hash0", "shift0", "hash1", "shift1"],
        )


def _with_chunks(frame: DataFrame, text: str) -> DataFrame:
    """One row per chunk: ``chunk_no``, ``n_chunks``, ``chunk``; the empty text has one."""
    count = F.greatest(F.ceil(F.length(text) / F.lit(CHUNK_CHARS)), F.lit(1)).cast("int")
    rest = [name for name in frame.columns if name != text]
    return (
        frame.withColumn("n_chunks", count)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .select(
            *rest,
            "n_chunks",
            "chunk_no",
            F.when(F.col("n_chunks") == 1, F.col(text))
            .otherwise(F.substring(F.col(text), F.col("chunk_no") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)))
            .alias("chunk"),
        )
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_sha256``, ``n_bytes``, ``hash0``, ``hash1`` and the number of rows.

    ``docs`` has ``doc_id`` and ``text``. Rows that repeat both are one row here.
    """
    texts = docs.select("doc_id", normalized(F.col("text")).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    chunks = _with_chunks(texts, "norm").select("doc_id", "text_sha256", "n_chunks", "chunk_no", "chunk")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["n_bytes", "hash0", "shift0", "hash1", "shift1"]
    schema = f"doc_id {kind}, text_sha256 string, n_chunks int, chunk_no int, " + ", ".join(f"{c} bigint" for c in columns)
    hashed = stored(chunks.mapInArrow(_hash_chunks, schema), "chunk-hashes")
    # Most texts are one chunk; only the others need more than counting.
    parts = hashed.groupBy("doc_id", "text_sha256", "n_chunks", "chunk_no").agg(
        *[F.first(name).alias(name) for name in columns], F.count("*").alias("n_rows")
    )
    whole = parts.filter("n_chunks = 1").select("doc_id", "text_sha256", "n_bytes", "hash0", "hash1", "n_rows")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", *columns)))
    cut = (
        parts.filter("n_chunks > 1")
        .groupBy("doc_id", "text_sha256", "n_rows")
        .agg(ordered.alias("parts"))
        .select(
            "doc_id",
            "text_sha256",
            F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, p: total + p["n_bytes"]).alias("n_bytes"),
            *[_combined_parts(i).alias(f"hash{i}") for i in range(2)],
            "n_rows",
        )
    )
    return whole.unionByName(cut)


def _combined_parts(i: int) -> Column:
    def step(left: Column, part: Column) -> Column:
        return (left * part[f"shift{i}"] + part[f"hash{i}"]) % F.lit(PRIMES[i])

    return F.aggregate("parts", F.lit(0).cast("bigint"), step)


PRINT = ["n_bytes", "hash0", "hash1"]


def _unequal(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members (doc_id, text_sha256, keep_id, keep_sha) whose text is not the keeper's.

    Members and keepers meet by keeper and chunk, in a join that Spark splits where many
    members share a keeper. No task holds more than a chunk of either.
    """
    texts = docs.select("doc_id", normalized(F.col("text")).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    same_row = [F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("t.text_sha256") == F.col("m.text_sha256")]
    own = (
        texts.alias("t")
        .join(members.alias("m"), same_row)
        .select("m.doc_id", "m.text_sha256", "m.keep_id", "m.keep_sha", "t.norm")
    )
    chunks = stored(_with_chunks(own, "norm"), "duplicate-chunks")
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha"))
    keepers = chunks.filter(is_keeper).dropDuplicates(["keep_id", "keep_sha", "chunk_no"])
    pairs = (
        chunks.filter(~is_keeper)
        .alias("c")
        .join(
            keepers.alias("k"),
            [
                F.col("c.keep_id").eqNullSafe(F.col("k.keep_id")),
                F.col("c.keep_sha") == F.col("k.keep_sha"),
                F.col("c.chunk_no") == F.col("k.chunk_no"),
            ],
            "left",
        )
    )
    differs = ~F.col("c.chunk").eqNullSafe(F.col("k.chunk"))
    return pairs.filter(differs).select("c.doc_id", "c.text_sha256").distinct()


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs, id_column, text_column).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("bigint"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))).alias("__copy"),
    ).drop("__copy")


def _grouped(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per id and normalised text: doc_id, text_sha256, n_rows, keep_id, group_size."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    prints = stored(fingerprints(source), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha256")).alias("first")
    groups = (
        prints.groupBy(*PRINT)
        .agg(first, F.count("*").alias("n"), F.sum("n_rows").alias("group_size"))
        .select(*PRINT, F.col("first.doc_id").alias("keep_id"), F.col("first.text_sha256").alias("keep_sha"), "n", "group_size")
    )
    marked = stored(prints.join(groups, PRINT), "fingerprint-groups")
    unequal = stored(_unequal(source, marked.filter("n > 1")), "collisions")
    if unequal.isEmpty():
        grouped = marked
    else:
        same = [marked["doc_id"].eqNullSafe(unequal["doc_id"]), marked["text_sha256"] == unequal["text_sha256"]]
        split = marked.join(unequal.withColumn("other", F.lit(True)), same, "left").select(
            marked["doc_id"], marked["text_sha256"], *PRINT, "n_rows", F.when(F.col("other"), marked["text_sha256"]).alias("class")
        )
        again = (
            split.groupBy(*PRINT, "class")
            .agg(first, F.sum("n_rows").alias("group_size"))
            .select(*PRINT, "class", F.col("first.doc_id").alias("keep_id"), "group_size")
        )
        grouped = split.alias("s").join(
            again.alias("a"), [F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*PRINT, "class"]]
        )
        grouped = grouped.select("s.doc_id", "s.text_sha256", "s.n_rows", "a.keep_id", "a.group_size")
    return grouped.select("doc_id", "text_sha256", "n_rows", "keep_id", "group_size")


def without_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the smallest id.

    Of several rows with that id, the one with the smallest hash of its text as it is.
    """
    text = F.col(text_column)
    decided = _grouped(docs, id_column, text_column).filter("group_size > 1").select(
        F.col("doc_id").alias("__id"),
        F.col("text_sha256").alias("__key"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__kept"),
        F.col("n_rows").alias("__copies"),
    )
    return rows_decided(docs, decided, F.col(id_column), F.sha2(normalized(text), 256), F.xxhash64(text.cast("string")))
