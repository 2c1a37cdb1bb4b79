"""Decontamination and exact duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from riskflow.llm import exact_dedup
from riskflow.llm.decontamination import SPAN, benchmark_leaks, best_stretch, masks_of, without_leaks, words_of
from riskflow.llm.exact_dedup import BASES, PRIMES, combined, exact_duplicates, polynomial_hash, without_exact_duplicates
from riskflow.llm.queries import QUERIES


def plain_leaks(texts, items):
    found = set()
    for doc_id, text in texts:
        words = words_of(text)
        for item_id, item in items:
            other = words_of(item)
            for shift in range(1 - len(other), len(words)):
                low, high = max(0, shift), min(len(words), shift + len(other))
                equal = words[low:high] == other[low - shift : high - shift]
                start, end = best_stretch(equal)
                if len(other) and end - start >= min(SPAN, len(other)):
                    found.add((doc_id, item_id))
    return found


def test_leaks_query(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = QUERIES["op9_benchmark_decontamination"](spark, sf_dir).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(rows) == len(got)
    hit = {doc for doc, _ in got}
    # Brute force over the hits and as many others.
    chosen = [t for t in texts if t[0] in hit] + [t for t in texts if t[0] not in hit and len(t[1]) < 1500][: max(20, len(hit))]
    assert plain_leaks(chosen, items) == got


def test_substitutions(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    item = rng.sample(vocabulary, 40)
    docs, want = [], set()
    for doc_id in range(200):
        words = rng.choices(vocabulary, k=120)
        if doc_id % 2:
            part = item[rng.randrange(10) :][:30]
            for at in rng.sample(range(len(part)), 3):
                part[at] = "changed"
            words[50:80] = part
        docs.append((doc_id, " ".join(words).upper() + "."))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"] for r in benchmark_leaks(frame, benchmark).collect()}
    want = {doc for doc, _ in plain_leaks(docs, [(7, " ".join(item))])}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 90


def test_every_accepted_stretch_has_a_seed():
    for size in range(1, 17):
        span = min(SPAN, size)
        for number in range(1 << size):
            equal = np.array([number >> i & 1 for i in range(size)], dtype=bool)
            start, end = best_stretch(equal)
            if end - start >= span:
                windows = range(size - span + 1)
                assert any(all(equal[at + i] for i in kept) for at in windows for kept in masks_of(span)), equal


def test_regular_replacements(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(size, " ".join(rng.sample(vocabulary, size))) for size in (8, 9, 11, 20, 30, 40, 200, 1000)]
    docs = []
    for size, text in items:
        for period in range(4, 10):
            for phase in range(period):
                words = [f"x{at}" if at % period == phase else word for at, word in enumerate(text.split())]
                docs.append((len(docs), " ".join(["before", *words, "after"])))
        for _ in range(60):
            words = [f"x{at}" if rng.random() < 0.2 else word for at, word in enumerate(text.split())]
            docs.append((len(docs), " ".join(["before", *words, "after"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for doc_id, text in docs:
        # The items are at one place or not at all.
        words = words_of(text)[1:-1]
        for item_id, item in items:
            other = words_of(item)
            if len(words) == len(other):
                start, end = best_stretch(words == other)
                if end - start >= min(SPAN, len(other)):
                    want.add((doc_id, item_id))
    assert got == want and len(want) > 300


def test_leak_edges(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "one two three four"), (3, "one two three four"), (None, "x one two three four, y"), (4, "... !!!"), (5, "z " * 60_000 + "a b c d e f g h i j k l m n")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long")
    items = [(1, "One two, three four"), (2, None), (3, "?"), (4, "a b c d e f g h i j k l m n"), (4, "a b c d e f g h i j k l m n")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for chars in (4_000_000, 20):
        monkeypatch.setattr("riskflow.llm.decontamination.BLOCK_CHARS", chars)
        rows = sorted((str(r["doc_id"]), r["item_id"], r["n_words"]) for r in benchmark_leaks(frame, benchmark).collect())
        assert rows == [("3", 1, 4), ("3", 1, 4), ("5", 4, 14), ("5", 4, 14), ("None", 1, 4)]
    kept = without_leaks(frame, benchmark)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert benchmark_leaks(frame, benchmark.limit(0)).count() == 0
    assert benchmark_leaks(frame.limit(0), benchmark).count() == 0


def plain_groups(rows):
    first, size = {}, {}
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        order = (doc_id is None, doc_id)
        first[key] = min(first.get(key, order), order)
        size[key] = size.get(key, 0) + 1
    keys = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    return sorted(((d, first[k][1], size[k]) for d, k in keys), key=str)


EDGES = [(1, None), (2, ""), (3, "a  b"), (4, "a\n\tb"), (4, "a b"), (None, "a b"), (5, " a b"), (6, "x" * 70_000), (7, "x" * 70_000), (8, "x" * 69_999 + "y"), (9, "é  "), (10, "é   "), (None, "alone"), (11, "rep"), (11, "rep")]


@pytest.mark.parametrize("colliding", [False, True])
def test_exact_duplicates(spark, monkeypatch, colliding):
    if colliding:
        # A hash that is the same for all texts of a length: the comparison must tell them apart.
        monkeypatch.setattr(exact_dedup, "PRIMES", (1, 1))
    frame = spark.createDataFrame([(*e, "z") for e in EDGES], "doc_id long, text string, keep_id string").repartition(4)
    found = exact_duplicates(frame).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=str) == plain_groups(EDGES)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)
    kept = without_exact_duplicates(frame)
    assert kept.columns == frame.columns
    # One row of each group, also where the smallest id has several.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(r["doc_id"]) for r in found if r["kept"]})
    assert exact_duplicates(frame.limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "w"), (1, "w"), (2, "w "), (7, "w\n"), (7, "u"), (7, " u"), (None, "w"), (None, "own"), (None, "own")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __id", "'x' as __row", "2 as n_rows")
    kept = without_exact_duplicates(frame.repartition(3))
    assert kept.columns == frame.columns
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect())))
    assert got == sorted(map(str, [(1, "w"), (2, "w "), (7, " u"), (7, "u"), (None, "own")]))
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    leak = "so one two three four five six seven eight it is"
    docs = spark.createDataFrame([(7, leak), (7, "clean"), (None, leak), (None, None), (8, "")], "doc_id long, text string")
    left = without_leaks(docs, benchmark).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(7, "clean"), (None, None), (8, "")]))


def test_hashes_compose():
    left, right = b"some bytes" * 9_000, bytes(range(256)) * 300
    for base, prime in zip(BASES, PRIMES):
        own = [polynomial_hash(part, base, prime) for part in (left, right, left + right)]
        assert combined(own[0], own[1], len(right), base, prime) == own[2]
        value = 0
        for byte in right:
            value = (value * base + byte + 1) % prime
        assert value == own[1]
