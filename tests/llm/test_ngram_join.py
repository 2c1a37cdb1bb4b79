"""The n-gram join against all pairs."""

import hashlib
import random
import re

import numpy as np
import pytest

from riskflow.llm import ngram_join
from riskflow.llm.ngram_join import is_link, near_duplicates, shingles_of, signatures_of, without_near_duplicates
from riskflow.llm.queries import QUERIES


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(docs):
    sets = [plain_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, own in enumerate(sets):
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    pairs = {(a, b) for found in holders.values() for k, a in enumerate(found) for b in found[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            label[root(b)] = root(a)
    names = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            names[root(i)] = min(names.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), names.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op8_ngram_jaccard_join"](spark, sf_dir)) == plain_components(docs)


def mutated(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [words[at], "ins"]])
    return words


@pytest.mark.parametrize(("seed", "sample"), [(0, 4_000), (1, 40), (2, 4_000)])
def test_chains_copies_and_shared_passages(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCS", sample)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 6, 20, 66, 130, 260]))]
        if rng.random() < 0.7:
            base = base[:10] + passage + base[10:]
        docs.append(base)
        current = base
        for _ in range(rng.randrange(8)):
            current = mutated(rng, current, rng.randrange(1, 1 + max(1, len(current) // 40) * 2))
            docs.append(current)
    docs = [" ".join(words).replace("w1", "W1") for words in docs]
    docs += docs[:10] + [docs[3].upper()] * 30 + [None, "", " \n", "one", "ONE", "one two"]
    rows = [(i, t) for i, t in enumerate(docs)]
    rng.shuffle(rows)
    rows += [(None, docs[0]), (None, "only nameless words in this one"), (None, "only nameless words in this one"), (7, docs[40]), (7, docs[5]), (2_000, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key long").repartition(4)
    assert rows_of(near_duplicates(frame)) == plain_components(rows)
    kept = without_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert rows_of(near_duplicates(frame.limit(0))) == []


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(4)
    none, met = np.zeros(0, dtype=np.uint64), 0
    for _ in range(600):
        size = int(rng.integers(1, 700))
        left = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        lost, new = int(rng.integers(0, size // 5 + 1)), int(rng.integers(0, size // 6 + 1))
        right = np.unique(np.concatenate((left[lost:], rng.integers(0, 2**63, new, dtype=np.uint64) * np.uint64(2))))
        if not len(right) or not is_link(left, right):
            continue
        smaller, larger = sorted((left, right), key=len)
        for hot in (none, np.sort(left[: int(rng.integers(0, len(left)))]), np.sort(left[lost:])):
            ours, small = signatures_of(smaller, hot)
            theirs, _ = signatures_of(larger, hot)
            assert len(np.intersect1d(ours[:small], theirs))
            met += 1
    assert met > 300


def test_unlinked_texts_that_share_most_of_their_words(spark):
    """Texts of which three quarters are one passage: not near enough to link, and few pairs to look at."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(64)]
    docs = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([17, 18, 19, 20, 25]))])) for i in range(300)]
    docs += [(1000 + i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([2, 9, 12]))])) for i in range(40)]
    docs += [(2000 + i, text + " more") for i, (_, text) in enumerate(docs[:20])]
    assert rows_of(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == plain_components(docs)


def test_one_row_of_each_component_stays(spark):
    w, near = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41))
    u, v = "another text of its own " * 5, "nobody else has this one either " * 3
    rows = [(1, w, "a"), (7, w, "b"), (7, u, "c"), (7, u, "d"), (None, near, "e"), (None, v, "f"), (None, v, "g"), (3, None, "h"), (3, "", "i"), (1, near, "j")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "1 as key", "2 as label")
    kept = without_near_duplicates(frame.repartition(3))
    assert kept.columns == frame.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None]
    smallest = min((w, near), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert sorted(map(str, got)) == sorted(map(str, [(1, smallest), (3, ""), (3, None), (7, u)]))
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == [v]


def test_places_and_sizes_come_whole(spark):
    """Sets of many sizes, where the number of signatures depends on the size."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(1, 3_000)))) for i in range(40)]
    docs += [(100 + i, text + " " + " ".join(f"n{i}-{k}" for k in range(text.count(" ") // 9))) for i, (_, text) in enumerate(docs)]
    assert rows_of(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == plain_components(docs)


def test_very_long_text():
    text = "word " * 5 + " ".join(str(i) for i in range(200_000))
    assert len(signatures_of(shingles_of(text), np.zeros(0, np.uint64))[0]) > 50_000
