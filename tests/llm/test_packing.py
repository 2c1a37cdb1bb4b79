"""Packing against the tokenizer itself and the rules of a packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskflow.llm import packing
from riskflow.llm.packing import WordIds, best_fit_plan, pack_documents
from riskflow.llm.queries import QUERIES, TOKENIZER

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORDS = WordIds(TOKENIZER)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity):
    pieces = {}
    for row in rows:
        pieces.setdefault(row["doc_id"], []).append(row)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = plain_ids(texts[doc_id])
        own.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            data = np.array(ids[r["start"] : r["start"] + capacity], "<u4")
            assert (r["length"], r["ids_crc32"]) == (len(data), zlib.crc32(data.tobytes()))
            if "ids" in r:
                assert r["ids"] == data.tolist()
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r.asDict() for r in QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()]
    used = check(rows, texts, 2048)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_small_sequences_keep_ids(spark):
    texts = {1: None, 2: "", 3: "a b c d e f g " * 40, 4: "tie tie", 5: "tie tie", 6: "<|endoftext|> x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as length")
    rows = [r.asDict() for r in pack_documents(docs.repartition(3), TOKENIZER, capacity=16).collect()]
    check(rows, texts, 16)
    assert pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_repeated_rows_and_null_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = pack_documents(docs, TOKENIZER).collect()
    assert sorted((r["offset"], r["sequence_id"]) for r in rows) == [(0, 0), (3, 0), (6, 0)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ é̸́ſİΣ' \n\t\r  \x1c09!.<|>中\U0001f600"), max_size=60))
def test_ids_of_words(text):
    assert np.frombuffer(WORDS.texts([text])[0], "<u4").tolist() == plain_ids(text)[:-1]


def test_all_plain_characters():
    characters = [chr(number) for number in range(33, 256)]
    text = " ".join([a + b for a in characters for b in ("", "a", "!", "É", "\xad", "s ")])
    assert np.frombuffer(WORDS.texts([text, "", text])[2], "<u4").tolist() == plain_ids(text)[:-1]


def test_plain_letters_are_merged_only(monkeypatch):
    """Normalizing and splitting again is most of the time of a new word."""

    class Whole:
        def __init__(self, tokenizer):
            self.given, self._tokenizer = [], tokenizer

        def encode(self, text, **options):
            self.given.append(text)
            return self._tokenizer.encode(text, **options)

        def encode_batch(self, texts, **options):
            self.given.extend(texts)
            return self._tokenizer.encode_batch(texts, **options)

    words = WordIds(TOKENIZER)
    monkeypatch.setattr(words, "_tokenizer", Whole(words._tokenizer))
    text = "Größe, of ÀÉÎ thiswordisnew... x2\nof of"
    assert np.frombuffer(words.texts([text])[0], "<u4").tolist() == plain_ids(text)[:-1]
    assert sorted(words._tokenizer.given) == ["", ",", "...", "x2"]


def test_bounded_memory_of_words(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    words = WordIds(TOKENIZER)
    for text in ["a b c d e", "e f g a", "y" * 70 + " a é", "", "a b"]:
        assert np.frombuffer(words.texts([text])[0], "<u4").tolist() == plain_ids(text)[:-1]
        assert all(len(kept._words) <= 3 and max([len(w) for w in kept._words.to_pylist()], default=0) <= 64 for kept in (words._words, words._letters))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=20))
def test_plan(histogram):
    runs, capacity = best_fit_plan(histogram, 50), 50
    placed, load = {}, {}
    for run in runs:
        assert placed.get(run.length, 0) == run.rank
        placed[run.length] = run.rank + run.count
        for sequence in range(run.sequence, run.sequence + run.count):
            assert load.get(sequence, 0) == run.offset
            load[sequence] = run.offset + run.length
    assert placed == histogram
    assert all(total <= capacity for total in load.values())
    need = sum(length * count for length, count in histogram.items())
    # Two sequences at most half full would have become one.
    assert len(load) <= 2 * need / capacity + 1


def test_plan_does_not_grow_with_the_corpus():
    small = {length: 3 + length % 7 for length in range(1, 2048)}
    large = {length: 10**6 * count for length, count in small.items()}
    assert len(best_fit_plan(large)) < 5 * len(best_fit_plan(small)) + 20_000


@pytest.mark.parametrize("word", ["x" * 5000, "é" * 70 + " y"])
def test_long_words(word):
    assert np.frombuffer(WORDS.texts([word])[0], "<u4").tolist() == plain_ids(word)[:-1]
