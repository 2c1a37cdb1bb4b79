"""Token counts against the tokenizers library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskflow.llm.queries import BYTE_TOKENIZER, QUERIES, TOKENIZER
from riskflow.llm.token_counts import TokenCounter, token_counts

LIBRARY = Tokenizer.from_file(BYTE_TOKENIZER)
COUNTER = TokenCounter(BYTE_TOKENIZER)


def plain(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(texts, plain(list(texts.values()))))
    rows = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbe '’sté\n\t\x1c\x85 1½<|>中😀") | st.characters(codec="utf-8"), max_size=40)))
def test_any_text(texts):
    assert COUNTER.counts(texts) == plain(texts)


def test_overlapping_pairs_and_long_sequences():
    texts = ["a" * k for k in (1, 2, 3, 255, 256, 257, 1001)]
    texts += ["ab" * 600, "=" * 777, " " * 1000 + "x", "é" * 300, "qzjxkv" * 90]
    assert COUNTER.counts(texts) == plain(texts)


def test_special_strings():
    texts = ["<|endoftext|>", "a <|endoftext|><|endoftext|>  b", "<|endoftext", "  <|endoftext|>  "]
    assert COUNTER.counts(texts) == plain(texts)


def test_text_longer_than_a_part():
    text = ("word, 12 " * 130_000) + "x" * 3000 + " \n" * 70_000
    assert COUNTER.counts([text]) == plain([text])


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "one two", "c"), (2, "same", None), (2, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").selectExpr("*", "'x' as __text", "1 as n_bytes")
    got = sorted(map(str, token_counts(docs, BYTE_TOKENIZER, limit=1).collect()))
    want = [(1, 0, 0, False), (1, 0, 0, False), (None, 7, 2, True), (2, 4, 1, False), (2, 4, 1, False)]
    names = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted("Row(" + ", ".join(f"{n}={v}" for n, v in zip(names, row)) + ")" for row in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert token_counts(docs, BYTE_TOKENIZER).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(TOKENIZER)
