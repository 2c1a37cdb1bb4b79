"""Chat windows read back, and line dedup against all pairs."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskflow.llm.chat_format import conversation_digests, escaped, format_windows, read_loss, read_turns, unescaped
from riskflow.llm import line_dedup
from riskflow.llm.line_dedup import MIN_CHARS, dedup_lines, near_duplicate_lines
from riskflow.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digests(rows):
    conversations = {}
    for row in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        conversations.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return {
        conv: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(m := "".join(t for r, t in turns if r == "assistant")), sha(m))
        for conv, turns in conversations.items()
    }


def digests(frame):
    return {r["conv_id"]: tuple(r)[1:5] for r in frame.collect()}


def test_chat_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    control = r"\### Assistant: </turn> ok"
    assert digests(QUERIES["op6_chat_format"](spark, sf_dir)) == plain_digests([*rows, (-7, 0, "user", control), (-7, 1, "assistant", control)])


TRICKY = ["", None, "</turn>", "\\</turn>\n", "### x", "#### ", "\\\\### ", "a\n</turn>\nb", "\\", "é\U0001f600 \n", "x\n\n", "### assistant\nno"]


def test_tricky_turns_with_small_budgets(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "tool: %\n", None]), rng.choice(TRICKY)) for c in (1, 2, None) for t in range(40)]
    rows += [(3, t, "assistant" if t % 2 else "user", "word " * 30) for t in range(700)]
    rows += [(4, -1, "system", "be " * 50), (4, 5, "assistant", "yes"), (4, None, "user", "last"), (4, 5, "assistant", "yes"), (5, 0, "assistant", "big " * 30_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    for budget, history in ((40, 10), (300, 100), (1024, 256)):
        windows = format_windows(frame, budget, history).cache()
        assert digests(conversation_digests(windows)) == plain_digests(rows)
        sizes = windows.select("n_tokens", F.size(read_turns(F.col("text"))).alias("n"), "n_repeated").collect()
        assert all(r["n_tokens"] <= budget or r["n"] - r["n_repeated"] == 1 for r in sizes)
        repeated = windows.filter("conv_id = 3").agg(F.sum("n_repeated")).first()[0]
        assert repeated > 0 if history >= 100 else repeated == 0
    assert format_windows(frame.limit(0)).count() == 0


def test_system_turn_is_kept_and_targets_masked_once(spark):
    rows = [(1, 0, "system", "rules here")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t} text") for t in range(1, 60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_windows(frame, 60, 20).orderBy("first_turn").select(read_turns(F.col("text")).alias("turns"), read_loss(F.col("text"), F.col("loss")).alias("loss")).collect()
    assert len(windows) > 5 and all(w["turns"][0] == ("system", "rules here") for w in windows)
    assert [t for w in windows for t in w["loss"]] == [r[3] for r in rows if r[2] == "assistant"]


def test_escapes_are_reversible(spark):
    parts = ["\\", "### ", "</turn>", "#", "\n", "<", "/turn>", "a", "é"]
    rng = random.Random(2)
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", escaped(F.col("t")).alias("e")).withColumn("back", unescaped(F.col("e"))).collect()
    assert all(r["t"] == r["back"] for r in rows)
    assert not any(f"x\n{r['e']}\n</turn>\n".find("\n</turn>\n") < len(r["e"]) + 2 for r in rows)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    n = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[n:] == b[n + 1 :] or (len(a) == len(b) and a[n + 1 :] == b[n + 1 :])


def plain_lines(docs):
    """Kept texts by the rule, over all pairs of lines."""
    seen, out = [], []
    firsts = {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        kept = []
        for raw in (text or "").split("\n"):
            line = raw.strip(" \t\n\x0b\x0c\r")
            near = line in firsts or len(line) >= MIN_CHARS and any(len(o) >= MIN_CHARS and within_one(line, o) for o in seen)
            if line and line not in firsts:
                firsts[line] = 1
                seen.append(line)
            if not line or not near:
                kept.append(raw)
        out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=str)


def edited(rng, line):
    at, letter = rng.randrange(len(line) + 1), rng.choice("abé")
    return rng.choice([line[:at] + letter + line[at:], line[:at] + line[at + 1 :], line[:at] + letter + line[at + 1 :]])


@pytest.mark.parametrize("seed", range(3))
def test_near_lines(spark, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choices("ab é", k=rng.choice([3, 15, 16, 17, 63, 64, 65, 66, 127, 128, 129, 200]))) for _ in range(60)]
    for _ in range(300):
        lines.append(edited(rng, rng.choice(lines)))
    docs = [(i, "\n".join(rng.choices([*lines, "", "  "], k=6))) for i in range(80)] + [(None, lines[0]), (900, None), (901, "")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, line_no int").repartition(5)
    rows = dedup_lines(frame).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == plain_lines(docs)


def test_line_edges(spark):
    long_line = "x y " * 20_000
    docs = [(1, long_line), (2, long_line[:-5] + "z" + long_line[-5:]), (3, "tie tie tie tie tie"), (3, "tie tie tie tie tie")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["kept_doc_id"]) for r in near_duplicate_lines(frame).collect()} == {(2, 1)}
    assert dedup_lines(frame).count() == 4
    assert dedup_lines(frame.limit(0)).count() == 0
    assert dedup_lines(frame.withColumn("text", F.lit(None).cast("string"))).filter("text = ''").count() == 4


def test_only_places_of_shared_gaps_are_tried(spark, monkeypatch):
    rng = random.Random(5)
    start = "".join(rng.choices("abcdefgh", k=90))
    own = [start + "".join(rng.choices("abcdefgh", k=70)) for _ in range(20)]
    near = own[3][:40] + "Z" + own[3][41:]
    tried = []
    made = line_dedup._deletions
    monkeypatch.setattr(line_dedup, "_deletions", lambda lines: tried.append(made(lines)) or tried[-1])
    docs = spark.createDataFrame(list(enumerate([*own, near])), "doc_id long, text string")
    assert {(r["doc_id"], r["kept_doc_id"]) for r in near_duplicate_lines(docs).collect()} == {(20, 3)}
    # Each of all 21 lines without each of its 160 characters would be 3,360. Two lines give the
    # gaps of both sizes of parts around the edit.
    assert 0 < tried[0].count() <= 200


def test_space_before_an_odd_line_end_is_part_of_a_line(spark):
    docs = spark.createDataFrame([(1, "tie\u2028"), (2, "tie \u2028"), (3, "\x0b tie\u2028\t")], "doc_id long, text string")
    assert {(r["doc_id"], r["kept_doc_id"]) for r in near_duplicate_lines(docs).collect()} == {(3, 1)}


def test_rows_of_one_id_lose_their_own_lines(spark):
    docs = [(1, "first line\nsecond line"), (1, "third line\nfirst line"), (1, "third line\nfirst line"), (2, None)]
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows)
    assert got == [(1, 2, 0, "first line\nsecond line"), (1, 2, 1, "third line"), (1, 2, 1, "third line"), (2, 1, 0, "")]


def test_line_query_returns_all_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op1_line_dedup"](spark, sf_dir).collect()}
    assert rows.keys() == docs.keys() and any(r["n_dropped"] for r in rows.values())
    for doc_id, r in rows.items():
        assert r["n_lines"] == len(docs[doc_id].split("\n"))
        assert r["n_dropped"] or r["text"] == docs[doc_id]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_plain_distance(a, b):
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        rows = _next_row(rows, x, b, i)
    assert within_one(a, b) == (rows[-1] <= 1)


def _next_row(above, x, b, i):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row
