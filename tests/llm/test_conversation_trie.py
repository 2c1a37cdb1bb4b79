"""The trie against plain dictionaries."""

import hashlib
import math
import random
import zlib

from riskflow.llm import conversation_trie
from riskflow.llm.conversation_trie import ends_digests, numbered_turns, prefix_trie, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_turns(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            out.setdefault(conv, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    return {conv: [t[3:] for t in sorted(turns)] for conv, turns in out.items()}


def plain_rebuilt(turns):
    out = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = turns.get(conv - int(math.fmod(conv, 100)), [])[:h] + own[h:]
    return out


def plain_trie(convs):
    nodes = {}
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    children, sums = {}, {}
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]] = children.get(prefix[:-1], 0) + 1
    for prefix in sorted(nodes, key=len, reverse=True):
        leaves, saved = sums.get(prefix, (0, 0))
        own = (len(nodes[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        sums[prefix] = (leaves + (prefix not in children), saved + own)
        if prefix:
            above = sums.get(prefix[:-1], (0, 0))
            sums[prefix[:-1]] = (above[0] + sums[prefix][0], above[1] + sums[prefix][1])
    out = []
    for prefix, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(members), len(prefix), parent, len(members), children.get(prefix, 0), *sums[prefix], sha(ends)))
    return sorted(out, key=str)


def trie(frame):
    return sorted((tuple(r[n] for n in NAMES) for r in prefix_trie(*with_shared_heads(numbered_turns(frame))).collect()), key=str)


def test_against_dictionaries(spark):
    rng = random.Random(11)
    rows = []
    for conv in [*range(0, 130), *range(200, 260), 777, -3, -250]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "long text", "é"])))
    # Nulls, ties, repeated rows, roles and texts that join to the same letters.
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, "", ""), (None, 0, "user", "x")]
    rows += [(900, 7, "ab", "c"), (901, 7, "a", "bc"), (902, 7, "a", "bc")] + [(903, 0, "user", "again")] * 40
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as node", "2 as place").repartition(4)
    assert trie(frame) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK_TURNS", 64)
    levels = []
    stored = conversation_trie.stored
    monkeypatch.setattr(conversation_trie, "stored", lambda frame, name: levels.append(name) or stored(frame, name))
    rows = [(100, i, "user", f"t{i % 7}") for i in range(700)] + [(101, i, "user", f"t{i % 7}") for i in range(350)]
    rows += [(c, i, "user", f"t{i}") for c in range(102, 130) for i in range(4)] + [(777, None, "user", "same")] * 300
    assert trie(spark.createDataFrame(rows, SCHEMA)) == plain_trie(plain_rebuilt(plain_turns(rows)))
    # Every level halves the weight of the heaviest component.
    assert levels.count("level") <= math.log2(len(rows)) + 3


def test_empty_table_and_turnless_conversations(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    # Conversations of one turn whose own turns all give way to a head that is absent.
    rows = [(c, 0, "user", "x") for c in range(301, 330)]
    convs = plain_rebuilt(plain_turns(rows))
    assert any(not turns for turns in convs.values())
    assert trie(spark.createDataFrame(rows, SCHEMA)) == plain_trie(convs)


def test_ends_over_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(n, d, c) for n in range(3) for d in range(2) for c in range(n, 40 * (d + 1))]
        got = ends_digests(spark.createDataFrame(rows[::-1], "node long, depth long, conv_id long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {(n, d): sha(",".join(str(c) for a, b, c in rows if (a, b) == (n, d))) for n, d, _ in rows}
    assert {(r["node"], r["depth"]): r["ends_sha256"] for r in got} == want and len(got) == len(want)
