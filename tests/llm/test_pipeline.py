"""The pipeline against the same stages on plain lists."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskflow.llm.quality_resampling import resample, without_rejected
from riskflow.llm.rows_decided import rows_decided, text_digest

from .test_ngram_join import plain_set

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PASSAGE = "the answer to the first question of this benchmark is none of the four given below"


def order(row):
    return (row[0] is None, row[0] or 0, hashlib.sha256((row[1] or "").encode()).hexdigest())


def plain_exact(rows):
    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or ""), []).append(row)
    return [min(group, key=order) for group in groups.values()]


def plain_near(rows):
    sets = [plain_set(text) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        return i if group[i] == i else root(group[i])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    found = {}
    for i, row in enumerate(rows):
        found.setdefault(root(i), []).append(row)
    return [min(rows_, key=order) for rows_ in found.values()]


def plain_pieces(rows, capacity=2048):
    out = []
    for doc_id, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 30, 80]))) for _ in range(60)]
    near = [text + " more" for text in texts if len(text.split()) > 25][:15]
    leaks = [f"{text} {PASSAGE} {text}" for text in texts[:6]]
    rows = [(rng.randrange(70), text) for text in texts + near + leaks + texts[:20] + [t.replace(" ", "\n ") for t in texts[20:30]]]
    # Rows that repeat, ids that are null or name several texts, empty texts, a very long one.
    rows += rows[:8] + [(None, texts[0]), (None, texts[41]), (None, "nobody has this text but me"), (None, None), (3, ""), (4, " "), (4, None)]
    rows += [(500, " ".join(f"v{i * i % 99991}" for i in range(200_000)))]
    rng.shuffle(rows)
    return rows


def land(spark, folder, rows, labels):
    extra = ["'x' as lang", "'y' as source", "1L as n_chars", "2 as row", "'k' as key", "3 as label", "4 as length", "5 as __id"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *extra)
    frame.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return frame


def test_all_stages_against_plain_lists(spark, tmp_path):
    rows = corpus(1)
    frame = land(spark, tmp_path, rows, [])
    left = plain_near(plain_exact(rows))
    words = PASSAGE.split()
    clean = [r for r in left if PASSAGE not in " ".join((r[1] or "").split())]
    assert 0 < len(clean) < len(left) < len(rows) and words
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == plain_pieces(clean)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [offset for offset, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)][:-1]]).tolist()
        assert sum(n for _, n in own) <= 2048
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns


def test_rejected_rows_go_by_their_own_text(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["plain", "words", "of", "a", "clean", "text", "here"]) for _ in range(60)), 1) for i in range(80)]
    bad = [(100 + i, " ".join(rng.choice(["$$", "x9x", "!!", "BUY", "q0"]) for _ in range(60)), 0) for i in range(80)]
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad if i % 2], "doc_id long, quality int")
    rows = [(i, t) for i, t, _ in good + bad] + [(0, bad[0][1]), (102, good[3][1]), (None, good[5][1]), (None, bad[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = without_rejected(docs, labels)
    got = Counter(tuple(r) for r in kept.collect())
    assert kept.columns == docs.columns
    assert (0, bad[0][1]) not in got and (102, good[3][1]) in got and (None, good[5][1]) in got and (None, bad[5][1]) not in got
    assert sum((Counter(rows) - got).values()) == len(bad) + 2
    assert resample(docs, labels).count() == sum(got.values())
    assert docs.select(text_digest(docs["text"]).alias("d")).distinct().count() == len({t for _, t in rows})


def test_empty_tables(spark, tmp_path):
    land(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_do_not_repeat_are_read_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None)], "doc_id long, text string")
    schema = "__id long, __key string, __kept boolean, __copies long"

    def decided(*rows):
        return rows_decided(docs, spark.createDataFrame(rows, schema), F.col("doc_id"), F.coalesce("text", F.lit("")))

    single = decided((1, "a", False, 1), (3, "", True, 1))
    assert sorted(map(tuple, single.collect()), key=str) == sorted([(2, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None)], key=str)
    assert "Union" not in single._jdf.queryExecution().optimizedPlan().toString()
    repeated = decided((1, "a", True, 1), (2, "b", True, 2), (None, "c", False, 2))
    assert sorted(map(tuple, repeated.collect()), key=str) == sorted([(1, "a"), (2, "b"), (3, None)], key=str)
    assert sorted(map(tuple, decided((None, "c", True, 2), (2, "b", False, 2)).collect()), key=str) == sorted([(1, "a"), (None, "c"), (3, None)], key=str)
