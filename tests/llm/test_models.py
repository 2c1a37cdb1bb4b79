"""Quality resampling, the toxicity chain and the pipeline: held-out accuracy and rules."""

import numpy as np

import corpus_pipeline
from riskflow.llm.quality_resampling import _Words, buckets_of, kth_largest, log_ratios, resample, without_rejected
from riskflow.llm.toxicity_chain import best_threshold, features_of, fit, toxicity


def labelled(seed, n):
    rng = np.random.default_rng(seed)
    clean = [f"w{i}" for i in range(40)]
    bad, rude = ["%%%", "!!", "###"], ["scum", "moron", "idiotic"]
    rows = []
    for i in range(n):
        words = rng.choice(clean, int(rng.integers(5, 80))).tolist()
        kind = i % 5
        if kind == 0:
            words = [w + rng.choice(bad) for w in words]
        if kind == 1:
            words[int(rng.integers(len(words)))] = str(rng.choice(rude)) + ","
        rows.append((i, " ".join(words), int(kind != 0), int(kind == 1)))
    return rows


def test_resampling_keeps_clean_and_rejects_junk(spark):
    rows = labelled(1, 400)
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, quality int")
    kept = {r["doc_id"] for r in resample(docs, labels).collect()}
    # The sample is random; texts of a few words have weights of the size of its noise.
    assert np.mean([(r[0] in kept) == bool(r[2]) for r in rows]) >= 0.98
    assert without_rejected(docs, labels).columns == docs.columns
    edges = spark.createDataFrame([(1000, None, ""), (None, "", ""), (None, rows[1][1] * 2_000, "")], docs.schema)
    assert resample(docs.union(edges), labels).count() >= len(kept)
    assert resample(docs, labels.limit(0)).count() == len(rows)
    assert resample(docs.limit(0), labels).count() == 0


def test_few_labels_do_not_reject_clean_texts(spark):
    rng = np.random.default_rng(7)
    vocabulary, chances = np.array([f"w{i}" for i in range(3000)]), 1 / np.arange(1, 3001)
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(50, 300)), p=chances / chances.sum()))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in resample(docs, labels).collect()}
    assert np.mean([i not in kept for i in range(60, 1000)]) <= 0.1


def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(2).normal(size=500)] + [0.25] * 40
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 540):
        assert kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_ratio_of_models():
    counts = [np.bincount(buckets_of(text), minlength=17_408) for text in ("a b c a b", "a b z z z z")]
    ratios = log_ratios(*counts)
    assert ratios[buckets_of("c")].sum() > 0 > ratios[buckets_of("z z")].sum()


def test_shapes_of_words():
    known = _Words()

    def shape(word):
        return known.shapes[known[word]]

    assert shape("apple") == shape("a") == shape("äß") != shape("Apple")
    assert shape("Äpfel") == shape("Apple") != shape("APPLE")
    assert shape("12:30") == shape("9:5") != shape("٣:٤")
    assert shape("!!") == shape("!") != shape("?")
    assert len({shape("aB" * n) for n in (5, 6, 600)}) == 3


def test_chain_on_held_out_texts(spark):
    rows = labelled(3, 1500)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (None, "scum"), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1 - r[2], r[3]) for r in rows if r[0] < 900], "doc_id long, low int, toxic int")
    out = {r["doc_id"]: r for r in toxicity(docs, labels, ["low", "toxic"]).collect()}
    assert len(out) == len(rows) + 3
    held = [r for r in rows if r[0] >= 900]
    assert np.mean([out[r[0]]["is_toxic"] == bool(r[3]) for r in held]) > 0.99
    assert toxicity(docs.limit(0), labels, ["low", "toxic"]).count() == 0


def test_threshold_and_single_class():
    assert 0.3 < best_threshold(np.array([0.9, 0.7, 0.3]), np.array([1.0, 1.0, 0.0])) < 0.7
    assert best_threshold(np.zeros(0), np.zeros(0)) == 1.0
    model = fit([features_of("a"), features_of("b")], np.zeros((2, 0)), np.zeros(2))
    assert not model[:-1].any()


def test_pipeline_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[3:]:
        out = stage(spark, docs, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids


def test_chain_with_text_ids_conflicts_and_ties(spark):
    rows = labelled(5, 300)
    edges = [(rows[0][0], rows[9][1]), (None, rows[1][1]), (9001, None), (9002, ""), (9003, rows[1][1] * 3000)]
    docs = [(r[0], r[1]) for r in rows] + edges + [rows[2][:2]] * 2
    marks = [(r[0], 1 - r[2], r[3]) for r in rows] + [(r[0], 1, 1) for r in rows[:40]] + [(None, 1, 1), (5, None, 1)]
    results = []
    for kind in ("bigint", "string"):
        for parts in (2, 5):
            frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "1 as features", "2 as fold")
            labels = spark.createDataFrame(marks, "doc_id long, low int, toxic int").selectExpr(f"cast(doc_id as {kind}) doc_id", "low", "toxic")
            found = toxicity(frame.repartition(parts), labels.repartition(parts), ["low", "toxic"]).collect()
            assert len(found) == len(docs)
            results.append(sorted((str(r["doc_id"]), round(r["p_low"], 6), round(r["p_toxic"], 6), r["is_low"], r["is_toxic"]) for r in found))
        assert results[-1] == results[-2]
    by_id = {r[0]: r for r in results[-1]}
    assert by_id["9001"][1:] == by_id["9002"][1:]
