"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import hard_negatives
from riskflow.llm.hard_negatives import Shard, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, positives=5, negatives=10):
    def usable(vector):
        return vector is not None and all(x is not None and math.isfinite(x) for x in vector)

    rows = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if i is not None and label is not None and usable(v)
    ]
    out = []
    for a, anchor in enumerate(rows):
        if not is_anchor(anchor[0]):
            continue
        scored = [
            (-sum(x * y for x, y in zip(anchor[1], other[1])), other[0], other[2] == anchor[2])
            for b, other in enumerate(rows)
            if a != b
        ]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and -30 * p <= -100 * s[0] <= -90 * p][:negatives]
            out += [(anchor[0], positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(frame, **options):
    return sorted(map(tuple, mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, **options).collect()))


@pytest.mark.parametrize("values", [64, 1 << 18])
def test_against_all_scores(spark, monkeypatch, values):
    monkeypatch.setattr(hard_negatives, "SHARD_VALUES", values)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, [c + rng.gauss(0, 0.6) for c in centres[i % 3]], i % 4) for i in range(150)]
    # Ties, repeated rows and ids, copies of one vector, short, long and empty vectors.
    rows += [rows[10], rows[10], (20, rows[7][1], 1), (21, [], 2), (30, [], 1), (31, [1.0], 1), (32, [0.5] * 9, 2)]
    rows += [(200 + i, [0.25, 0.5, 0.0, 0.0, -0.125, 0.0], i % 2) for i in range(60)]
    rows += [(None, rows[3][1], 1), (40, rows[3][1], None), (50, None, 1), (60, [None, 1.0], 1), (61, [math.nan], 1), (62, [math.inf], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as row", "1 as rank", "'y' as shard").repartition(3)
    got = mined(frame)
    assert got and got == plain(rows, lambda i: i % 10 == 0)


def test_scores_below_zero_and_at_zero(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2), (3, [0.0, 1.0], 1), (4, [0.0, 2.0], 3)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows, lambda i: i % 10 == 0) == [(0, 3, 1, 4, 0, 0)]


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []


def test_components_whose_scores_leave_a_long(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [3e38], 2), (3, [0.5], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == [(0, 1, 1, 3, 65536, 32768)]


class Counting(np.ndarray):
    """An array that counts the rows read by number."""

    read = 0

    def __getitem__(self, key):
        if isinstance(key, np.ndarray) and key.ndim == 1:
            Counting.read += len(key)
        return super().__getitem__(key)


def test_reading_stops_early_and_never_too_early():
    rng = np.random.default_rng(3)
    n, k = 4000, 5
    vectors = rng.integers(-40, 40, (n, 4))
    vectors[:20] = [200, -150, 180, 90]
    ids = rng.permutation(n)
    shard = Shard(np.arange(n), ids, np.zeros(n), vectors.view(Counting))
    anchor = np.array([7, -5, 6, 2])
    scores = vectors @ anchor
    windows = [(-math.inf, math.inf), (0, int(scores.max()) - 1)]
    Counting.read = 0
    places, found = shard.best(anchor, np.ones(n, bool), windows[:1], k)[0]
    assert Counting.read < n / 4
    for (low, high), (places, found) in zip(windows, shard.best(anchor, np.ones(n, bool), windows, k)):
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if low <= s <= high)[:k]
        assert [(-s, ids[p]) for p, s in zip(places.tolist(), found.tolist())] == want
