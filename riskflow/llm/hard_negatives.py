"""Hard negatives of anchors by Fagin's threshold algorithm.

Candidates are dealt to shards. Of each shard one task holds the vectors and, for every
dimension, the list of its rows sorted by that component. All anchors pass by it. For one
anchor the lists are read from the end that its component's sign makes the better one, all
lists to the same depth. Rows seen for the first time are scored by random access, exactly
and in integers. What lies deeper scores no more than the threshold, the sum of the
anchor's products with the last values read; reading stops once that falls strictly below
the kth score of every window asked for (or below the window itself), so that a row of the
same score and a smaller id is never missed. Shards give their best rows of each window, and
of these the best stay.

The first pass finds an anchor's positives: its best other rows of the same label. Each
positive's score opens a window of scores, in which the second pass finds the best rows of
another label.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part; nor do those with a component of 2**25 or more after scaling, whose scores
would leave a long. Vectors of different lengths score as if the shorter ended in zeros; an
empty vector scores zero. Equal vectors tie and come by id. Rows that repeat an id are rows
of their own: each is an anchor, a positive or a negative for itself. A positive whose score
is below zero opens an empty window. Empty tables and anchors without positives give no
rows. Columns other than id, label and vector play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

SCALE = 256
LARGEST = 1 << 25
# Components that a shard holds, and how deep its lists are read at first; then twice as deep.
SHARD_VALUES = 1 << 18
FIRST_DEPTH = 16

_FOUND = (
    "anchor_row long, anchor_id long, target_row long, target_id long, target_score long, "
    "row long, id long, score long"
)


@dataclass
class Shard:
    """Candidates with their lists, one per dimension, ascending by component."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T

    def best(
        self, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[float, float]], k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of the best ``k`` rows that fit, for each window of scores."""
        n, shared = len(self.rows), min(len(anchor), self.vectors.shape[1])
        anchor = anchor[:shared]
        vectors = self.vectors[:, :shared]
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, dtype=bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = 0
        while depth < n:
            # Without a list nothing bounds the rows not seen.
            until = min(n, max(FIRST_DEPTH, 2 * depth)) if len(up) + len(down) else n
            read = np.zeros(n, dtype=bool)
            if until == n:
                read[:] = True
            else:
                read[self.lists[up, n - until : n - depth]] = True
                read[self.lists[down, depth:until]] = True
            fresh = np.flatnonzero(read & ~seen & fits)
            seen |= read
            places = np.append(places, fresh)
            scores = np.append(scores, vectors[fresh] @ anchor)
            depth = until
            last = (vectors[self.lists[up, n - depth], up] @ anchor[up]) + (
                vectors[self.lists[down, depth - 1], down] @ anchor[down]
            )
            if all(self._closed(int(last), scores, window, k) for window in windows):
                break
        found = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            order = np.lexsort((self.rows[places[inside]], self.ids[places[inside]], -scores[inside]))
            inside = inside[order[:k]]
            found.append((places[inside], scores[inside]))
        return found

    @staticmethod
    def _closed(threshold: int, scores: np.ndarray, window: tuple[float, float], k: int) -> bool:
        """Whether no row not seen yet can be among the best of the window."""
        low, high = window
        if threshold < low:
            return True
        inside = scores[(scores >= low) & (scores <= high)]
        return len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors as rows, shorter ones closed by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(part.shape[1] for part in parts)
    return np.vstack([np.pad(part, ((0, 0), (0, width - part.shape[1]))) for part in parts])


def _search(dealt: DataFrame, shards: int, k: int, low: int, high: int, negatives: bool) -> DataFrame:
    """Every anchor's best rows in every shard.

    Rows of ``dealt`` come by shard, candidates before anchors, so that a task holds one
    shard and a batch of anchors at a time.
    """

    def windows_of(targets: list[dict] | None) -> list[tuple[dict | None, tuple[float, float]]]:
        if not negatives:
            return [(None, (-math.inf, math.inf))]
        bounds = [(t, (-(-low * t["score"] // 100), high * t["score"] // 100)) for t in targets]
        return [(t, window) for t, window in bounds if window[0] <= window[1]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, parts = None, None, []
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            kinds = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, len(numbers)]):
                if stop == start:
                    continue
                part = batch.slice(start, stop - start)
                if numbers[start] != current:
                    current, shard, parts = numbers[start], None, []
                rows, ids, labels = (part.column(c).to_numpy() for c in ("row", "id", "label"))
                vectors = _matrix(part.column("vector"))
                if not kinds[start]:
                    parts.append((rows, ids, labels, vectors))
                    continue
                if shard is None:
                    # An anchor is a candidate too, so no shard that anchors come to is
                    # without candidates unless hashing left it empty.
                    if not parts:
                        continue
                    shard = Shard(*(np.concatenate(c) for c in list(zip(*parts))[:3]), _stacked([p[3] for p in parts]))
                    parts = []
                targets = part.column("targets").to_pylist()
                out = []
                for row, id_, label, vector, own in zip(rows, ids, labels, vectors, targets):
                    windows = windows_of(own)
                    if not windows:
                        continue
                    same = shard.labels == label
                    fits = ~same if negatives else same & (shard.rows != row)
                    for (target, _), (places, scores) in zip(
                        windows, shard.best(vector, fits, [window for _, window in windows], k)
                    ):
                        about = (target["row"], target["id"], target["score"]) if target else (None, None, None)
                        for place, score in zip(places, scores):
                            out.append((row, id_, *about, shard.rows[place], shard.ids[place], score))
                if out:
                    columns = [pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])

    # As many parts as shards: their work is searching, which their bytes do not show.
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "is_anchor")
    found = ordered.mapInArrow(search, _FOUND)
    # Only the best of the shards' best: the window's limit is applied before the shuffle too.
    each = Window.partitionBy("anchor_row", "target_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    embeddings: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
) -> DataFrame:
    """The best rows of another label for every anchor and positive of it.

    ``anchors`` tells which rows are anchors. Scores are inner products of the components
    after ``floor(scale * x)``. A negative's score is from ``low`` to ``high`` percent of
    its positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score. Ids and labels are whole numbers.
    """
    scaled = F.lit(float(scale))
    vector = F.col(vector_column)
    # NaN and infinity are above the bound.
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scaled) < F.lit(float(LARGEST)), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scaled).cast("int"))
    rows = embeddings.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).cast("long").alias("label"),
        F.when(usable, whole).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "embeddings")
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    shards = max(1, math.ceil(count * max(width, 1) / SHARD_VALUES))
    none = F.lit(None).cast("array<struct<row:bigint,id:bigint,score:bigint>>")
    candidates = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"),
        F.lit(False).alias("is_anchor"), "row", "id", "label", "vector",
        none.alias("targets"),
    )

    def dealt(queries: DataFrame) -> DataFrame:
        """The queries come to every shard; they are the stated query set, a share of the rows."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
        return candidates.union(
            queries.select(every.alias("shard"), F.lit(True), "row", "id", "label", "vector", "targets")
        )

    queries = rows.filter("is_anchor")
    best = _search(dealt(queries.withColumn("targets", none)), shards, positives, low, high, negatives=False)
    targets = best.groupBy(F.col("anchor_row").alias("row")).agg(
        F.collect_list(F.struct("row", "id", "score")).alias("targets")
    )
    found = _search(dealt(queries.join(targets, "row")), shards, negatives, low, high, negatives=True)
    return found.select(
        "anchor_id",
        F.col("target_id").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("target_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
