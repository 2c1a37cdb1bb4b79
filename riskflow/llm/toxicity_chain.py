"""Toxicity by a chain of linear classifiers.

Categories have an order. The model of a category sees which words and word beginnings a
text has (hashed) and the probabilities of all earlier categories. In training those are
out-of-fold: each labelled text gets them from models that did not see it, so a later model
learns how far the earlier ones can be trusted on new texts. A category is assigned from the
probability on that is best (F1) on the out-of-fold predictions.

Models are fitted on a bounded sample of labelled texts (``TRAIN_DOCS``), a task for each
fold; every document is scored, whole.

Defined cases: a null or empty text has no features and gets the models' base rates.
Labels that are null do not take part; of several labels of a document the smallest counts,
and of several texts the one with the smallest digest is learnt from. A category whose
sample holds one class only is predicted as its rate. Repeated rows get equal results, equal
probabilities the same assignment. Texts are read whole, one at a time. Ids may be of any
type. Without labels nothing is assigned; an empty table gives no rows. Columns other than
id, text and categories play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows_decided import text_digest
from .stored import stored

FEATURES = 1 << 17
TRAIN_DOCS = 8_000
FOLDS = 3
ROUNDS = 40
MEMORY = 8
PENALTY = 1e-4
MIN_TEXTS = 3
PREFIX = 5
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’–—…¿¡"
REMEMBERED = 200_000


class _WordFeatures(dict):
    """The features of a word: itself and its beginning."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        normal = word.lower().strip(PUNCTUATION)
        parts = [normal] if len(normal) <= PREFIX else [normal, f"{normal[:PREFIX]}-"]
        value = tuple(xxhash.xxh64_intdigest(part) % FEATURES for part in parts) if normal else ()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_features() -> _WordFeatures:
    return _WordFeatures()


def features_of(text: str | None) -> np.ndarray:
    """The features that a text has, each once."""
    known = _word_features()
    found = {feature for word in set((text or "").split()) for feature in known[word]}
    return np.sort(np.fromiter(found, dtype=np.int64, count=len(found)))


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def _logit(values: np.ndarray) -> np.ndarray:
    clipped = np.clip(values, 1e-4, 1 - 1e-4)
    return np.log(clipped / (1 - clipped))


def _margins(features: Sequence[np.ndarray], earlier: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Sums of the weights of each text's features, of earlier categories and the constant."""
    own = np.array([model[f].sum() for f in features]) if len(features) else np.zeros(0)
    chained = earlier.shape[1]
    return own + _logit(earlier) @ model[FEATURES : FEATURES + chained] + model[-1]


def _minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halved step sizes."""
    at, (value, slope) = start, loss(start)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        way, shares = slope.copy(), []
        for moved, turned, scale in reversed(memory):
            shares.append(scale * (moved @ way))
            way -= shares[-1] * turned
        if memory:
            moved, turned, scale = memory[-1]
            way /= scale * (turned @ turned)
        else:
            way /= max(1.0, float(np.sqrt(slope @ slope)))
        for (moved, turned, scale), share in zip(memory, reversed(shares)):
            way += (share - scale * (turned @ way)) * moved
        size = 1.0
        for _ in range(20):
            next_at = at - size * way
            next_value, next_slope = loss(next_at)
            if next_value <= value - 1e-4 * size * (way @ slope):
                break
            size /= 2
        else:
            return at
        moved, turned = next_at - at, next_slope - slope
        if moved @ turned > 1e-12:
            memory = [*memory[-MEMORY + 1 :], (moved, turned, 1 / (moved @ turned))]
        done = value - next_value < 1e-6 * value
        at, value, slope = next_at, next_value, next_slope
        if done:
            break
    return at


def fit(features: Sequence[np.ndarray], earlier: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights of features, earlier categories and constant, by logistic loss.

    Features count by the log ratio of their rates in the two classes (smoothed), those of
    under ``MIN_TEXTS`` texts not at all.
    """
    texts, chained = len(truth), earlier.shape[1]
    model = np.zeros(FEATURES + chained + 1)
    rate = (truth.sum() + 0.5) / (texts + 1)
    model[-1] = np.log(rate / (1 - rate))
    if truth.min(initial=1) == truth.max(initial=0):
        return model
    columns = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(texts), [len(f) for f in features])
    of_class = [np.bincount(columns, truth[rows] == c, minlength=FEATURES) for c in (0, 1)]
    ratio = np.log((of_class[1] + 1) / (truth.sum() + 2)) - np.log((of_class[0] + 1) / (texts - truth.sum() + 2))
    ratio[of_class[0] + of_class[1] < MIN_TEXTS] = 0
    use = ratio[columns] != 0
    columns, rows = columns[use], rows[use]
    values, logits = ratio[columns], _logit(earlier)
    weight = np.full(len(model), PENALTY)
    weight[-1] = 0

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.bincount(rows, at[columns] * values, minlength=texts) + logits @ at[FEATURES:-1] + at[-1]
        error = (_sigmoid(margin) - truth) / texts
        slope = np.concatenate([np.bincount(columns, error[rows] * values, minlength=FEATURES), logits.T @ error, [error.sum()]])
        value = float(np.mean(np.logaddexp(0, margin) - truth * margin) + 0.5 * (weight * at) @ at)
        return value, slope + weight * at

    model = _minimum(loss, model)
    model[:FEATURES] *= ratio
    return model


def _fold_models(sample: DataFrame, category: str, earlier: Sequence[str]) -> DataFrame:
    """Out-of-fold probabilities of ``category`` for the sample, and the model of all its texts.

    ``fold`` FOLDS trains on everything and gives the model, the others give probabilities.
    """
    copies = sample.withColumn("model_fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        number = int(rows["model_fold"].iloc[0])
        learn = (rows["fold"] != number).to_numpy()
        features = rows["features"].tolist()
        chained = rows[list(earlier)].to_numpy(dtype=float).reshape(len(rows), len(earlier))
        truth = rows[category].to_numpy(dtype=float)
        model = fit([f for f, use in zip(features, learn) if use], chained[learn], truth[learn])
        if number == FOLDS:
            return pd.DataFrame({"doc_id": [None], "probability": [None], "model": [model.tobytes()]})
        held = [f for f, use in zip(features, learn) if not use]
        probability = _sigmoid(_margins(held, chained[~learn], model))
        return pd.DataFrame({"doc_id": rows["doc_id"][~learn], "probability": probability, "model": None})

    kind = sample.schema["doc_id"].dataType.simpleString()
    return copies.groupBy("model_fold").applyInPandas(train, f"doc_id {kind}, probability double, model binary")


def best_threshold(probability: np.ndarray, truth: np.ndarray) -> float:
    """The probability from which on assignments have the best F1; between two values."""
    order = np.argsort(-probability, kind="stable")
    ranked, hits = probability[order], np.cumsum(truth[order])
    if not len(ranked) or not hits[-1]:
        return 1.0
    score = 2 * hits / (np.arange(1, len(ranked) + 1) + hits[-1])
    score[np.append(ranked[1:] == ranked[:-1], False)] = -1
    best = int(np.argmax(score))
    below = ranked[best + 1] if best + 1 < len(ranked) else 0.0
    return float((ranked[best] + below) / 2)


def train_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> tuple[list[np.ndarray], list[float]]:
    """The models and thresholds of the categories, in order.

    ``docs`` has doc_id and text, ``labels`` has doc_id and a 0/1 column per category.
    """
    marked = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.min(c).alias(c) for c in categories])
    total = marked.count()
    if total > TRAIN_DOCS:
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
        marked = marked.filter(share < int(1_000_000 * TRAIN_DOCS / total))

    def with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in ("doc_id", *categories)], pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", *categories, "features"],
            )

    typed = marked.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories])
    texts = docs.dropna(subset=["doc_id"]).join(typed, "doc_id").groupBy("doc_id", *categories)
    texts = texts.agg(F.min_by("text", text_digest(F.col("text"))).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} int" for c in categories) + ", features array<bigint>"
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = stored(texts.mapInArrow(with_features, schema).withColumn("fold", fold), "labelled-texts")
    models, thresholds = [], []
    for i, category in enumerate(categories):
        earlier = [f"p_{name}" for name in categories[:i]]
        trained = stored(_fold_models(sample, category, earlier), "fold-models")
        # One row, of the size of a model.
        models += [np.frombuffer(row["model"]) for row in trained.filter("model is not null").collect()]
        name = f"p_{category}"
        held = trained.filter("model is null").select("doc_id", F.col("probability").alias(name))
        sample = stored(sample.join(held, "doc_id"), "labelled-texts")
        # At most the sample.
        pairs = sample.select(name, category).toPandas()
        thresholds.append(best_threshold(pairs[name].to_numpy(), pairs[category].to_numpy(dtype=float)))
    if len(models) < len(categories):  # nothing is labelled
        models, thresholds = [fit([], np.zeros((0, i)), np.zeros(0)) for i in range(len(categories))], [1.0] * len(categories)
    return models, thresholds


def score_chain(docs: DataFrame, models: Sequence[np.ndarray], thresholds: Sequence[float], categories: Sequence[str]) -> DataFrame:
    """doc_id, and for each category its probability ``p_<category>`` and assignment ``is_<category>``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [features_of(text.as_py()) for text in batch.column("text")]
            earlier = np.zeros((len(features), 0))
            for model in models:
                probability = _sigmoid(_margins(features, earlier, model))
                earlier = np.column_stack([earlier, probability])
            assigned = [pa.array(earlier[:, i] >= threshold) for i, threshold in enumerate(thresholds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(earlier[:, i]) for i in range(len(models))], *assigned],
                ["doc_id", *[f"p_{c}" for c in categories], *[f"is_{c}" for c in categories]],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [f"p_{c} double" for c in categories] + [f"is_{c} boolean" for c in categories]
    return docs.mapInArrow(score, f"doc_id {kind}, " + ", ".join(columns))


def toxicity(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Probabilities and assignments of all documents."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    models, thresholds = train_chain(source, labels, categories)
    return score_chain(source, models, thresholds, categories)
