"""Toxicity: a linear classifier learned from confirmed toxic and unlabelled texts (non-negative risk)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relimpute.llm.tables import crc_fold, stored, taken
from relimpute.llm.words import word_hashes

U64 = np.uint64
#: Texts the classifier is fitted on, at most: confirmed toxic ones and unlabelled ones, drawn by hash.
TOXIC_SAMPLE, UNLABELLED_SAMPLE = 4_000, 12_000
#: A word becomes a feature if so many sampled texts hold it and its share differs by so many standard errors.
LEAST_TEXTS, LEAST_ERRORS = 5, 4.0
#: All of ASCII but digits and letters lies between words.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = [not chr(i).isalnum() for i in range(128)]


@dataclass
class Model:
    """Score of a text: the logistic function of bias + the weights of the features it holds."""

    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, starts = word_hashes(texts, BETWEEN)
        total = np.full(len(texts), self.bias)
        if len(self.features) and len(words):
            at = np.minimum(np.searchsorted(self.features, words), len(self.features) - 1)
            hit = np.flatnonzero(self.features[at] == words)
            row = np.searchsorted(starts, hit, "right") - 1
            pair = np.unique(row * len(self.features) + at[hit])
            total += np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, features: int, prior: float, rounds: int = 400, rate: float = 0.1, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for texts with the given (row, feature) pairs; `toxic` marks confirmed rows, the others are unlabelled.

    The risk is prior * loss(toxic as 1) + max(0, loss(unlabelled as 0) - prior * loss(toxic as 0)): the unlabelled
    hold toxic texts at the rate of the prior, and the second part estimates the clean ones alone. Where it falls below
    zero, which only overfitting does, the step goes against it instead.
    """
    n_toxic, n_other = int(toxic.sum()), int((~toxic).sum())
    weights, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, rounds + 1):
        f = np.bincount(rows, weights[columns], len(toxic)) + bias
        clean = soft(f[~toxic]).mean() - prior * soft(f[toxic]).mean()
        slope = np.zeros(len(toxic))
        if clean >= 0:
            slope[toxic] = prior * (sigmoid(f[toxic]) - 1 - sigmoid(f[toxic])) / n_toxic
            slope[~toxic] = sigmoid(f[~toxic]) / n_other
        else:
            slope[toxic] = prior * sigmoid(f[toxic]) / n_toxic
            slope[~toxic] = -sigmoid(f[~toxic]) / n_other
        step = np.r_[np.bincount(columns, slope[rows], features) + shrink * weights, slope.sum()]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def telling_words(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Words whose share among toxic texts differs clearly from their share among the unlabelled."""
    counts = []
    for group in (toxic, ~toxic):
        words = np.concatenate([texts[i] for i in np.flatnonzero(group)])
        counts.append(np.unique(words, return_counts=True))
    every = np.union1d(counts[0][0], counts[1][0])
    held = np.zeros((2, len(every)))
    for g, (words, n) in enumerate(counts):
        held[g, np.searchsorted(every, words)] = n
    sizes = np.array([toxic.sum(), (~toxic).sum()], float)
    share = held / sizes[:, None]
    pooled = held.sum(axis=0) / sizes.sum()
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / sizes).sum())
    return every[(np.abs(share[0] - share[1]) > LEAST_ERRORS * error) & (held.sum(axis=0) >= LEAST_TEXTS)]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From docs (doc_id, text) and labels (doc_id, toxic), both without the held-out rows; None if nothing can be learned."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = stored(marked, "toxic-labels")
    prior = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    draw = lambda ids, n: ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    confirmed = draw(marked.where("toxic = 1").join(docs.select("doc_id"), "doc_id", "left_semi"), TOXIC_SAMPLE).withColumn("toxic", F.lit(True))
    other = draw(docs.where("doc_id IS NOT NULL"), UNLABELLED_SAMPLE).withColumn("toxic", F.lit(False))
    # At most 16,000 ids.
    sample = stored(confirmed.unionByName(other), "toxic-sample")

    def run(batches):
        for batch in batches:
            words, starts = word_hashes(batch.column("text"), BETWEEN)
            sets = [np.unique(words[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.record_batch([batch.column("toxic"), pa.array(sets, pa.binary())], names=["toxic", "words"])

    rows = docs.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "toxic"]).select("toxic", "text").mapInArrow(run, "toxic boolean, words binary").toArrow()
    toxic = np.array(rows.column("toxic").to_pylist(), bool)
    if prior is None or not 0 < prior < 1 or not toxic.any() or toxic.all():
        return None
    texts = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("words")]
    features = telling_words(texts, toxic)
    lengths = np.array([len(t) for t in texts])
    words, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), lengths)
    at = np.minimum(np.searchsorted(features, words), max(len(features) - 1, 0))
    hit = features[at] == words if len(features) else np.zeros(len(words), bool)
    weights, bias = train(owner[hit], at[hit], toxic, len(features), float(prior))
    return Model(features, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Score every whole text for toxicity.

    Learns from texts and labels of rows whose crc32(doc_id as text) modulo `folds` is not `held_out`: confirmed toxic texts
    (toxic = 1) against unlabelled ones, with the share of toxic labels as class prior; labels of 0 only enter that
    prior. Returns one row per input row: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5). NULL and
    empty texts get the score of a text without telling words. If there is nothing to learn (no toxic label, no text, one kind only), all
    scores are 0. Labels without a document, NULL labels and NULL ids teach nothing; of several labels of
    one id the largest counts. Repeated rows come out as often as they went in; other columns are ignored.

    The fit sees at most 4,000 toxic and 12,000 unlabelled texts as sets of word hashes, drawn by the hash of their
    id; words are features if they tell the two apart. Scoring reads every text once, without an exchange.
    """
    rows = taken(docs, doc_id=id_col, text=text_col).withColumn("held_out", crc_fold("doc_id", folds) == held_out)
    marks = taken(labels, doc_id=id_col, toxic=toxic_col).withColumn("held_out", crc_fold("doc_id", folds) == held_out)
    model = fit(rows.where(~F.col("held_out")).select("doc_id", "text"), marks.where(~F.col("held_out")).select("doc_id", F.col("toxic").cast("int").alias("toxic")))

    def run(batches):
        for batch in batches:
            score = model.scores(batch.column("text")) if model else np.zeros(batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
