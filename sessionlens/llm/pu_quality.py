"""Quality scores learnt from trusted positives and unlabelled web text.

Labels of bad text are not used. Trusted positives are a sample of good text, and the texts of all
training rows, labelled or not, a sample of all text. Of the latter an unknown share, the class
prior, is good. It is estimated first: a classifier of positives against all text is fitted on one half of the
rows, and on the other half the prior is the least ratio, over thresholds, of the share of all text
above it to the share of positives above it, with a margin for chance. Then the non-negative
unbiased risk

    prior * mean over positives of loss(f) + max(0, mean over all of loss(-f) - prior * mean over positives of loss(-f))

is minimised for the logistic loss by Newton steps. Every step is one pass over all training rows
for its sums (fixed in size by the number of weights) and one to choose its length by the risk itself.

A text is described by ``FEATURES`` of its whole length, each as the quantiles of all documents it
exceeds; a weight for each makes the score additive and lets it bend, and the penalty on weights keeps the
steps small that few positives support.

Defined results: null and empty texts are described by zeros and get a score like any other. A
null doc_id is never held out nor labelled. Repeated documents are scored each. A document is a
trusted positive if all its labels that are not null are 1. Without a positive, or without training
rows, every score is 0.5. Columns other than doc_id, text and quality are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.shared import gathered, segment_rows, stored

FEATURES = (
    "words", "letters_a_word", "long_words", "short_words", "distinct", "richness", "top_word",
    "same_as_before", "lines", "words_a_line", "repeated_lines", "ended_lines", "symbols", "bars", "exclamations",
    "commas", "stops", "capitals", "digits", "not_ascii", "brackets", "controls")
QUANTILES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 0.8, 0.9, 0.95, 0.98, 0.995)
WEIGHTS = len(FEATURES) * len(QUANTILES) + 1
PENALTY = 20.0  # of squared weights, divided by the number of positives
PRIOR_STEPS, RISK_STEPS = 6, 8
LENGTHS = (2.0, 1.0, 0.5, 0.25, 0.125, 0.03)  # tried for every Newton step
SCORES = 1000  # thresholds of the prior's estimate
CONFIDENCE = 0.1
SEGMENTS = 8  # a sum of arrays is summed in so many pieces
GOOD = 0.7


def _codes(letters: str) -> list[int]:
    return list(letters.encode())


_SYMBOLS, _BRACKETS = _codes("#*$%&^~=+_@\\/"), _codes("<>{}[]()")
_CAPITALS, _DIGITS = slice(65, 91), slice(48, 58)


def described(text: bytes | None) -> list[float]:
    """The features of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, chars = max(1, len(words)), len(text)
    counts, lengths = Counter(words), Counter(map(len, words))
    lines = [line for line in map(bytes.strip, text.split(b"\n")) if line]
    n_lines = max(1, len(lines))
    ended = sum(line.endswith((b".", b"!", b"?", b":", b'"', b"\xe2\x80\xa6", b"\xe3\x80\x82")) for line in lines)
    return [
        np.log1p(len(words)),
        sum(k * v for k, v in lengths.items()) / n,
        sum(v for k, v in lengths.items() if k > 12) / n,
        sum(v for k, v in lengths.items() if k <= 3) / n,
        len(counts) / n,
        np.log1p(len(counts)) / np.log1p(n),
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        np.log1p(len(lines)),
        np.log1p(n / n_lines),
        1 - len(set(lines)) / n_lines,
        ended / n_lines,
        seen[_SYMBOLS].sum() / n,
        seen[124] / n,
        seen[33] / n,
        seen[44] / n,
        seen[46] / n,
        seen[_CAPITALS].sum() / chars,
        seen[_DIGITS].sum() / chars,
        seen[128:].sum() / chars,
        seen[_BRACKETS].sum() / n,
        (seen[:9].sum() + seen[14:32].sum() + seen[127]) / chars,
    ]


def described_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, trusted, half, x): each document's features and its part in the training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [described(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))],
                ["doc_id", "held_out", "x"])

    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("binary")) \
        .mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, x array<float>")
    trusted = labels.where(F.col("quality").isNotNull()).groupBy("doc_id") \
        .agg((F.min("quality") == 1).alias("trusted"))
    return (
        rows.join(trusted, "doc_id", "left")
        .withColumns({"trusted": F.coalesce("trusted", F.lit(False)) & ~F.col("held_out"),
                      "half": F.pmod(F.xxhash64("doc_id", "x"), F.lit(2)) == 0}))


@dataclass
class Model:
    """Edges by feature, and a weight for each edge exceeded and for a constant."""

    edges: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS))

    def exceeded(self, batch: pa.RecordBatch) -> np.ndarray:
        """Per row, 1 for each edge exceeded, and a constant 1."""
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
        out = np.zeros((len(x), WEIGHTS))
        for k, edges in enumerate(self.edges):
            at = k * len(QUANTILES)
            out[:, at:at + len(edges)] = x[:, k, None] > edges
        out[:, -1] = 1
        return out

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.exceeded(batch) @ self.weights


def quantile_edges(rows: DataFrame) -> list[np.ndarray]:
    """Quantiles of each feature over all documents; equal ones once."""
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], list(QUANTILES), 10_000).alias(f"f{k}")
                       for k in range(len(FEATURES))]).head()
    return [np.unique(np.array(q or [], np.float32)) for q in found]


def _summed(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum over batches of an array of fixed size, added up in segments on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        yield segment_rows(total, SEGMENTS)

    return gathered(rows.select("trusted", "x").mapInArrow(run, "segment int, counts binary"), "float64", SEGMENTS, size)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _softplus(f: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, f)


def _slopes(rows: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """Of positives, then of all: rows, sums of x, of s x and of s (1 - s) x x', s the model's probability."""
    d = WEIGHTS

    def of_set(x: np.ndarray) -> np.ndarray:
        s = _sigmoid(x @ model.weights)
        return np.concatenate([[len(x)], x.sum(0), s @ x, (x.T @ (x * (s * (1 - s))[:, None])).ravel()])

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        x, trusted = model.exceeded(batch), batch.column("trusted").to_numpy(zero_copy_only=False)
        return np.concatenate([of_set(x[trusted]), of_set(x)])

    total = _summed(rows, of_batch, 2 * (1 + 2 * d + d * d))
    out = []
    for part in np.split(total, 2):
        n = max(1.0, part[0])
        out += [part[0], part[1:d + 1] / n, part[d + 1:2 * d + 1] / n, part[2 * d + 1:].reshape(d, d) / n]
    return tuple(out)


def _losses(rows: DataFrame, model: Model, tried: np.ndarray) -> np.ndarray:
    """For each of the tried weights: mean loss(f) and loss(-f) of positives, and mean loss(-f) of all."""

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        f = tried @ model.exceeded(batch).T
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
        sums = [_softplus(-f[:, trusted]).sum(1), _softplus(f[:, trusted]).sum(1), _softplus(f).sum(1)]
        return np.concatenate([[trusted.sum(), len(trusted)], *sums])

    total = _summed(rows, of_batch, 2 + 3 * len(tried))
    sums = total[2:].reshape(3, -1)
    return sums / np.maximum(1, [[total[0]], [total[0]], [total[1]]])


def _penalty(positives: float) -> np.ndarray:
    """Per weight; the constant's is next to none."""
    return np.append(np.full(WEIGHTS - 1, PENALTY / max(1.0, positives)), 1e-6)


def class_prior(rows: DataFrame, edges: list[np.ndarray]) -> float:
    """The share of good text in all training text."""
    model = Model(edges)
    fitting = rows.where(F.col("half"))
    for _ in range(PRIOR_STEPS):
        n, mean, hit, curve, _, _, all_hit, all_curve = _slopes(fitting, model)
        penalty = _penalty(n)
        model.weights = model.weights - np.linalg.solve(
            curve + all_curve + np.diag(penalty), all_hit - (mean - hit) + penalty * model.weights)

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        place = np.minimum((_sigmoid(model.scores(batch)) * SCORES).astype(int), SCORES - 1)
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(place[trusted], minlength=SCORES), np.bincount(place, minlength=SCORES)])

    above = np.cumsum(_summed(rows.where(~F.col("half")), of_batch, 2 * SCORES).reshape(2, -1)[:, ::-1], 1)
    n_positive, n_all = above[:, -1]
    if not n_positive:
        return 0.5
    positive, everything = above[0] / n_positive, above[1] / n_all
    chance = sum(np.sqrt(np.log(4 / CONFIDENCE) / (2 * n)) for n in (n_positive, n_all))
    used = positive > 0
    best = np.argmin((everything[used] + chance) / positive[used])
    return float(np.clip((everything[used] / positive[used])[best], 0.01, 0.99))


def fit(rows: DataFrame) -> Model:
    """The model of least non-negative risk on the training rows."""
    model = Model(quantile_edges(rows))
    training = rows.where(~F.col("held_out"))
    if not training.where(F.col("trusted")).limit(1).count():
        return model
    prior = class_prior(training, model.edges)
    model.weights[-1] = np.log(prior / (1 - prior))
    reached = np.inf
    for _ in range(RISK_STEPS):
        n, mean, _, _, _, _, all_hit, all_curve = _slopes(training, model)
        penalty = _penalty(n)
        step = np.linalg.solve(all_curve + np.diag(penalty), all_hit - prior * mean + penalty * model.weights)
        tried = model.weights - np.outer([0.0, *LENGTHS], step)
        good, wrong, rest = _losses(training, model, tried)
        risk = prior * good + np.maximum(0, rest - prior * wrong) + tried ** 2 @ penalty / 2
        best = int(np.argmin(risk))
        model.weights = tried[best]
        if best == 0 or reached - risk[best] < 1e-6:
            break
        reached = risk[best]
    return model


def score(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = stored(described_rows(docs, labels, held_out))
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _sigmoid(model.scores(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()),
                 pa.array((p >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "x").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
