"""Operator 3: a quality classifier, support vectors over n-gram indicators scaled by Naive Bayes log-count ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batches, free_name, stored, text_or_empty
from .neardup import mixed

#: Indicators are hashed to this many places; the weights are sent to the workers, 4 bytes each.
PLACES = 1 << 20
#: Labelled rows that the model learns from at most: those of the least hash of doc_id. A documented bound.
SAMPLE = 8_000
#: Bytes of the sample's indicators at most, a documented bound too: a labelled text has a few kB as a rule, 4 MB at most.
SAMPLE_BYTES = 256 << 20
FOLDS, THRESHOLD = 5, 0.3
TOKENS = re.compile(r"\w+|[^\w\s]+")


class _Tokens(dict):
    """token -> 56 bits of its hash, and its shape in the low 8 bits."""

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) & ~0xFF | shape(token)
        if len(self) < 300_000 and len(token) <= 64:
            self[token] = h
        return h


def shape(token: str) -> int:
    """Lower case, capitalised, upper case, mixed, digits, letters with digits, or the kind and length of punctuation."""
    if token.isalpha():
        kind = 1 if token.islower() else 3 if token.isupper() and len(token) > 1 else 2 if token[1:].islower() or len(token) == 1 else 4
        return kind * 4 + (len(token) > 3) + (len(token) > 8)
    if token.isdigit():
        return 24
    if token[0].isalnum() or token[0] == "_":
        return 25
    return 32 + (min(len(token), 4) - 1) * 32 + ord(token[0]) % 32 if len(set(token)) == 1 else 28


_tokens = _Tokens()


def indicators(text: str) -> np.ndarray:
    """Sorted distinct places of a text's token 1- and 2-grams and shape 2- and 3-grams."""
    found = TOKENS.findall(text)
    h = np.fromiter(map(_tokens.__getitem__, found), np.uint64, len(found))
    s = h & np.uint64(0xFF)
    grams = [h * np.uint64(3)]
    if len(h) > 1:
        again = int((h[1:] == h[:-1]).sum())  # tokens that repeat the one before
        grams.append(np.array([(1 << 42) + min(again.bit_length(), 6)], np.uint64))
        grams += [h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], np.unique(s[:-1] << np.uint64(8) | s[1:]) + np.uint64(1 << 40)]
    if len(h) > 2:
        grams.append(np.unique(s[:-2] << np.uint64(16) | s[1:-1] << np.uint64(8) | s[2:]) + np.uint64(1 << 41))
    return np.unique((mixed(np.concatenate(grams)) >> np.uint64(44)).astype(np.int32))


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = weights over the indicators / their scaled length + bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[found].sum(dtype=np.float64)))
        return float(self.weights[found].sum(dtype=np.float64)) / max(length, 1e-9) + self.bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.shift, -60, 60))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """r = log((p / |p|) / (q / |q|)): smoothed counts of each indicator in the rows of either class."""
    counts = np.full((2, PLACES), smooth)
    for x, c in zip(rows, y, strict=True):
        counts[c, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0]).astype(np.float32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model, classes balanced by cost: coordinate descent in the dual, one variable for each row."""
    sign = np.where(y == 1, 1.0, -1.0)
    upper = np.where(y == 1, cost * len(y) / (2 * max(1, (y == 1).sum())), cost * len(y) / (2 * max(1, (y == 0).sum())))
    w, bias, dual = np.zeros(PLACES), 0.0, np.zeros(len(rows))
    norm = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = sign[i] * (w[x] @ v + bias) - 1.0
            new = min(max(dual[i] - g / norm[i], 0.0), upper[i])
            step = (new - dual[i]) * sign[i]
            if step:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, by Newton steps with Platt's smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (target - p) - 1e-4 * ab)
        ab += step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def fitted(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model from indicators and labels: three quarters of the rows fit it, the rest set the logistic curve."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        constant = float(y.mean()) if len(y) else 0.5
        zero = np.zeros(PLACES, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log((constant + 0.01) / (1.01 - constant))))
    rest = np.arange(len(y)) % 4 == 3 if min((y == 1).sum(), (y == 0).sum()) >= 8 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~rest)
    r = log_ratios([rows[i] for i in fit], y[fit])
    scaled = lambda x: (v := r[x].astype(np.float64)) / max(float(np.sqrt(v @ v)), 1e-9)
    w, bias = dual_descent([rows[i] for i in fit], [scaled(rows[i]) for i in fit], y[fit])
    model = Model((w * r).astype(np.float32), (r * r).astype(np.float32), bias, 1.0, 0.0)
    ends = np.flatnonzero(rest) if rest.any() else fit
    model.slope, model.shift = calibrated(np.array([model.margin(rows[i]) for i in ends]), y[ends])
    return model


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod FOLDS = 0; a row without a doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that are not held out (those of the least hash of doc_id), and SAMPLE_BYTES of indicators.

    The sample's ids are a bounded table, so it is sent to the documents; indicators of one text for each id come to
    the driver, 4 bytes each.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def rows(it):
        for b in it:
            found = [indicators(t).tobytes() for t in b["text"]]
            yield {"doc_id": b["doc_id"], "quality": b["quality"], "size": [len(x) for x in found], "found": found}

    # One row of each doc_id, then those of the least hash up to a number of bytes.
    one = arrow_map(texts, "doc_id long, quality int, size long, found binary", rows).groupBy("doc_id").agg(F.min(F.struct("size", "found", "quality")).alias("r")).select("doc_id", "r.*")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    few = stored(one, "sample")
    fit = few.select("doc_id", F.sum("size").over(before).alias("bytes")).filter(F.col("bytes") <= SAMPLE_BYTES)
    got = few.join(F.broadcast(fit.select("doc_id")), "doc_id").toArrow()
    ids, y = np.array(got.column("doc_id").to_pylist(), np.int64), np.array(got.column("quality").to_pylist(), np.int64)
    found = [np.frombuffer(x, np.int32) for x in got.column("found").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: xxhash.xxh3_64_intdigest(str(ids[i])))
    return fitted([found[i] for i in order], y[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; a null text is empty, and an empty one has the score of no indicator."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it):
        for b in it:
            scores = [sent.value.score(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return arrow_map(text_or_empty(docs).withColumn("held_out", held_out()), "doc_id long, held_out boolean, score double, predicted int", rows)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from labels and score every document (see learn and score).

    Cases: labels without a document, or of another value than 0 and 1, teach nothing; with no labels or of one class
    only, all scores are the smoothed share of label 1; repeated rows give repeated rows; a null doc_id stays null;
    an empty table gives no rows; text alone is the model's input.
    """
    return score(docs, learn(docs, labels, sample))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that are rejected; columns are as they were, whatever their names.

    Cases: as for classify; a null text is judged as an empty one; repeated rows stay or go together; a row without a
    doc_id is judged by its text; with no labels all have the same score, 0.5, and stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    @F.pandas_udf("double")
    def likely(text):
        return text.map(lambda t: sent.value.score(t or "")).astype(float)

    batches(docs.sparkSession)
    name = free_name(docs, "likely_good")
    return docs.withColumn(name, likely("text")).filter(F.col(name) >= threshold).drop(name)
