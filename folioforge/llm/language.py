"""Operator 13: language identification by nearest centroids of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batches, stored

FOLDS, HELD = 4, 2
UNDETERMINED = "und"
#: Components of a vector: pairs and triples of neighbouring characters, by hash.
WIDTH = 1 << 13
#: Distinct texts of a language that teach, chosen by hash (about so many; at most a third more), and the most languages: what bounds the model.
PER_LANGUAGE, MOST_LANGUAGES = 1000, 256
#: Centroids of a language, and rounds over its vectors to find them.
CENTROIDS, ROUNDS = 4, 12
#: A text is far from a language if it is less like its centroid than all but this share of the texts that taught it, by more than this.
FAR_SHARE, FAR_MARGIN = 0.005, 0.05
#: Characters whose n-grams are counted at a time, and rows that are compared at a time.
_SLICE, _ROWS = 1 << 18, 256

_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Components and counts of a whole text's n-grams: letters in lower case, all else is one blank; none without a letter."""
    letters = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(WIDTH, np.int64)
    for k in range(0, len(letters) - 1, _SLICE):
        c = np.frombuffer(letters[k : k + _SLICE + 2].encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
        two = (c[:-1] ^ (c[1:] >> np.uint32(7)) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (c[2:] >> np.uint32(5)) * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        for x in (two[:_SLICE], three[:_SLICE]):
            total += np.bincount(x >> np.uint32(32 - 13), minlength=WIDTH)
    at = np.flatnonzero(total)
    return at, total[at]


def vectors(found: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Rows of length 1: (1 + ln of the count) times the component's weight; a text without n-grams has zeros."""
    out = np.zeros((len(found), WIDTH), np.float32)
    for row, (at, n) in zip(out, found, strict=True):
        if len(at):
            v = (1 + np.log(n)) * weights[at]
            row[at] = v / np.sqrt(v @ v)
    return out


def centroids(x: np.ndarray, many: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Directions of clusters of the rows of x, and the cluster of each row: from rows that are unlike each other, by spherical k-means.

    Equal distances go to the first, so the result depends on the rows and their order alone. A cluster that loses all its rows goes.
    """
    mean = x.mean(axis=0)
    first = [int(np.argmax(x @ mean))]
    near = x @ x[first[0]]
    while len(first) < min(many, len(x)) and near.min() < 1 - 1e-6:
        first.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[first[-1]])
    c, of = x[first], np.zeros(len(x), int)
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        filled = np.unique(of)
        c = np.stack([x[of == k].sum(axis=0) for k in filled])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


@dataclass
class Model:
    """Weights of the components, and for each centroid its language, its direction and the least similarity of a text that is not far from it."""

    weights: np.ndarray
    languages: list[str]
    directions: np.ndarray
    least: np.ndarray

    def nearest(self, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[str, float, float, bool]]:
        """For each text: the language of the centroid most like it, that likeness, how much it is above the next language's, and whether it is far."""
        if not self.languages:
            yield from ((UNDETERMINED, 0.0, 0.0, True) for _ in found)
            return
        names = np.array(self.languages, object)
        for k in range(0, len(found), _ROWS):
            x = vectors(found[k : k + _ROWS], self.weights)
            like = np.clip((x @ self.directions.T).astype(np.float64), 0.0, 1.0)
            best = np.argmax(like, axis=1)
            for at, row, (gram, _) in zip(best, like, found[k : k + _ROWS], strict=True):
                others = row[names != names[at]]
                if len(gram):
                    yield names[at], float(row[at]), float(row[at] - others.max()) if len(others) else float(row[at]), bool(row[at] < self.least[at])
                else:
                    yield UNDETERMINED, 0.0, 0.0, True


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod FOLDS = HELD; a row without a doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def taught(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """language, key, at, n: about per_language distinct texts of each language of the rows that are not held out, by hash of the text.

    Equal texts count as one, so copies fill neither the sample nor a task. A sketch says how many distinct texts a language has; it
    gives the share of hashes that are taken. At most MOST_LANGUAGES languages; more are an error.
    """
    key = F.xxhash64("text")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("lang").alias("language"), "text", key.alias("key"))
    sizes = {r["language"]: r["texts"] for r in known.groupBy("language").agg(F.approx_count_distinct("key", 0.05).alias("texts")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    scale = 1 << 40
    rows_ = [(name, int(min(1.0, per_language / max(1, n)) * scale)) for name, n in sorted(sizes.items())]
    share = docs.sparkSession.createDataFrame(rows_, "language string, share long")
    chosen = known.join(F.broadcast(share), "language").filter(F.pmod("key", F.lit(scale)) < F.col("share"))

    def rows(it):
        for b in it:
            found = [grams(t) for t in b["text"]]
            yield {"language": b["language"], "key": b["key"], "at": [a.astype(np.int16).tobytes() for a, _ in found], "n": [n.astype(np.int32).tobytes() for _, n in found]}

    found = arrow_map(chosen.select("language", "key", "text"), "language string, key long, at binary, n binary", rows)
    once = found.groupBy("language", "key").agg(F.min(F.struct("at", "n")).alias("v")).select("language", "key", "v.*")
    return stored(once.filter(F.length("at") > 0), "taught")


def _unpacked(at: list[bytes], n: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(c, np.int32)) for a, c in zip(at, n, strict=True)]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Weights from the texts that teach, then the centroids of each language in a task of its own; its vectors are of bounded number and width."""
    spark = docs.sparkSession
    sample = taught(docs, per_language)

    def holders(it):
        total = np.zeros(WIDTH, np.int64)
        for b in it:
            for a in b["at"]:
                total[np.frombuffer(a, np.int16)] += 1
        held = np.flatnonzero(total)
        yield {"component": held, "n": total[held]}

    df = np.zeros(WIDTH)
    for r in arrow_map(sample.select("at"), "component int, n long", holders).groupBy("component").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["component"]] = r["n"]
    weights = np.log((1 + sample.count()) / (1 + df)) + 1

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        x = vectors(_unpacked(group["at"].tolist(), group["n"].tolist()), weights)
        c, of = centroids(x)
        like = x @ c.T
        least = [float(np.quantile(like[of == k, k], FAR_SHARE)) - FAR_MARGIN if (of == k).any() else 1.0 for k in range(len(c))]
        return pd.DataFrame({"language": group["language"].iloc[0], "number": range(len(c)), "direction": [v.astype(np.float32).tobytes() for v in c], "least": least})

    batches(spark)
    got = sorted(sample.groupBy("language").applyInPandas(fit, "language string, number int, direction binary, least double").collect())
    directions = np.array([np.frombuffer(r["direction"], np.float32) for r in got]).reshape(-1, WIDTH)
    return Model(weights, [r["language"] for r in got], directions, np.array([r["least"] for r in got]))


def label(docs: DataFrame, model: Model, rejecting: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, nearest, far of every whole text; with rejecting, texts that are far from all centroids are `und`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it):
        for b in it:
            got = list(sent.value.nearest([grams(t or "") for t in b["text"]]))
            nearest, score, margin, far = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
            pred = [UNDETERMINED if rejecting and f else n for n, f in zip(nearest, far, strict=True)]
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pred, "score": score, "margin": margin, "nearest": nearest, "far": far}

    return arrow_map(docs.select("doc_id", "text", held_out().alias("held_out")), "doc_id long, held_out boolean, lang_pred string, score double, margin double, nearest string, far boolean", rows)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, rejecting: bool = True) -> DataFrame:
    """Learn from docs and label every document (see learn and label).

    Each language has up to CENTROIDS centroids of the TF-IDF vectors of its texts' character pairs and triples. A text
    goes to the language of the centroid with the greatest cosine, its score; margin is what that is above the next
    language's. A text is far if its cosine is below what that centroid's own texts have (FAR_SHARE, FAR_MARGIN).

    Cases: a null text, or one without a letter, is `und` with score 0 and far; with no labelled row all are; rows
    without a language or a text, or of an empty text, teach nothing; a null doc_id stays null and teaches; equal
    likenesses go to the first language by code point; repeated rows give repeated rows; texts are taken whole, in
    slices; an empty table gives no rows; text alone is the input of a prediction; other columns are not read.
    """
    return label(docs, learn(docs, per_language), rejecting)
