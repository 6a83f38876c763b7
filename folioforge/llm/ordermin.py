"""Operator 4: document fingerprints by Order MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches, partitions, text_or_empty
from .neardup import mixed

#: Characters of a k-mer, tuples of a fingerprint; each tuple holds the two least k-mers of one hash function.
K, TUPLES = 8, 48
_rng = np.random.Generator(np.random.PCG64(20240611))
_TIMES = _rng.integers(0, 1 << 31, TUPLES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, TUPLES, dtype=np.uint32)[:, None]
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_COLUMNS = 2048
#: The low bits that a k-mer's hash leaves free, whatever the length of the text.
_LOW = np.uint64((1 << 24) - 1)
#: k-mers that are sorted together with their places.
MOST_PACKED = 1 << 24


def numbered(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """40-bit k-mer hash, 32-bit hash of (k-mer, occurrence number) and place of every k-mer, by k-mer and place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (c + np.uint64(1)) * _P[0]
    if len(h) >= K:
        for width, p in ((1, _P[1]), (2, _P[2]), (4, _P[3])):
            h = h[:-width] * p + h[width:]
    else:  # a shorter text is one k-mer
        h = np.array([int(sum(int(x) * (i + 2) for i, x in enumerate(mixed(h)))) & (1 << 64) - 1], np.uint64)
    kmer = mixed(h) & ~_LOW
    if len(h) <= MOST_PACKED:  # the same order, found more quickly
        s = np.sort(kmer | np.arange(len(h), dtype=np.uint64))
        kmer, place = s & ~_LOW, s & _LOW
    else:
        place = np.argsort(kmer, kind="stable")
        kmer = kmer[place]
    at = np.arange(len(kmer))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], kmer[1:] != kmer[:-1])), at, 0))
    occurrence = (at - first).astype(np.uint64)
    return kmer, (mixed(kmer + occurrence * _P[1]) >> np.uint64(32)).astype(np.uint32), place


def fingerprint(text: str) -> np.ndarray:
    """TUPLES 16-bit hashes. The empty text has zeros."""
    if not text:
        return np.zeros(TUPLES, np.uint16)
    kmer, element, place = numbered(text)
    best = second = None
    every = np.arange(TUPLES)
    for k in range(0, len(element), _COLUMNS):
        x = _TIMES * element[None, k : k + _COLUMNS]
        x += _PLUS
        i = x.argmin(axis=1)
        v = x[every, i].astype(np.uint64) << np.uint64(32) | (i + k).astype(np.uint64)
        if x.shape[1] > 1:
            x[every, i] = 0xFFFFFFFF
            j = x.argmin(axis=1)
            w = x[every, j].astype(np.uint64) << np.uint64(32) | (j + k).astype(np.uint64)
        else:
            w = v if best is None else np.full(TUPLES, (1 << 64) - 1, np.uint64)
        if best is None:
            best, second = v, w
        else:
            best, second = np.minimum(best, v), np.minimum(np.maximum(best, v), np.minimum(second, w))
    low = np.uint64(0xFFFFFFFF)
    a, b = (best & low).astype(np.int64), (second & low).astype(np.int64)
    swap = place[a] > place[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return (mixed(kmer[a] * _P[2] + mixed(kmer[b] + _P[3])) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


DIGESTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_sequence(texts: DataFrame) -> DataFrame:
    """doc_id, text, part, role: range parts in the order (doc_id, text), role 0; and, as role 1, each part's follower.

    The follower is the first document of the next part that has any; after the last part, that of the first one. So
    every document finds the next one in its own part, with one shuffle and no part that holds all. Bounds and first
    ids are numbers, one for each part.
    """
    n = partitions(texts.sparkSession)
    ids = texts.select("doc_id")
    bounds = np.unique(ids.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)) if n > 1 else np.empty(0)

    @F.pandas_udf("int")
    def part(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.fillna(-np.inf).to_numpy(float), side="left").astype(np.int32))

    firsts = {r["part"]: None if r["empty"] else r["first"] for r in ids.groupBy(part("doc_id").alias("part")).agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("empty")).toLocalIterator()}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    leads = F.create_map(*[F.lit(x) for p in order for x in (p, before[p])]) if order else F.create_map().cast("map<int,int>")
    own = texts.withColumn("part", part("doc_id"))
    first_of = F.create_map(*[F.lit(x) for p in order if firsts[p] is not None for x in (p, firsts[p])]) if any(v is not None for v in firsts.values()) else F.create_map().cast("map<int,bigint>")
    is_first = F.col("doc_id").eqNullSafe(F.try_element_at(first_of, F.col("part")))
    places = F.when(is_first, F.array(F.struct(F.col("part"), F.lit(0).alias("role")), F.struct(F.try_element_at(leads, F.col("part")).alias("part"), F.lit(1).alias("role"))))
    placed = own.withColumn("at", F.explode(places.otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("role"))))))
    placed = placed.select("doc_id", "text", F.col("at.part").alias("part"), F.col("at.role").alias("role"))
    return placed.repartitionById(max(n, len(bounds) + 1), F.col("part")).sortWithinPartitions("part", "role", F.asc_nulls_first("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see edited), and their likeness.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (hex), near_edited and
    near_next (likeness to the edited text's and the next document's fingerprint: the share of equal tuples).
    Each of TUPLES hash functions ranks the (k-mer, occurrence) pairs of a text; the two least ones, in the order of
    the text, are hashed to a tuple, so both content and order count.

    Cases: a null text is empty; empty texts have a fingerprint of zeros, alike only each other; texts under 8 code
    points are one k-mer; equal texts have equal fingerprints; the next document is that of the next doc_id (rows
    without one come first, ties go by text, repeated rows follow each other), and after the last the first; a
    single document follows itself; an empty table gives no rows; other columns are ignored.
    """
    batches(docs.sparkSession)
    schema = pa.schema([(f.name, f.type) for f in arrow_schema(DIGESTS)])

    def result(doc, text, mine, following, other) -> dict:
        changed = edited(text, following)
        f = mine if changed == text else fingerprint(changed)
        return {"doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), "fingerprint": shown(mine), "edited_fingerprint": shown(f), "near_edited": likeness(mine, f), "near_next": likeness(mine, other)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part, out = None, None, []
        for b in it:
            for doc, text, p, role in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "part", "role")), strict=True):
                mine = None
                if waiting is not None and p == part:
                    mine = fingerprint(text)
                    out.append(result(*waiting, text, mine))
                    waiting = None
                if role == 0:
                    waiting, part = (doc, text, fingerprint(text) if mine is None else mine), p
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []

    return in_sequence(text_or_empty(docs)).mapInArrow(run, DIGESTS)
