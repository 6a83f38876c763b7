"""Operator 6: exact top-k search by inner product, with block-at-a-time pruning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stored
from .neardup import _streamed

K, EVERY = 20, 20
#: Vectors of a document range and queries of a query group that meet in a task, and vectors to a block.
GROUP, QUERIES, BLOCK = 2048, 2048, 64
#: One row in so many, by hash, is searched first: its k-th score bounds the query's from below everywhere else.
SEED = 16
#: Rows, by hash, that ranges gather around; and ranges' envelopes that are sent to the queries at most (2 kB for 128 components each).
PIVOTS, ENVELOPES = 256, 4096


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, x: components floor(scale * x) as doubles, packed. Null vectors and those with a null, infinite or NaN component are left out, and rows without a vec_id."""

    def rows(it):
        for b in it:
            ids, packed = [], []
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                if i is None or v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v):
                    continue
                ids.append(i)
                packed.append(np.floor(scale * np.array(v, np.float64)).tobytes())
            yield {"vec_id": ids, "x": packed}

    return arrow_map(vectors.select("vec_id", "embedding"), "vec_id long, x binary", rows)


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        v = np.frombuffer(p, np.float64)
        out[i, : len(v)] = v
    return out


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products (rows x queries): in doubles where no partial sum can reach 2 ** 53, else in Python's whole numbers."""
    if not rows.size or not queries.size or float(np.abs(rows).max()) * float(np.abs(queries).sum(axis=1).max()) < 2.0**53:
        return rows @ queries.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for q in queries] for r in rows], dtype=object)


def bounds_of(high: np.ndarray, low: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The most that an inner product of a query with a vector between low and high can be, and a little for rounding: (queries x rows of high)."""
    found = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return found + np.abs(found) * 1e-12


def _below(score: np.ndarray) -> np.ndarray:
    """A score of whole numbers as a double that is not above it."""
    return score - np.abs(score) * 1e-12


class Blocks:
    """A document range in blocks, with the greatest and the least of each component ("term") in each.

    Vectors of like signs stand together, so that a block's bounds are as close as its vectors allow.
    """

    def __init__(self, ids: list[int], packed: list[bytes], width: int, block: int = BLOCK):
        rows = matrix(packed, width)
        order = np.lexsort((np.array(ids), *(rows[:, : min(16, width)] > 0).T))
        self.ids, self.rows, self.block = np.array(ids, np.int64)[order], rows[order], block
        starts = range(0, len(ids), block)
        self.high = np.array([self.rows[s : s + block].max(axis=0) for s in starts])
        self.low = np.array([self.rows[s : s + block].min(axis=0) for s in starts])
        self.scored = 0

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of query, vec_id, score) of up to k vectors for each query, none with its own vec_id or a score below `least`.

        Each query goes through the blocks in the order of their bounds, the sums of term maxima, until a bound is below
        its k-th score; a bound that equals it may hide a tie, so that block is read. Queries that have the same block
        next share a matrix product.
        """
        bounds = bounds_of(self.high, self.low, queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth = np.array(least, float)
        top = np.full((len(queries), k), -np.inf)
        live, found = np.arange(len(queries)), []
        for step in range(order.shape[1]):
            next_ = order[live, step]
            go = bounds[live, next_] >= kth[live]
            live, next_ = live[go], next_[go]
            if not len(live):
                break
            for b in np.unique(next_):
                of = live[next_ == b]
                at = slice(b * self.block, (b + 1) * self.block)
                scores = products(self.rows[at], queries[of]).T
                self.scored += scores.size
                good = (scores >= kth[of][:, None]) & (self.ids[at][None, :] != query_ids[of][:, None])
                q, r = np.nonzero(good)
                if len(q):
                    found.append((of[q], self.ids[at][r], scores[q, r]))
                    held = np.where(good, scores, -np.inf).astype(float)
                    merged = np.concatenate([top[of], held], axis=1)
                    top[of] = -np.partition(-merged, k - 1, axis=1)[:, :k]
                    kth[of] = np.maximum(kth[of], _below(top[of].min(axis=1)))
        if not found:
            return (np.empty(0, np.int64),) * 3
        q, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = scores >= kth[q]
        q, ids, scores = q[keep], ids[keep], scores[keep]
        if scores.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), int)
        else:
            order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        first = rank < k
        return q[first], ids[first], scores[first]


def _joined(dealt: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score: up to k candidates of each range for each query that is sent to it (range, vec_id, x, least)."""
    docs = dealt.select("range", "part", F.lit(1).alias("role"), "vec_id", "x", F.lit(None).cast("double").alias("least"))
    asked = asked.select("range", "part", F.lit(0).alias("role"), "vec_id", "x", "least")

    def search(_, rows):
        queries, ids, packed = [], [], []
        for r in rows:
            if r["role"]:
                ids.append(r["vec_id"])
                packed.append(r["x"])
            else:
                queries.append((r["vec_id"], r["x"], -math.inf if r["least"] is None else r["least"]))
        if ids and queries:
            names = np.array([q[0] for q in queries])
            blocks = Blocks(ids, packed, width)
            for q, i, s in zip(*blocks.best(names, matrix([q[1] for q in queries], width), k, np.array([q[2] for q in queries])), strict=True):
                yield {"query_id": int(names[q]), "vec_id": int(i), "score": int(s)}

    return _streamed(docs.unionAll(asked), ["range", "part"], ["role", "vec_id"], "query_id long, vec_id long, score long", search)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k vectors of the highest whole-number inner product.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but those of the query's vec_id;
    ties go to the smaller vec_id. Vectors gather around pivots (rows chosen by hash, a bounded number) in ranges of
    about GROUP; queries come in groups of about QUERIES.
    1. Every query searches the rows of one hash in SEED. Its k-th score there is a bound from below.
    2. The ranges' greatest and least components, in ENVELOPES rows at most, are sent to the queries, and a query goes to the ranges
       whose bound reaches its k-th score. Range and group meet in one task (see Blocks), which gives candidates that
       reach the bound only; so their number follows the number of queries, not its product with that of ranges.
    Both steps are exact, whatever the vectors; how much is pruned depends on how well they cluster. Memory is that of
    one range and one group.

    Cases: see whole_vectors for vectors that take no part; every row is a candidate, so one that is repeated comes as
    often; rows that agree in vec_id and vector are one query, and if a vec_id has several vectors, their candidates
    are ranked together; vectors of different lengths are filled up with zeros; with fewer than k candidates all are
    given; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = stored(whole_vectors(vectors), "vectors")
    facts = x.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.length("x")).alias("bytes")).first()
    n, width = facts["n"], (facts["bytes"] or 0) // 8
    groups = max(1, math.ceil(facts["q"] / QUERIES))
    hashed = F.xxhash64("vec_id", "x")
    # pivots, and the range of each vector
    chosen = x.filter(F.pmod(hashed, F.lit(1 << 30)) <= int(min(1.0, 2 * PIVOTS / max(1, n)) * (1 << 30))).select(hashed.alias("h"), "x").orderBy("h").limit(PIVOTS).collect()
    pivots = matrix([bytes(r["x"]) for r in chosen], width) if chosen else np.zeros((1, width))
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    sent = spark.sparkContext.broadcast(pivots)

    def near(it):
        for b in it:
            yield {"vec_id": b["vec_id"], "x": b["x"], "pivot": (matrix(b["x"], width) @ sent.value.T).argmax(axis=1).tolist() if b["x"] else []}

    x = stored(arrow_map(x, "vec_id long, x binary, pivot int", near), "pivoted")
    sizes = {r["pivot"]: r["count"] for r in x.groupBy("pivot").count().collect()}
    chunks = {p: math.ceil(c / GROUP) for p, c in sizes.items()}
    starts, ranges = {}, 0
    for p in sorted(chunks):
        starts[p], ranges = ranges, ranges + chunks[p]
    lookup = lambda of: F.element_at(F.create_map(*(F.lit(v) for p in sorted(of) for v in (p, of[p]))), F.col("pivot")) if of else F.lit(0)
    x = x.withColumn("range", (lookup(starts) + F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), lookup(chunks))).cast("int")).drop("pivot")
    x = stored(x.repartition("range"), "ranges")
    span = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = x.filter(F.col("vec_id") % every == 0).select("vec_id", "x").distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    # step 1
    seeds = math.ceil(n / SEED / GROUP) or 1
    seed = x.filter(F.pmod(F.xxhash64("vec_id", "x", F.lit(2)), F.lit(SEED)) == 0).select(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(seeds)).cast("int").alias("range"), span(groups).alias("part"), "vec_id", "x")
    first = _joined(seed, queries.select(span(seeds).alias("range"), "part", "vec_id", "x", F.lit(None).cast("double").alias("least")), width, k)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    least = first.withColumn("nth", nth).filter(F.col("nth") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") - F.abs("score") * 1e-12).alias("least"))
    queries = stored(queries.join(least, "vec_id", "left"), "queries")
    # step 2
    wide = max(1, math.ceil(ranges / ENVELOPES))

    def envelopes(it):
        held: dict[int, tuple] = {}
        for b in it:
            rows, of = matrix(b["x"], width), np.array(b["range"]) // wide
            for r in np.unique(of):
                high, low = rows[of == r].max(axis=0), rows[of == r].min(axis=0)
                held[int(r)] = (np.maximum(high, held[r][0]), np.minimum(low, held[r][1])) if r in held else (high, low)
        yield {"envelope": list(held), "high": [h.tobytes() for h, _ in held.values()], "low": [v.tobytes() for _, v in held.values()]}

    high, low = {}, {}
    for r in arrow_map(x.select("range", "x"), "envelope int, high binary, low binary", envelopes).toLocalIterator():
        e, h, v = r["envelope"], np.frombuffer(r["high"]), np.frombuffer(r["low"])
        high[e], low[e] = np.maximum(high.get(e, h), h), np.minimum(low.get(e, v), v)
    order = sorted(high)
    bounds = spark.sparkContext.broadcast((np.array([high[e] for e in order]), np.array([low[e] for e in order])))

    def reached(it):
        for b in it:
            out = {c: [] for c in ("range", "part", "vec_id", "x", "least")}
            if b["x"] and order:
                limit = np.array([-math.inf if v is None else v for v in b["least"]])
                for q, e in zip(*np.nonzero(bounds_of(*bounds.value, matrix(b["x"], width)) >= limit[:, None]), strict=True):
                    for r in range(order[e] * wide, min(ranges, (order[e] + 1) * wide)):
                        out["range"].append(r)
                        for c in ("part", "vec_id", "x", "least"):
                            out[c].append(b[c][q])
                    if len(out["range"]) >= 5000:
                        yield out
                        out = {c: [] for c in out}
            yield out

    asked = arrow_map(queries, "range int, part int, vec_id long, x binary, least double", reached)
    found = _joined(x.select("range", span(groups).alias("part"), "vec_id", "x"), asked, width, k)
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
