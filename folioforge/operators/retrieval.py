"""Hybrid retrieval for batches of queries: cosine, BM25 over the candidates, blending, threshold, first of equal texts, rank."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import free_name
from ..functions.text import low_signal, rag_tokens, signature, strip
from ..storage import stored

TOP_K, FETCH_K, MIN_SCORE, DENSE_WEIGHT, RERANK_BLEND = 5, 40, 0.20, 0.70, 0.35
#: Bytes of query vectors that are sent to every task of one scan of the index; more queries go in parts, each with a scan of its own.
MOST_QUERY_BYTES = 256 << 20
#: Products of queries and vectors that a task holds at a time.
MOST_PRODUCTS = 4 << 20
#: Candidates of all queries (ids and scores, some 40 bytes each) that are sent to the scan that fetches their texts; beyond it they are joined by shuffle.
MOST_SENT = 2_000_000
#: What a candidate carries of its text, found once a chunk.
LOW, SIGNATURE = "low_signal_text", "signature_of_text"


def dense_candidates(index: DataFrame, queries: DataFrame, fetch_k: int = FETCH_K, source_name: str | None = None) -> DataFrame:
    """The fetch_k nearest rows of index (chunk_id, source_name, chunk_index, text, embedding) for each query (query_id, query_text, query_vector).

    All queries are sent to one scan of vectors, up to MOST_QUERY_BYTES. There each Arrow batch of vectors meets blocks of
    queries in matrix products, and only what can be among a query's nearest leaves the task. Texts are read for the
    candidates alone, and each text is looked at once, however many queries have it. The result is stored, as all steps
    behind it read it more than once; it also has LOW and SIGNATURE.
    Cases: ties go by chunk_id, the index's key; rows without a vector are no candidates; a vector of zeros, or of
    another length than the query's, has the score 0; no queries or an empty index give no rows.
    """
    if source_name:
        index = index.filter(F.col("source_name") == source_name)
    with_vector = queries.filter(F.col("query_vector").isNotNull())
    size = with_vector.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("query_vector").cast("long")), F.lit(0)).alias("numbers")).first()
    parts = max(1, -(-8 * size["numbers"] // MOST_QUERY_BYTES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    vectors = index.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    near = stored(reduce(DataFrame.unionByName, (_first(_nearest(vectors, with_vector.filter(part == k), fetch_k), fetch_k) for k in range(parts))), "near")
    few = size["n"] * fetch_k <= MOST_SENT
    sent = F.broadcast if few else lambda df: df
    chunks = index.drop("embedding").join(sent(near.select("chunk_id").distinct()), "chunk_id", "left_semi")
    chunks = chunks.withColumn(LOW, (strip(F.col("text")) == "") | low_signal(F.col("text"))).withColumn(SIGNATURE, signature(F.col("text")))
    return stored(chunks.join(sent(near), "chunk_id").join(queries.drop("query_vector"), "query_id"), "candidates")


def _cosines(rows: np.ndarray, norms: np.ndarray, queries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each query (rows) and each vector (columns)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (queries @ rows.T) / (sizes[:, None] * norms[None, :])
    return np.where(np.isfinite(out), out, 0.0)


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles; one of another length, or with a null, as zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(vectors) and vectors.null_count == 0 and (lengths == width).all() and not vectors.flatten().null_count:
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    fit = lambda v: v if v is not None and len(v) == width and None not in v else [0.0] * width
    return np.array([fit(v) for v in vectors.to_pylist()], np.float64).reshape(len(vectors), width)


def _nearest(vectors: DataFrame, asked: DataFrame, fetch_k: int) -> DataFrame:
    """query_id, chunk_id, cosine: from each task what can be among the fetch_k nearest of a query, and a little more."""
    spark = vectors.sparkSession
    id_type, kind = vectors.schema["chunk_id"].dataType, asked.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("chunk_id", id_type), T.StructField("cosine", T.DoubleType())])
    groups: dict[int, list] = {}
    for r in asked.select("query_id", "query_vector").toLocalIterator():
        groups.setdefault(len(r["query_vector"]), []).append(r)
    if not groups:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast([(pa.array([r["query_id"] for r in g], to_arrow_type(kind)), np.array([r["query_vector"] for r in g], np.float64)) for g in groups.values()])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth = [np.full((len(v), fetch_k), -np.inf) for _, v in sent.value]
        sizes = [np.sqrt((v * v).sum(axis=1)) for _, v in sent.value]
        for b in it:
            for (ids, queries), best, size in zip(sent.value, kth, sizes, strict=True):
                rows = _matrix(b.column("embedding"), queries.shape[1])
                norms = np.sqrt((rows * rows).sum(axis=1))
                many = max(1, MOST_PRODUCTS // max(1, len(rows)))
                for k in range(0, len(queries), many):
                    scores, mine = _cosines(rows, norms, queries[k : k + many], size[k : k + many]), best[k : k + many]
                    mine[:] = -np.partition(-np.concatenate([mine, scores], axis=1), fetch_k - 1, axis=1)[:, :fetch_k]
                    # Scores are rounded to nine places later: what could be equal then stays.
                    q, r = np.nonzero(scores >= mine.min(axis=1)[:, None] - 2e-9)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + k)), b.column("chunk_id").take(pa.array(r)), pa.array(scores[q, r])], names=["query_id", "chunk_id", "cosine"])

    return vectors.mapInArrow(run, schema)


def _first(near: DataFrame, fetch_k: int) -> DataFrame:
    """query_id, chunk_id, dense_score_raw, cand_pos of the fetch_k nearest; each task's are ranked before they are shuffled."""
    near = near.select("query_id", "chunk_id", F.round("cosine", 9).alias("dense_score_raw"))
    order = Window.partitionBy("query_id").orderBy(F.desc("dense_score_raw"), "chunk_id")
    return near.withColumn("cand_pos", F.row_number().over(order)).filter(F.col("cand_pos") <= fetch_k)


def usable(candidates: DataFrame) -> DataFrame:
    """Candidates whose text says something; those of dense_candidates know it already."""
    low = F.col(LOW) if LOW in candidates.columns else (strip(F.col("text")) == "") | low_signal(F.col("text"))
    return candidates.filter(~low)


def min_max(c: str, default: float = 0.0) -> Column:
    w = Window.partitionBy("query_id")
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < 1e-12, F.lit(default)).otherwise((F.col(c) - low) / (high - low))


def token_postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, token, tf, size: how often each token occurs in a chunk, and the chunk's tokens in all; one without a token has a row of a null token."""
    rows = chunks.select("chunk_id", rag_tokens(F.col("text")).alias("tokens")).select("chunk_id", F.size("tokens").alias("size"), F.explode_outer("tokens").alias("token"))
    return rows.groupBy("chunk_id", "token").agg(F.count("token").alias("tf"), F.max("size").alias("size"))


def bm25(candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, postings: DataFrame | None = None) -> DataFrame:
    """candidates with bm25_raw: Okapi over the candidate set of each query; query tokens count as often as they occur.

    postings are the index's (see token_postings, index.postings); without them each candidate chunk's tokens are counted once.
    Cases: a query without a token, or whose tokens no candidate has, scores 0 everywhere; a candidate without a token
    scores 0; chunk_id is the key of a chunk; one that the postings lack has no token.
    """
    held = token_postings(candidates.select("chunk_id", "text").dropDuplicates(["chunk_id"])) if postings is None else postings.select("chunk_id", "token", "tf", "size")
    tf = candidates.select("query_id", "cand_pos", "chunk_id").join(held, "chunk_id", "inner" if postings is None else "left").withColumn("size", F.coalesce("size", F.lit(0)))
    tf = stored(tf.select("query_id", "cand_pos", "size", "token", "tf"), "terms")
    sizes = tf.select("query_id", "cand_pos", "size").distinct().groupBy("query_id").agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"))
    tf = tf.filter(F.col("token").isNotNull())
    idf = tf.groupBy("query_id", "token").agg(F.count("*").alias("df")).join(sizes, "query_id")
    idf = idf.withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = epsilon * F.avg("raw").over(Window.partitionBy("query_id"))
    idf = idf.select("query_id", "token", "docs", "mean_size", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    asked = candidates.groupBy("query_id").agg(F.first("query_text").alias("query_text")).select("query_id", F.explode(rag_tokens(F.col("query_text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    hits = tf.join(asked.join(idf, ["query_id", "token"]), ["query_id", "token"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    scores = hits.groupBy("query_id", "cand_pos").agg(F.sum(part).alias("found"))
    found = free_name(candidates, "found")
    scores = scores.withColumnRenamed("found", found)
    return candidates.join(scores, ["query_id", "cand_pos"], "left").withColumn("bm25_raw", F.round(F.coalesce(found, F.lit(0.0)), 9)).drop(found)


def hybrid(candidates: DataFrame, dense_weight: float = DENSE_WEIGHT, postings: DataFrame | None = None) -> DataFrame:
    """dense_score, bm25_score (min-max over the query's candidates) and their blend, score."""
    w = min(1.0, max(0.0, dense_weight))
    rows = bm25(candidates, postings=postings).withColumn("dense_score", min_max("dense_score_raw")).withColumn("bm25_score", min_max("bm25_raw"))
    return rows.withColumn("score", F.round(w * F.col("dense_score") + (1 - w) * F.col("bm25_score"), 9))


def _in_score_order(rows: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_pos")
    return rows.withColumn(name, F.row_number().over(order) - 1)


def rerank_blend(rows: DataFrame, reranked: DataFrame, blend: float = RERANK_BLEND) -> DataFrame:
    """Blend in a reranker's answer (query_id, index from 0 in score order, relevance_score or score).

    Rows that an answer leaves out have 0; a query without any answer keeps its scores, and api_rerank_score 0, as when
    the call has failed.
    """
    b = min(1.0, max(0.0, blend))
    index, api, any_ = (free_name(rows, n) for n in ("index", "api", "answered"))
    got = reranked.groupBy("query_id", F.col("index").alias(index)).agg(F.first(F.coalesce("relevance_score", "score", F.lit(0.0))).alias(api))
    answered = reranked.select("query_id", F.lit(True).alias(any_)).distinct()
    out = _in_score_order(rows, index).join(got, ["query_id", index], "left").join(answered, "query_id", "left").withColumn(api, F.coalesce(api, F.lit(0.0)))
    scaled = F.when(F.col(any_), min_max(api)).otherwise(0.0)
    blended = F.when(F.col(any_), F.round((1 - b) * F.col("score") + b * F.col("api_rerank_score"), 12)).otherwise(F.col("score"))
    return out.withColumn("api_rerank_score", scaled).withColumn("score", blended).drop(index, api, any_)


#: What a reranker answers to a query and its candidates' texts: pairs of a candidate's index and its score.
Rerank = Callable[[str, list[str]], list[tuple[int, float]]]


def service_rerank(url: str, key: str | None = None, model: str | None = None, timeout: float = 40.0) -> Rerank:
    """A reranking service that takes {query, documents, top_n} and gives {results or data: [{index, relevance_score or score}]}; a key is needed."""
    from .generate import _posted, base_url, resolved_key

    if not (key := resolved_key(key, ("OPENAI_API_KEY",))):
        raise RuntimeError("a reranking service needs a key")

    def call(query: str, texts: list[str]) -> list[tuple[int, float]]:
        said = _posted(f"{base_url(url)}/rerank", {"query": query, "documents": texts, "top_n": len(texts), **({"model": model} if model else {})}, key, timeout)
        rows = said.get("results") or said.get("data") or []
        return [(int(r["index"]), float(r.get("relevance_score", r.get("score", 0)))) for r in rows if r.get("index") is not None]

    return call


def rerank_answers(rows: DataFrame, rerank: Rerank) -> DataFrame:
    """query_id, index, relevance_score, score: a reranker's answers, one request for the candidates of each query.

    A query's candidates are at most fetch_k rows; they come to one task, in the order of score, and a task has the
    queries of its partition, so requests run as wide as there are tasks. A call that fails in any way leaves its query
    without an answer and touches no other one; indices out of range are dropped, of equal ones the last counts. The
    result is stored: asking again may give another answer.
    """
    spot = free_name(rows, "spot")
    given = _in_score_order(rows, spot).select("query_id", F.col(spot).alias("spot"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("query_text", F.lit("")).alias("query_text"))
    whole = given.groupBy("query_id").agg(F.first("query_text").alias("query_text"), F.transform(F.sort_array(F.collect_list(F.struct("spot", "text"))), lambda x: x["text"]).alias("texts"))

    @F.pandas_udf("string")
    def asked(query, texts):
        def one(q: str, ts) -> str | None:
            try:
                said = {int(i): float(x) for i, x in rerank(q, list(ts)) if 0 <= int(i) < len(ts)}
            except Exception:  # noqa: BLE001 - whatever a service does, the query keeps its scores
                return None
            return json.dumps([{"index": i, "score": x} for i, x in said.items()] or [{"index": 0, "score": 0.0}])

        import pandas as pd

        return pd.Series([one(q, ts) for q, ts in zip(query, texts, strict=True)], dtype=object)

    said = stored(whole.select("query_id", asked("query_text", "texts").alias("said")), "reranked")
    pairs = said.select("query_id", F.explode(F.from_json("said", "array<struct<index:int,score:double>>")).alias("x"))
    return pairs.select("query_id", "x.index", F.col("x.score").alias("relevance_score"), F.lit(None).cast("double").alias("score"))


def ranked(rows: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Threshold, the first row of each text signature, the first top_k of a query with their rank."""
    sig, nth = free_name(rows, "sig"), free_name(rows, "nth")
    rows = rows.filter(F.col("score") >= min_score).withColumn(sig, F.col(SIGNATURE) if SIGNATURE in rows.columns else signature(F.col("text"))).filter(F.col(sig) != "")
    first = F.row_number().over(Window.partitionBy("query_id", sig).orderBy(F.desc("score"), "cand_pos"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_pos"))
    return rows.withColumn(nth, first).filter(F.col(nth) == 1).withColumn("rank", rank).filter(F.col("rank") <= top_k).drop(nth, sig, LOW, SIGNATURE)


def retrieve(
    index: DataFrame, queries: DataFrame, top_k: int = TOP_K, fetch_k: int = FETCH_K, min_score: float = MIN_SCORE, dense_weight: float = DENSE_WEIGHT, source_name: str | None = None,
    reranked: DataFrame | None = None, rerank: Rerank | None = None, blend: float = RERANK_BLEND, postings: DataFrame | None = None,
) -> DataFrame:
    """All steps. The threshold holds for scores that are relative to a query's candidates, so a single candidate (score 0) is dropped at the default.

    Candidates are reranked by a table of answers, or by calls of `rerank`, or not at all. postings are the index's, where it keeps them.
    """
    rows = hybrid(usable(dense_candidates(index, queries, max(fetch_k, top_k), source_name)), dense_weight, postings)
    if reranked is None and rerank is not None:
        rows = stored(rows, "hybrid")
        reranked = rerank_answers(rows, rerank)
    return ranked(rows if reranked is None else rerank_blend(rows, reranked, blend), top_k, min_score)


def context(results: DataFrame) -> DataFrame:
    """query_id, context: numbered chunks in the order of rank."""
    block = F.concat(F.lit("["), F.col("source_name"), F.lit(" chunk="), F.col("chunk_index").cast("string"), F.lit("]\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"))


def numbered_context(results: DataFrame) -> DataFrame:
    """query_id, context: results as numbered blocks of source, chunk and text, as slide plans are asked for."""
    named = F.coalesce("source_name", F.lit("unknown"))
    block = F.concat(F.lit("[source#"), F.col("rank").cast("string"), F.lit("]\nsource_name="), named, F.lit("\nchunk_index="), F.coalesce("chunk_index", F.lit(-1)).cast("string"), F.lit("\ntext="), strip(F.coalesce("text", F.lit(""))))
    parts = F.sort_array(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"))


def with_defaults(chunks: DataFrame) -> DataFrame:
    """chunks whose missing payload is filled: text and ids empty, source_name "unknown", chunk_index -1."""
    rows = chunks.withColumn("source_name", F.coalesce("source_name", F.lit("unknown"))).withColumn("chunk_index", F.coalesce("chunk_index", F.lit(-1)))
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def study_context(chunks: DataFrame, most: int = 18_000) -> DataFrame:
    """doc_id, context: chunks (doc_id, pos, source_name, chunk_index, text) in order, each under a header, while they and what separates them fit.

    A first one that does not fit is cut, with dots behind. Cases: blank chunks are left out; a document of blank
    chunks has no row; a missing source is "unknown", a missing index -1.
    """
    text = strip(F.coalesce("text", F.lit("")))
    header = F.concat(F.lit("[Source: "), F.coalesce("source_name", F.lit("unknown")), F.lit(" | chunk="), F.coalesce("chunk_index", F.lit(-1)).cast("string"), F.lit("]\n"))
    rows = chunks.select("doc_id", "pos", header.alias("header"), text.alias("body")).filter("body <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("used", F.sum(F.length("header") + F.length("body") + 2).over(w) - 2).withColumn("first", F.row_number().over(w) == 1)
    room = F.lit(most - 3) - F.length("header")
    cut = F.when(room > 0, F.concat(F.substring("body", F.lit(1), room), F.lit("..."))).otherwise(F.substring("body", 1, most))
    rows = rows.filter(F.col("first") | (F.col("used") <= most)).withColumn("body", F.when(F.col("used") > most, cut).otherwise(F.col("body")))
    block = F.struct("pos", F.concat("header", "body").alias("block"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda p: p["block"]), "\n\n").alias("context"))
