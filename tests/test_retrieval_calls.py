"""Retrieval of many queries in one scan, and reranking by calls."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import retrieval

WORDS = "red blue green seven nine data model query index text".split()



@pytest.fixture(scope="module")
def index(spark):
    body = lambda k: " ".join(WORDS[(k * 7 + j * (k + 3)) % 10] for j in range(40)) + f" chunk {k}."
    rows = [(k, f"s{k % 3}", k, body(k), [float(np.cos(k * j)) for j in range(1, 5)]) for k in range(60)]
    return spark.createDataFrame(rows, "chunk_id long, source_name string, chunk_index int, text string, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(q, f"{WORDS[q]} and chunk {q}", [float(np.sin(q * j + 1)) for j in range(1, 5)]) for q in range(6)], "query_id int, query_text string, query_vector array<float>")


def test_many_queries_are_one_scan(spark, index, monkeypatch):
    """50,000 queries meet the index in one scan; the nearest rows are those of a matrix product."""
    calls = []
    real = retrieval._nearest
    monkeypatch.setattr(retrieval, "_nearest", lambda *a: calls.append(1) or real(*a))
    many = 50_000
    asked = spark.range(many).select(F.col("id").alias("query_id"), F.lit("words").alias("query_text"), F.array(*(F.sin(F.col("id") * j + 1).cast("float") for j in range(1, 5))).alias("query_vector"))
    got = retrieval.dense_candidates(index, asked, 2).select("query_id", "cand_pos", "chunk_id").toPandas().sort_values(["query_id", "cand_pos"])
    assert len(calls) == 1 and len(got) == 2 * many
    a = np.array([r.embedding for r in index.orderBy("chunk_id").collect()], np.float32).astype(float)
    q = np.array([r.query_vector for r in asked.orderBy("query_id").collect()], np.float32).astype(float)
    cos = np.round((q @ a.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(a, axis=1)), 9)
    want = np.argsort(-cos, axis=1, kind="stable")[:, :2]
    assert (got["chunk_id"].to_numpy().reshape(-1, 2) == want).mean() > 0.9999


def scored(rows):
    return sorted((r.query_id, r.chunk_id, round(r.score, 9), round(r.api_rerank_score, 9)) for r in rows.collect())


def test_rerank_by_calls(spark, index, queries):
    """One request a query, in the order of score; a query whose call fails keeps its scores, and the others' do not change."""
    def length_of(query, texts):
        if query.startswith(WORDS[2]):
            raise TimeoutError("no answer")
        if query.startswith(WORDS[3]):
            return []
        return [(k, len(set(query.split()) & set(t.split())) + 0.1 * k) for k, t in enumerate(texts)] + [(len(texts), 99.0), (-1, 99.0)]

    rows = retrieval.stored(retrieval.hybrid(retrieval.usable(retrieval.dense_candidates(index, queries, 10))), "rows")
    got = scored(retrieval.rerank_blend(rows, retrieval.rerank_answers(rows, length_of)))
    want = []
    by_query = {}
    for r in rows.collect():
        by_query.setdefault(r.query_id, []).append(r)
    for q, held in by_query.items():
        held.sort(key=lambda r: (-r.score, r.cand_pos))
        if q == 2:
            want += [(q, r.chunk_id, round(r.score, 9), 0.0) for r in held]
            continue
        api = [0.0] * len(held) if q == 3 else [x for _, x in length_of(held[0].query_text, [r.text for r in held])[: len(held)]]
        low, high = min(api), max(api)
        unit = [0.0 if high - low < 1e-12 else (x - low) / (high - low) for x in api]
        want += [(q, r.chunk_id, round(round(0.65 * r.score + 0.35 * u, 12), 9), round(u, 9)) for r, u in zip(held, unit, strict=True)]
    assert got == sorted(want)
    # The whole way: without a reranker nothing changes, and its failure for all queries is the same as none.
    view = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    plain = view(retrieval.retrieve(index, queries))
    def broken(query, texts):
        raise OSError

    assert view(retrieval.retrieve(index, queries, rerank=broken)) == plain
    assert view(retrieval.retrieve(index, queries, rerank=length_of)) != plain


def test_rerank_service(monkeypatch):
    import http.server
    import json

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            out = json.dumps({"data": [{"index": 1, "score": 0.5}, {"index": 0, "relevance_score": 0.25}, {"score": 3}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    url = f"http://127.0.0.1:{server.server_port}"
    with pytest.raises(RuntimeError, match="key"):
        retrieval.service_rerank(url)
    assert retrieval.service_rerank(url, "k", "m")("q", ["a", "b"]) == [(1, 0.5), (0, 0.25)]
    assert seen == [("/v1/rerank", "Bearer k", {"query": "q", "documents": ["a", "b"], "top_n": 2, "model": "m"})]
    server.shutdown()


def test_names_of_a_caller_stay(spark, index, queries):
    """Columns that a caller has under the names that steps use come out as they were."""
    rows = retrieval.hybrid(retrieval.usable(retrieval.dense_candidates(index.withColumn("sig", F.lit("mine")).withColumn("nth", F.lit(7)), queries, 5)))
    got = retrieval.ranked(retrieval.rerank_blend(rows.withColumn("api", F.lit("theirs")), retrieval.rerank_answers(rows, lambda q, t: [(0, 1.0)])))
    assert {(r.sig, r.nth, r.api) for r in got.collect()} == {("mine", 7, "theirs")}
    assert retrieval.LOW not in got.columns and retrieval.SIGNATURE not in got.columns
