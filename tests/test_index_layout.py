"""The index: its layout is kept, its changes are whole, its postings follow it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioforge import storage
from folioforge.operators import index, retrieval

SCHEMA = "chunk_id string, source_name string, chunk_index int, text string"


def held(spark, folder, collection="docs"):
    return sorted((r.chunk_id, r.source_name, r.text) for r in index.open_collection(spark, folder, collection).collect())


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_buckets_are_kept(spark, tmp_path):
    folder = str(tmp_path / "index")
    index.ingest(folder, "docs", chunks(spark, ("a1", "s1", 0, "x"), ("a2", "s1", 1, "y"), ("b1", "s2", 0, "z")), buckets=16)
    with pytest.raises(ValueError, match="16 buckets"):
        index.ingest(folder, "docs", chunks(spark, ("a3", "s1", 0, "new")), buckets=64)
    index.ingest(folder, "docs", chunks(spark, ("a3", "s1", 0, "new")))
    assert held(spark, folder) == [("a3", "s1", "new"), ("b1", "s2", "z")]
    index.ingest(folder, "other", chunks(spark, ("a3", "s1", 0, "else")), buckets=4)
    assert held(spark, folder, "other") == [("a3", "s1", "else")] and len(held(spark, folder)) == 2


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.range(10_000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("hot").alias("source_name"), F.col("id").cast("int").alias("chunk_index"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    index.ingest(folder, "docs", rows, file_rows=1000)
    (bucket,) = [x for x in os.listdir(f"{folder}/collection=docs") if x.startswith("bucket=")]
    files = [x for x in os.listdir(f"{folder}/collection=docs/{bucket}") if x.endswith(".parquet")]
    tasks = {x.split("-")[1] for x in files}
    assert len(files) >= 5 and len(tasks) >= 2 and max(spark.read.parquet(f"{folder}/collection=docs/{bucket}/{f}").count() for f in files) <= 4000
    assert index.open_collection(spark, folder, "docs").count() == 10_000


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    index.ingest(folder, "docs", chunks(spark, ("a", "s1", 0, "x"), ("b", "s2", 0, "y")), keep_postings=True)
    real = index._write

    def broken(rows, path, *rest):
        real(rows, path, *rest)
        if path.endswith("postings"):
            raise OSError("disk full")

    monkeypatch.setattr(index, "_write", broken)
    with pytest.raises(OSError):
        index.ingest(folder, "docs", chunks(spark, ("c", "s1", 0, "z")))
    assert held(spark, folder) == [("a", "s1", "x"), ("b", "s2", "y")] and not os.listdir(f"{folder}.staging")


def test_a_lost_driver_after_the_switch(spark, tmp_path, monkeypatch):
    """From the journal on the new rows hold: whatever has been moved, and also after the next ingest."""
    folder = str(tmp_path / "index")
    first = [(f"{s}{k}", s, k, f"text {k}") for s in ("s1", "s2", "s3", "s4") for k in range(2)]
    index.ingest(folder, "docs", chunks(spark, *first), keep_postings=True)
    real, moved = index.Files.move, []

    def stops(self, source, *below):
        if moved:
            raise KeyboardInterrupt
        moved.append(source)
        real(self, source, *below)

    monkeypatch.setattr(index.Files, "move", stops)
    new = [("n1", "s1", 0, "new one"), ("n2", "s2", 0, "new two"), ("s30", "s4", 0, "moved over")]
    with pytest.raises(KeyboardInterrupt):
        index.ingest(folder, "docs", chunks(spark, *new))
    monkeypatch.setattr(index.Files, "move", real)
    want = [("n1", "s1", "new one"), ("n2", "s2", "new two"), ("s30", "s4", "moved over"), ("s31", "s3", "text 1")]
    assert os.path.exists(f"{folder}.journal/docs.json") and held(spark, folder) == want
    index.ingest(folder, "docs", chunks(spark, ("m", "s9", 0, "more")))
    assert held(spark, folder) == sorted([*want, ("m", "s9", "more")]) and not os.path.exists(f"{folder}.journal/docs.json")
    assert sorted(r.chunk_id for r in index.postings(spark, folder, "docs").select("chunk_id").distinct().collect()) == ["m", "n1", "n2", "s30", "s31"]


def test_a_broken_index_is_not_overwritten(spark, tmp_path):
    folder = tmp_path / "index"
    index.ingest(str(folder), "docs", chunks(spark, ("a", "s1", 0, "x")))
    (bucket,) = (folder / "collection=docs").iterdir()
    for f in bucket.iterdir():
        f.unlink()
    (bucket / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        index.ingest(str(folder), "docs", chunks(spark, ("b", "s1", 0, "y")))
    assert (bucket / "part-0.parquet").read_text() == "no parquet"


def test_facts_of_a_collection(spark, tmp_path):
    folder = str(tmp_path / "index")
    index.ingest(folder, "docs", chunks(spark, ("a", None, 0, "x")).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))), buckets=3)
    with open(f"{folder}.collections/docs.json") as f:
        assert json.load(f) == {"buckets": 3, "postings": False, "dim": 2}
    assert index.postings(spark, folder, "docs") is None and index.dimension(spark, folder, "none") is None
    index.ingest(folder, "docs", chunks(spark, ("b", None, 0, "y")).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))))
    # null sources do not meet each other as sources; ids do.
    assert sorted(r.chunk_id for r in index.open_collection(spark, folder, "docs").collect()) == ["a", "b"]


def test_postings_give_the_same_scores(spark, tmp_path):
    """bm25 from kept postings and from texts, before and after an ingest; with postings no pattern is looked for in texts."""
    folder = str(tmp_path / "index")
    words = "red blue green seven nine data model query index text".split()
    body = lambda k, n: " ".join(words[(k * 7 + j * j) % 10] for j in range(n))
    first = [(f"c{k}", f"s{k % 4}", k, body(k, 20 + k)) for k in range(24)] + [("empty", "s9", 0, "! ?")]
    index.ingest(folder, "docs", chunks(spark, *first), keep_postings=True)

    def scores():
        rows = index.open_collection(spark, folder, "docs")
        asked = spark.createDataFrame([(1, "red model model"), (2, "nothing here"), (3, "index of data")], "query_id int, query_text string")
        candidates = rows.crossJoin(asked).withColumn("cand_pos", F.abs(F.xxhash64("chunk_id")))
        kept = retrieval.bm25(candidates, postings=index.postings(spark, folder, "docs"))
        plain = retrieval.bm25(candidates)
        view = lambda df: sorted((r.query_id, r.chunk_id, round(r.bm25_raw, 9)) for r in df.collect())
        assert view(kept) == view(plain) and any(x for *_, x in view(kept))
        return view(kept)

    before = scores()
    index.ingest(folder, "docs", chunks(spark, *[(f"d{k}", "s1", k, body(k + 3, 30)) for k in range(5)]))
    assert scores() != before
    flat = index.postings(spark, folder, "docs")
    want = retrieval.token_postings(index.open_collection(spark, folder, "docs"))
    assert sorted(map(str, flat.select("chunk_id", "token", "tf", "size").collect())) == sorted(map(str, want.select("chunk_id", "token", "tf", "size").collect()))
    assert "regexp" not in flat._jdf.queryExecution().optimizedPlan().toString().replace("regexp_extract(_metadata", "")


def test_scopes_of_stored_tables(spark):
    outer = storage.stored(spark.range(5), "outer")
    with storage.scope(spark):
        inner = storage.stored(spark.range(7), "inner")
        assert inner.count() == 7
    assert outer.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        inner.collect()
