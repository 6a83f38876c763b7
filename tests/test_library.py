"""The library's functions and operators against plain Python statements of their rules."""

import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge import sinks
from folioforge.functions import structured, text
from folioforge.operators import chunking, dialogue, index, retrieval
from folioforge.sources import readers


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_whitespace_and_artifacts(spark):
    assert values(spark, text.normalize_whitespace, ["a\xa0 \tb\n\n\n\nc  ", "", " \n "]) == ["a b\n\nc", "", ""]
    assert values(spark, text.fix_pdf_artifacts, ["exam-\nple", "a b c", "a b cd", "x , y !", "go a b c d end"]) == ["example", "abc", "a b cd", "x, y!", "go abcd end"]


def test_substitution(spark):
    assert values(spark, text.decode_substitution, ["2024", "http://A1B2", "a/2024", "hello ABC", ""]) == ["в0в4".translate(str.maketrans("04", "ад")), "http://A1B2", "a/2024", "hello сту", ""]


def test_sentences_and_chunks(spark):
    assert values(spark, text.split_sentences, ["One. Two! Three?", "a\n\nb", ""]) == [["One.", "Two!", "Three?"], ["a", "b"], []]
    got = values(spark, lambda c: chunking.chunk_text(c, 50, 10), ["First sentence here. Second sentence here. Third sentence here.", "", "Just one."])
    assert got[1] == [] and got[2] == ["Just one."] and len(got[0]) > 1 and got[0][1].startswith("ence here.")
    assert values(spark, lambda c: chunking.chunk_text(c, 10, 2), ["x" * 25])[0] == ["x" * 10, "x" * 10, "x" * 9, "x"]
    for size, overlap in ((0, 0), (10, 10)):
        with pytest.raises(ValueError):
            chunking.chunk_text(F.lit(""), size, overlap)


def test_uuid5(spark):
    names = ["a:0:x", "ключ:1:ё", ""]
    assert values(spark, chunking.uuid5, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_low_signal(spark):
    toc = "Chapter one ........ 12\nChapter two ........ 40\n" + "x" * 120
    assert values(spark, text.low_signal, ["short", toc, "1\n2\n3\n" + "word " * 40, "word " * 60]) == [True, True, True, False]


def test_stems_and_cuts(spark):
    assert values(spark, text.stem, ["running", "моделями", "cats", "ёлка"]) == ["runn", "модел", "cats", "елка"]
    assert values(spark, lambda c: text.shorten(c, 10), ["short", "a longer text than ten"]) == ["short", "a longe..."]
    assert values(spark, lambda c: text.short_text(c, 8), ["abc defghij", "abcdefghijk"]) == ["abc", "abcdefgh"]
    assert values(spark, text.to_float, ["12,5%", "x", "3"]) == [0.125, 0.0, 3.0]
    assert values(spark, text.normalize_tone, [" Science ", "научно"]) == ["scientific", "scientific"]


def test_structured(spark):
    raw = ['{"a": 1}', "```json\n{'a': 2,}\n```", 'Sure: {"a": 3} ok', "none", ""]
    assert [r and r["a"] for r in values(spark, lambda c: structured.parsed(c, "a int"), raw)] == [1, 2, 3, None, None]
    cards = spark.sql("SELECT array(named_struct('question', ' q ', 'answer', 'a'), named_struct('question', '', 'answer', 'a')) AS c, array(named_struct('question', 'q', 'options', array('x', ' ', 'y'), 'correct_index', '7', 'explanation', null)) AS t, array('1', 'x', '9', '1', '2') AS ids, array('i', 'j') AS base, array(array('j', 'k')) AS more")
    row = cards.select(structured.sanitized_cards(F.col("c")).alias("c"), structured.sanitized_tests(F.col("t")).alias("t"), structured.int_ids(F.col("ids"), F.lit(3)).alias("ids"), structured.merged_insights(F.col("base"), F.col("more")).alias("m")).first()
    assert [x["question"] for x in row["c"]] == ["q"] and row["t"][0]["correct_index"] == 0 and row["t"][0]["options"] == ["x", "y"]
    assert row["ids"] == [1, 2] and row["m"] == ["i", "j", "k"]


def test_dialogue(spark):
    raw = "\n".join(f"Speaker {1 + i % 2}: line {i}" for i in range(6))
    assert values(spark, dialogue.normalized, [raw, "Speaker 1: x"])[0].startswith("Ведущий 1: line 0\nВедущий 2: line 1")
    assert values(spark, dialogue.low_quality, ["Ведущий 1: a\n" * 7]) == [True]


def test_single_candidate_is_dropped(spark):
    rows = spark.createDataFrame([(1, "s", 0, "word " * 60, [1.0, 0.0])], "chunk_id long, source_name string, chunk_index int, text string, embedding array<float>")
    asked = spark.createDataFrame([(0, "word", [1.0, 0.5])], "query_id int, query_text string, query_vector array<float>")
    assert retrieval.retrieve(rows, asked).count() == 0
    assert retrieval.retrieve(rows, asked, min_score=0.0).count() == 1


def test_candidates_of_many_queries(spark):
    """Each query's nearest rows against a loop; equal scores by chunk_id, no row without a vector, a zero vector has score 0."""
    vectors = {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [0.0, 0.0], 4: None, 5: [2.0, 0.0], 6: [-1.0, 0.5]}
    rows = spark.createDataFrame([(i, "s", 0, f"text {i}", v) for i, v in vectors.items()], "chunk_id long, source_name string, chunk_index int, text string, embedding array<double>")
    asked = {10: [1.0, 0.0], 11: [0.0, 3.0]}
    queries = spark.createDataFrame([(q, "words", v) for q, v in asked.items()], "query_id long, query_text string, query_vector array<double>")
    got = {(r.query_id, r.cand_pos): (r.chunk_id, r.dense_score_raw, r.text) for r in retrieval.dense_candidates(rows, queries, 3).collect()}
    want = {}
    for q, a in asked.items():
        size = lambda v: sum(x * x for x in v) ** 0.5
        near = sorted((-round(sum(x * y for x, y in zip(a, v, strict=True)) / (size(a) * size(v)), 9) if size(v) else 0.0, i) for i, v in vectors.items() if v)
        want |= {(q, n + 1): (i, -s, f"text {i}") for n, (s, i) in enumerate(near[:3])}
    assert got == want
    assert retrieval.dense_candidates(rows.limit(0), queries).count() == 0 and retrieval.dense_candidates(rows, queries.limit(0)).count() == 0


def test_replace_by_source(spark, tmp_path):
    schema = "chunk_id string, source_name string, chunk_index int, text string"
    old = spark.createDataFrame([("a", "s1", 0, "x"), ("b", "s2", 0, "y"), ("c", "s3", 0, "z")], schema)
    new = spark.createDataFrame([("d", "s1", 0, "n"), ("c", "s4", 1, "w")], schema)
    assert sorted((r.chunk_id, r.source_name) for r in index.replace_by_source(old, new).collect()) == [("b", "s2"), ("c", "s4"), ("d", "s1")]
    assert index.replace_by_source(old, new.limit(0)).count() == 3
    folder = str(tmp_path / "index")
    index.ingest(folder, "docs", old)
    assert index.ingest(folder, "docs", new)["inserted_chunks"] == 2
    # as above: c has moved from s3 to s4, and an id is written once
    held = lambda: sorted((r.chunk_id, r.source_name) for r in spark.read.parquet(folder).collect())
    assert held() == [("b", "s2"), ("c", "s4"), ("d", "s1")]
    index.ingest(folder, "docs", new.limit(0))
    assert len(held()) == 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.md").write_text("no")
    got = {r.path.rsplit("/")[-1]: r.text for r in readers.read_documents(readers.collect_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "plain text", "b.docx": "One\nTwo"}
    assert readers.parsed_html_text("<nav><div>x</div></nav><p>a &amp; b</p><script>t='</p>'</script>c") == "a & b\nc"


def test_sinks():
    assert sinks.table_csv(["a", "b"], [["1", 'x"y']]) == 'a,b\r\n1,"x""y"\r\n'
    for data in (sinks.table_xlsx("t", ["a"], [["<1>"]]), sinks.slides_pptx("t", [("s", ["b"])])):
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    assert sinks.wav([[0.0, 1.0, -2.0]])[:4] == b"RIFF" and "</script>x" not in sinks.graph_html("t", [{"id": "</script>x"}], [])


def test_stream(spark, tmp_path):
    from folioforge.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("A sentence. Another one.")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), "docs", str(tmp_path / "ck"))
    ingest_stream(*args).awaitTermination(120)
    (tmp_path / "in/b.txt").write_text("More text.")
    ingest_stream(*args).awaitTermination(120)
    assert sorted(r.source_name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.txt", "b.txt"]


def test_entry():
    import __spark_entry__ as e

    assert "hybrid_retrieve" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_more_queries_than_are_sent_at_once(spark, monkeypatch):
    index = spark.createDataFrame([(i, f"src{i % 2}", 0, f"text {i}", [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id long, source_name string, chunk_index int, text string, embedding array<float>")
    queries = spark.createDataFrame([(i, f"query {i}", [float(i % 3), 1.0, float(i % 4)]) for i in range(23)], "query_id long, query_text string, query_vector array<float>")
    found = lambda: sorted(map(tuple, retrieval.dense_candidates(index, queries, 5, "src1").collect()))
    want = found()
    monkeypatch.setattr(retrieval, "MOST_QUERY_BYTES", 10 * 3 * 8)
    assert len(want) == 23 * 5 and found() == want


def test_study_context_at_the_reference_budget(spark, tmp_path):
    """About 5,000 characters are packed whole; of 30,000, what fits 18,000."""
    from folioforge.plans import catalog

    sentence = "This is a sentence of some forty letters. "
    spark.createDataFrame([(1, "a", sentence * 120), (2, "a", sentence * 720)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.context for r in catalog.QUERIES["study_context_pack_whole"](spark, str(tmp_path)).collect()}
    assert len(got[1]) > 5000 and 16_000 < len(got[2]) <= 18_000 and "18000" in catalog.ORACLES["study_context_pack_whole"]
