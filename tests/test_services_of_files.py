"""Mind maps, tables and podcasts of uploads, decks of queries, descriptions by a model, strict answers."""

import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge import api
from folioforge.functions import structured
from folioforge.operators import concepts, generate
from folioforge.operators.generate import Backends

TEXT = "Модель данных хранит индекс. Индекс данных ищет запрос. Запрос читает индекс данных. Модель отвечает на запрос. Слова разные. Конец близок."


def docx(path, *lines):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:body></w:document>")
    return path.read_bytes()


def uploads(spark, *rows):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "file_name string, content binary")


def test_mind_maps_of_files(spark, tmp_path):
    got = {r.file_name: r for r in api.file_mind_maps(uploads(spark, ("a.b.txt", TEXT.encode()), ("c.DOCX", docx(tmp_path / "c.docx", "Слово одно.", "Другое дело.")), ("d.txt", b"1 2 3"))).collect()}
    a = got["a.b.txt"]
    assert a.meta.nodes_count == len(a.nodes) > 1 and a.meta.edges_count == len(a.edges) > 0 and a.meta.top_terms == [n.id for n in a.nodes[:6]] and a.meta.source == "file"
    assert got["c.DOCX"].nodes == [] and got["c.DOCX"].meta.summary == "Ключевые понятия в тексте не определены." and got["d.txt"].meta.summary == ""
    for bad, what in (("x.md", "unsupported"), ("y.txt", "no text")):
        with pytest.raises(Exception, match=what):
            api.file_mind_maps(uploads(spark, (bad, b" "))).collect()


def test_tables_of_files(spark, tmp_path):
    got = {r.file_name: r for r in api.file_tables(uploads(spark, ("t.txt", b"name: Ann\nage: 5"), ("", b"city: Rome"), ("d.docx", docx(tmp_path / "d.docx", "a: b"))), "csv").collect()}
    assert bytes(got["t.txt"].file).decode().split() == ["name,value", "name,Ann", "age,5"] and b"Rome" in bytes(got[""].file) and b"a,b" in bytes(got["d.docx"].file)


def test_podcasts_of_files(spark):
    lines = "\n".join(f"Ведущий {1 + k % 2}: реплика номер {k}" for k in range(8))
    backends = Backends(text=lambda prompts: [lines for _ in prompts])
    asked = []

    def voices(speaker, text):
        asked.append(speaker)
        return [0.5] * 10 if speaker == "aidar" else [0.25] * 10

    rows = uploads(spark, ("p.txt", ("Предложение о данных и модели. " * 9).encode()))
    r = api.file_podcasts(rows, backends, "aidar", "eugene", voices, tone="научно").first()
    assert r.dialogue == lines and r.has_audio and bytes(r.audio)[:4] == b"RIFF" and r.meta.speakers == ["aidar", "eugene"] and r.source == "file"
    quiet = api.file_podcasts(rows, backends).first()
    assert not quiet.has_audio and quiet.meta.speakers == ["baya", "xenia"]
    assert api.speakers() == ["aidar", "baya", "eugene", "kseniya", "xenia"]
    with pytest.raises(ValueError, match="speaker"):
        api.file_podcasts(rows, backends, "nobody")


def test_decks_of_queries(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}.txt").write_text(f"Document number {i} tells about topic{i} and nothing else. " * 4)
    s = api.Settings(str(tmp_path / "store"))
    api.ingest(spark, s, [f"{tmp_path}/f{i}.txt" for i in range(4)])
    queries = spark.createDataFrame([(1, "what about topic3"), (2, "topic1 please")], "query_id int, query_text string")
    got = {r.query_id: r for r in api.presentations_of(spark, s, queries, min_score=0.9, top_k=1).collect()}
    assert got[1].plan.slides[0].title == "f3.txt" and bytes(got[2].file)[:2] == b"PK" and got[1].slides_count == 2
    none = api.presentations_of(spark, s, queries, min_score=0.0, source_name="nowhere").collect()
    assert [(r.slides_count, r.file) for r in none] == [(0, None)] * 2
    # A reranker turns the order round; it is asked once a query.
    last = lambda q, texts: [(len(texts) - 1, 1.0)]
    first = {r.query_id: r.source_name for r in api.retrieve(spark, s, queries, min_score=0.0, rerank=last).filter("rank = 1").collect()}
    assert set(first) == {1, 2}


def test_descriptions_by_a_model(spark):
    docs = spark.createDataFrame([(k, TEXT) for k in range(1, 6)] + [(9, "Слово. Дело.")], "doc_id int, text string")
    g = concepts.graph(docs)
    terms = [r.term for r in g.nodes.filter("doc_id = 1").orderBy("place").collect()]
    prompts = {r.doc_id: r.prompt for r in concepts.description_prompts(g).collect()}
    assert set(prompts) == {1, 2, 3, 4, 5} and re.findall("(?m)^- ([^:]+):", prompts[1]) == terms
    assert max(len(x) for x in prompts[1].splitlines()) <= 400 + max(map(len, terms)) + 4
    good = json.dumps({t: f"about {t}" for t in terms[1:]} | {terms[1]: 7}, ensure_ascii=False)
    said = {1: good, 2: f"```json\n{good}\n```", 3: "no JSON: " + good, 4: "[1, 2]", 5: None}
    answers = spark.createDataFrame([(k, v) for k, v in said.items() if v], "doc_id int, answer string")
    got = {}
    for r in concepts.descriptions(g, answers).collect():
        got.setdefault(r.doc_id, {})[r.term] = r.summary
    plain = {r.term: r.summary for r in concepts.descriptions(g).filter("doc_id = 1").collect()}
    want = {t: f"about {t}" for t in terms} | {terms[0]: concepts.LABEL + terms[0], terms[1]: "7"}
    assert got[1] == got[2] == want and got[3] == got[4] == got[5] == plain

    def model(batch):
        assert len(batch) == 1
        if "разные" in batch[0]:
            raise OSError
        return [good]

    maps = {r.doc_id: json.loads(r.graph) for r in api.mind_maps(docs, backends=Backends(text=model, tries=1)).collect()}
    assert {n["id"]: n["summary"] for n in maps[1]["nodes"]} == want and maps[9] == {"nodes": [], "edges": [], "meta": {"summary": "Ключевые понятия в тексте не определены.", "top_terms": []}}

    def fails(batch):
        raise OSError

    maps = {r.doc_id: json.loads(r.graph) for r in api.mind_maps(docs, backends=Backends(text=fails, tries=1)).collect()}
    assert {n["id"]: n["summary"] for n in maps[1]["nodes"]} == plain


def whole_by_hand(t):
    try:
        return json.loads(t)
    except ValueError:
        return None


def unfenced(t):
    t = t.strip()
    if t.startswith("```"):
        t = t[3:]
        t = t[4:] if t.startswith("json") else t
        t = t.lstrip()
        if t.rstrip().endswith("```"):
            t = t.rstrip()[:-3].rstrip()
    return t


def between(t):
    a, b = t.find("{"), t.rfind("}")
    return t[a : b + 1] if 0 <= a < b else None


ANSWERS = [
    '{"title": "a"}', ' {"title": "a"} ', '```json\n{"title": "a"}\n```', '```\n{"title": "a"}```', 'Here: {"title": "a"} so', '[{"title": "a"}]', '{"title": "a",}', "{'title': 'a'}", "", "none", '{"title": "a"} {"title": "b"}',
    'x ```json\n{"title": "a"}\n``` y {"title": "b"}', '{"title": "a"}]', '{"title": "a"}}', '{"title": "a"}, "y": 2', "```json\n[1]\n```", '"{}"', "7", '{"title": {"b": "c"}}', "```json\n{\"title\": \"a\"}", "{", "}{", 'text } {"title": "q"}',
]


def test_strict_answers(spark):
    """Which answers count, for tables, card packs and descriptions, against a plain statement of each rule."""
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, a string")
    kinds = {"table": structured.table_object, "cards": structured.cards_object, "alone": structured.object_alone}
    got = {r.i: r for r in rows.select("i", *(F.to_json(f(F.col("a"), "title string")).alias(k) for k, f in kinds.items())).collect()}
    for i, t in enumerate(ANSWERS):
        alone = whole_by_hand(unfenced(t))
        table = alone if alone is not None else whole_by_hand(between(unfenced(t)) or "")
        inner = t.strip().split("```")
        fence = next((x for x in (p[4:].strip() if p.startswith("json") else p.strip() for p in inner[1::2][: len(inner) // 2]) if x.startswith("{") and x.endswith("}")), None) if len(inner) > 2 else None
        body = fence if fence else t.strip()
        cards = whole_by_hand(body if body.startswith("{") else between(body) or body)
        for name, want in (("alone", alone), ("table", table), ("cards", cards)):
            assert (got[i][name] is not None) == isinstance(want, dict), (name, t, got[i][name], want)
            if isinstance(want, dict) and isinstance(want.get("title"), str):
                assert json.loads(got[i][name])["title"] == want["title"], (name, t)


def test_answers_that_are_no_tables(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id int, text string")
    for answer in ('[["a"]]', "none", '{"columns": ["a"], "rows": [["1"]],}'):
        with pytest.raises(Exception, match="no columns"):
            generate.extract_table(docs, backends=Backends(text=lambda p: [answer] * len(p), tries=1)).collect()  # noqa: B023
        with pytest.raises(Exception, match="no JSON object"):
            generate.flash_materials(docs, backends=Backends(text=lambda p: [answer] * len(p), tries=1)).collect()  # noqa: B023


def test_retrieval_with_kept_postings(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.txt").write_text(f"Document number {i} tells about topic{i} and topic{(i + 1) % 5} only. " * 4)
    queries = spark.createDataFrame([(1, "what about topic3"), (2, "topic1 please")], "query_id int, query_text string")
    found = []
    for keep in (False, True):
        s = api.Settings(str(tmp_path / f"store-{keep}"), keep_postings=keep)
        api.ingest(spark, s, [f"{tmp_path}/f{i}.txt" for i in range(5)])
        assert (api.index.postings(spark, s.folder, "docs") is not None) == keep
        found.append(sorted((r.query_id, r["rank"], r.source_name, r.score) for r in api.retrieve(spark, s, queries, min_score=0.0).collect()))
    assert found[0] == found[1] and len(found[0]) == 10
