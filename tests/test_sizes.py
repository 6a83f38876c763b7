"""Work that grew faster than its input: each case ran for minutes, or differed, before."""

import time

from pyspark.sql import functions as F

from folioforge.functions.columns import bound
from folioforge.operators import generate
from folioforge.sources import readers


def plain_pack(text: str, cards: int, tests: int):
    import re

    sents = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", text[:18_000])) if len(s) >= 40][: max(cards, tests, 1)]
    made = [(s.replace(w, "____"), w) for s in sents for w in [max(s.split(), key=lambda w: (len(w), w))]]
    others = list(dict.fromkeys(a for _, a in made[:4]))[:3]
    quiz = [(q, o, o.index(a)) for q, a in made[: max(1, tests)] for o in [sorted({a, *others})] if len(o) >= 2]
    return made[: max(1, cards)], quiz


def test_a_pack_of_long_texts(spark):
    lines = [f"The sentence number {i} holds a word like wonderful{i % 3 * 'ly'}{i} somewhere in it{'.!?'[i % 3]}" for i in range(260)]
    texts = [" ".join(lines[k:] + lines[:k]) for k in range(48)] + ["", "Too short.", "One sentence of more than forty characters stands alone here."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    began = time.time()
    got = {r.doc_id: r.pack for r in generate.flash_materials(docs, 10, 10).collect()}
    assert time.time() - began < 60
    for k, t in enumerate(texts):
        cards, quiz = plain_pack(t, 10, 10)
        assert [(c.question, c.answer) for c in got[k].flashcards] == cards
        assert [(x.question, list(x.options), x.correct_index) for x in got[k].tests] == quiz


def test_a_bound_column_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(20).select(bound(counted("id"), lambda x: x + x * x + F.when(x > 3, x).otherwise(-x)).alias("y")).collect()
    assert [r.y for r in rows][:5] == [0, 1, 4, 9, 24] and seen.value == 20


def test_a_title_keeps_its_quotation_marks(spark):
    pages = spark.createDataFrame([("<title>token = &quot;0b96&quot; &amp;quot; &#39;x&#39; &lt;b&gt;</title>",)], "html string")
    assert pages.select(readers.html_title(F.col("html")).alias("t")).first().t == "token = \"0b96\" &quot; 'x' <b>"


def odd_documents():
    """Words of both scripts with every suffix, repeated and missing doc_ids, empty texts, one sentence without an end, equal counts."""
    from folioforge.functions.text import EN_SUFFIXES, RU_SUFFIXES

    stems = ["model", "модел", "abcd", "test7", "данн", "2024", "42", "it", "ёлк", "straße", "naïve", "hôtel", "x1"]
    words = [s + e + r for s in stems for e in ("", *EN_SUFFIXES) for r in ("", *RU_SUFFIXES)]
    said = lambda k, n, step: " ".join(words[(k + i * step) % len(words)] + (".", ",", "!\n", " ", "? ")[(i * 7 + k) % 5] for i in range(n))
    rows = [(k, said(k * 37, 60 + 40 * (k % 5), 1 + k % 3) * (1 + k % 3)) for k in range(40)]
    rows += [(40, " ".join(words[:200] * 3)), (41, ""), (42, None), (43, "One. Two three! the and"), (44, "Alpha beta. Alpha beta. Gamma delta. Gamma delta. "), (45, " \n\n . ! ?")]
    return [*rows, rows[3], rows[3], rows[7], (9, None), (None, "Alpha beta. Alpha beta."), (None, "Gamma.")]


def test_graphs_of_odd_documents_as_in_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(odd_documents(), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("concept_term_stats", "cooccurrence_edges", "graph_nodes", "graph_edges", "graph_summary", "concept_contexts", "graph_descriptions", "graph_edge_titles"):
        said = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in said.description]
        want = sorted(map(repr, said.fetchall()))
        assert want and sorted(repr(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).select(*(f"`{c}`" for c in columns)).collect()) == want, name


def test_graphs_need_no_windows(spark):
    from folioforge.operators import concepts

    docs = spark.createDataFrame([(k, "Alpha beta met gamma. Alpha and beta again. " * 3) for k in range(9)], "doc_id long, text string")
    g = concepts.graph(docs)
    for rows in (concepts.term_stats(concepts.documents(docs)), g.nodes, g.edges, concepts.summary(g), concepts.contexts(g), concepts.described(g)):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
