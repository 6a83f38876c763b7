"""Operators 11 to 13: units and outputs, ranked search and language prediction against plain versions on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import fill_middle, language, lexical, queries

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "   \n\t ", "one", "one two three four", "one two three four", "a<P>b", "ends <S>", "😀a😀😀bc\n\nd́é", "É È ΑΣ İß \x1c a\x85b　c", "x" * 3000 + " " + "ab7" * 900,
    " ".join(f"w{i % 50}" for i in range(4000)), "漢字かな ไทย", "<S<M", "<", "1234 5678", "One one ONE two",
]
NAMED = "doc_id long, text string, lang string, source string, n int, score double, output string, parts int, block int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "a") for i, t in enumerate(ODD)] + [(3, "one", "en", "a"), (None, "no id here one", "en", "c")]
    return spark.createDataFrame([(*r, -1, 0.5, "x", 7, 9) for r in rows], NAMED)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def middle_by_hand(doc_id, text, units):
    """A text's units one after the other, and the output put together from them."""
    text, u = text or "", []
    for ch in text:
        joins = u and any(re.fullmatch(f"[{r}]", u[-1][-1]) and re.fullmatch(f"[{r}]", ch) for r in units.runs)
        if units.closed_by:
            joins = u and not re.fullmatch(f"[{units.closed_by}]", u[-1][-1])
        if joins:
            u[-1] += ch
        else:
            u.append(ch)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", [fill_middle.WORDS, fill_middle.CHARACTERS, fill_middle.WORDS_AND_BLANKS, fill_middle.LINES])
def test_fill_in_middle(docs, real, units):
    for df in (docs, real, docs.limit(0)):
        want = [middle_by_hand(r.doc_id, r.text, units) for r in df.select("doc_id", "text").collect()]
        got = fill_middle.fill_in_middle(df, units)
        assert rows_of(got) == sorted(want, key=str)
        back = fill_middle.restored(got.select("doc_id", "output", "form"))
        assert back.columns == ["doc_id", "output", "form", "restored"]
        assert sorted((r.doc_id, r.restored) for r in back.collect() if r.doc_id is not None) == sorted((r.doc_id, r.text or "") for r in df.collect() if r.doc_id is not None)
    forms = Counter(r.form for r in fill_middle.fill_in_middle(real, units).collect())
    assert set(forms) == {"plain", "psm", "spm"}


def test_fill_in_middle_query_and_marks(spark, real):
    got = {r.doc_id: r for r in queries.op11_fill_in_middle(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in real.collect():
        d, n, form, p, m, _, out = middle_by_hand(r.doc_id, r.text, fill_middle.WORDS)
        size = lambda x: None if x is None else len(x)
        assert tuple(got[d]) == (d, n, form, size(p), size(m), sha(out), sha(r.text or ""))
    for bad in (("<a", "a>", "b"), ("x", "x", "y"), ("", "a", "b"), ("aba", "c", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fill_middle.checked_marks(bad)
    none = fill_middle.fill_in_middle(real, plain=100)
    assert none.filter("form <> 'plain'").count() == 0


def test_fill_in_middle_stays_in_the_jvm(real):
    plan = fill_middle.restored(fill_middle.fill_in_middle(real))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def search_by_hand(docs, items, top):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(k for _, _, k in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, k in counted:
            m = 100 - 25 + (25 * k * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def pairs(df, key="doc_id"):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_search(spark, docs, real, monkeypatch):
    items = spark.createDataFrame([(1, "one two", 5), (2, "One ONE w7 w8 w9", 5), (3, None, 5), (4, "...", 5), (5, "nowhere", 5), (None, "one", 5), (1, "one two", 5), (6, "漢字かな é x", 5)], "item_id long, text string, rank int")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for block in (64, 1, 3):
        monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
        for d, i, top in ((docs, items, 20), (docs, items, 3), (real, bench, 20), (docs.limit(0), items, 20), (docs, items.limit(0), 20)):
            got = lexical.ranked_search(d, i, top)
            assert rows_of(got) == search_by_hand(pairs(d), pairs(i, "item_id"), top)
            assert got.columns == ["item_id", "rank", "doc_id", "score"]
    # Several scans of the index for many queries, and ties that are cut.
    monkeypatch.setattr(lexical, "MOST_TERMS", 100)
    assert rows_of(lexical.ranked_search(real, bench)) == search_by_hand(pairs(real), pairs(bench, "item_id"), 20)
    same = spark.createDataFrame([(100 - k, "tie tie other") for k in range(60)] + [(k + 200, f"else {k}") for k in range(200)], "doc_id long, text string")
    tie = spark.createDataFrame([(1, "tie")], "item_id long, text string")
    assert rows_of(lexical.ranked_search(same.repartition(5), tie)) == search_by_hand(pairs(same), [(1, "tie")], 20)


def test_search_prunes(spark):
    """On blocks of unlike documents most (query, block) pairs are never scored, and the rest gives the same results."""
    r = np.random.default_rng(1)
    texts = [" ".join(f"t{k // 64}x{w}" for w in r.integers(0, 40, 30)) + " common " * int(r.integers(1, 4)) for k in range(64 * 40)]
    texts = [t + (f" t{(k // 64 + 1) % 40}x{k % 40}" if k % 9 == 0 else "") for k, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = [(q, f"common t{q}x1 t{q}x2 t{q}x3 t{q}x4 t{(q + 7) % 40}x1") for q in range(40)]
    index = lexical.block_index(df)
    assert index.count() == 40
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == search_by_hand(list(enumerate(texts)), items, 20)
    asked = lexical.Asked(0)
    for q, t in items:
        asked.add(q, lexical.terms_of(t))
    facts = lexical.statistics(index, asked)
    blocks = [b for g in lexical._groups(index.select(*lexical._SEARCHED).toArrow().to_batches(), asked.vocabulary(), facts) for b in g]
    scored = lexical.search_blocks(blocks, asked, [lexical.Best(0, 20) for _ in items])
    assert scored < 0.2 * len(blocks) * len(items)


def grams_by_hand(text):
    letters = "".join(c if re.match(r"[^\W\d_]", c) else " " for c in text.lower())
    letters = " " + " ".join(letters.split()) + " "
    if not letters.strip():
        return Counter()
    u = lambda x: x & 0xFFFFFFFF
    c = [u(ord(x) * 0x9E3779B1) for x in letters]
    two = [u((a ^ u((b >> 7) * 0x85EBCA6B)) * 0xC2B2AE35) for a, b in zip(c, c[1:], strict=False)]
    three = [u((a ^ u((b >> 5) * 0x27D4EB2F)) * 0x165667B1) for a, b in zip(two, c[2:], strict=False)]
    return Counter(x >> 19 for x in two + three)


def test_grams(real, monkeypatch):
    for size in (1 << 18, 7):
        monkeypatch.setattr(language, "_SLICE", size)
        for t in [t or "" for t in ODD] + [r.text or "" for r in real.limit(20).collect()]:
            at, n = language.grams(t)
            assert dict(zip(at.tolist(), n.tolist(), strict=True)) == dict(grams_by_hand(t))


def test_nearest_centroid_by_hand(spark, real):
    model = language.learn(real)
    per = Counter(model.languages)
    assert max(per.values()) <= language.CENTROIDS and sorted(per) == sorted({r.lang for r in real.collect() if r.lang})
    taught = {r.text for r in real.collect() if r.lang and r.text and (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 != 2)}
    df = Counter(g for t in taught for g in grams_by_hand(t))
    for r in language.label(real, model, rejecting=False).join(real.select("doc_id", "text", "lang"), "doc_id").collect():
        v = {g: (1 + math.log(n)) * (math.log((1 + len(taught)) / (1 + df[g])) + 1) for g, n in grams_by_hand(r.text or "").items()}
        if not v:
            assert (r.lang_pred, r.score, r.far) == ("und", 0.0, True)
            continue
        size = math.sqrt(sum(x * x for x in v.values()))
        like = [sum(x * c[g] for g, x in v.items()) / size for c in model.directions]
        best = defaultdict(float)
        for lang, x in zip(model.languages, like, strict=True):
            best[lang] = max(best[lang], x)
        assert abs(r.score - max(like)) < 1e-4 and best[r.lang_pred] > max(like) - 1e-4 and 0 <= r.score <= 1


def test_language_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d, rejecting=False).join(d.select("doc_id", "lang", F.length("text").alias("size")), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in got) > 0.98 * len(got) > 100
    # A text in letters that taught nothing is far from all of them.
    far = spark.createDataFrame([(1, "щёлк жгут фьючерс " * 20), (2, got[0].lang)], "doc_id long, text string")
    model = language.learn(d)
    assert [(r.lang_pred, r.far) for r in language.label(far, model).filter("doc_id = 1").collect()] == [("und", True)]
    assert [r.lang_pred for r in language.label(far, model, rejecting=False).filter("doc_id = 1").collect()][0] in model.languages


def test_language_cases(spark, docs):
    got = language.identify(docs, rejecting=False)
    rows = {(r.doc_id, r.lang_pred, r.score > 0) for r in got.collect()}
    assert got.count() == docs.count() and (0, "und", False) in rows and (1, "und", False) in rows and (15, "und", False) in rows and (4, "en", True) in rows
    assert language.identify(docs.limit(0)).count() == 0
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    # Copies count once, so a group of them is one text that teaches; the sample is bounded.
    many = docs.select("doc_id", "text", F.lit("x").alias("lang")).crossJoin(docs.sparkSession.range(30))
    assert language.taught(many).count() == language.taught(docs.withColumn("lang", F.lit("x"))).count()
    words = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("x").alias("lang"))
    assert 20 < language.taught(words, 50).count() < 100
    with pytest.raises(ValueError):
        language.taught(words.withColumn("lang", F.col("text")))


def test_centroids_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (language.learn(x) for x in (d, d.repartition(7)))
    assert a.languages == b.languages and np.array_equal(a.directions, b.directions) and np.array_equal(a.least, b.least)
