"""The corpus pipeline as a whole, and each of its stages on the one before it, against plain loops."""

import hashlib
import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from folioforge.llm import quality, secrets  # noqa: E402

FROM = "/root/testdata/sf0.01"
WORDS = re.compile("[^ \t-\r]+")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(docs):
    """The document of the least id in each group of those that are linked from a similarity of 0.8."""
    sets = [shingles(d["text"]) for d in docs]
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, d in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d["doc_id"]), d["doc_id"])
    return [d for i, d in enumerate(docs) if least[root(i)] == d["doc_id"]]


def mixture(docs):
    """Read each source through in the order of its keys until its target is met."""
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len(WORDS.findall(d["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, stopped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    out = []
    for s in order:
        target = int(3 * sizes[s] if s in stopped else level * weight[s])
        mine = sorted((d for d in docs if d["source"] == s and WORDS.search(d["text"] or "")), key=lambda d: hashlib.md5(str(d["doc_id"]).encode()).hexdigest())
        left = target
        while left > 0 and mine:
            for d in mine:
                found = WORDS.findall(d["text"])
                if left >= len(found):
                    out.append((d["doc_id"], d["text"]))
                elif left > 0:
                    out.append((d["doc_id"], " ".join(found[:left])))
                left -= len(found)
                if left <= 0:
                    break
    return out


def test_stages_and_whole(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{FROM}/documents.parquet").filter("doc_id < 500").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FROM}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "bpe"]
    plain = lambda df: sorted((r.doc_id, r.text or "", r.source, r.lang) for r in df.collect())
    want = lambda rows: sorted((d["doc_id"], d["text"] or "", d["source"], d["lang"]) for d in rows)

    model = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [d for d in rows if model.score(d["text"] or "") >= quality.THRESHOLD]
    at = stages["quality"](spark, docs, folder)
    assert plain(at) == want(good) and 0 < len(good) < len(rows)

    single = one_of_each(good)
    at = stages["near_duplicates"](spark, at, folder)
    assert plain(at) == want(single) and len(single) < len(good)

    clean = [d | {"text": secrets.redacted(d["text"] or "")} for d in single]
    at = stages["secrets"](spark, at, folder)
    assert plain(at) == want(clean) and sum(a["text"] != b["text"] for a, b in zip(single, clean, strict=True)) > 0

    read = mixture(clean)
    at = stages["mixing"](spark, at, folder)
    assert sorted((r.doc_id, r.text) for r in at.collect()) == sorted(read) and len(read) > len({d for d, _ in read})

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted((d, t.encode(x, add_special_tokens=False).ids) for d, x in read)
    assert sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == ids
