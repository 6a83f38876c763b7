"""Brute-force versions of the fingerprint and of the classifier's fit, clashing names, and very long texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from folioforge.llm import common, encoding, neardup, ordermin, quality, secrets, terms, token_counts, training_order  # noqa: E402

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
WIDE = 1 << 64


def finalised(v: int) -> int:
    v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 % WIDE
    v = (v ^ v >> 27) * 0x94D049BB133111EB % WIDE
    return v ^ v >> 31


def plain_fingerprint(text: str) -> list[int]:
    """Order MinHash by loops: of the numbered k-mers of each hash function the two least, in the order of the text."""
    if not text:
        return [0] * ordermin.TUPLES
    p = [int(x) for x in ordermin._P]

    def gram(s: str) -> int:  # by halves, as adjacent k-mers share them
        if len(s) == 1:
            return (ord(s) + 1) * p[0] % WIDE
        half = len(s) // 2
        return (gram(s[:half]) * p[{1: 1, 2: 2, 4: 3}[half]] + gram(s[half:])) % WIDE

    if len(text) >= ordermin.K:
        grams = [finalised(gram(text[i : i + ordermin.K])) for i in range(len(text) - ordermin.K + 1)]
    else:
        grams = [finalised(sum(finalised(gram(c)) * (i + 2) for i, c in enumerate(text)) % WIDE)]
    grams = [g >> 24 << 24 for g in grams]
    seen, numbered = Counter(), []
    for place, g in enumerate(grams):
        numbered.append((g, finalised((g + seen[g] * p[1]) % WIDE) >> 32, place))
        seen[g] += 1
    numbered.sort(key=lambda x: (x[0], x[2]))
    out = []
    for times, plus in zip(ordermin._TIMES[:, 0].tolist(), ordermin._PLUS[:, 0].tolist(), strict=True):
        ranked = sorted(((element * times + plus) % (1 << 32), i) for i, (_, element, _) in enumerate(numbered))
        two = [numbered[i] for _, i in (ranked * 2)[:2]]  # a single k-mer counts twice
        a, b = sorted(two, key=lambda x: x[2])
        out.append(finalised((a[0] * p[2] + finalised((b[0] + p[3]) % WIDE)) % WIDE) >> 48)
    return out


def test_fingerprints_against_loops(spark):
    r = np.random.default_rng(12)
    texts = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaa", "abababababababababab", "é漢字かな ไทย 👩‍💻 x", *("".join(r.choice(list("ab c"), n)) for n in (30, 200)), " ".join(f"w{i % 40}" for i in range(900))]
    want = [plain_fingerprint(t) for t in texts]
    assert [ordermin.fingerprint(t).tolist() for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shown = lambda f: "".join(f"{x:04x}" for x in f)
    alike = lambda f, g: sum(a == b for a, b in zip(f, g, strict=True)) / len(f)
    for row in ordermin.fingerprints(df).collect():
        k = row.doc_id
        after = texts[(k + 1) % len(texts)]
        q = len(texts[k]) // 4
        changed = texts[k][: len(texts[k]) - q] + after[:q]
        f, g = want[k], plain_fingerprint(changed)
        assert (row.fingerprint, row.edited_fingerprint, row.edited_sha256) == (shown(f), shown(g), hashlib.sha256(changed.encode()).hexdigest())
        assert row.near_edited == alike(f, g) and row.near_next == alike(f, plain_fingerprint(after))


def test_fingerprints_of_either_way_to_sort(monkeypatch):
    """Beyond 2 ** 24 k-mers another sort is taken; with fewer free bits it is taken for short texts, and gives the same."""
    text = " ".join(f"w{i % 977}" for i in range(20_000))
    want = ordermin.numbered(text)
    monkeypatch.setattr(ordermin, "MOST_PACKED", 5)
    assert all(np.array_equal(x, y) for x, y in zip(ordermin.numbered(text), want, strict=True))


def test_dual_descent_against_loops():
    """The dual of the hinge loss, by plain coordinate descent over dense vectors until nothing moves."""
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 60, 12)).astype(np.int32) for _ in range(40)]
    y = np.array([int((x < 25).sum() > 5) for x in rows])
    values = [np.ones(len(x)) / np.sqrt(len(x)) for x in rows]
    w, bias = quality.dual_descent(rows, values, y, rounds=3000)
    dense = np.zeros((40, 61))
    for i, x in enumerate(rows):
        dense[i, x], dense[i, 60] = values[i], 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    upper = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    a = np.zeros(40)
    for _ in range(3000):
        for i in range(40):
            v = (a * sign) @ dense
            a[i] = min(max(a[i] - (sign[i] * (dense[i] @ v) - 1) / (dense[i] @ dense[i]), 0), upper[i])
    v = (a * sign) @ dense
    objective = lambda u: u @ u / 2 + (upper * np.maximum(0, 1 - sign * (dense @ u))).sum()
    got = np.concatenate([w[:60], [bias]])
    assert abs(objective(got) - objective(v)) < 0.02 * objective(v)
    ratios = quality.log_ratios(rows, y)
    n = [sum(np.isin(k, x).all() for x, c in zip(rows, y) if c) + 1 for k in range(60)], [sum(np.isin(k, x).all() for x, c in zip(rows, y) if not c) + 1 for k in range(60)]
    size = [sum(map(len, (x for x, c in zip(rows, y) if c == side))) + quality.PLACES for side in (1, 0)]
    assert np.allclose(ratios[:60], np.log((np.array(n[0]) / size[0]) / (np.array(n[1]) / size[1])), atol=1e-5)


def test_clashing_names(spark):
    names = "doc_id long, text string, likely_good double, gone_id long, GONE_ID_ string, unnamed string, quality int"
    df = spark.createDataFrame([(1, "one two three four five six", 0.1, 1, "x", "u", 5), (2, "one two three four five six", 0.2, 2, "y", "v", 6), (None, None, None, None, None, None, None)], names)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert sorted(map(str, quality.accepted(df, labels).collect())) == sorted(map(str, df.collect()))
        assert sorted(map(str, neardup.deduplicated(df).collect())) == sorted(map(str, df.filter("doc_id = 1 OR doc_id IS NULL").collect()))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert quality.accepted(df.limit(0), labels).count() == 0 and neardup.deduplicated(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Over 300 KB: whole texts go through, to their last word."""
    words = [f"word{i * 7919 % 5000}" for i in range(40_000)]
    long, other = " ".join(words), " ".join([*words[:-3], "an", "other", "end"])
    secret = long + ' api_key = "Zx81kQmm2p99Ab" '
    df = spark.createDataFrame([(1, long), (2, other), (3, secret), (4, "x" * 300_000)], "doc_id long, text string")
    t, b = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in encoding.encode(df, WORD).collect():
        assert list(r.ids) == t.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, BYTE).collect()} == {d: len(b.encode(x, add_special_tokens=False).ids) for d, x in texts.items()}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.n_assign for r in secrets.scan(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    prints = {r.doc_id: r for r in ordermin.fingerprints(df).collect()}
    assert prints[1].n_chars == len(long) and prints[1].near_next > 0.9
    assert sum(r.n_tokens for r in training_order.training_order(df, RANKS).collect()) == 4 + sum(len(b.encode(x, add_special_tokens=False).ids) for x in texts.values())


def test_many_followers_and_hot_buckets(spark, monkeypatch):
    """Small chunks, tiles and salts give the same groups."""
    r = np.random.default_rng(14)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(120):
        w = list(base)
        for at in r.choice(60, r.integers(0, 3), replace=False):
            w[at] = f"x{r.integers(0, 5)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, neardup.near_duplicates(df).collect()))
    monkeypatch.setattr(neardup, "CHUNK", 4)
    monkeypatch.setattr(neardup, "LED", 3)
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == want


def test_stored_tables_can_be_cleared(spark):
    import os

    path = common.stored(spark.range(3), "some").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and common.clear(spark) > 0 and not os.path.exists(path)


def test_long_hot_terms_are_sent_not_joined(spark, monkeypatch):
    """A long separator that every document has is in the dictionary; terms beyond its bytes are not, and counts are the same."""
    from tokenizers import Tokenizer

    line = "-" * 300
    rows = [(k, f"{line} word{k % 7} {line}\n" + "\u00e9" * (k % 5) + "z" * 5000 * (k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = token_counts.piece_counts(df, BYTE)
    hot = terms.hottest(table, "pieces")
    assert any(t.strip().startswith("-" * 100) for t in hot) and len(hot) == table.count()
    t = Tokenizer.from_file(BYTE)
    want = sorted((k, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for k, x in rows)
    for most in (terms.HOT_BYTES, 1600):
        monkeypatch.setattr(terms, "HOT_BYTES", most)
        assert sum(len(x.encode()) for x in terms.hottest(table, "pieces")) <= most
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, BYTE).collect()) == want
    assert len(terms.hottest(table, "pieces")) < len(hot)
