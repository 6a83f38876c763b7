"""The attention model against loops, numeric gradients, other partitionings, and itself without attention."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from folioforge.llm import attention, terms  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
W, D = attention.WINDOW, attention.WIDTH


def small_model(size: int = 700, seed: int = 3) -> attention.Model:
    r = np.random.default_rng(seed)
    return attention.fresh(r.integers(0, 50, size).astype(float), size - 1)


def window_logs(m: attention.Model, given: list[int], goal: list[int]) -> list[float]:
    """ln probability of each goal of one window, by loops in doubles."""
    p = {k: v.astype(float) for k, v in m.params.items()}
    out = []
    x = [p["E"][g] + p["P"][i] for i, g in enumerate(given)]
    q, k, v = ([row @ p["A"][:, n * D : n * D + D] for row in x] for n in range(3))
    for i, g in enumerate(goal):
        s = np.array([q[i] @ k[j] for j in range(i + 1)])
        a = np.exp(s - s.max())
        h = x[i] + (sum(w * v[j] for j, w in enumerate(a)) / a.sum()) @ p["O"]
        h[-1] = 1
        z = p["H"] @ h
        c = m.cluster[g]
        at = g if c == 0 else m.bounds[0] - 1 + c
        log = z[at] - np.log(np.exp(z).sum())
        if c:
            low, high = m.bounds[c - 1], m.bounds[c]
            z = p["T"][low:high] @ h
            log += z[g - low] - np.log(np.exp(z).sum())
        out.append(log)
    return out


def test_scores_against_loops():
    """Each subword counts once, in the first window that holds it behind the overlap; texts are of all lengths around a window's."""
    sub = attention.Subwords(RANKS)
    m = small_model(sub.size)
    r = np.random.default_rng(4)
    parts = [[*(f"w{i}" for i in r.integers(0, 99, n)), attention.END] for n in (0, 1, 9, 15, 16, 17, 40, 90)]
    want = []
    for p in parts:
        goal = m.place[sub.ids(p)].tolist()
        given = [int(m.place[sub.end]), *goal[:-1]]
        total, start = 0.0, 0
        while True:
            got = window_logs(m, given[start : start + W], goal[start : start + W])
            total += sum(got if start == 0 else got[attention.OVERLAP :])
            if start + W >= len(goal):
                break
            start += W - attention.OVERLAP
        want.append(total)
    assert np.allclose(attention.text_logs(m, sub, parts), want, rtol=1e-5)


def test_probabilities_sum_to_one():
    m = small_model()
    given = np.random.default_rng(1).integers(0, 700, (1, W))
    live = np.zeros((1, W), bool)
    live[0, 7] = True
    total = sum(np.exp(attention.logs(m, given, np.full((1, W), g), live)[0]) for g in range(700))
    assert abs(total - 1) < 1e-4


def test_large_weights_do_not_overflow():
    m = small_model()
    m.params["H"] *= 500
    m.params["A"] *= 30
    ids = np.random.default_rng(2).integers(0, 700, (3, W))
    assert np.isfinite(attention.logs(m, ids, ids, np.ones((3, W), bool))).all()


def test_gradients():
    """The first step of the trainer gives the gradient away: state holds its square."""
    m, r = small_model(), np.random.default_rng(6)
    given, goal = r.integers(0, 700, (2, 3, W))
    live = r.random((3, W)) < 0.8
    t = attention.Trainer(m)
    t.step(given, goal, live)
    for name in m.params:
        g = (m.params[name] - t.p[name]) * np.sqrt(t.state[name]) / t.rate
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        loss = []
        for d in (0.01, -0.01):
            p = {k: v.copy() for k, v in m.params.items()}
            p[name][at] += d
            loss.append(-attention.logs(attention.Model(p, m.place, m.bounds, m.cluster), given, goal, live).mean())
        assert np.isclose(g[at], (loss[0] - loss[1]) / 0.02, rtol=0.03), name


def test_training_windows_hold_whole_texts():
    sub = attention.Subwords(RANKS)
    m = small_model(sub.size)
    for n in (0, 1, 30, 31, 32, 5000):
        text = " ".join(f"w{i % 70}" for i in range(n))
        ids = m.place[sub.ids(attention.tokens(text))]
        given, goal, live = attention.training_windows(m, sub, text)
        assert goal[live].tolist() == ids.tolist() and given[live].tolist() == [m.place[sub.end], *ids[:-1]]


def topics(spark, n: int = 400):
    """Texts of one of two topics; a word tells the topic, and the topic the next words, which are even over the corpus."""
    r = np.random.default_rng(8)
    words = [["red", "blue", "green", "black"], ["seven", "nine", "four", "two"]]
    return spark.createDataFrame([(i, " ".join(r.choice(words[i % 2], 40))) for i in range(n)], "doc_id long, text string")


def learnt(df):
    return attention.learn(df, terms.counted(df, attention.tokens), RANKS)


def test_same_model_under_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(attention, "SHARD", 4000)
    df = topics(spark)
    a, b = learnt(df.repartition(7)), learnt(df.repartition(2, "doc_id"))
    assert all(np.array_equal(a.params[k], b.params[k]) for k in a.params)


def test_attention_carries_the_score(spark):
    """Held-out gain over subword counts, with attention and without what it adds: at least a quarter is attention's."""
    m, sub = learnt(topics(spark)), attention.Subwords(RANKS)
    r = np.random.default_rng(9)
    parts = [attention.tokens(" ".join(r.choice(w, 40))) for w in (["red", "blue", "green", "black"], ["seven", "nine", "four", "two"])]
    on = sum(attention.text_logs(m, sub, parts))
    m.params["O"] = m.params["O"] * 0
    off = sum(attention.text_logs(m, sub, parts))
    assert on > off > -1e9


def test_sum_of_rows_is_weighted_by_use(spark, monkeypatch):
    """One shard's average is what the shard learnt."""
    df = topics(spark, 60)
    sub = attention.Subwords(RANKS)
    table = terms.counted(df, attention.tokens)
    counts = attention.subword_counts(table, RANKS, sub.size)
    first = attention.initial(df, attention.fresh(counts, sub.end), RANKS, 60)
    m = attention.fresh(counts, sub.end)
    m.params = first.p
    texts = [r.text for r in df.selectExpr("text", "xxhash64(doc_id, text) AS k").orderBy("k", "text").collect()]
    at, _, rows = attention.shard_moves(m, first.state, sub, texts)
    want = np.concatenate([first.p[k].reshape(-1, D) for k in attention._NAMES])
    want[at] = rows
    got = learnt(df)
    assert np.allclose(np.concatenate([got.params[k].reshape(-1, D) for k in attention._NAMES]), want, atol=1e-5)


def test_sums_beyond_whole_numbers_of_64_bits(spark):
    big = (1 << 62) + 12345
    rows = spark.createDataFrame([(3, big, [big] * D), (3, big, [-big] * D), (3, big, [big] * D), (4, 1, [7] * D)], "at int, w long, v array<long>")
    got = {r["at"]: r for r in attention.summed_moves(rows).to_pylist()}
    assert got[3]["w"] == float(3 * big) and got[3]["v0"] == got[3][f"v{D - 1}"] == float(big) and got[4]["v5"] == 7.0


def test_clusters_hold_every_id_once():
    r = np.random.default_rng(5)
    for shares in (np.sort(r.pareto(1.0, 5000) + 1e-9)[::-1], np.ones(3000), np.array([1.0, *[1e-9] * 40_000]), np.ones(3)):
        bounds = attention.cluster_bounds(shares / shares.sum())
        assert bounds[-1] == len(shares) and (np.diff(bounds) > 0).all() and np.diff(bounds).max(initial=0) <= attention.LARGE and len(bounds) < 256


def test_outputs_in_parts_are_the_same(monkeypatch):
    """However many outputs are worked out at a time, and with memory that is used again."""
    m, r = small_model(), np.random.default_rng(6)
    given, goal = r.integers(0, 700, (2, 5, W))
    live = r.random((5, W)) < 0.8
    a, b = attention.Trainer(m), attention.Trainer(m)
    want = attention.logs(m, given, goal, live)
    a.step(given, goal, live)
    monkeypatch.setattr(attention, "_CELLS", 50)
    assert np.allclose(attention.logs(m, given, goal, live), want, rtol=1e-5)
    b.step(given, goal, live)
    b.step(given[:2], goal[:2], live[:2])
    a.step(given[:2], goal[:2], live[:2])
    assert all(np.allclose(a.p[k], b.p[k], atol=1e-4) for k in a.p)


ODD = ["", " ", "\t a\x0bB \n", "It's one's 're", "x\u00a0y \u3000 z\u2028", "\x1c \x85a", "Ünï 日本 \U0001f600!! 12345 a_b", "é" * 60 + " word", "a\x00b \x00", "A " * 50 + "end"]


@pytest.mark.parametrize("room", [500_000, 3])
def test_texts_encoded_together(room, monkeypatch):
    """Words that are looked up and encoded all in one go have the ids that each has by itself, in texts of any blanks and signs."""
    monkeypatch.setattr(attention, "_KEPT", room)
    sub = attention.Subwords.__wrapped__(RANKS)
    one = attention.Subwords.__wrapped__(RANKS)
    for texts in (ODD, ODD[::-1], [""], []):
        got = sub.many_ids(texts)
        assert [g.tolist() for g in got] == [np.concatenate([np.frombuffer(one.packed(w), one.code) for w in attention.tokens(t)]).tolist() for t in texts]
    monkeypatch.setattr(attention, "_TOGETHER", 10)
    assert [g.tolist() for g in sub.stream(iter(ODD))] == [g.tolist() for g in one.many_ids(ODD)]


def test_words_are_counted_as_by_loops(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in ODD * 3], "text string")
    want = sorted(terms.counted(df, attention.tokens).collect())
    assert sorted(attention.word_counts(df).collect()) == want
    monkeypatch.setattr(attention, "_COUNTED", 1)
    assert sorted(attention.word_counts(df).collect()) == want
    assert attention.word_counts(df.limit(0)).count() == 0


def test_attention_in_slices_is_the_same():
    """One window or many, alone or in slices: the same move; attention goes through slices that stay in a core's cache."""
    m, r = small_model(), np.random.default_rng(11)
    given, goal = r.integers(0, 700, (2, 2 * attention._BLOCK + 5, W))
    live = r.random(given.shape) < 0.9
    seen, trunk, a, b = [], attention.trunk, attention.Trainer(m), attention.Trainer(m)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(attention, "trunk", lambda w, x, *rest: (seen.append(len(x)), trunk(w, x, *rest))[1])
        a.step(given, goal, live)
        patch.setattr(attention, "_BLOCK", len(given))
        b.step(given, goal, live)
    assert seen == [attention._BLOCK, attention._BLOCK, 5, len(given)]
    assert all(np.allclose(a.p[k], b.p[k], atol=1e-4) for k in a.p)
