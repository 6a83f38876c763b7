"""Operator 8: language-model scoring by a causal self-attention model, trained in numpy on subword ids."""

from __future__ import annotations

import base64
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from .common import arrow_map, one_thread, stored

FOLDS, HELD = 7, 2
#: The term that ends every document; no word can be it.
END = "\n"
#: Width of the model, positions of a context window, and positions that a scored window shares with the one before.
WIDTH, WINDOW, OVERLAP = 16, 32, 4
#: Most frequent ids that may have an output of their own; most ids of a cluster.
SINGLES, LARGE = (8, 16, 32, 64), 8192
#: The initial fit: about so many training documents of the least hash, windows of each, rounds over them.
FIRST_DOCS, FIRST_WINDOWS, EPOCHS = 2000, 8, 4
FIRST_BATCH, FIRST_RATE, BATCH, RATE = 128, 0.05, 256, 0.1
#: Subwords of a training shard, and the most shards; beyond that, shards grow.
SHARD, MOST_SHARDS = 8_000_000, 16_384


def words(text: str) -> list[bytes]:
    """Words of the text in lower case (A-Z): bytes are split at the blanks of ASCII."""
    return text.encode("utf-8", "replace").lower().split()


def tokens(text: str) -> list[str]:
    """Words of the text in lower case (A-Z), and the end."""
    return [*map(bytes.decode, words(text)), END]


def parted(texts: list[str]) -> pa.LargeListArray:
    """The words of each text, and an empty one for blanks at either end of it."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_string())))


#: Bytes of words that a task counts at a time.
_COUNTED = 32 << 20


def word_counts(texts: DataFrame) -> DataFrame:
    """terms.counted(texts, tokens): term, n over all rows of texts."""

    def tally(held: list[pa.Array], docs: int) -> dict[str, pa.Array]:
        found = pa.chunked_array(held, pa.large_string()).value_counts()
        word, n = found.field("values"), found.field("counts")
        real = pc.not_equal(word, "")
        return {"term": pa.concat_arrays([word.filter(real).cast(pa.string()), pa.array([END] * (docs > 0), pa.string())]), "n": pa.concat_arrays([n.filter(real), pa.array([docs] * (docs > 0), pa.int64())])}

    def rows(it):
        held, docs = [], 0
        for b in it:
            held.append(parted(b["text"]).flatten())
            docs += len(b["text"])
            if sum(x.nbytes for x in held) > _COUNTED:
                yield tally(held, docs)
                held, docs = [], 0
        yield tally(held, docs)

    return arrow_map(texts.select("text"), "term string, n long", rows).groupBy("term").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=2)
class Subwords:
    """word -> packed ids of a byte-level rank file, the word with a space before it; the end has the first free id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        #: Bytes of an id: two where all ids and one more, for what fills records up, have room in them.
        self.code = "H" if self.size < 1 << 16 else "I"
        #: Bytes that an id stands for.
        self.bytes = np.zeros(self.size, np.int64)
        self.bytes[list(ranks.values())] = list(map(len, ranks))
        self.words = _Packed(self)

    def packed(self, word: str | bytes) -> bytes:
        word = word if isinstance(word, str) else word.decode()
        return array(self.code, [self.end] if word == END else self.encode(" " + word)).tobytes()

    def packed_all(self, words: list[bytes]) -> list[bytes]:
        """packed of each word, encoded as one text: patterns part words at the space before each, unless a word has a blank in it itself."""
        plain = [w for w in words if len(w.decode().split()) == 1]
        ids = np.array(self.encode(" " + b" ".join(plain).decode()) if plain else [], self.code)
        cuts = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(w) + 1 for w in plain]), side="left") + 1
        ends, whole = (cuts * ids.itemsize).tolist(), ids.tobytes()
        if len(plain) == len(words):
            return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        found = {w: whole[a:b] for w, a, b in zip(plain, [0, *ends], ends, strict=False)}
        return [found[w] if w in found else self.packed(w) for w in words]

    def packed_words(self, words: list[bytes]) -> list[bytes]:
        """packed of distinct words, kept as far as there is room; an empty word has no ids."""
        out = list(map(self.words.get, words))
        at = [k for k, f in enumerate(out) if f is None and words[k]]
        for k, f in zip(at, self.packed_all([words[k] for k in at]), strict=True):
            out[k] = self.words.keep(words[k], f)
        return [f or b"" for f in out]

    def ids(self, words: list[str] | list[bytes]) -> np.ndarray:
        found = list(map(self.words.get, words))
        if None in found:
            held = self.words
            found = [held[w] if f is None else f for w, f in zip(words, found, strict=True)]
        return np.frombuffer(b"".join(found), np.dtype(self.code))

    def text_ids(self, text: str) -> np.ndarray:
        """ids(tokens(text))."""
        return self.ids([*words(text), END.encode()])

    def many_ids(self, texts: list[str]) -> list[np.ndarray]:
        """text_ids of each text: each distinct word of them all is looked up once."""
        cut = parted(texts)
        coded = cut.flatten().dictionary_encode()
        # Blanks at a text's ends leave empty words, which have no ids.
        spelt = coded.dictionary.cast(pa.binary())
        packed = self.packed_words(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(spelt)], pa.int32()), spelt), b" ")[0].as_py().split(b" ") if len(spelt) else [])
        held = np.frombuffer(b"".join(packed), np.dtype(self.code))
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // held.itemsize
        word = coded.indices.to_numpy()
        many = np.take(size, word)
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = np.take(held, np.arange(ends[-1]) + np.repeat(np.take(np.cumsum(size) - size, word) - ends[:-1], many))
        cuts, last = ends[cut.offsets.to_numpy()].tolist(), np.array([self.end], held.dtype)
        return [np.concatenate([ids[a:b], last]) for a, b in zip(cuts, cuts[1:], strict=False)]


    def stream(self, texts):
        """text_ids of each text, some of them at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > _TOGETHER:
                yield from self.many_ids(held)
                held, size = [], 0
        if held:
            yield from self.many_ids(held)


#: Words that a worker keeps with their ids.
_KEPT = 500_000
#: Characters of texts that are encoded together.
_TOGETHER = 4 << 20


class _Packed(dict):
    def __init__(self, owner):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str | bytes) -> bytes:
        return self.keep(word, self.owner.packed(word))

    def keep(self, word: str | bytes, found: bytes) -> bytes:
        if len(self) < _KEPT and len(word) <= 48:
            self[word] = found
        return found


@dataclass
class Model:
    """Parameters, the place of each subword id by frequency, the clusters' bounds in that order, and the cluster of each place (0: an output of its own).

    E embeds the given id and P its position; A makes queries, keys and values, O takes what attention gives back. The
    last component of what comes out is 1, so H (single ids and clusters) and T (ids inside their cluster) hold biases.
    """

    params: dict[str, np.ndarray]
    place: np.ndarray
    bounds: np.ndarray
    cluster: np.ndarray


def cluster_bounds(shares: np.ndarray) -> np.ndarray:
    """Where clusters of ids begin and end, ids by falling share, chosen so that a position has few outputs to work out.

    A position works out the single ids and one output for each cluster, and with a cluster's share also its ids. A cluster takes
    ids until its share times its size is a bound; of some numbers of single ids and some bounds the cheapest is taken. Each
    cluster counts as some outputs more, as it takes steps of its own.
    """
    size, below = len(shares), np.concatenate([[0.0], np.cumsum(shares)])
    best = None
    for singles in SINGLES:
        for most in (0.5, 1, 2, 4, 8):
            cuts, cost = [min(singles, size)], 0.0
            while (at := cuts[-1]) < size:
                reach = np.arange(1, min(LARGE, size - at) + 1)
                load = (below[at + 1 : at + len(reach) + 1] - below[at]) * reach
                many = max(1, int(np.searchsorted(load, most, side="right")))
                cost += load[many - 1]
                cuts.append(at + many)
            cost += cuts[0] + 2 * (len(cuts) - 1)
            if len(cuts) < 250 and (best is None or cost < best[0]):
                best = cost, cuts
    return np.array(best[1])


def fresh(counts: np.ndarray, end: int, seed: int = 7) -> Model:
    """A model before training: random weights, biases from the counts. The end and the most frequent ids are single."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    order = np.concatenate([[end], order[order != end]])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    r, smooth = np.random.default_rng(seed), counts[order] + 0.1
    bounds = cluster_bounds(smooth / smooth.sum())
    draw = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[-1])).astype(np.float32)
    v, d = len(order), WIDTH
    p = {"E": draw(v, d) * 4, "P": draw(WINDOW, d), "A": draw(d, 3 * d) * 2, "O": draw(d, d), "H": draw(bounds[0] + len(bounds) - 1, d), "T": draw(v, d)}
    p["A"][:, :d] /= np.float32(np.sqrt(d))
    head = np.concatenate([smooth[: bounds[0]], [smooth[a:b].sum() for a, b in zip(bounds, bounds[1:], strict=False)]])
    p["H"][:, -1] = np.log(head / head.sum())
    for a, b in zip(bounds, bounds[1:], strict=False):
        p["T"][a:b, -1] = np.log(smooth[a:b] / smooth[a:b].sum())
    return Model(p, place, bounds, np.searchsorted(bounds, np.arange(v), side="right").astype(np.uint8))


#: Later positions have no part in a row's greatest value, nor in its sum.
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_ONES = np.ones(LARGE + 4096, np.float32)
#: Outputs that are worked out at a time: their values stay in a core's cache.
_CELLS = 1 << 16
#: Rows of a product that are multiplied at a time: the library is quicker on many small products than on one of millions of short rows.
_ROWS = 256
#: Exponents beyond this, either way, are shifted by the greatest of their row.
_FAR = 40.0
#: Windows that attention goes through at a time.
_BLOCK = 64


#: Numbers that are asked for at a time: numpy asks for large pages if it is much.
_ARENA = 4 << 20


class _Room:
    """Memory for the large arrays of a step, which is used again in the next one: fresh pages cost more than the sums in them."""

    def __init__(self):
        self.held: dict[str | tuple[str, int], np.ndarray] = {}
        self.rest = np.empty(0, np.float32)

    def __call__(self, name: str | tuple[str, int], *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self.held or self.held[name].size < size:
            many = (size + size // 4 + 15) & -16
            if many > len(self.rest):
                self.rest = np.empty(max(many, _ARENA), np.float32)
            self.held[name], self.rest = self.rest[:many], self.rest[many:]
        return self.held[name][:size].reshape(shape)


_room = _Room()


def _turned(x: np.ndarray) -> np.ndarray:
    return x.swapaxes(1, 2)


def _times(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """a @ b for many short rows a."""
    even = len(a) - len(a) % _ROWS
    if even:
        np.matmul(a[:even].reshape(-1, _ROWS, a.shape[1]), b, out=out[:even].reshape(-1, _ROWS, b.shape[1]))
    if even < len(a):
        np.matmul(a[even:], b, out=out[even:])
    return out


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for many short rows."""
    even = len(a) - len(a) % _ROWS
    total = a[even:].T @ b[even:]
    if even:
        total += np.matmul(_turned(a[:even].reshape(-1, _ROWS, a.shape[1])), b[:even].reshape(-1, _ROWS, b.shape[1])).sum(axis=0)
    return total


def _exp(z: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray | float:
    """z becomes exp(z - shift); the shift of a row is its greatest value if some value is far from 0, else 0, which is quicker and the same softmax."""
    wide = z.max(initial=0.0) > _FAR or z.min(initial=0.0) < -_FAR
    if mask is not None:
        z += mask
    shift = z.max(axis=-1) if wide else 0.0
    if wide:
        z -= shift[..., None]
    np.exp(z, out=z)
    return shift


def embedded(p: dict[str, np.ndarray], given: np.ndarray, place: int = 0) -> np.ndarray:
    x = np.take(p["E"], given, axis=0, out=_room(("x", place), *given.shape, WIDTH), mode="clip")
    x += p["P"]
    return x


def inputs(p: dict[str, np.ndarray]) -> np.ndarray:
    """What makes queries, keys and values of embeddings, the values as O gives them back."""
    return np.concatenate([p["A"][:, : 2 * WIDTH], p["A"][:, 2 * WIDTH :] @ p["O"]], axis=1)


def trunk(w: np.ndarray, x: np.ndarray, h: np.ndarray, place: int = 0) -> tuple[np.ndarray, ...]:
    """Masked attention over windows x (n, WINDOW, WIDTH) with a residual, all windows at a time; w are the inputs, h takes what comes out.

    What it gives back for the gradient stays as it is until the same place is used again.
    O is in the values already: (a @ v) @ O is a @ (v @ O). The last component of what comes out is 1 whatever the values are, so the
    last value is 1, and a row's sum of exponentials comes with its values. a is not divided by that sum, o is.
    """
    n, flat = len(x), x.reshape(-1, WIDTH)
    rows = _times(flat, w, _room(("rows", place), len(flat), 3 * WIDTH))
    rows[:, -1] = 1
    q, k, v = (rows.reshape(n, WINDOW, 3 * WIDTH)[:, :, j * WIDTH : (j + 1) * WIDTH] for j in range(3))
    turned = _room("turned", n, WIDTH, WINDOW)
    turned[...] = _turned(k)
    a = np.matmul(q, turned, out=_room(("a", place), n, WINDOW, WINDOW))
    _exp(a, _MASK)
    o = np.matmul(a, v, out=_room(("o", place), n, WINDOW, WIDTH)).reshape(-1, WIDTH)
    total = o[:, -1].copy()
    o /= total[:, None]
    np.add(o, flat, out=h)
    h[:, -1] = 1
    return x, q, k, v, a, o, total


def untrunk(w: np.ndarray, made: tuple[np.ndarray, ...], dh: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """The gradient of the inputs w, from what trunk made and the gradient dh of what came out; dx takes the gradient of x."""
    x, q, k, v, a, o, total = made
    dh[:, -1] = 0
    # The last value is 1, so what a row's gradients have in common is taken off with the product by the values.
    dh[:, -1] = np.multiply(dh, o, out=_room("hr", *dh.shape)) @ -_ONES[:WIDTH]
    e = np.divide(dh, total[:, None], out=_room("hr", *dh.shape)).reshape(x.shape)
    dh[:, -1] = 0
    d, turned = _room("d", *x.shape[:2], 3 * WIDTH), _room("turned", len(x), WIDTH, WINDOW)
    np.matmul(_turned(a), e, out=d[:, :, 2 * WIDTH :])
    turned[...] = _turned(v)
    da = np.matmul(e, turned, out=_room("da", *a.shape))
    da *= a
    np.matmul(da, k, out=d[:, :, :WIDTH])
    np.matmul(_turned(da), q, out=d[:, :, WIDTH : 2 * WIDTH])
    d = d.reshape(-1, 3 * WIDTH)
    d[:, -1] = 0
    _times(d, np.ascontiguousarray(w.T), dx)
    dx += dh
    return _gram(x.reshape(-1, WIDTH), d)


def by_cluster(cluster: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the positions by cluster, and where each cluster but 0 begins and ends in it."""
    order = np.argsort(cluster, kind="stable")
    ends = np.cumsum(np.bincount(cluster, minlength=1)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False), 1) if b > a]


def inverse(order: np.ndarray) -> np.ndarray:
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return back


def goal_logs(m: Model, given: np.ndarray, live: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """ln of the probability of the goals, one for each live position of windows (n, WINDOW): its output's, and within a cluster its own."""
    p, w, h, done = m.params, inputs(m.params), _room("live", len(goal), WIDTH), 0
    for k in range(0, len(given), _BLOCK):
        at, part = np.flatnonzero(live[k : k + _BLOCK]), given[k : k + _BLOCK]
        all_ = _room("h", part.size, WIDTH)
        trunk(w, embedded(p, part), all_)
        np.take(all_, at, axis=0, out=h[done : done + len(at)], mode="clip")
        done += len(at)

    def softmax(h: np.ndarray, w: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        turned, many = np.ascontiguousarray(w.T), max(1, _CELLS // len(w))
        for k in range(0, len(h), many):
            part = h[k : k + many]
            z = _times(part, turned, _room("z", len(part), len(w)))
            mine = np.take(z.reshape(-1), np.arange(0, z.size, len(w)) + at[k : k + many])
            shift = _exp(z)
            out[k : k + many] += mine - shift - np.log(z @ _ONES[: len(w)])

    order, parts = by_cluster(np.take(m.cluster, goal))
    h, g, out = np.take(h, order, axis=0, out=_room("hs", *h.shape), mode="clip"), np.take(goal, order), np.zeros(len(goal))
    at = g.copy()
    for k, a, b in parts:
        at[a:b] = m.bounds[0] - 1 + k
    softmax(h, p["H"], at, out)
    for k, a, b in parts:
        low, high = m.bounds[k - 1], m.bounds[k]
        softmax(h[a:b], p["T"][low:high], g[a:b] - low, out[a:b])
    back = np.empty_like(out)
    back[order] = out
    return back


def logs(m: Model, given: np.ndarray, goal: np.ndarray, live: np.ndarray) -> np.ndarray:
    """goal_logs for goals (n, WINDOW)."""
    return goal_logs(m, given, live, goal[live].astype(np.int64))


class Trainer:
    """Adagrad over batches of windows; `state` holds the sums of squared gradients."""

    def __init__(self, model: Model, state: dict[str, np.ndarray] | None = None, rate: float | None = None):
        one_thread()
        self.m, self.rate = model, np.float32(RATE if rate is None else rate)
        self.p = {k: v.copy() for k, v in model.params.items()}
        self.state = {k: v.copy() for k, v in (state or {k: np.full_like(v, 1e-6) for k, v in self.p.items()}).items()}

    def _move(self, name: str, g: np.ndarray, rows=slice(None)) -> None:
        square = self.state[name][rows]
        square += g * g
        if not isinstance(rows, slice):  # a copy, not the rows themselves
            self.state[name][rows] = square
        self.p[name][rows] -= self.rate * g / np.sqrt(square)

    def _output(self, name: str, rows, h: np.ndarray, at: np.ndarray, scale: np.ndarray, dh: np.ndarray) -> None:
        """Move the outputs of one softmax; the gradient of its input is added to dh."""
        w = self.p[name][rows]
        turned, g, many = np.ascontiguousarray(w.T), 0.0, max(1, _CELLS // len(w))
        for k in range(0, len(h), many):
            hk = h[k : k + many]
            z = _times(hk, turned, _room("z", len(hk), len(w)))
            _exp(z)
            total = z @ _ONES[: len(w)]
            z.reshape(-1)[np.arange(0, z.size, len(w)) + at[k : k + many]] -= total
            z *= (scale[k : k + many] / total)[:, None]
            dh[k : k + many] += _times(z, w, _room("dz", *hk.shape))
            g = g + _gram(z, hk)
        self._move(name, g, rows)

    def step(self, given: np.ndarray, goal: np.ndarray, live: np.ndarray) -> None:
        """One move along the gradient of the mean loss over live positions."""
        p, m = self.p, self.m
        w, on, h = inputs(p), live.ravel(), _room("h", given.size, WIDTH)
        blocks = [(k, slice(k * WINDOW, (k + _BLOCK) * WINDOW)) for k in range(0, len(given), _BLOCK)]
        made = [trunk(w, embedded(p, given[k : k + _BLOCK], k), h[rows], k) for k, rows in blocks]
        order, parts = by_cluster(np.where(on, np.take(m.cluster, goal.ravel()), 0))
        g = np.take(goal.ravel(), order).astype(np.int64)
        scale = np.take(on, order) * np.float32(1 / max(1, on.sum()))
        at = g if not parts else g.copy()
        for cluster, b, e in parts:
            at[b:e] = m.bounds[0] - 1 + cluster
        # A position that is not live has no weight: any output will do as its goal.
        at[: parts[0][1] if parts else None][scale[: parts[0][1] if parts else None] == 0] = 0
        hs, ds = np.take(h, order, axis=0, out=_room("hs", *h.shape), mode="clip"), _room("ds", *h.shape)
        ds[...] = 0
        self._output("H", slice(None), hs, at, scale, ds)
        for cluster, b, e in parts:
            low, high = m.bounds[cluster - 1], m.bounds[cluster]
            self._output("T", slice(low, high), hs[b:e], g[b:e] - low, scale[b:e], ds[b:e])
        dh, dx = np.take(ds, inverse(order), axis=0, out=_room("dh", *h.shape), mode="clip"), _room("hs", *h.shape)
        dw = sum(untrunk(w, made[i], dh[rows], dx[rows]) for i, (_, rows) in enumerate(blocks))
        values, back = p["A"][:, 2 * WIDTH :].copy(), dw[:, 2 * WIDTH :]
        dw[:, 2 * WIDTH :], do = back @ p["O"].T, values.T @ back
        self._move("O", do)
        self._move("A", dw)
        self._move("P", dx.reshape(*given.shape, WIDTH).sum(axis=0))
        ids = given.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        self._move("E", np.add.reduceat(np.take(dx, order, axis=0, out=_room("dh", *dx.shape), mode="clip"), first, axis=0), ids[first])


def training_windows(m: Model, sub: Subwords, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Given and goal places and live positions (n, WINDOW) of a text from its beginning to its end: each id is a goal once."""
    return windows_of(m, sub, sub.text_ids(text))


def windows_of(m: Model, sub: Subwords, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """training_windows of a text with these ids."""
    places = np.take(m.place, ids)
    stream = np.zeros(-(-len(places) // WINDOW) * WINDOW + 1, np.uint16 if len(m.place) < 1 << 16 else np.int64)
    stream[0] = m.place[sub.end]
    stream[1 : len(places) + 1] = places
    live = np.arange(len(stream) - 1) < len(places)
    return tuple(x.reshape(-1, WINDOW) for x in (stream[:-1], stream[1:], live))


#: Windows that are scored at a time: positions of one cluster meet in one product.
_SCORED = 1024


def text_logs(m: Model, sub: Subwords, parts: list[list[str]]) -> list[float]:
    """ln of the probability of each list of tokens."""
    return id_logs(m, sub, [sub.ids(p) for p in parts])


def id_logs(m: Model, sub: Subwords, texts: list[np.ndarray]) -> list[float]:
    """ln of the probability of each text, given as ids. Windows overlap; each subword counts once, with the most context."""
    one_thread()
    out = np.zeros(len(texts))
    for k in range(0, len(texts), 64):
        streams = [np.take(m.place, ids) for ids in texts[k : k + 64]]
        lengths = np.array([len(s) for s in streams])
        goal = np.concatenate(streams)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        given = np.concatenate([[0], goal[:-1]])
        given[first] = m.place[sub.end]
        stride = WINDOW - OVERLAP
        many = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
        doc = np.repeat(np.arange(len(streams)), many)
        number = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        start, stop = first[doc] + number * stride, (first + lengths)[doc]
        # Live positions follow each other from window to window, so all goals come in their order.
        each, done = np.empty(len(goal)), 0
        for b in range(0, len(doc), _SCORED):
            at = start[b : b + _SCORED, None] + np.arange(WINDOW)
            live = at < stop[b : b + _SCORED, None]
            live[:, :OVERLAP] &= number[b : b + _SCORED, None] == 0
            many = np.count_nonzero(live)
            each[done : done + many] = goal_logs(m, np.take(given, at, mode="clip"), live, goal[done : done + many])
            done += many
        out[k : k + 64] = np.add.reduceat(each, first)
    return out.tolist()


def held_out():
    """crc32(doc_id as text) mod FOLDS = HELD; a row without a doc_id is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def subword_counts(table: DataFrame, vocabulary: str, size: int) -> np.ndarray:
    """Occurrences of each subword id in the training documents, from the word table; one number for each id comes to the driver."""

    def rows(it):
        sub, total = Subwords(vocabulary), np.zeros(size)
        for b in it:
            packed = sub.packed_all([w.encode() for w in b["term"]])
            ids = np.frombuffer(b"".join(packed), np.dtype(sub.code))
            total += np.bincount(ids, np.repeat(np.array(b["n"], float), np.array(list(map(len, packed)), int) // ids.itemsize), size)
        at = np.flatnonzero(total)
        yield {"id": at.tolist(), "n": total[at].tolist()}

    got = arrow_map(table.select("term", "n"), "id int, n double", rows).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[np.array(got.column(0).to_pylist(), int)] = got.column(1).to_pylist()
    return out


def initial(train_docs: DataFrame, model: Model, vocabulary: str, docs: float) -> Trainer:
    """A first fit, where all shards start: a few windows of about FIRST_DOCS of `docs` training documents, chosen by hash."""
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = train_docs.filter(hashed < int(min(1.0, FIRST_DOCS / max(1.0, docs)) * (1 << 30))).select(hashed.alias("key"), "text")

    def rows(it):
        sub = Subwords(vocabulary)
        for b in it:
            out = []
            for key, text in zip(b["key"], b["text"], strict=True):
                parts = np.stack([x.astype(np.uint32) for x in training_windows(model, sub, text)], axis=1)
                out.append(parts[np.unique((key + np.arange(FIRST_WINDOWS) * 0x9E3779B1) % len(parts))].tobytes())
            yield {"key": b["key"], "w": out}

    got = sorted(zip(*(c.to_pylist() for c in arrow_map(chosen, "key long, w binary", rows).toArrow().columns), strict=True))
    trainer, r = Trainer(model, rate=FIRST_RATE), np.random.default_rng(3)
    if got:
        windows = np.frombuffer(b"".join(w for _, w in got), np.uint32).reshape(-1, 3, WINDOW).astype(np.int64)
        for _ in range(EPOCHS):
            order = r.permutation(len(windows))
            for k in range(0, len(order), FIRST_BATCH):
                given, goal, live = windows[order[k : k + FIRST_BATCH]].transpose(1, 0, 2)
                trainer.step(given, goal, live > 0)
    return trainer


#: Matrices in the order in which their rows are numbered for averaging.
_NAMES = ("E", "T", "H", "P", "A", "O")
_SCALE = float(1 << 20)


def shard_moves(model: Model, state: dict[str, np.ndarray], sub: Subwords, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Train on every window of the texts; numbers, weights and new values of the parameter rows that were used.

    A row weighs as much as the shard used it: an id's embedding by its occurrences, a cluster by its goals, others by
    all goals.
    """
    trainer, held, waiting = Trainer(model, state), [], 0
    given_n, cluster_n = np.zeros(len(model.place), np.int64), np.zeros(len(model.bounds), np.int64)

    def go(parts, many):
        nonlocal given_n, cluster_n
        given, goal, live = (x[:many] for x in parts)
        given_n += np.bincount(given[live], minlength=len(given_n))
        cluster_n += np.bincount(model.cluster[goal[live]], minlength=len(cluster_n))
        for k in range(0, many, BATCH):
            trainer.step(given[k : k + BATCH], goal[k : k + BATCH], live[k : k + BATCH])

    for ids in sub.stream(texts):
        held.append(windows_of(model, sub, ids))
        waiting += len(held[-1][0])
        if waiting >= 8 * BATCH:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            whole = waiting - waiting % BATCH
            go(parts, whole)
            held, waiting = [tuple(x[whole:] for x in parts)], waiting - whole
    if waiting:
        go([np.concatenate(x) for x in zip(*held, strict=True)], waiting)
    if not cluster_n.sum():
        return None
    weights = {"E": given_n, "T": np.where(model.cluster > 0, cluster_n[model.cluster], 0)}
    rows = np.concatenate([trainer.p[k].reshape(-1, WIDTH) for k in _NAMES])
    w = np.concatenate([weights.get(k, np.full(model.params[k].size // WIDTH, cluster_n.sum())) for k in _NAMES])
    at = np.flatnonzero(w)
    return at, w[at], rows[at]


def summed_moves(moves: DataFrame) -> pa.Table:
    """at, w and the components of v added up over all shards, in whole numbers of 38 digits: a corpus of any size stays within them."""
    whole = lambda c, name: F.sum(c.cast("decimal(38,0)")).cast("double").alias(name)
    return moves.groupBy("at").agg(whole(F.col("w"), "w"), *(whole(F.get("v", F.lit(i)), f"v{i}") for i in range(WIDTH))).toArrow()


def learn(train_docs: DataFrame, table: DataFrame, vocabulary: str) -> Model:
    """Fit on every training document from its beginning to its end.

    Outputs begin with the subword counts of all training documents, weights with a small first fit (see initial).
    Then documents are dealt by hash to shards of about SHARD subwords, in which they stand in the order of their hash; each shard is trained
    through in one go, and the shards' parameters are averaged, each row by its use. Sums are of whole numbers, so
    neither shards nor averages depend on how the table is cut into files or tasks.
    """
    sub = Subwords(vocabulary)
    counts = subword_counts(table, vocabulary, sub.size)
    model = fresh(counts, sub.end)
    if not counts.sum():
        return model
    first = initial(train_docs, model, vocabulary, counts[sub.end])
    model.params = first.p
    shards = int(min(MOST_SHARDS, -(-counts.sum() // SHARD)))
    sent = train_docs.sparkSession.sparkContext.broadcast((model, first.state))
    key = F.xxhash64("doc_id", "text")
    dealt = train_docs.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), key.alias("key"), "text").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "text")

    def rows(it):
        stream = ((s, t) for b in it for s, t in zip(b["shard"], b["text"], strict=True))
        for _, of in groupby(stream, key=lambda x: x[0]):
            if (moved := shard_moves(*sent.value, Subwords(vocabulary), (t for _, t in of))) is not None:
                at, w, v = moved
                whole = np.rint(v.astype(np.float64) * w[:, None] * _SCALE).astype(np.int64)
                yield {"at": at.tolist(), "w": w.tolist(), "v": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * WIDTH, pa.int32()), pa.array(whole.ravel()))}

    moves = arrow_map(dealt.select("shard", "text"), "at int, w long, v array<long>", rows)
    got = summed_moves(moves)
    at, w, *v = (c.to_numpy() for c in got.columns)
    flat = np.concatenate([model.params[k].reshape(-1, WIDTH) for k in _NAMES])
    flat[at] = np.stack(v, axis=1) / (w[:, None] * _SCALE)
    cuts = np.cumsum([model.params[k].size // WIDTH for k in _NAMES])[:-1]
    model.params = {k: np.ascontiguousarray(x).reshape(model.params[k].shape) for k, x in zip(_NAMES, np.split(flat, cuts), strict=True)}
    return model


def score(docs: DataFrame, vocabulary: str, hot: int = 2 * terms.HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are lower-case words and an end. base_score is the add-one unigram score under the counts of all training
    documents. score is log10 of the probability that the attention model gives the text's subwords, end included:
    a distribution over texts, with no help from the word table. Windows overlap by OVERLAP positions, and each subword
    is scored once; its probability is that of its output times, for all but the most frequent ids, its share of the
    cluster, and both come from the context.

    Cases: a null or empty text is the end alone; with no training document, counts are 0 and the model is untrained;
    repeated rows give repeated rows; a row without a doc_id is trained on; an empty table gives no rows; texts of any
    length go through in windows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train_docs = texts.filter(~held_out())
    table = stored(word_counts(train_docs), "words")
    facts = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, all_ = facts["n"], float(facts["n"] + facts["v"] + 1)
    table = table.withColumn("value", F.log10((F.col("n") + 1) / F.lit(all_)))
    unknown = float(np.log10(1 / all_))
    sent = spark.sparkContext.broadcast(learn(train_docs, table, vocabulary))

    def extra(raw: list[str], parts: list[list[str]]) -> tuple[list[int], list[float]]:
        sub = Subwords(vocabulary)
        return [0] * len(raw), id_logs(sent.value, sub, list(sub.stream(raw)))

    out = terms.summed(texts, table, "value", terms.hottest(table, "value", hot), tokens, extra)
    return out.select(
        "doc_id", held_out().alias("held_out"), F.col("n_terms").alias("n_tokens"), F.col("found").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("total") + (F.col("n_terms") - F.col("found")) * unknown).alias("base_score"), (F.col("y") / float(np.log(10))).alias("score"),
    )
