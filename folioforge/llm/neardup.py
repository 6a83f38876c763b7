"""Operator 10: near-duplicate groups of documents by HyperMinHash, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, batches, free_name, stored, text_or_empty

#: A link needs 100 * intersection >= PERCENT * union.
PERCENT, SHINGLE = 85, 5
#: The same for deduplicated, a stage of pipelines. Two sets of similarity 0.80 share no band with a probability of 5e-8.
STAGE_PERCENT = 80
#: Registers of a signature, and registers to a band: 32 bands of 64 bits. Two sets of similarity 0.85 share no band
#: with a probability of (1 - 0.85 ** 4) ** 32, about 6e-11.
REGISTERS, ROWS = 128, 4
MANTISSA = 10
#: Estimates this far below the threshold, 4.5 standard deviations, are not confirmed.
SLACK = 4.5
#: Documents of a bucket that are buffered, and those that are streamed past them, in a group.
CHUNK = 256
#: Documents that meet their leader's set in a task.
LED = 1024

_rng = np.random.Generator(np.random.PCG64(20240607))
_TIMES = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_PLACE = _rng.integers(0, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = 0x9E3779B97F4A7C15


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's set: 5-word shingles, or the whole sequence of fewer words."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return mixed((w * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n * _SHORT & (1 << 64) - 1))
    h = w[: n - SHINGLE + 1] * _PLACE[0]
    for j in range(1, SHINGLE):
        h += w[j : n - SHINGLE + 1 + j] * _PLACE[j]
    h = np.sort(mixed(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def registers(found: np.ndarray) -> np.ndarray:
    """HyperMinHash: of the least value of each of 128 hash functions, the number of leading zeros (6 bits) and the 10 bits after the first one."""
    h = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 2048):
        x = _TIMES * h[None, k : k + 2048]
        x += _PLUS
        np.minimum(least, x.min(axis=1), out=least)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # length in bits; 0 for 0
    wide = least.astype(np.int64) << 32
    tail = (wide >> np.maximum(bits - 1 + 32 - MANTISSA, 0)) & ((1 << MANTISSA) - 1)
    return ((32 - bits) << MANTISSA | tail).astype(np.uint16)


def chance(n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray | float:
    """The probability that registers of disjoint sets of n and m elements agree: same leading zeros, same mantissa."""
    high = 0.5 ** np.arange(0, 33)
    inside = lambda s: np.exp(-np.multiply.outer(s, high[1:])) - np.exp(-np.multiply.outer(s, high[:-1]))
    return (inside(n) * inside(m)).sum(axis=-1) / (1 << MANTISSA)


def estimate(same: np.ndarray | float, n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray | float:
    """Jaccard similarity from the share of registers that agree, corrected for those that agree by chance."""
    c = chance(n, m)
    return (same - c) / (1 - c)


def floor_of(percent: int) -> float:
    s = percent / 100
    return s - SLACK * float(np.sqrt(s * (1 - s) / REGISTERS))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union, on sorted distinct sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if n > m:
        a, b, n, m = b, a, m, n
    at = np.searchsorted(b, a)
    at[at == m] = m - 1
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (n + m - both)


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit hash of the set), bands (the registers, four to a 64-bit word)."""

    def rows(it):
        for b in it:
            out = {"doc_id": b["doc_id"], "n_shingles": [], "k1": [], "k2": [], "bands": []}
            for t in b["text"]:
                s = shingles(t)
                k1, k2 = _halves(s.tobytes())
                out["n_shingles"].append(len(s))
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["bands"].append(registers(s).view(np.int64).tolist() if len(s) else [])
            yield out

    return arrow_map(text_or_empty(docs), SIGNED, rows)


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b): label is the least node that is reachable.

    Each round gives every node the least of its neighbours and itself as parent, follows parents three steps on,
    and replaces the edges by those between parents; rounds end when no edge is left. All are joins and partial
    aggregations over tables in the shared folder, so a hub's edges need not meet in one task.
    """
    labels = None
    e = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("parent"))
        for _ in range(3):
            parent = stored(parent, "parents")
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parent = parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        parent = stored(parent, "parents")
        if labels is None:
            labels = parent.withColumnRenamed("parent", "label")
        else:
            step = parent.select(F.col("node").alias("label"), "parent")
            labels = stored(labels.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        pa_, pb_ = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        e = stored(e.join(pa_, "a").join(pb_, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct(), "edges")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _streamed(df: DataFrame, keys: list[str], order: list[str], ddl: str, group) -> DataFrame:
    """Deal df by keys, sort by keys and order, and run group over each key's rows as a stream of dicts."""
    batches(df.sparkSession)
    fields = [(f.name, f.type) for f in arrow_schema(ddl)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in it for row in b.to_pylist())
        held: list[dict] = []
        for key, rows in groupby(stream, key=lambda r: tuple(r[k] for k in keys)):
            for out in group(key, rows):
                held.append(out)
                if len(held) >= 5000:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(fields))
                    held = []
        yield pa.RecordBatch.from_pylist(held, pa.schema(fields))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def _likely(percent: int):
    """Of a bucket's chunk: the documents with a likely partner of another label, whose first shared band this is."""
    least = floor_of(percent)

    def group(key, rows):
        band, at_key = key[0], dict(zip(("band", "key", "chunk", "tile"), key, strict=True))
        nodes, labels, sizes, regs, hit, matrix = [], [], [], [], [], None
        for r in rows:
            mine = np.array(r["bands"], np.int64)
            if not r["role"]:
                nodes.append(r["node"])
                labels.append(r["label"])
                sizes.append(r["n_shingles"])
                regs.append(mine)
                hit.append(False)
                continue
            if not nodes:
                continue
            if matrix is None:
                matrix, known, counts = np.array(regs).view(np.uint16), np.array(labels), np.array(sizes, float)
                words = matrix.view(np.int64)
            n = r["n_shingles"]
            near = (known != r["label"]) & (100 * np.minimum(counts, n) >= percent * np.maximum(counts, n)) & ((words[:, :band] == mine[:band]).sum(axis=1) == 0)
            if near.any():
                at = np.flatnonzero(near)
                same = (matrix[at] == mine.view(np.uint16)).mean(axis=1)
                at = at[estimate(same, counts[at], float(n)) >= least]
                if len(at):
                    for i in at:
                        hit[i] = True
                    yield at_key | {"role": 1, "node": r["node"], "label": r["label"]}
        for node, label, h in zip(nodes, labels, hit, strict=True):
            if h:
                yield at_key | {"role": 0, "node": node, "label": label}

    return group


def _confirmed(percent: int):
    """Exact links between a chunk's buffered documents and those streamed past, one for each pair of labels at most."""

    def group(_, rows):
        held, done = [], set()
        for r in rows:
            mine = np.frombuffer(r["found"], np.uint64)
            if not r["role"]:
                held.append((r["node"], r["label"], mine))
                continue
            for node, label, other in held:
                if label != r["label"] and (label, r["label"]) not in done and linked(mine, other, percent):
                    done |= {(label, r["label"]), (r["label"], label)}
                    yield {"a": label, "b": r["label"]}

    return group


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by 100 * intersection >= percent * union.

    1. A map makes the sets' hashes and HyperMinHash registers. Equal sets, by a 128-bit hash, become one node with a number.
    2. Nodes are dealt by band. In every bucket the node of the least doc_id leads; each node's most frequent leader is confirmed
       on the full sets, and the components of those links found.
    3. Buckets that still hold several components are gone through exactly: all pairs of different components whose
       first shared band it is are estimated, and the likely ones confirmed on full sets. The documents outside a
       bucket's largest component are dealt to chunks, and the whole bucket to tiles; each chunk meets each tile in a
       group of its own, so no task reads a bucket, and no pair list is made.
       A group of thousands of near copies is one component after step 2 and costs nothing here.

    Cases: null and empty texts, and those of white space only, have no set and are linked with nothing; a text of
    fewer than five words is one shingle; very long texts are hashed in blocks; repeated rows are linked as equal
    sets; rows without a doc_id take no part and stay (component_id null, kept); a doc_id that comes with different
    texts is judged by each; an empty table gives no rows; other columns are ignored.
    """
    # step 1
    sig = stored(signatures(docs), "signatures")
    real = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = stored(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc")), "sets")
    own = real.join(sets.withColumn("doc_id", F.col("doc")), ["doc_id", "k1", "k2"]).dropDuplicates(["k1", "k2"])
    nodes = stored(own.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "doc", "n_shingles", "bands"), "nodes")
    # step 2
    in_bands = nodes.select("node", "doc", F.posexplode("bands").alias("band", "key"))
    leaders = in_bands.groupBy("band", "key").agg(F.min_by("node", "doc").alias("leader"), F.count("*").alias("many")).filter("many > 1")
    members = stored(in_bands.join(leaders, ["band", "key"]).select("band", "key", "node", "leader"), "members")
    votes = members.filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
    best = stored(votes.groupBy("node").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader")), "best")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc", "k1", "k2"), "node")
    full = stored(_sets_of(docs, wanted), "full_sets")
    # A leader's set goes to one task for each LED of those that follow it.
    salts = best.groupBy("leader").agg(F.ceil(F.count("*") / LED).cast("int").alias("salts"))
    led = best.join(salts, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    leading = full.select(F.col("node").alias("leader"), F.col("found").alias("other")).join(salts, "leader").select("leader", "other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = led.join(full.select("node", F.col("found").alias("mine")), "node").join(leading, ["leader", "salt"])
    links = stored(arrow_map(pairs, "a long, b long", _verify(percent)), "links")
    labels = components(links)
    # step 3
    placed = stored(members.select("band", "key", "node").join(labels, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label")), "placed")
    held = placed.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    buckets = held.groupBy("band", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    many = lambda c: F.ceil(c / CHUNK).cast("int")
    rows = placed.join(buckets.select("band", "key", "main", many(F.col("all") - F.col("most")).alias("chunks"), many(F.col("all")).alias("tiles")), ["band", "key"])
    every = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    dealt = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    role = lambda chunk, tile, r: F.struct(chunk.alias("chunk"), tile.alias("tile"), F.lit(r).alias("role"))
    past = every("chunks", lambda c: role(c, dealt(1, "tiles"), 1))
    roles = F.when(F.col("label") != F.col("main"), F.concat(every("tiles", lambda t: role(dealt(0, "chunks"), t, 0)), past)).otherwise(past)
    rows = rows.select("band", "key", "node", "label", F.explode(roles).alias("r")).select("band", "key", "node", "label", "r.*")
    rows = rows.join(nodes.select("node", "n_shingles", "bands"), "node")
    key = ["band", "key", "chunk", "tile"]
    likely = _streamed(rows, key, ["role", "node"], "band int, key long, chunk int, tile int, role int, node long, label long", _likely(percent))
    likely = stored(likely, "likely")
    more = _streamed(likely.join(full, "node"), key, ["role", "node"], "a long, b long", _confirmed(percent))
    upper = components(more)
    upper = upper.select(F.col("node").alias("label"), F.col("label").alias("top"))
    # every row's component
    final = placed.select("node", "label").distinct().join(upper, "label", "left").select("node", F.coalesce("top", "label").alias("top"))
    final = stored(final.join(nodes.select("node", "doc", "k1", "k2"), "node"), "tops")
    least = final.groupBy("top").agg(F.min("doc").alias("component_id"))
    final = final.join(least, "top").select("k1", "k2", "component_id")
    out = sig.join(sets.join(final, ["k1", "k2"], "left"), ["k1", "k2"], "left").withColumn("alone", (F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    component = F.when(F.col("alone"), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, found (sorted hashes) of the wanted nodes (node, doc, k1, k2), from their texts."""
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc")

    def rows(it):
        for b in it:
            nodes, sets = [], []
            for node, text, *key in zip(b["node"], b["text"], b["k1"], b["k2"], strict=True):
                s = shingles(text or "").tobytes()
                if _halves(s) == tuple(key):
                    nodes.append(node)
                    sets.append(s)
            yield {"node": nodes, "found": sets}

    return arrow_map(texts, "node long, found binary", rows).dropDuplicates(["node"])


def _halves(found: bytes) -> tuple[int, int]:
    """A set's 128-bit hash as two numbers."""
    key = xxhash.xxh3_128_digest(found)
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def _verify(percent: int):
    def rows(it):
        for b in it:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["mine"], b["other"], strict=True)]
            yield {"a": [n for n, k in zip(b["node"], ok, strict=True) if k], "b": [n for n, k in zip(b["leader"], ok, strict=True) if k]}

    return rows


def deduplicated(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """docs with one document of each group, the one of the least doc_id; columns are as they were, whatever their names.

    Cases: rows of one doc_id that stay are one document: one of them is kept; rows without a doc_id stay; texts that
    are null, empty or of white space only stay; groups are those of near_duplicates; an empty table gives no rows.
    """
    gone_id, unnamed = free_name(docs, "gone_id"), free_name(docs, "unnamed")
    gone = near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
    return left.withColumn(unnamed, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", unnamed]).drop(unnamed)
