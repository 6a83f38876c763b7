"""Operator 12: ranked lexical search by block-max pruning over blocks of neighbouring documents."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, stored

TOP = 20
#: Runs of letters and digits of ASCII, and of all other characters, over UTF-8.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A block is closed at so many documents or postings; one document's postings stay together.
BLOCK_DOCS, BLOCK_POSTINGS = 64, 1 << 16
#: Blocks of a file of the index, which a reader may decode as a whole.
FILE_BLOCKS = 256
#: Blocks, and postings, among which a task looks for a query's best blocks at a time.
GROUP_BLOCKS, GROUP_POSTINGS = 64, 4 << 20
#: Query terms that are sent to the tasks at a time; more queries go through in several scans of the index.
MOST_TERMS = 1 << 20
#: One block of so many gives each query a score from below before all blocks are gone through.
SAMPLED = 16

INDEX = (
    "block long, docs array<long>, lengths array<long>, terms array<string>, holders array<int>, most array<int>, shortest array<long>, "
    "ends array<int>, slots array<int>, freqs array<int>"
)


def terms_of(text: str) -> list[bytes]:
    """All terms of a text in their order, A-Z in lower case."""
    return TERM.findall(text.encode("utf-8", "replace").lower())


class _Open:
    """A block that documents are added to."""

    def __init__(self) -> None:
        self.docs, self.lengths, self.ends, self.slot = [], [], [0], {}
        self.slots, self.freqs = array("i"), array("i")

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        slot = self.slot
        for term, n in Counter(found).items():
            self.slots.append(slot.setdefault(term, len(slot)))
            self.freqs.append(n)
        self.docs.append(doc_id)
        self.lengths.append(len(found))
        self.ends.append(len(self.slots))

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or len(self.slots) >= BLOCK_POSTINGS

    def row(self, block: int) -> dict[str, list]:
        slots, freqs = np.array(self.slots), np.array(self.freqs)
        of = np.repeat(np.array(self.lengths, np.int64), np.diff(self.ends))
        order = np.argsort(slots, kind="stable")
        starts = np.searchsorted(slots[order], np.arange(len(self.slot)))
        most, shortest = np.maximum.reduceat(freqs[order], starts), np.minimum.reduceat(of[order], starts)
        return {
            "block": [block], "docs": [self.docs], "lengths": [self.lengths], "terms": pa.array([list(self.slot)], pa.list_(pa.string())), "holders": [np.bincount(slots)],
            "most": [most], "shortest": [shortest], "ends": [self.ends], "slots": [slots], "freqs": [freqs],
        }


def block_index(docs: DataFrame) -> DataFrame:
    """The index, stored: a row for each block of neighbouring documents in the order of the table.

    A block's head has its terms, how many of its documents hold each, and for each the greatest frequency and the
    least length of a document that holds it, which bound its part in any score from above under any statistics. Its forward part
    has each document's terms and frequencies. Documents without a term are left out. Nothing is shuffled; a row is of
    bounded size but for a single document's terms.
    """

    def rows(it):
        number, held = TaskContext.get().partitionId() << 32, _Open()
        for b in it:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                if found := terms_of(text):
                    held.add(doc_id, found)
                    if held.full():
                        yield held.row(number)
                        number, held = number + 1, _Open()
        if held.docs:
            yield held.row(number)

    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    return stored(arrow_map(texts, INDEX, rows), "lexical", compression="zstd", rows_a_file=FILE_BLOCKS)


@dataclass
class Asked:
    """Some queries: their ids, and their terms as places in a vocabulary with how often each occurs."""

    first: int
    ids: list = field(default_factory=list)
    place: dict[bytes, int] = field(default_factory=dict)
    starts: list[int] = field(default_factory=lambda: [0])
    at: array = field(default_factory=lambda: array("i"))
    times: array = field(default_factory=lambda: array("q"))

    def add(self, item_id, found: list[bytes]) -> None:
        for term, n in Counter(found).items():
            self.at.append(self.place.setdefault(term, len(self.place)))
            self.times.append(n)
        self.ids.append(item_id)
        self.starts.append(len(self.at))

    def vocabulary(self) -> pa.Array:
        return pa.array(list(self.place), pa.string())


def asked_in_parts(items: DataFrame) -> Iterator[Asked]:
    """Queries (item_id, text) in parts of at most MOST_TERMS terms or one query; those without a term are left out."""
    held = Asked(0)
    for r in items.filter(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        if found := terms_of(r["text"]):
            held.add(r["item_id"], found)
            if len(held.at) >= MOST_TERMS:
                yield held
                held = Asked(held.first + len(held.ids))
    if held.ids:
        yield held


@dataclass
class Statistics:
    """Documents with a term, their terms in all, and the weight of each term of a vocabulary."""

    n: int
    total: int
    weights: np.ndarray

    def parts(self, places: np.ndarray, freqs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What postings add to a score: whole numbers, greater for a greater frequency and a smaller length."""
        m = 75 + (25 * lengths * self.n) // self.total
        tf = freqs.astype(np.int64)
        return self.weights[places] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def statistics(index: DataFrame, asked: Asked) -> Statistics:
    """From the heads of all blocks; a number for each term of the vocabulary comes to the driver."""
    sent, many = index.sparkSession.sparkContext.broadcast(asked.vocabulary()), len(asked.place)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, total = np.zeros(many, np.int64), 0, 0
        for b in it:
            at = pc.index_in(b.column("terms").flatten(), sent.value)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(found, at.drop_null().to_numpy(), b.column("holders").flatten().to_numpy()[known])
            lengths = b.column("lengths").flatten().to_numpy()
            n, total = n + len(lengths), total + int(lengths.sum())
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int32()), pa.array([n, total, *found[held].tolist()], pa.int64())], names=["term", "n"])

    got = {r["term"]: r["n"] for r in index.select("terms", "holders", "lengths").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-2, 0)
    weight = lambda df: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return Statistics(n, got.get(-1, 0), np.array([weight(got.get(k, 0)) for k in range(many)], np.int64))


class Block:
    """A block as a search sees it: the vocabulary's terms of its head, and its forward part on demand."""

    def __init__(self, row: dict, vocabulary: pa.Array, facts: Statistics):
        at = pc.index_in(row["terms"], vocabulary)
        self.row, self.facts = row, facts
        self.slots = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        self.places = at.drop_null().to_numpy()
        self.bounds = facts.parts(self.places, row["most"].to_numpy()[self.slots], row["shortest"].to_numpy()[self.slots])
        self._scores: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Each of its documents' parts for each of its terms of the vocabulary, terms in the order of their places."""
        if self._scores is None:
            local = np.full(len(self.row["terms"]), -1, np.int32)
            order = np.argsort(self.places, kind="stable")
            local[self.slots[order]] = np.arange(len(order))
            lengths = self.row["lengths"].to_numpy()
            slots, freqs = self.row["slots"].to_numpy(), self.row["freqs"].to_numpy()
            doc = np.repeat(np.arange(len(lengths)), np.diff(self.row["ends"].to_numpy()))
            mine = np.flatnonzero(local[slots] >= 0)
            places = self.places[order]
            out = np.zeros((len(order), len(lengths)), np.int64)
            out[local[slots[mine]], doc[mine]] = self.facts.parts(places[local[slots[mine]]], freqs[mine], lengths[doc[mine]])
            self._scores = places, out
        return self._scores


class Best:
    """A query's best documents so far; `least` is what a document must have at least."""

    def __init__(self, least: int, most: int):
        self.least, self.most = max(1, least), most
        self.scores, self.docs, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        on = scores >= self.least
        if not on.any():
            return
        s, d, e = (np.concatenate([x, y[on]]) for x, y in ((self.scores, scores), (self.docs, docs), (self.null, null)))
        order = np.lexsort((d, e, -s))[: self.most]
        self.scores, self.docs, self.null = s[order], d[order], e[order]
        if len(order) == self.most:
            self.least = max(self.least, int(self.scores[-1]))


def search_blocks(blocks: list[Block], asked: Asked, best: list[Best]) -> int:
    """Go through blocks for each query, the one of the greatest bound first, until none can have a document that counts; (query, block) pairs scored."""
    present = np.unique(np.concatenate([b.places for b in blocks]))
    if not len(present):
        return 0
    bounds = np.zeros((len(present), len(blocks)), np.int64)
    for k, b in enumerate(blocks):
        bounds[np.searchsorted(present, b.places), k] = b.bounds
    at, times, scored = np.frombuffer(asked.at, np.int32), np.frombuffer(asked.times, np.int64), 0
    row = np.minimum(np.searchsorted(present, at), len(present) - 1)
    hit = present[row] == at
    for q, mine in enumerate(best):
        part = slice(asked.starts[q], asked.starts[q + 1])
        on = hit[part]
        if not on.any():
            continue
        of = times[part][on]
        bound = of @ bounds[row[part][on]]
        if bound.max() < mine.least:
            continue
        wanted = at[part][on]
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < mine.least:
                break
            scored += 1
            places, parts = blocks[k].scores()
            here = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            same = places[here] == wanted
            docs = blocks[k].row["docs"]
            mine.add(of[same] @ parts[here[same]], docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False))
    return scored


_SEARCHED = ("docs", "lengths", "terms", "most", "shortest", "ends", "slots", "freqs")


def _groups(it: Iterable[pa.RecordBatch], vocabulary: pa.Array, facts: Statistics) -> Iterator[list[Block]]:
    held, postings = [], 0
    for b in it:
        for k in range(b.num_rows):
            row = {c: b.column(c)[k].values for c in _SEARCHED}
            held.append(Block(row, vocabulary, facts))
            postings += len(row["slots"])
            if len(held) >= GROUP_BLOCKS or postings >= GROUP_POSTINGS:
                yield held
                held, postings = [], 0
    if held:
        yield held


def _found(index: DataFrame, asked: Asked, facts: Statistics, least: np.ndarray, top: int) -> DataFrame:
    """query (number), doc_id, score: from each task what can be among a query's first `top`."""
    sent = index.sparkSession.sparkContext.broadcast((asked, facts, least))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, facts, least = sent.value
        best = [Best(int(x), top) for x in least]
        for group in _groups(it, asked.vocabulary(), facts):
            search_blocks(group, asked, best)
        number = np.repeat(np.arange(len(best)), [len(b.scores) for b in best]) + asked.first
        put = lambda name: np.concatenate([getattr(b, name) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(put("docs"), mask=put("null")), pa.array(put("scores"))], names=["query", "doc_id", "score"])

    return index.select(*_SEARCHED).mapInArrow(run, "query long, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of an index with the highest scores above 0 for each item.

    Queries are sent to the blocks, MOST_TERMS terms a scan. The blocks of a sample give each query the score that it
    reaches in any case; then each task puts its blocks in the order of a query's bounds, the sum of its terms' block
    maxima, and scores documents until the bound is below the score that counts. Results are the same whatever the blocks are.
    """
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType
    out = []
    for asked in asked_in_parts(items):
        facts = statistics(index, asked)
        least = np.zeros(len(asked.ids), np.int64)
        sample = index.filter(F.pmod(F.xxhash64("block"), F.lit(SAMPLED)) == 0)
        for r in _ranked(_found(sample, asked, facts, least, top), top).filter(F.col("rank") == top).collect():
            least[r["query"] - asked.first] = r["score"]
        schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", kind)])
        names = spark.createDataFrame([(asked.first + k, i) for k, i in enumerate(asked.ids)], schema)
        found = _ranked(_found(index, asked, facts, least, top), top)
        out.append(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, out)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index all documents and rank them for each item (see block_index, search).

    Cases: a null, empty or termless text is neither a document nor a query; items whose terms no document has have no
    row; equal scores go by doc_id, rows without one last; a repeated document counts and is ranked as often as it
    comes, a repeated item has its rows as often; empty tables give no rows; texts of any length are taken whole; other
    columns are not read.
    """
    return search(block_index(docs), items, top)
