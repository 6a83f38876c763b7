"""Corpus-wide term tables, and sums of a term's value over each document without materialising its tokens.

Terms are counted once over all documents. The most frequent HOT of them, of HOT_BYTES in all, go to the workers as one
dictionary of bounded size; all others are joined by term. So no hot term meets in one task, long separator lines
included, and what is broadcast does not grow with the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

HOT, HOT_BYTES = 1 << 17, 24 << 20
#: Distinct terms that a task holds before it passes on what it has counted.
FLUSH = 400_000


def counted(texts: DataFrame, split: Callable[[str], Iterable[str]]) -> DataFrame:
    """term, n over all rows of texts; tasks add up what they have read before the shuffle."""

    def rows(it):
        held: Counter[str] = Counter()
        for b in it:
            for t in b["text"]:
                held.update(split(t))
                if len(held) > FLUSH:
                    yield {"term": list(held), "n": list(held.values())}
                    held = Counter()
        yield {"term": list(held), "n": list(held.values())}

    return arrow_map(texts.select("text"), "term string, n long", rows).groupBy("term").agg(F.sum("n").alias("n"))


def hottest(terms: DataFrame, value: str, most: int = HOT) -> dict[str, float]:
    """The most frequent terms with their values, at most `most` and HOT_BYTES of UTF-8 in all: a bounded dictionary.

    A histogram over n, in 16 steps to a doubling, says from which step on terms are few and short enough; a filter takes them. So
    no task sorts or gathers terms. A term that takes a sixteenth of the bytes or more is left to the join: it costs there no more than its texts do.
    """
    step = F.floor(F.log2(F.col("n")) * 16)
    short = terms.filter((F.octet_length("term") < HOT_BYTES // 16) & (F.col("n") > 0)).withColumn("step", step)
    left, room, least = most, HOT_BYTES, None
    for row in sorted(short.groupBy("step").agg(F.count("*").alias("count"), F.sum(F.octet_length("term")).alias("bytes")).collect(), key=lambda r: -r["step"]):
        if row["count"] > left or row["bytes"] > room:
            break
        left, room, least = left - row["count"], room - row["bytes"], row["step"]
    if least is None:
        return {}
    got = short.filter(F.col("step") >= least).select("term", value).toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def summed(texts: DataFrame, terms: DataFrame, value: str, hot: dict[str, float], split: Callable[[str], list[str]], extra: Callable[[list[str], list[list[str]]], tuple[list[int], list[float]]]) -> DataFrame:
    """A row for each row of texts (doc_id, text): doc_id, n_terms, total and found over its terms, and x and y of `extra`.

    total: the sum of the values of its terms that the table has; found: how many of its terms those are; terms
    count as often as they occur. extra gets the texts of a batch and their terms, and gives a whole number and a
    double for each. n_terms is the number of all terms. Each distinct term of a text that is not hot is a row, once,
    with its frequency. Rows that agree in doc_id and text are equal in every result; they are counted and given back as often.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(hot)

    def rows(it):
        get = sent.value.get
        for b in it:
            parts = [split(t) for t in b["text"]]
            xs, ys = extra(b["text"], parts)
            own: dict[str, list] = {c: [] for c in ("doc_id", "key", "term", "freq", "total", "found", "n_terms", "x", "y", "one")}
            cold_of, cold_terms, cold_freqs = [], [], []
            for k, (doc, text, found) in enumerate(zip(b["doc_id"], b["text"], parts, strict=True)):
                total, known = 0.0, 0
                for term, n in Counter(found).items():
                    if (v := get(term)) is None:
                        cold_of.append(k)
                        cold_terms.append(term)
                        cold_freqs.append(n)
                    else:
                        total += v * n
                        known += n
                key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)
                # The document's own row: a name that no term has, so that it joins nothing and lands anywhere.
                for c, v in zip(own, (doc, key, f"\0{doc}/{key}/{k}", 0, total, known, len(found), xs[k], ys[k], 1), strict=True):
                    own[c].append(v)
            yield own
            for at in range(0, len(cold_of), 20_000):
                of, many = cold_of[at : at + 20_000], len(cold_of[at : at + 20_000])
                whole, real = np.zeros(many, np.int64), np.zeros(many)
                yield {
                    "doc_id": [b["doc_id"][k] for k in of], "key": [own["key"][k] for k in of], "term": cold_terms[at : at + many], "freq": cold_freqs[at : at + many],
                    "total": pa.array(real), "y": pa.array(real), **{c: pa.array(whole) for c in ("found", "n_terms", "x", "one")},
                }

    cold = arrow_map(texts, "doc_id long, key long, term string, freq long, total double, found long, n_terms long, x long, y double, one long", rows)
    joined = cold.join(terms.select("term", F.col(value).cast("double").alias("value")), "term", "left")
    hit = F.col("value").isNotNull()
    parts = joined.groupBy("doc_id", "key").agg(
        F.sum("one").alias("times"),
        F.sum(F.col("total") + F.when(hit, F.col("value") * F.col("freq")).otherwise(0.0)).alias("total"),
        F.sum(F.col("found") + F.when(hit, F.col("freq")).otherwise(0)).alias("found"),
        *(F.sum(c).alias(c) for c in ("n_terms", "x", "y")),
    )
    # Equal rows have been added up: each gets its share.
    share = lambda c: (F.col(c) / F.col("times")).alias(c)
    count = lambda c: F.expr(f"{c} div times").alias(c)
    return parts.select("doc_id", share("total"), count("found"), count("n_terms"), count("x"), share("y"), F.explode(F.expr("array_repeat(0, int(times))")).alias("copy")).drop("copy")
