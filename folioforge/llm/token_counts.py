"""Operator 5: token counts of whole texts, without materialising ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from .common import arrow_map, stored, text_or_empty
from .pieces import byte_vocabulary

LIMIT = 1024


def piece_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """term, n, pieces: every distinct pre-token of the corpus, its frequency, and its number of tokens, found once."""

    def sized(it):
        size = byte_vocabulary(vocabulary).size
        for b in it:
            yield {"term": b["term"], "n": b["n"], "pieces": [size(t) for t in b["term"]]}

    found = terms.counted(docs.select(F.coalesce("text", F.lit("")).alias("text")), lambda t: byte_vocabulary(vocabulary).pretokens(t))
    return stored(arrow_map(found, "term string, n long, pieces long", sized), "pieces")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, hot: int = 2 * terms.HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every text under the byte vocabulary at `vocabulary`.

    Distinct pre-tokens are counted over all documents and merged once each; documents bring their pre-token
    frequencies, which are joined to those counts and summed (see terms). A null or empty text has 0 bytes and 0
    tokens; special strings in a text are one token each; a null doc_id stays null; repeated rows give repeated rows;
    an empty table gives none; other columns are ignored.
    """
    table = piece_counts(docs, vocabulary)
    split = lambda t: byte_vocabulary(vocabulary).pretokens(t)
    extra = lambda texts, _: ([len(t.encode("utf-8", "replace")) for t in texts], [0.0] * len(texts))
    out = terms.summed(text_or_empty(docs), table, "pieces", terms.hottest(table, "pieces", hot), split, extra)
    n = F.col("total").cast("long")
    return out.select("doc_id", F.col("x").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))
