"""Operator 1: BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, text_or_empty
from .pieces import word_vocabulary

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WHOLE = "doc_id long, n_tokens long, ids array<int>, decoded string"


IDS = "doc_id long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids only; cases as in encode_decode."""

    def rows(it):
        make = word_vocabulary(vocabulary).encode
        for b in it:
            packed = [make(t)[0] for t in b["text"]]
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield {"doc_id": b["doc_id"], "n_tokens": sizes.tolist(), "ids": ids}

    return arrow_map(text_or_empty(docs), IDS, rows)


def encode_decode(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Encode every text with the word vocabulary at the path `vocabulary`, and decode the ids again.

    Returns one row per input row: doc_id, n_tokens, then ids and decoded (or, with digests, their SHA-256 only:
    ids as little-endian unsigned 32-bit integers, the decoded text as UTF-8). A null or empty text, or one of white
    space only, has 0 tokens and the empty text. A null doc_id stays null; repeated rows give repeated rows; other
    columns are ignored. Words are merged in a contiguous rank array; words of over 160 bytes take a heap with the
    same result. A worker keeps the ids of up to 250,000 words and pieces, so memory is bounded.
    The operator is one map without a shuffle.
    """

    def rows(it):
        encode = word_vocabulary(vocabulary).encode
        for b in it:
            out = [encode(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "n_tokens": [len(i) // 4 for i, _ in out]} | (
                {"ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in out], "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in out]}
                if digests
                else {"ids": [array("I", i).tolist() for i, _ in out], "decoded": [d for _, d in out]}
            )

    return arrow_map(text_or_empty(docs), DIGESTS if digests else WHOLE, rows)
