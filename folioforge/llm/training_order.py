"""Operator 2: token ids in training order, as fixed-stride binary shards."""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attention import Subwords
from .common import arrow_map, arrow_schema, batches, partitions, stored, text_or_empty
from .neardup import mixed
from .pieces import ByteVocabulary, _Filled, odd_blanks

#: Tokens of a sequence, sequences of a shard, and most shards (of 2 MB) that a task writes.
LENGTH, PER_SHARD, RANGE = 1024, 1024, 64
ROUNDS, KEY = 4, 0x5EED


@lru_cache(maxsize=2)
def _packed_runs(path: str) -> _Filled:
    sub = Subwords(path)
    return _Filled(lambda run: array(sub.code, sub.encode(run)).tobytes(), 400_000)


def packed_ids(path: str, text: str) -> bytes:
    """Ids of a text under a rank file, as little-endian integers of the vocabulary's width; special strings are ordinary text."""
    if odd_blanks(text):
        return array(Subwords(path).code, Subwords(path).encode(text)).tobytes()
    return b"".join(map(_packed_runs(path).__getitem__, ByteVocabulary.RUNS.findall(text)))


def permuted(ordinals: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: a balanced Feistel network over the least even number of bits, walked on while outside.

    The network permutes 0 .. 4 ** half - 1, which is less than 4 n; applying it again to values of n and more until
    they fall below n permutes 0 .. n - 1.
    """
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    x = ordinals.astype(np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        x[todo] = left << shift | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """part, row, n_tokens, doc_ids, starts, first_from, ids: every document's ids and an end id, one behind the other, cut into sequences of `length` tokens.

    Documents that follow each other in a part of the scan share sequences, so only the last sequence of a part can be
    shorter. doc_ids has the document of each piece of a sequence, starts the token of the sequence at which the piece
    begins, first_from the token of its document at which the first piece begins (later pieces begin theirs). ids are
    little-endian integers of the vocabulary's width (see Subwords.code). part and row number the sequences as they
    were written; the table is stored, so the numbers stay.
    """

    def rows(it):
        sub = Subwords(vocabulary)
        wide, size, end = length * array(sub.code).itemsize, array(sub.code).itemsize, array(sub.code, [sub.end]).tobytes()
        part, at, held, pieces, out = TaskContext.get().partitionId(), 0, bytearray(), [], []

        def close():
            nonlocal at, held, pieces
            docs_, starts, froms = zip(*pieces, strict=True)
            out.append((part, at, len(held) // size, list(docs_), list(starts), froms[0], bytes(held)))
            at, held, pieces = at + 1, bytearray(), []

        def flushed():
            nonlocal out
            now, out = out, []
            return dict(zip(("part", "row", "n_tokens", "doc_ids", "starts", "first_from", "ids"), map(list, zip(*now, strict=True)), strict=True))

        for b in it:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids, k = packed_ids(vocabulary, text) + end, 0
                while k < len(ids):
                    pieces.append((doc, len(held) // size, k // size))
                    more = ids[k : k + wide - len(held)]
                    held += more
                    k += len(more)
                    if len(held) == wide:
                        close()
            if out:
                yield flushed()
        if held:
            close()
            yield flushed()

    return stored(arrow_map(text_or_empty(docs), "part int, row long, n_tokens int, doc_ids array<long>, starts array<int>, first_from long, ids binary", rows), "sequences", "zstd")


def _packer(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """What short records of ids have in common, for their way through the shuffle; None where there are too few."""
    try:
        return zstandard.train_dictionary(32 << 10, sample)
    except zstandard.ZstdError:
        return None


def _unpacker(common: bytes | None) -> Callable[[bytes], bytes]:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(common) if common else None).decompress


def training_order(docs: DataFrame, vocabulary: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """slot, shard, offset, n_tokens, doc_ids, starts, first_from, ids: every sequence (see sequences) at its place in training, in range partitions of whole shards, sorted by slot.

    Sequences are numbered by the table's parts, and the keyed permutation gives each number its slot; slot //
    per_shard is its shard and slot % per_shard its place there. Counts of parts are one number a task.
    A table that is split into other parts (other files, another maxPartitionBytes) has other sequences, and another order.
    Cases: a null or empty text is an end id alone; repeated rows are encoded as often; a null doc_id stays null in
    doc_ids; an empty table gives no rows; other columns are ignored; texts of any length are cut.
    """
    placed, common = _placed(docs, vocabulary, length, per_shard, key)

    @F.pandas_udf("binary")
    def unpacked(packed: pd.Series) -> pd.Series:
        return packed.map(_unpacker(common))

    return placed.select(*(c for c in placed.columns if c != "packed"), unpacked("packed").alias("ids"))


def _placed(docs: DataFrame, vocabulary: str, length: int, per_shard: int = PER_SHARD, key: int = KEY) -> tuple[DataFrame, bytes | None]:
    """training_order with compressed ids, and what they were compressed with."""
    table = sequences(docs, vocabulary, length)
    parts = table.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    n = table.count()

    @F.pandas_udf("long")
    def slot(ordinal: pd.Series) -> pd.Series:
        return pd.Series(permuted(ordinal.to_numpy(), n, key))

    # Any few sequences will do: they make the rest smaller on its way, and nothing else.
    trained = _packer([bytes(r["ids"]) for r in table.select("ids").limit(600).collect()])
    common = trained.as_bytes() if trained else None

    @F.pandas_udf("binary")
    def packed(ids: pd.Series) -> pd.Series:
        held = zstandard.ZstdCompressionDict(common) if common else None
        if held:
            held.precompute_compress(level=6)  # else each record would take it in anew
        return ids.map(zstandard.ZstdCompressor(level=6, dict_data=held).compress)

    placed = table.join(F.broadcast(starts), "part").withColumn("slot", slot(F.col("before") + F.col("row")))
    placed = placed.select("slot", F.expr(f"slot div {per_shard}").alias("shard"), (F.col("slot") % per_shard).alias("offset"), "n_tokens", "doc_ids", "starts", "first_from", packed("ids").alias("packed"))
    shards = max(1, -(-n // per_shard))
    ranges = max(min(shards, partitions(docs.sparkSession)), -(-shards // RANGE))
    return placed.repartitionById(ranges, F.expr(f"int(shard * {ranges} div {shards})")).sortWithinPartitions("slot"), common


def _same(store, path: str, size: int, digest: str) -> bool:
    """Whether a file is there with these bytes."""
    if store.get_file_info(path).size != size:
        return False
    held = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while part := f.read(1 << 20):
            held.update(part)
    return held.hexdigest() == digest


def _written(it: Iterator[pa.RecordBatch], folder: str, vocabulary: str, length: int, ids_of: Callable[[dict], bytes]) -> Iterator[tuple[dict, list[dict]]]:
    """Write the shards of a partition; the manifest's row of each, and its sequences without their ids."""
    from pyarrow import fs

    sub = Subwords(vocabulary)
    fill = array(sub.code, [sub.size]).tobytes()
    record = length * len(fill)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    stream = (r for b in it for r in b.to_pylist())
    for shard, rows in groupby(stream, key=lambda r: r["shard"]):
        path, digest, placed = f"{root}/shard-{shard:08d}.bin", hashlib.sha256(), []
        held = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(held) as f:
            for r in rows:
                ids = ids_of(r)
                data = ids + fill * ((record - len(ids)) // len(fill))
                f.write(data)
                digest.update(data)
                placed.append(r)
        if _same(store, path, len(placed) * record, digest.hexdigest()):
            store.delete_file(held)
        else:
            store.move(held, path)
        yield {"shard": shard, "path": path, "sequences": len(placed), "tokens": sum(r["n_tokens"] for r in placed), "sha256": digest.hexdigest()}, placed


def write_shards(ordered: DataFrame, folder: str, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Write each shard of training_order as a file of records of `length` ids, and return the manifest.

    shard, path, sequences, tokens, sha256. Record k of a shard begins at byte k * length * 2 (4 for vocabularies of
    65,535 ids and more), so a reader resumes at any slot. A short record is filled up with an id behind the end id,
    which no text has. A file is written under another name and renamed, so a lost executor leaves no half shard; one
    that is there already with the same bytes is kept, any other is replaced. An empty table writes nothing. Files
    that an earlier run with more shards left in the folder stay there; the manifest says which ones belong to this run.
    """
    ddl = "shard long, path string, sequences long, tokens long, sha256 string"
    schema = pa.schema([(f.name, f.type) for f in arrow_schema(ddl)])
    batches(ordered.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in _written(it, folder, vocabulary, length, lambda r: r.pop("ids")):
            yield pa.RecordBatch.from_pylist([row], schema)

    return ordered.select("shard", "n_tokens", "ids").mapInArrow(run, ddl)


def written_order(docs: DataFrame, folder: str, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Write the shards of the documents' training order, in the same pass that gives every sequence's place and its shard's manifest.

    slot, shard, offset, n_tokens, doc_ids, starts, first_from, ids_sha256, path, shard_sha256. ids_sha256 is that of
    the ids read back from the sequence's record, without what fills it up. Files and cases are those of write_shards
    and training_order.
    """
    ddl = "slot long, shard long, offset long, n_tokens int, doc_ids array<long>, starts array<int>, first_from long, ids_sha256 string, path string, shard_sha256 string"
    schema = pa.schema([(f.name, f.type) for f in arrow_schema(ddl)])
    batches(docs.sparkSession)
    placed, common = _placed(docs, vocabulary, length)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        size, unpack = array(Subwords(vocabulary).code).itemsize, _unpacker(common)
        for shard, rows in _written(it, folder, vocabulary, length, lambda r: unpack(r.pop("packed"))):
            with store.open_input_stream(shard["path"]) as f:
                for r in rows:
                    ids = f.read(length * size)[: r["n_tokens"] * size]
                    r |= {"ids_sha256": hashlib.sha256(ids).hexdigest(), "path": shard["path"], "shard_sha256": shard["sha256"]}
            yield pa.RecordBatch.from_pylist(rows, schema)

    return placed.mapInArrow(run, ddl)
