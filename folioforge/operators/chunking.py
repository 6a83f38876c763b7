"""Chunks of documents: greedy packing of sentences with an overlap of characters, and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_sentences, strip

SIZE, OVERLAP = 900, 180
#: UUID namespace of URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def windows(sentence: Column, size: int, overlap: int) -> Column:
    """Fixed windows of a sentence that is longer than a chunk."""
    starts = F.sequence(F.lit(0), F.length(sentence) - 1, F.lit(max(1, size - overlap)))
    return F.filter(F.transform(starts, lambda s: strip(F.substring(sentence, s + 1, F.lit(size)))), lambda w: w != "")


def chunk_text(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks in order. One that overflows is closed, and its last `overlap` characters begin the next one, which is not measured again; after the windows of a long sentence nothing is carried over."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    state = "struct<done:array<string>,held:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    closed = lambda s: F.when(s["held"] != "", F.array_append(s["done"], s["held"])).otherwise(s["done"])
    tail = lambda s: strip(F.concat(strip(F.right(s["held"], F.lit(overlap))), F.lit(" "))) if overlap else F.lit("")

    def step(s: Column, sentence: Column) -> Column:
        joined = F.when(s["held"] == "", sentence).otherwise(F.concat(s["held"], F.lit(" "), sentence))
        after = strip(F.concat(tail(s), F.lit(" "), sentence))
        long = F.struct(F.concat(closed(s), windows(sentence, size, overlap)).alias("done"), F.lit("").alias("held"))
        fits = F.struct(s["done"].alias("done"), joined.alias("held"))
        over = F.struct(closed(s).alias("done"), after.alias("held"))
        return F.when(F.length(sentence) > size, long).when(F.length(joined) <= size, fits).otherwise(over).cast(state)

    return F.aggregate(split_sentences(text), start.cast(state), step, closed)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID: SHA-1 of namespace and name with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(path: Column, index: Column, text: Column) -> Column:
    return uuid5(F.concat(path, F.lit(":"), index.cast("string"), F.lit(":"), text))


def build_chunks(docs: DataFrame, path: str, source_name: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, overrides: DataFrame | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """source_path, source_name, chunk_index, text, chunk_id, and metadata if any is given; documents without text give no chunk.

    overrides (path, name) give sources another name.
    """
    rows = docs.select(F.col(path).cast("string").alias("source_path"), F.col(source_name).alias("source_name"), F.posexplode(chunk_text(F.col(text), size, overlap)).alias("chunk_index", "text"))
    if overrides is not None:
        named = overrides.groupBy(F.col("path").cast("string").alias("source_path")).agg(F.max("name").alias("other"))
        rows = rows.join(named, "source_path", "left").withColumn("source_name", F.coalesce(F.nullif("other", F.lit("")), "source_name")).drop("other")
        rows = rows.select("source_path", "source_name", "chunk_index", "text")
    rows = rows.withColumn("chunk_id", chunk_id(F.col("source_path"), F.col("chunk_index"), F.col("text")))
    return rows.withColumn("metadata", F.create_map(*(F.lit(x) for kv in metadata.items() for x in kv))) if metadata else rows
