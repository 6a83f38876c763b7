"""Operator 9: mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS, MOST = (5, 2, 1), 3
#: Each weight's rate at the start and the end of training, as a multiple of its mean: heavy sources fade, light ones grow.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WORDS = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that deal a source's documents to buckets: 16 to this power parts of even size, whatever the source.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ramps: tuple[tuple[float, float], ...] = RAMPS) -> DataFrame:
    """source, source_size, target, early, late from partial sums (source, size): one row for each source.

    Sources by code point, null last, take the weights in turn. Their shares of all sizes rise together until one
    reaches `most` times its own size: so target = min(most * size, level * weight) with one level for all. The
    sources that stop are those of the least size for their weight, a prefix of that order, so the level comes from
    two running sums. Rows here are sources, already summed up; their order is the only thing one task holds.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    one = one.withColumn("place", place).withColumn("weight", pick(weights)).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    one = one.select(
        "*",
        F.sum("source_size").over(everything).alias("all"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"),
    )
    level = (F.col("all") - F.col("caps_before")).cast("double") / (F.col("weights") - F.col("weights_before"))
    one = one.withColumn("stopped", level * F.col("weight") > F.col("cap"))
    stopped = lambda c, flag: F.sum(F.when(F.col("stopped") == flag, F.col(c)).otherwise(0)).over(everything)
    level = (F.col("all") - stopped("cap", True)).cast("double") / stopped("weight", False)
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return one.select("source", "source_size", target.alias("target"), pick([r[0] for r in ramps]).alias("early"), pick([r[1] for r in ramps]).alias("late"))


def mix(
    docs: DataFrame,
    carry: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    ramps: tuple[tuple[float, float], ...] = RAMPS,
    digits: int = DIGITS,
) -> DataFrame:
    """How many words of each document the mix takes, and where in training its passes begin.

    Returns a row for each row of docs: doc_id, source, size, source_size, target, taken, whole (full passes), more
    (words of a last pass), positions (array of doubles, one for each pass over the document, empty if nothing is
    taken) and the columns in carry, with carry_ before their names.

    A source's documents stand in the order of md5(doc_id); the mix reads through them again and again until the
    target is met, so all are taken floor(target / source_size) times and the first of the order once more, the last
    of them in part: the words taken come within one of the target. No document is taken over `most` times.
    Each source asks for words at a rate that changes linearly over training, target * (early + (late - early) * t)
    for t from 0 to 1. The integral is its cumulative demand; a pass that begins at word c of the source's reading
    stands at the time t at which that demand is c, and its position is the demand of all sources together up to t.

    Cases: a null text has size 0, and documents of size 0 take nothing; null sources are one source, which comes
    last; repeated rows count each; ties of the key go by doc_id and text; an empty table gives no rows.
    A source's running sum is cut at the first hex digits of the key into even buckets, so that no source, however
    large, meets in one task; the result is in the order of the first position (range partitions).
    """
    keep = list(carry)
    rows = docs.select(
        "doc_id",
        F.col("source"),
        words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64("text").alias("tie"),
        *(F.col(c).alias(f"carry_{c}") for c in keep),
    )
    rows = rows.select("*", F.substring("key", 1, digits).alias("bucket"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("of_source"))
    if not keep:
        rows = stored(rows, "sizes")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, weights, most, ramps)
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    # All sources' demand up to t is first * t + second * t * t.
    first, second = (F.sum(F.col("target") * c).over(Window.partitionBy(F.lit(0))) for c in (F.col("early"), (F.col("late") - F.col("early")) / 2))
    targets = targets.select("*", first.alias("first"), second.alias("second"), total.alias("all_targets"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    t, o = targets.alias("t"), offsets.alias("o")
    plan = o.join(t, F.expr("o.source <=> t.source")).select(
        F.col("o.source").isNull().alias("no_source"), F.coalesce("o.source", F.lit("")).alias("of_source"), "bucket", "offset", "source_size", "target", "early", "late", "first", "second"
    )
    # The join and the running sum share their keys, so rows with their texts are dealt once for both.
    dealt = ["no_source", "of_source", "bucket"]
    rows = rows.join(plan, dealt)
    inside = Window.partitionBy(*dealt).orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("begin", F.col("offset") + F.col("inside"))
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size")) - F.col("begin")
    rows = rows.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("more"))
    passes = F.when(F.col("size") > 0, F.col("whole") + (F.col("more") > 0).cast("long")).otherwise(0)

    def position(k: Column) -> Column:
        u = (k * F.col("source_size") + F.col("begin")) / F.col("target")
        # early * t + (late - early) / 2 * t * t = u, in the form that also holds where early = late
        at = 2 * u / (F.col("early") + F.sqrt(F.col("early") * F.col("early") + 2 * (F.col("late") - F.col("early")) * u))
        return F.col("first") * at + F.col("second") * at * at

    positions = F.transform(F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1)).otherwise(F.array().cast("array<long>")), position)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "whole", "more", positions.alias("positions"), *(f"carry_{c}" for c in keep))


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sort by the first position; documents that take nothing come last."""
    first = F.get("positions", F.lit(0))
    return mixed.withColumn("first_position", first).orderBy(F.asc_nulls_last("first_position"), "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as training reads them: a row for each pass over a document, range-sorted by position, columns as they were.

    The one pass of a source that its target cuts short holds the first words only, with single spaces between.
    n_chars is set anew for it where it is a column.

    Cases: documents without a word (null, empty or blank texts), and those that the mix takes nothing of, have no row;
    repeated rows are read each; a null doc_id or source stays null; equal positions go by doc_id; columns of any names come out as they were; an empty table gives no rows.
    """
    columns = docs.columns
    rows = mix(docs, tuple(columns)).select("*", F.posexplode("positions").alias("pass", "position"))
    cut = (F.col("pass") == F.col("whole")) & (F.col("more") < F.col("size"))
    short = F.array_join(F.slice(F.regexp_extract_all("carry_text", F.lit(f"({WORDS})"), 1), 1, F.col("more").cast("int")), " ")
    rows = rows.withColumn("cut", cut).withColumn("carry_text", F.when(cut, short).otherwise(F.col("carry_text")))
    if "n_chars" in columns:
        rows = rows.withColumn("carry_n_chars", F.when(F.col("cut"), F.length("carry_text").cast("long")).otherwise(F.col("carry_n_chars")))
    return rows.orderBy("position", "doc_id").select(*(F.col(f"carry_{c}").alias(c) for c in columns))
