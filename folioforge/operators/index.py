"""Chunk index: replace by source, upsert by chunk id, fixed dimension and layout, changes that are there as a whole; postings; and user rows.

A collection is dealt by the hash of source_name to folders, its buckets; a bucket has as many files as its rows ask for. An
ingest writes changed buckets beside the index, then a journal that names them, then moves them to their places. The journal is the
switch: before it the old rows hold, from it on the new ones, also for readers that come while folders are moved or
after a driver that was lost. What a journal left undone is done by the next ingest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Files, stored
from .retrieval import token_postings

#: Buckets of a new collection, and rows of a file of a bucket, about.
BUCKETS, FILE_ROWS = 64, 25_000


def latest(chunks: DataFrame, key: str = "chunk_id", order: str = "chunk_index") -> DataFrame:
    """The last row of each key."""
    return chunks.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("nth = 1").drop("nth")


def replace_by_source(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old whose source does not come again and whose id is not written again, and all of new. An empty new deletes nothing; of equal ids in new the last counts."""
    kept = old.join(new.select("source_name").distinct(), "source_name", "left_anti").join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return kept.select(*new.columns).unionByName(latest(new))


def check_dimension(chunks: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return chunks.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(F.raise_error(F.lit(f"embedding must have {dim} components"))))


def _beside(folder: str, what: str) -> str:
    return f"{folder.rstrip('/')}.{what}"


def _facts(spark: SparkSession, folder: str, collection: str) -> dict:
    """What a collection was made with: dim, buckets, postings; empty for none."""
    files = Files(spark, _beside(folder, "collections"))
    return json.loads(files.read(f"{collection}.json")) if files.exists(f"{collection}.json") else {}


def dimension(spark: SparkSession, folder: str, collection: str) -> int | None:
    """The number of components that a collection was made with, which is kept beside the index; null for none."""
    return _facts(spark, folder, collection).get("dim")


def _journal(spark: SparkSession, folder: str, collection: str) -> dict:
    """What has been switched but not moved yet: {staging, roots: {root: {bucket: filled}}}; empty for nothing."""
    files = Files(spark, _beside(folder, "journal"))
    return json.loads(files.read(f"{collection}.json")) if files.exists(f"{collection}.json") else {}


def _paths(spark: SparkSession, folder: str, root: str, collection: str) -> dict[int, str]:
    """Where the rows of each bucket are, changes that are switched but not moved included."""
    at = folder if root == "chunks" else _beside(folder, root)
    held = Files(spark, at)
    out = {int(n.partition("=")[2]): f"{at}/collection={collection}/{n}" for n in held.names(f"collection={collection}") if n.startswith("bucket=")}
    journal = _journal(spark, folder, collection)
    if journal:
        staged = f"{journal['staging']}/{root}/collection={collection}"
        for n in Files(spark, staged).names():
            if n.startswith("bucket="):
                out[int(n.partition("=")[2])] = f"{staged}/{n}"
        for bucket, filled in journal["roots"].get(root, {}).items():
            if not filled:
                out.pop(int(bucket), None)
    return out


def _read(spark: SparkSession, folder: str, root: str, collection: str, only: set[int] | None = None) -> DataFrame | None:
    """The rows of a collection with their bucket, of all or some buckets; null if it has none. A folder that cannot be read is an error."""
    paths = {b: p for b, p in _paths(spark, folder, root, collection).items() if only is None or b in only}
    if not paths:
        return None
    bucket = F.regexp_extract("_metadata.file_path", "/bucket=([0-9]+)/", 1).cast("int")
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths.values()).withColumn("bucket", bucket)


def open_collection(spark: SparkSession, folder: str, collection: str) -> DataFrame:
    """The chunks of a collection; one that is not there is an error."""
    rows = _read(spark, folder, "chunks", collection)
    if rows is None or rows.isEmpty():
        raise ValueError(f"no collection {collection}")
    return rows.drop("bucket")


def postings(spark: SparkSession, folder: str, collection: str) -> DataFrame | None:
    """chunk_id, token, tf, size of a collection's chunks, where ingest keeps them (see retrieval.token_postings); else null."""
    rows = _read(spark, folder, "postings", collection)
    return rows.drop("bucket") if rows is not None else None


def recover(spark: SparkSession, folder: str, collection: str) -> None:
    """Move what a journal names to its place; begun moves go on where they stopped."""
    journal = _journal(spark, folder, collection)
    if not journal:
        return
    for root, buckets in journal["roots"].items():
        target = Files(spark, folder if root == "chunks" else _beside(folder, root))
        staged = Files(spark, journal["staging"])
        for bucket, filled in buckets.items():
            here = (f"collection={collection}", f"bucket={bucket}")
            if not filled:
                target.delete(*here)
            elif staged.exists(root, *here):
                target.move(f"{journal['staging']}/{root}/{'/'.join(here)}", *here)
    Files(spark, _beside(folder, "journal")).delete(f"{collection}.json")
    Files(spark, journal["staging"]).delete()


def _write(rows: DataFrame, path: str, sizes: dict[int, int], by: str, file_rows: int) -> None:
    """Buckets as files of about file_rows rows each: a large bucket is dealt by the hash of `by` to several tasks."""
    files = {b: max(1, -(-n // file_rows)) for b, n in sizes.items()}
    spark = rows.sparkSession
    many = F.broadcast(spark.createDataFrame(sorted(files.items()), "bucket int, many_files int"))
    rows = rows.join(many, "bucket").withColumn("many_files", F.pmod(F.xxhash64(by), F.col("many_files")))
    tasks = min(sum(files.values()), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows.repartition(tasks, "bucket", "many_files").drop("many_files").write.option("maxRecordsPerFile", 4 * file_rows).partitionBy("collection", "bucket").parquet(path)


def ingest(folder: str, collection: str, new: DataFrame, dim: int | None = None, files: int | None = None, buckets: int | None = None, keep_postings: bool = False, file_rows: int = FILE_ROWS) -> dict:
    """Write new chunks as the rows of their sources and ids; indexed_files, inserted_chunks and the collection's name.

    The buckets that hold a source or an id of the new rows are read, changed (see replace_by_source) and written as a
    whole, others are not touched; to find ids that come again, the ids of all chunks are read, and nothing else of them. New rows are stored first, so they (and
    their embeddings) are worked out once. The first ingest fixes the dimension of a collection with an embedding column, its number
    of buckets (BUCKETS, if not given), and whether it keeps postings; another dimension or number later is an error. Postings of changed buckets are written and switched with them.

    Cases: no rows change nothing; a null source is a source of its own; a write that fails leaves the old rows as they
    are; an index that cannot be read is an error and is not overwritten.
    """
    spark = new.sparkSession
    rows = stored(latest(new), "ingest")
    n = rows.count()
    done = {"indexed_files": files if files is not None else rows.select("source_name").distinct().count(), "inserted_chunks": n, "collection": collection}
    if not n:
        return done
    recover(spark, folder, collection)
    facts = _facts(spark, folder, collection)
    fresh = not facts
    if fresh:
        facts = {"buckets": buckets or BUCKETS, "postings": keep_postings, "dim": None}
    elif buckets and buckets != facts["buckets"]:
        raise ValueError(f"collection {collection} has {facts['buckets']} buckets")
    if "embedding" in rows.columns:
        held = facts["dim"]
        dim = dim or held or rows.select(F.size("embedding").alias("n")).first()["n"]
        if held is not None and held != dim:
            raise ValueError(f"collection {collection} has vectors of {held} components")
        facts["dim"], fresh = dim, fresh or held is None
        rows = check_dimension(rows, dim)
    bucket = F.pmod(F.xxhash64("source_name"), F.lit(facts["buckets"])).cast("int")
    old, before = _read(spark, folder, "chunks", collection), {}
    if old is not None:
        touched = old.join(rows.select("chunk_id").distinct(), "chunk_id", "left_semi").select("bucket").union(rows.select(bucket.alias("bucket"))).distinct()
        # Buckets are a bounded number of small integers.
        mine = {r["bucket"] for r in touched.collect()}
        old = _read(spark, folder, "chunks", collection, mine)
        before = dict.fromkeys(mine & set(_paths(spark, folder, "chunks", collection)), False)
        rows = replace_by_source(old.drop("bucket"), rows) if old is not None else rows
    rows = stored(rows.withColumn("collection", F.lit(collection)).withColumn("bucket", bucket), "changed")
    sizes = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    after = {str(b): b in sizes for b in sorted({*before, *sizes})}
    staging = f"{_beside(folder, 'staging')}/{uuid.uuid4().hex}"
    roots = {"chunks": after}
    try:
        _write(rows, f"{staging}/chunks", sizes, "chunk_id", file_rows)
        if facts["postings"]:
            parts = token_postings(rows).join(rows.select("chunk_id", "collection", "bucket"), "chunk_id")
            _write(parts, f"{staging}/postings", {b: 64 * k for b, k in sizes.items()}, "chunk_id", 64 * file_rows)
            roots["postings"] = after
        if fresh:
            Files(spark, _beside(folder, "collections")).write(json.dumps(facts), f"{collection}.json")
        Files(spark, _beside(folder, "journal")).write(json.dumps({"staging": staging, "roots": roots}), f"{collection}.json")
    except Exception:
        Files(spark, staging).delete()
        raise
    recover(spark, folder, collection)
    return done


def register(users: DataFrame, new: DataFrame) -> DataFrame:
    """New users whose e-mail and name are free, among the new ones too (the first by e-mail and name), with a known role."""
    free = new.filter(F.col("role").isin("researcher", "government", "student"))
    free = free.join(users.select("email"), "email", "left_anti").join(users.select("username"), "username", "left_anti")
    once = lambda key, by: F.row_number().over(Window.partitionBy(key).orderBy(by))
    free = free.withColumn("nth", once("email", "username")).filter("nth = 1").withColumn("nth", once("username", "email")).filter("nth = 1")
    return free.select(*new.columns)


def user(users: DataFrame, email: str | None = None, username: str | None = None) -> DataFrame:
    """The row of an e-mail, or of a user name."""
    return users.filter(F.col("email") == email if email is not None else F.col("username") == username).limit(1)


def active_user(users: DataFrame, email: str) -> DataFrame:
    """The row of an e-mail; one that is not active is an error, where it is read."""
    checked = F.when(F.col("is_active"), F.col("is_active")).otherwise(F.raise_error(F.lit("inactive user")).cast("boolean"))
    return user(users, email).withColumn("is_active", checked)
