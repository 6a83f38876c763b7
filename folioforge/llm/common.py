"""Helpers that all operators of this subpackage share: shared tables, Arrow maps, worker-side state."""

from __future__ import annotations

import ctypes
import glob
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import clear, shared_path, stored  # noqa: F401

#: Rows and bytes of an Arrow batch, so that a worker holds some tens of MB of texts, however long they are.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, unless the session bounds them more tightly. The bounds hold for the session's later plans too."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key) or "")
        if not held or not 0 < int(held[1]) <= most:
            spark.conf.set(key, str(most))


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Matrix products of this process take one core from now on: Spark runs a task on each, and threads of small products wait for each other, at full load."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def arrow_map(df: DataFrame, ddl: str, rows: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]]) -> DataFrame:
    """mapInArrow over batches as {column: list}; rows is called once a task and yields {column: list}.

    Results are cut to BATCH_ROWS rows a batch.
    """
    batches(df.sparkSession)
    schema = pa.schema([(f.name, f.type) for f in arrow_schema(ddl)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dicts() -> Iterator[dict[str, list]]:
            for b in it:
                yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for out in rows(dicts()):
            batch = pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
            for k in range(0, batch.num_rows, 20 * BATCH_ROWS):
                yield batch.slice(k, 20 * BATCH_ROWS)

    return df.mapInArrow(run, ddl)


def text_or_empty(df: DataFrame) -> DataFrame:
    """doc_id and whole text, null as empty; other columns are not read."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
