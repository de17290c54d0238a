"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Bytes of a batch that are Python objects at a time.
PART = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="webgrain-"))
    return _LOCAL[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, by exact name and under new names.

    Goes by position, so extra columns whose names clash (also by case, or twice the
    same) do no harm; of equal names the first counts.
    """
    at = {out: df.columns.index(name) for out, name in wanted.items()}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(out) for out, i in at.items()))


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The table with its columns named by position, and the new name of a column (of equal names the first).

    For operators that keep all columns: ``out.toDF(*df.columns)`` gives the names back,
    and no name clashes in between.
    """
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), lambda name: f"c{df.columns.index(name)}"


def give_back() -> None:
    """Return freed memory to the system: workers are used again by other stages, which need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Apply a function of column lists to parts of each Arrow batch of about 8 MB; ``start`` makes it once a task."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start()
        for whole in batches:
            step = max(1, PART * whole.num_rows // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                out = apply({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine; a full path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
