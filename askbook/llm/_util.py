"""What the operators of this subpackage share: checkpoints, Arrow batches, names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from askbook.shipping import scratch, ship

__all__ = ["checkpointed", "deleted", "free_name", "map_rows", "replaced", "ship", "slices", "with_fields", "written"]


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder, so that no lineage hangs on lost executors.

    The folder is the one that spark.checkpoint.dir names. Without it a session within one process (local mode) gets a folder of its own; a
    cluster is refused, since its executors would each write to a disk of their own.
    """
    _use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, options: dict[str, str]) -> str:
    """The path of a Parquet table of the rows, new in the shared checkpoint folder; who writes it deletes it."""
    _use_shared_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Takes away a table that `written` has made."""
    told = spark._jvm.org.apache.hadoop.fs.Path(path)
    told.getFileSystem(spark._jsc.hadoopConfiguration()).delete(told, True)


def _use_shared_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not _one_process(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or scratch())


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores put ahead until no column has it."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = "_" + name
    return name


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with this package shipped first."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows: what a task holds as Python objects stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_fields(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """The schema with these (name, DDL type) fields at its end, in place of any of the same name."""
    names = {n.lower() for n, _ in fields}
    kept = [f for f in schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t), True) for n, t in fields])


def replaced(batch: pa.RecordBatch, schema: T.StructType, values: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns in the schema's order, some of them replaced or added."""
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([values[f.name] if f.name in values else batch.column(names.index(f.name)) for f in schema.fields], names=[f.name for f in schema.fields])
