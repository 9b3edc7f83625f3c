"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python helper handles at once.
CHUNK_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see. A cluster names it in spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests) a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rastrix-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class SharedTable:
    """A DataFrame written to the shared folder: it cuts the lineage and outlives any executor."""

    #: Tables that aren't dropped yet, in the order in which they were made.
    standing: ClassVar[list[SharedTable]] = []

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.standing.append(self)
        self.path = f"{shared_folder(self.spark)}/rastrix/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.standing.remove(self)


def drop_tables(since: int = 0, but: DataFrame | None = None) -> None:
    """Deletes the tables made after the first `since` ones, for when all results that read them are written; that of the DataFrame `but` stays."""
    for table in SharedTable.standing[since:]:
        if table.df is not but:
            table.drop()


@atexit.register
def _drop_rest() -> None:
    with contextlib.suppress(Exception):  # Spark may be gone
        drop_tables()


def written(df: DataFrame, label: str) -> DataFrame:
    return SharedTable(df, label).df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes for no column to have it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bits of a map for each hash in it, and bits at least and at most (8 MB, a million rows), so a map may always be broadcast.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


class KeyFilter:
    """A map of the 64-bit hashes in a column of a written table, as a table of rows (slot, 64 bits) to be broadcast: it tells which rows surely have no partner there, so that only
    the others are shuffled. The map is as large as the number of hashes asks for, up to MOST_BITS; beyond that it lets more through, which costs a shuffle of more rows and changes no result."""

    def __init__(self, values: DataFrame, column: str, label: str):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (values.count() * BITS_EACH - 1).bit_length()))
        bit = F.pmod(F.col(column), F.lit(self.bits))
        slots = values.select(F.shiftright(bit, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("bit"))
        self.held = written(slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")), f"{label}-map")

    def mark(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """The rows with a boolean column `name`: false where the map lacks the hash in the column."""
        slot, bits = free_name(df, "slot"), free_name(df, "bits")
        own = self.held.select(F.col("slot").alias(slot), F.col("bits").alias(bits))
        found = df.join(F.broadcast(own), F.shiftright(F.pmod(F.col(column), F.lit(self.bits)), 6) == F.col(slot), "left")
        return found.withColumn(name, F.coalesce(F.getbit(bits, F.pmod(F.col(column), F.lit(64)).cast("int")) == 1, F.lit(False))).drop(slot, bits)

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows that may have a partner, and those that have none."""
        name = free_name(df, "maybe")
        marked = self.mark(df, column, name)
        return marked.where(name).drop(name), marked.where(~F.col(name)).drop(name)


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null ids: fold 0)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(0)).cast("int")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most about `limit` bytes of text (one text at least), with null texts as empty. At the end, memory that is free goes back."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), side="right")))
            yield batch.slice(at, end - at), [x or "" for x in column.slice(at, end - at).to_pylist()]
            at = end
    release()


def release() -> None:
    """Gives free memory of a Python worker back, as workers stay for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text: rows alike in both have equal results, so they may share it. Nulls count as empty."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
