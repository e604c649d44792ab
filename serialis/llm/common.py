"""What the operators share: tables in the shared folder, and small Arrow helpers."""

from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serialis.sources.io import scratch

#: A word is a run of characters other than these white-space bytes; bytes.split() cuts at just them.
WORD = r"[^\x20\x09-\x0D]+"


#: What `saved` has written in the call at hand; threads and calls of `settled` have lists of their own.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def saved(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. The table goes when the driver's JVM ends, or with `settled`."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    if (mine := _written.get()) is not None:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spent: list[str]) -> DataFrame:
    """The table that `make` gives, saved. What was saved on the way, and what `spent` names, is dropped then;
    spent names the new table afterwards, for the next call."""
    outer = _written.set([])
    try:
        out = saved(make())
        mine = _written.get()
    finally:
        _written.reset(outer)
    spark = out.sparkSession
    for path in [*spent, *mine[:-1]]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spent[:] = mine[-1:]
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches, at most so many rows at a time, so that a task holds few texts as Python objects."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def with_text(df: DataFrame, text_col: str, *without: str, keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """(table, name, kinds) for a function over Arrow batches that reads a text and hands on the columns of
    df (or those to keep), less some: the columns, with the text among them once, its name there, which is
    `__text` if it is not handed on, and the kinds of those handed on, each followed by a comma."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in without]
    out = df.select(*kept, *([] if text_col in kept else [F.col(text_col).alias("__text")]))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in out.schema if f.name in kept)
    return out, text_col if text_col in kept else "__text", kinds


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy rows."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype(), copy=False)))


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id written as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def word_count(text: str) -> Column:
    """Words of a text column as long; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def summed(df: DataFrame, vectors: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int, slots: int = 8) -> np.ndarray:
    """The sum of the float vectors (all of the fixed `size`) that `vectors` makes of each partition.

    Each task adds up its own and cuts the sum in `slots` parts; the parts are added up by slot, in the
    order of the partitions. One job, and one vector reaches the driver, whatever the input.
    """
    cuts = [size * k // slots for k in range(slots + 1)]

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size), False
        for v in vectors(batches):
            total += v
            any_row = True
        if any_row:
            parts = [total[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(slots)), pa.array([TaskContext.get().partitionId()] * slots), pa.array(parts, pa.binary())], ["slot", "part", "total"])

    def of_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                v = np.frombuffer(x.as_py(), np.float64)
                totals[slot] = totals[slot] + v if slot in totals else v
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["slot", "total"])

    parts = df.mapInArrow(of_part, "slot long, part long, total binary").repartition(slots, "slot").sortWithinPartitions("slot", "part")
    total = np.zeros(size)
    for row in parts.mapInArrow(of_slot, "slot long, total binary").collect():
        total[cuts[row["slot"]] : cuts[row["slot"] + 1]] = np.frombuffer(row["total"], np.float64)
    return total
