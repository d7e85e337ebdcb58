"""What the operators of this subpackage share: reading, scratch tables, row keys."""

from __future__ import annotations

import ctypes
import functools
import os
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradelens.session import scratch_path

#: Bits of the bitmaps that tell which rows a later join needs: 4 MB, whatever the input.
BITMAP_BITS = 1 << 25

# Words of the contracts: runs of bytes other than space and \t..\r. The same
# rule is ``bytes.split()`` in Python (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (``addPyFile`` of a small zip, once per session).

    For callers whose executors don't have it installed.
    """
    context = spark.sparkContext
    if getattr(context, "_tradelens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tradelens-package-")  # served by the driver, not shared
    context.addPyFile(shutil.make_archive(f"{folder}/tradelens_package", "zip", root, "tradelens"))
    context._tradelens_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables; Spark's reader only, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Cuts the lineage: a lost executor never makes Spark recompute what stands
    before, and two readers see the same rows. The files stay until the shared
    folder is cleared, as the returned frame is lazy.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap_of(keys: DataFrame, key: Column) -> np.ndarray:
    """Bitmap (one bit each, by hash) of a table's keys; at most BITMAP_BITS / 64 rows reach the driver."""
    slot = F.pmod(key, F.lit(BITMAP_BITS))
    longs = (keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("k"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                           F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow())
    out = np.zeros(BITMAP_BITS >> 6, "i8")
    out[longs.column("k").to_numpy()] = longs.column("bits").to_numpy()
    return out.view("u8")


def split_by_bitmap(df: DataFrame, key: Column, bitmap: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in the bitmap, all others).

    A join that concerns few rows then shuffles those (and few others, by
    chance) and leaves the rest where it is. With very many keys the bitmap
    fills up and the first part approaches the whole table; both stay right.
    """
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    slotted = df.withColumn("__slot", F.pmod(key, F.lit(BITMAP_BITS)))

    def rows(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = batch.column(batch.num_columns - 1).to_numpy()
                hit = ((shared.value[slots >> 6] >> (slots & 63).astype("u8")) & np.uint64(1)).astype(bool)
                yield batch.filter(pa.array(hit == wanted)).select(batch.schema.names[:-1])

        return slotted.mapInArrow(run, df.schema)

    return rows(True), rows(False)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``df`` with its columns called like one of ``names`` renamed, a function that gives a frame derived
    from it the columns of ``df`` again: theirs and no others, by their own names, in their order)."""
    taken = {n.lower() for n in names}
    apart = {c: f"__aside_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(apart.get(c, c)).alias(c) for c in df.columns))

    return df.withColumnsRenamed(apart), back


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows no learner may see: crc32(doc_id as text) mod 5 is 0 (a NULL id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Characters of text that a task handles at once (a longer text is a slice of its own), and rows.
SLICE_CHARACTERS, SLICE_ROWS = 1 << 21, 4096


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches whose last column is the text, in slices of bounded size: (the slice, its texts as
    Python strings)."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        start, held, weight = 0, [], 0
        for i in range(0, batch.num_rows, 64):
            for text in texts.slice(i, 64).to_pylist():
                held.append(text)
                weight += len(text or "")
                if weight >= SLICE_CHARACTERS or len(held) >= SLICE_ROWS:
                    yield batch.slice(start, len(held)), held
                    start, held, weight = start + len(held), [], 0
        if held:
            yield batch.slice(start, len(held)), held


def released(run: Callable) -> Callable:
    """``run`` (a task's function over batches), after which the worker gives its free memory back.

    Spark keeps Python workers for later tasks; what one operator's tables and
    word memories took would otherwise stay with them through the next stages.
    """

    @functools.wraps(run)
    def task(*args):
        yield from run(*args)
        free_memory()

    return task


def free_memory() -> None:
    """Free pages of Arrow's pool and of the C library go back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
