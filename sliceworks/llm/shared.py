"""Helpers that several corpus operators share: reading, written intermediate tables, text in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: An Arrow batch takes no more rows once it has so many bytes.
ARROW_BYTES = 4 << 20

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a temporary one serves, but only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stash_path = path
    return back


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def unstash(*written: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in written:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def python_ready(spark: SparkSession) -> None:
    """Python workers get the package, and Arrow batches of a bounded number of bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        out.append(f"_{name}")
        taken.add(f"_{name}".lower())
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that are sorted by integer ``keys``, with each group's first row. Held at a time: a batch and the group that it ends in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        turns = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if [last.column(c)[0].as_py() for c in keys] != k[0].tolist():
                turns = np.concatenate([[0], turns])
        if not len(turns):
            held.append(batch)
            continue
        cut = int(turns[-1])
        ready = [*held, batch.slice(0, cut)]
        held = [batch.slice(cut)]
        yield from _grouped(ready, keys)
    if held:
        yield from _grouped(held, keys)


def _grouped(batches: list[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    table = pa.Table.from_batches(batches)
    if table.num_rows:
        k = np.stack([table.column(c).to_numpy() for c in keys], axis=1)
        yield table, np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_runs(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows ``(first, end, bytes, offsets)`` of at most ``most`` bytes of UTF-8, or of one longer text. Null is empty.

    ``bytes`` is a view of the whole column's buffer; ``offsets`` are the absolute limits of rows first..end.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data, offsets[first : end + 1]
        first = end


