"""What the training-data operators share: scratch tables and text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.session import shared_folder


#: Scratch folders made inside the innermost `released`, if any; threads and coroutines have their own.
_made: ContextVar[list[str] | None] = ContextVar("scratch folders", default=None)


def _in_hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the folder that all executors share, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, place = _in_hadoop(spark, path)
    files.deleteOnExit(place)
    own = _made.get()
    if own is not None:
        own.append(path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are deleted at its end, also after an error: what reads them has to be written by then.

    Folders of other threads, which have lists of their own, stay.
    """
    own: list[str] = []
    outer = _made.set(own)
    try:
        yield
    finally:
        _made.reset(outer)
        for path in own:
            files, place = _in_hadoop(spark, path)
            files.delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    It cuts the lineage: what was written survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds, equals fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def apart(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names out of the way, and the renaming that puts them back."""
    taken, prefix = {c.lower() for c in df.columns}, "kept__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    back = {prefix + c: c for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of the column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
