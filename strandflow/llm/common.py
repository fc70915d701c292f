"""What the operators share: scratch tables, shipping of the package, Arrow text buffers."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to a Python worker, so that its memory doesn't follow the length of rows.
BATCH_BYTES = 4 << 20
#: Bytes of an operator's input to a file of its scratch tables, at least.
PART_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application.

    Workers unpickle the operators' functions by module name, so the package has to be importable
    there whatever the driver's working directory is.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))  # served by the driver; no shared folder is needed
    _SHIPPED.add(context.applicationId)


class Scratch:
    """Tables that cut lineage, in the folder shared by driver and executors.

    The folder is ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests) a local
    temporary folder is made and set. With ``like``, the table that the work starts from, tables of little data
    get few files: one for PART_BYTES of it, but enough for every core. All goes when the driver ends, and
    with ``drop`` before.
    """

    def __init__(self, spark: SparkSession, label: str, within: str | None = None, like: DataFrame | None = None, parts: int | None = None):
        self.spark = spark
        base = within or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="strandflow-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.parts = parts
        if like is not None:
            size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            self.parts = max(2 * spark.sparkContext.defaultParallelism, min(size // PART_BYTES, 1 << 30))
        self.marked = within is not None

    def inner(self, name: str) -> Scratch:
        """Tables of a step that names its own, in a folder of this one."""
        return Scratch(self.spark, name, self.root, parts=self.parts)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return the table read again with the same schema."""
        few = df.coalesce(self.parts) if self.parts else df
        few.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        if not self.marked:
            path, system = self._at(self.root)
            system.deleteOnExit(path)
            self.marked = True
        # what was shuffled for the table isn't needed again: let Spark's cleaner find it unused now
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _at(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        for name in names:
            path, system = self._at(self.path(name))
            system.delete(path, True)


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text, for a broadcast (a few MB, whatever the corpus)."""
    return Path(path).read_text(encoding="utf-8")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    rows = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[rows[0] : rows[-1]], rows - rows[0]


def slices(batch: pa.RecordBatch, limit: int = 2 << 20, name: str = "text"):
    """``batch`` in pieces of about ``limit`` bytes of text, so that memory doesn't follow batch length."""
    _, rows = text_buffer(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(rows, rows[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def fs_for(uri: str):
    """A pyarrow file system and path for a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


def ddl(df: DataFrame, *names: str) -> str:
    """The columns' types, for the schema of a Python stage."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
