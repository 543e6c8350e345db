"""A data source for named entries under one root: frames and arrays, written by tasks and read back with planned partitions.

    register(spark)
    df.write.format("tidemark").mode("overwrite").save(root, entry="signals")
    spark.read.format("tidemark").load(root, entry="signals")

Each task writes parquet files of its own; the commit writes the entry's manifest, with its kind, schema and files, and
only what a manifest names is part of an entry. A read plans one partition for each file. Files hold the range of their
first column, and a filter on that column leaves out the files beyond it. Paths may be any that Arrow opens; on a cluster
the root is a folder that driver and executors share.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MANIFEST = "entry.json"
#: Rows of a file; a task writes as many files as it needs.
FILE_ROWS = 1 << 20


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _manifest(root: str, entry: str) -> dict | None:
    fs, base = _open(root)
    path = posixpath.join(base, entry, MANIFEST)
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _value(v):
    return v if isinstance(v, (int, float, str)) and v == v else None


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class File(InputPartition):
    path: str


class EntryWriter(DataSourceWriter):
    def __init__(self, root: str, entry: str, schema: StructType, overwrite: bool, meta: dict):
        self.root, self.entry, self.schema, self.overwrite, self.meta = root, entry, schema, overwrite, meta

    def write(self, iterator: Iterator) -> Written:
        fs, base = _open(self.root)
        schema, files, rows = to_arrow_schema(self.schema), [], []
        fs.create_dir(posixpath.join(base, self.entry))

        def flush() -> None:
            if rows:
                name = f"{uuid.uuid4().hex}.parquet"
                table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], schema)
                pyarrow.parquet.write_table(table, posixpath.join(base, self.entry, name), filesystem=fs)
                first = [v for v in table.column(0).to_pylist() if _value(v) is not None] if len(schema) else []
                files.append({"name": name, "rows": len(rows), "low": min(first, default=None), "high": max(first, default=None)})
                rows.clear()

        for row in iterator:
            rows.append(row)
            if len(rows) >= FILE_ROWS:
                flush()
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        old = None if self.overwrite else _manifest(self.root, self.entry)
        files = (old["files"] if old else []) + [f for m in messages if m for f in m.files]
        kept = {f["name"] for f in files}
        fs, base = _open(self.root)
        folder = posixpath.join(base, self.entry)
        fs.create_dir(folder)
        with fs.open_output_stream(posixpath.join(folder, MANIFEST)) as f:
            f.write(json.dumps(self.meta | {"schema": self.schema.jsonValue(), "files": files}).encode())
        for info in fs.get_file_info(pyarrow.fs.FileSelector(folder)):
            if info.base_name.endswith(".parquet") and info.base_name not in kept:
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.root)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(posixpath.join(base, self.entry, f["name"]))


class EntryReader(DataSourceReader):
    def __init__(self, root: str, entry: str, schema: StructType, manifest: dict):
        self.root, self.entry, self.schema, self.files = root, entry, schema, manifest["files"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Leaves out files by their range; every filter is applied to the rows all the same."""
        first = self.schema.names[:1]
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and list(f.attribute) == first and _value(f.value) is not None:
                over = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual))
                under = isinstance(f, (EqualTo, LessThan, LessThanOrEqual))
                self.files = [x for x in self.files if x["low"] is not None and (not over or x["high"] >= f.value) and (not under or x["low"] <= f.value)]
            yield f

    def partitions(self) -> list[File]:
        return [File(f["name"]) for f in self.files] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            fs, base = _open(self.root)
            schema = to_arrow_schema(self.schema)
            for b in pyarrow.parquet.ParquetFile(posixpath.join(base, self.entry, partition.path), filesystem=fs).iter_batches():
                yield pa.RecordBatch.from_arrays([b.column(k).cast(f.type) for k, f in enumerate(schema)], schema=schema)


class EntrySource(DataSource):
    """Format `tidemark`: path is the root; options entry (the name), kind (frame or array) and shape (of an array)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def _found(self) -> dict:
        found = _manifest(self.options["path"], self.options["entry"])
        if found is None:
            raise ValueError(f"no entry {self.options['entry']!r} in {self.options['path']}")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(self._found()["schema"])

    def reader(self, schema: StructType) -> EntryReader:
        return EntryReader(self.options["path"], self.options["entry"], schema, self._found())

    def writer(self, schema: StructType, overwrite: bool) -> EntryWriter:
        meta = {"kind": self.options.get("kind", "frame"), "shape": json.loads(self.options.get("shape", "null"))}
        return EntryWriter(self.options["path"], self.options["entry"], schema, overwrite, meta)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EntrySource)


class Entries:
    """Named frames and arrays under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        register(spark)

    def write(self, data: DataFrame | np.ndarray, name: str) -> None:
        """A frame, or an array of numbers: one row for each index of its first axis, (row, values) with values flat."""
        if isinstance(data, DataFrame):
            data.write.format("tidemark").mode("overwrite").save(self.root, entry=name)
            return
        data = np.asarray(data, float)
        rows = data.reshape(len(data), int(np.prod(data.shape[1:]))) if data.ndim else data.reshape(1, 1)
        table = pa.table({"row": pa.array(np.arange(len(rows))), "values": pa.array(list(rows), pa.list_(pa.float64()))})
        self.spark.createDataFrame(table).write.format("tidemark").mode("overwrite").options(kind="array", shape=json.dumps(data.shape)).save(self.root, entry=name)

    def kind(self, name: str) -> str | None:
        found = _manifest(self.root, name)
        return found and found["kind"]

    def read(self, name: str) -> DataFrame | None:
        """The entry, an array as (row, values); a name that isn't there as an entry is looked for as a table, then as gzipped JSON, else None."""
        if self.kind(name) is not None:
            return self.spark.read.format("tidemark").load(self.root, entry=name)
        from .readers import Store

        store = Store(self.spark, self.root)
        found = store.read(name)
        return found if found is not None else store.read(name, json=True)

    def array(self, name: str) -> np.ndarray | None:
        """An array entry as one array, in the driver's memory."""
        found = _manifest(self.root, name)
        if found is None or found["kind"] != "array":
            return None
        rows = self.read(name).orderBy("row").select("values").toArrow()["values"].to_pylist()
        return np.array(rows, float).reshape(found["shape"])


def arrays_of(signals: DataFrame) -> DataFrame:
    """(row, values) of signals(id, x), as array entries are laid out."""
    return signals.select(F.col("id").cast("long").alias("row"), F.col("x").alias("values"))
