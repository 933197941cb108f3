"""One JSON array of any size as one file: tasks write parts, the commit frames them, one task joins them.

Rows become JSON on the JVM; a task streams its rows into a part of its own, named by partition and attempt. The
commit lists the parts that count, in partition order; what a failed or repeated attempt left is not on the list. A
task then copies the listed parts, a megabyte at a time, between the brackets, and the driver renames the result over
the old file: a reader sees the old array or the new one. The rename is atomic where the file system's is (HDFS, local);
on object stores it is a copy. The driver sees neither rows nor bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_COPY_BYTES = 1 << 20
_LIST = "_parts.json"


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId():09d}-{task.taskAttemptId()}"
        fs, folder = _fs(self.path)
        fs.create_dir(folder)
        rows = 0
        try:
            with fs.open_output_stream(f"{folder}/{name}") as out:
                for batch in iterator:
                    for value in batch.column(0):
                        out.write((b",\n" if rows else b"") + value.as_py().encode())
                        rows += 1
        except BaseException:
            fs.delete_file(f"{folder}/{name}")
            raise
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, folder = _fs(self.path)
        fs.create_dir(folder)
        names = sorted(m.name for m in messages if m is not None and m.rows)
        with fs.open_output_stream(f"{folder}/{_LIST}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = _fs(self.path)
        if fs.get_file_info(folder).type.name == "Directory":
            fs.delete_dir(folder)


class JsonParts(DataSource):
    """Write only: rows of one string column, each one JSON value, as parts of an array."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_json_parts"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"])


def _joined(spark: SparkSession, staging: str) -> str:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(staging)
        with fs.open_input_stream(f"{folder}/{_LIST}") as f:
            names = json.loads(f.read())
        whole = f"{folder}/all-{uuid.uuid4().hex}"
        with fs.open_output_stream(whole) as out:
            out.write(b"[")
            for i, name in enumerate(names):
                out.write(b",\n" if i else b"\n")
                with fs.open_input_stream(f"{folder}/{name}") as part:
                    while piece := part.read(_COPY_BYTES):
                        out.write(piece)
            out.write(b"\n]\n")
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([whole])], names=["path"])

    return spark.range(0, 1, 1, 1).mapInArrow(join, "path string").first()[0]


def write_array(df: DataFrame, path: str) -> None:
    """df as one JSON array in the file `path`, replaced as a whole; rows in the order of df's partitions, nulls written out."""
    spark = df.sparkSession
    spark.dataSource.register(JsonParts)
    staging = f"{path}.parts-{uuid.uuid4().hex}"
    fs, folder = _fs(staging)
    try:
        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
        rows.write.format(JsonParts.name()).mode("append").option("path", staging).save()
        fs.move(_joined(spark, staging), _fs(path)[1])
    finally:
        if fs.get_file_info(folder).type.name == "Directory":
            fs.delete_dir(folder)
