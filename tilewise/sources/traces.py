"""A sink for trace ranges: a data source whose files count only once all of a write has succeeded.

Each task writes one file under a name that no other attempt has. When all tasks are done the driver writes the list of
their files; when the write fails it removes them. Readers take the listed files, so what a lost or repeated attempt left
behind is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tilewise.sources import files

LIST = "_committed.json"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class TraceWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator) -> Written:
        """A task's ranges as one file; none for no rows."""
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        name, out, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=fs, compression="zstd")
                    out.write_batch(batch)
                    rows += batch.num_rows
        except BaseException:
            if out:
                out.close()
                fs.delete_file(f"{base}/{name}")
            raise
        if out:
            out.close()
        return Written(name if out else None, rows)

    def commit(self, messages) -> None:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        before = [] if self.overwrite else committed(self.folder)
        listed = [[m.name, m.rows] for m in messages if m is not None and m.name]
        files.put(self.folder, LIST, json.dumps(before + listed).encode())

    def abort(self, messages) -> None:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None and m.name and fs.get_file_info(f"{base}/{m.name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{base}/{m.name}")


class Traces(DataSource):
    """``df.write.format("traces").mode("append").save(folder)``, after ``spark.dataSource.register(Traces)``."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options["path"], overwrite)


def committed(folder: str) -> list:
    """[file, rows] of what a folder's writes have committed."""
    fs, base = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{base}/{LIST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{base}/{LIST}") as f:
        return json.loads(f.read())


def write_traces(df: DataFrame, folder: str) -> None:
    """Write ranges; all of them are there afterwards, or none."""
    df.sparkSession.dataSource.register(Traces)
    df.write.format("traces").mode("append").save(folder)


def read_traces(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The committed ranges of a folder."""
    names = [f"{folder}/{name}" for name, _ in committed(folder)]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
