"""A sink of files that are there all at once, or not at all.

Each task writes its files under names of its own and, when it is done, a list of them; the job's commit, written last,
names the lists that count. A reader goes by commits alone, so what a failed task or job has left is never seen, and a
run after it writes only what is missing. The driver holds a name a task, however many files there are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .ranges import file_system, layer_records

LISTED = "name string, file string, bytes long, sha256 string, about string"


@dataclass
class Written(WriterCommitMessage):
    listing: str
    files: int
    bytes: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = file_system(self.path)
        own = f"{self.job}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        fs.create_dir(f"{root}/_files/{own}", recursive=True)
        fs.create_dir(f"{root}/_lists", recursive=True)
        listed, size = [], 0
        for batch in iterator:
            about = batch.column("about") if "about" in batch.schema.names else pa.nulls(batch.num_rows, pa.string())
            for name, data, said in zip(batch.column("name"), batch.column("data"), about, strict=True):
                name, data = name.as_py(), data.as_py() or b""
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"{name!r} is no name for a file")
                file = f"_files/{own}/{name}"
                with fs.open_output_stream(f"{root}/{file}", compression=None) as f:
                    f.write(data)
                listed.append({"name": name, "file": file, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "about": said.as_py()})
                size += len(data)
        listing = f"_lists/{own}.json"
        with fs.open_output_stream(f"{root}/{listing}", compression=None) as f:
            f.write("".join(json.dumps(x) + "\n" for x in listed).encode())
        return Written(listing, len(listed), size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        done = [m for m in messages if m is not None]
        fs.create_dir(f"{root}/_commits", recursive=True)
        said = {"lists": [m.listing for m in done], "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        with fs.open_output_stream(f"{root}/_commits/.{self.job}", compression=None) as f:
            f.write(json.dumps(said).encode())
        fs.move(f"{root}/_commits/.{self.job}", f"{root}/_commits/{self.job}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.listing}")
                fs.delete_dir(f"{root}/_files/{m.listing.removeprefix('_lists/').removesuffix('.json')}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitewright_files"

    def schema(self) -> str:
        return "name string, data binary, about string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"], self.options["job"])


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``name, file, bytes, sha256, about`` of the files that commits under ``path`` name; ``file`` is relative to it."""
    from pyarrow.fs import FileSelector

    fs, root = file_system(path)
    lists = []
    for f in fs.get_file_info(FileSelector(f"{root}/_commits", allow_not_found=True)):
        if f.extension == "json":
            with fs.open_input_stream(f.path) as s:
                lists += json.loads(s.read())["lists"]
    if not lists:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).json([f"{path}/{x}" for x in sorted(lists)])


def write_files(rows: DataFrame, path: str) -> None:
    """Write the files of ``rows(name, data)``, and ``about``, a text kept with each, that are not there yet.

    Names are unique. Nothing of the job is there before all of it is; a name that an earlier job has written is left out.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    missing = rows.join(committed(spark, path).select("name"), "name", "left_anti").select(*[c for c in ("name", "data", "about") if c in rows.columns])
    missing.write.format("sitewright_files").options(path=path, job=uuid.uuid4().hex).mode("append").save()


def contents(spark: SparkSession, path: str) -> DataFrame:
    """``name, data, about`` of the committed files, read by tasks and held against their sums."""
    kind = "name string, data binary, about string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            for name, file, told, about in zip(*[batch.column(c).to_pylist() for c in ("name", "file", "sha256", "about")], strict=True):
                with fs.open_input_stream(f"{root}/{file}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != told:
                    raise ValueError(f"{name} is damaged")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([about], pa.string())], ["name", "data", "about"])

    return committed(spark, path).mapInArrow(read, kind)


def write_layers(chunks: DataFrame, path: str) -> None:
    """Layer records of ``chunks(first, records, data)``, as ``binary.layer_chunks`` makes them, as committed files that are
    in order by name: one layer file in parts."""
    rows = chunks.selectExpr("format_string('layers-%015d.bin', first) AS name", "data", "to_json(struct(first, records)) AS about")
    write_files(rows, path)


def layer_parts(spark: SparkSession, path: str, record_bytes: int, fields: list[dict], wanted: list[str] | None = None) -> DataFrame:
    """The records of the parts that ``write_layers`` has written; parts are listed in the driver, as files of a table are."""
    parts = [f"{path}/{r.file}" for r in committed(spark, path).select("file", "name").orderBy("name").collect()]
    return layer_records(spark, parts, record_bytes, None, fields, wanted)
