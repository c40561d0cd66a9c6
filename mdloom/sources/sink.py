"""A sink that writes each row as a file of its own, with a commit: files appear under their names once all tasks are done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Folders of attempts that are moved at once.
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote: the folder that holds it, and how many files."""

    folder: str
    n: int


@dataclass
class FileWriter(DataSourceArrowWriter):
    """An attempt writes into a folder of its own, so tasks that are tried again or twice at once don't meet. Only the folders of
    the attempts that Spark names in the commit are moved; a failure removes all of them and leaves earlier exports alone."""

    uri: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    def place(self) -> tuple[fs.FileSystem, str, str]:
        system, root = fs.FileSystem.from_uri(self.uri)
        return system, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, temporary = self.place()
        own, n = f"{temporary}/{uuid.uuid4().hex}", 0
        system.create_dir(own, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"not a file name: {name!r}")
                with system.open_output_stream(f"{own}/{name}") as f:
                    f.write(content if isinstance(content, bytes) else (content or "").encode())
                n += 1
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, temporary = self.place()

        def move(message: Written) -> None:
            for file in system.get_file_info(fs.FileSelector(message.folder)):
                system.move(file.path, f"{root}/{file.base_name}")

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(move, filter(None, messages)))  # the list raises what a move raised
        self.clear(system, temporary)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, temporary = self.place()
        self.clear(system, temporary)

    @staticmethod
    def clear(system: fs.FileSystem, temporary: str) -> None:
        if system.get_file_info(temporary).type == fs.FileType.Directory:
            system.delete_dir(temporary)


class RowFiles(DataSource):
    """df.write.format("row_files").mode("append").save(uri): the first column names the file, the second (text or bytes; null is
    empty) fills it. A name that is there already is replaced; of rows with one name, one stays."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("row_files replaces files by name; write with mode append")
        if len(schema) != 2:
            raise ValueError("row_files takes two columns: name, content")
        return FileWriter(self.options["path"])


def export_files(df: DataFrame, folder: str, name_col: str, content_col: str) -> None:
    """Write each row as a file (UTF-8) into a folder that all nodes share, all of them or none."""
    df.sparkSession.dataSource.register(RowFiles)
    df.select(name_col, content_col).write.format("row_files").mode("append").save(folder)
