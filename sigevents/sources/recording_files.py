"""A sink that writes one file a recording, all of them or none.

Rows are (recording_id, line) for text or (recording_id, content) for bytes. A recording's rows have to be
in one partition, one after the other; tasks write each file as its rows stream by, into a folder of the
run, and the files of the attempts that count are moved to their place when all tasks have ended. If the
job fails, the run's folder is deleted, so that no reader ever sees a part of it. A name that is no file
name (empty, or with a slash) is an error, and so is a recording that comes twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.ending, self.overwrite = options["path"].rstrip("/"), options.get("ending", ""), overwrite
        self.run = f"_temporary/{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._open()
        folder = f"{root}/{self.run}/{uuid.uuid4().hex}"  # of this attempt
        system.create_dir(folder, recursive=True)
        files, seen, last, out = [], set(), None, None
        try:
            for batch in iterator:
                text = batch.schema.field(1).type not in (pa.binary(), pa.large_binary())
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if out is None or name != last:
                        if out is not None:
                            out.close()
                        if not name or "/" in str(name) or name in seen:
                            raise ValueError(f"no name of one recording's file: {name!r}")
                        seen.add(name)
                        last, at = name, f"{folder}/{name}{self.ending}"
                        out = system.open_output_stream(at)
                        files.append((at, f"{root}/{name}{self.ending}"))
                    out.write(f"{value}\n".encode() if text else value)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._open()
        pairs = [p for m in messages if m for p in m.files]
        if len({final for _, final in pairs}) < len(pairs):
            self.abort(messages)
            raise ValueError("a recording came in two partitions")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for at, final in pairs:
            system.move(at, final)
        system.delete_dir(f"{root}/{self.run}")
        system.delete_dir(f"{root}/_temporary")
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._open()
        if system.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.run}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def schema(self) -> str:
        return "recording_id string, line string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def write_files(rows: DataFrame, path: str, ending: str, overwrite: bool = False) -> None:
    """Write rows that are dealt by recording, and in order, with one file each."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.write.format("recording_files").option("ending", ending).mode("overwrite" if overwrite else "append").save(path)
