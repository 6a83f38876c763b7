"""Binary files under names of their rows as a data sink: decks, sheets, sounds, pages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (file's name, its name until the commit)."""

    files: list[tuple[str, str]]


class FileSink(DataSource):
    """Rows (file_name, content) become files of a folder that driver and executors share.

    Tasks write under names of the attempt in a folder of the job; the driver's commit gives them their names once every
    task has ended. So a task that fails, is run again or runs twice leaves no file of its own, and a job that fails
    leaves none at all. A rerun gives the same names; files of those names are replaced, others stay.
    Cases: a null content is an empty file; a null or blank name, one with a path in it, and a name that comes twice are errors; no rows write nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if schema.names != ["file_name", "content"]:
            raise ValueError("rows of file_name and content are needed")
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f"_pending-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        return store, root.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = self._store()
        files: list[tuple[str, str]] = []
        try:
            for r in rows:
                name, held = r["file_name"], f"{self.job}/{uuid.uuid4().hex}"
                if not (name or "").strip() or "/" in name or name.startswith("_pending-"):
                    raise ValueError(f"no name of a file: {name}")
                if not files:
                    store.create_dir(f"{root}/{self.job}", recursive=True)
                with store.open_output_stream(f"{root}/{held}") as f:
                    f.write(bytes(r["content"] or b""))
                files.append((name, held))
        except BaseException:
            for _, held in files:
                store.delete_file(f"{root}/{held}")
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        files = [f for m in messages if m for f in m.files]
        names = [n for n, _ in files]
        if len(set(names)) < len(names):
            raise ValueError(f"a file comes twice: {next(n for n in names if names.count(n) > 1)}")
        for name, held in files:
            store.move(f"{root}/{held}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = self._store()
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


def write_files(rows: DataFrame, path: str, file_name: str = "file_name", content: str = "content") -> None:
    """Write rows as files (see FileSink); rows without a content, as of dialogues that none could speak, are left out."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    files = rows.filter(rows[content].isNotNull()).select(rows[file_name].alias("file_name"), rows[content].cast("binary").alias("content"))
    files.write.format(FileSink.name()).mode("append").option("path", path).save()
