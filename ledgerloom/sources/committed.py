"""A sink of files, committed as a whole: what tasks write shows only when all of them are done.

A task writes its files under a staging folder, in a folder of its attempt, and tells
the driver their names.  The commit moves those of the attempts that count into
place and removes the staging folder, with whatever failed or repeated attempts left in it.  A job
that fails leaves nothing.  Folders are those of any file system that pyarrow opens; on a
cluster they must be shared.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..config import TemplateSettings
from .workbook import review_books, template_books

_STAGING = "_staging"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and where it goes


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.staging = f"{self.folder}/{_STAGING}-{uuid.uuid4().hex}"

    def _system(self) -> tuple[object, Callable[[str], str]]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        return system, lambda path: path.split("://", 1)[1] if "://" in path and not path.startswith("file:") else path.removeprefix("file://")

    def write(self, iterator: Iterator) -> _Written:
        system, at = self._system()
        attempt = f"{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(at(attempt))
        out = []
        for n, row in enumerate(iterator):
            if row.content is None:
                continue
            with system.open_output_stream(at(f"{attempt}/{n}")) as f:
                f.write(bytes(row.content))
            out.append((f"{attempt}/{n}", f"{self.folder}/{row.name}"))
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, at = self._system()
        moves = [m for message in messages if message is not None for m in message.files]
        targets = [t for _, t in moves]
        double = [t for t, n in Counter(targets).items() if n > 1]
        there = [] if self.overwrite else [i.path for i in system.get_file_info([at(t) for t in targets]) if i.type != fs.FileType.NotFound]
        if double or there:
            self.abort(messages)
            raise ValueError(f"files of one name: {double[:3] or there[:3]}")
        for source, target in moves:
            system.create_dir(at(target.rsplit("/", 1)[0]), recursive=True)
            system.move(at(source), at(target))
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, at = self._system()
        if system.get_file_info(at(self.staging)).type == fs.FileType.Directory:
            system.delete_dir(at(self.staging))


class CommittedFiles(DataSource):
    """Rows (name, content) as files of that name under the folder ``path``; null contents give no file."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, folder: str, name: Column | str = "name", content: Column | str = "content", overwrite: bool = False) -> None:
    """Write one file for each row; two files of one name, or one that is there already, are an error and nothing is written.

    Names may have folders in them.  With ``overwrite`` files that are there are replaced;
    others stay.
    """
    files.sparkSession.dataSource.register(CommittedFiles)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    shown = files.select(column(name).cast("string").alias("name"), column(content).cast("binary").alias("content"))
    shown.write.format("committed_files").option("path", folder).mode("overwrite" if overwrite else "append").save()


def _plain(value: Column) -> Column:
    """As a part of a file's name."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("none")), r"[^\w.-]+", "_")


def _book_name(keys: list[str], kind: str) -> Column:
    return F.concat(F.concat_ws("-", *[_plain(F.col(k)) for k in keys], F.lit(kind), F.lpad(F.col("book").cast("string"), 5, "0")), F.lit(".xlsx"))


#: Order of records in a sheet: by path, page and region.
SHEET_ORDER = ["file_id", "page_no", "region_no"]


def write_template_books(records: DataFrame, folder: str, keys: list[str], order: list[str] | None = None, template: TemplateSettings = TemplateSettings(), source: bytes | None = None, most: int = 50_000, overwrite: bool = False) -> None:
    """Import sheets as files, one for each batch (``keys``) and part of ``most`` records, made and written in tasks."""
    books = template_books(records, keys, order or SHEET_ORDER, template, source, most)
    write_files(books, folder, _book_name(keys, "import"), overwrite=overwrite)


def write_review_books(records: DataFrame, folder: str, keys: list[str], order: list[str] | None = None, most: int = 500, overwrite: bool = False) -> None:
    """Review sheets with their crops as files, made and written in tasks: a task holds ``most`` records and their images."""
    books = review_books(records, keys, order or SHEET_ORDER, most)
    write_files(books, folder, _book_name(keys, "review"), overwrite=overwrite)


def write_crops(crops: DataFrame, folder: str, ending: str = "png", overwrite: bool = False) -> None:
    """Images of regions (file_id, page_no, region_no, crop) as files, in a folder for each input file; regions without an image give none.

    Folders have the input file's last name and a hash of its whole path.
    """
    file = F.concat(_plain(F.element_at(F.split("file_id", "/"), -1)), F.lit("-"), F.lpad(F.hex(F.xxhash64("file_id")), 16, "0"))
    write_files(crops, folder, F.concat(file, F.lit("/p"), F.col("page_no").cast("string"), F.lit("-r"), F.col("region_no").cast("string"), F.lit(f".{ending}")), "crop", overwrite)
