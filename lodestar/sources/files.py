"""What the file sources share: paths of any file system, and folders whose files appear when a write commits."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a URI or an absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files of a folder with one of `suffixes`, or the one file at `path`, in the order of their names.

    Names that begin with _ or . are writes that never committed.
    """
    system, root = located(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [root]
    names = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file]
    return sorted(n for n in names if n.lower().endswith(suffixes) and n.rsplit("/", 1)[-1][0] not in "_.")


@dataclass
class Staged(WriterCommitMessage):
    name: str


class FolderWriter(DataSourceWriter):
    """One file for each task that has rows. A lost or repeated task leaves only a hidden file; files get their names when
    all tasks are done, and an overwrite drops the older ones then."""

    def __init__(self, path: str, suffix: str, encode: Callable[[Iterator, object], None], overwrite: bool):
        self.path, self.suffix, self.encode, self.overwrite = path, suffix, encode, overwrite

    def write(self, iterator: Iterator) -> Staged:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{root}/_{name}") as out:
            self.encode(iterator, out)
        return Staged(name)

    def commit(self, messages: list) -> None:
        system, root = located(self.path)
        old = listed(self.path, (self.suffix,)) if self.overwrite else []
        for m in messages:
            system.move(f"{root}/_{m.name}", f"{root}/part-{m.name}{self.suffix}")
        for name in old:
            system.delete_file(name)

    def abort(self, messages: list) -> None:
        system, root = located(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/_{m.name}")


class ArrowFolderWriter(FolderWriter, DataSourceArrowWriter):
    """The same for an encoder of Arrow batches."""
