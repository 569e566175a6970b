"""Folders and files of a vault wherever it is: local ones by the operating system, others by Arrow's file systems."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

MARKDOWN = ".md"


def is_local(root: str) -> bool:
    """Whether root is a path of the local file system, by its scheme."""
    return not re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", root)


def local_path(root: str) -> str:
    return re.sub("^file:(?://)?", "", root)


class Tree:
    """A folder tree under a root that is a local path, or else a URI.

    Sources are absolute paths, or URIs. Links to folders are not followed, links to files are files."""

    def __init__(self, root: str):
        self.files = None
        if is_local(root):
            self.root = os.path.realpath(local_path(root))
        else:
            from pyarrow import fs

            self.root = root.rstrip("/")
            self.files, base = fs.FileSystem.from_uri(self.root)
            self.before = self.root.removesuffix(base.rstrip("/"))

    def _inner(self, source: str) -> str:
        return source.removeprefix(self.before)

    def listed(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        """(source, is a folder, size, time in microseconds) of what a folder holds; nothing if it is gone or closed."""
        try:
            if self.files is not None:
                from pyarrow import fs

                for x in self.files.get_file_info(fs.FileSelector(self._inner(folder))):
                    if x.type in (fs.FileType.Directory, fs.FileType.File):
                        yield self.before + x.path, x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1000
                return
            with os.scandir(folder) as entries:
                for x in entries:
                    if x.is_dir(follow_symlinks=False):
                        yield x.path, True, 0, 0
                    elif x.is_file():
                        at = x.stat()
                        yield x.path, False, at.st_size, at.st_mtime_ns // 1000
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return

    def read(self, source: str) -> bytes:
        if self.files is None:
            with open(source, "rb") as f:
                return f.read()
        with self.files.open_input_stream(self._inner(source)) as f:
            return f.read()

    def write(self, source: str, data: bytes) -> None:
        """A file, its folder too, complete or not at all."""
        if self.files is not None:
            self.files.create_dir(os.path.dirname(self._inner(source)))
            with self.files.open_output_stream(self._inner(source)) as f:
                f.write(data)
            return
        os.makedirs(os.path.dirname(source), exist_ok=True)
        with open(f"{source}.part", "wb") as f:
            f.write(data)
        os.replace(f"{source}.part", source)

    def drop(self, folder: str) -> None:
        import shutil

        if self.files is None:
            shutil.rmtree(folder, ignore_errors=True)
        else:
            self.files.delete_dir(self._inner(folder))

    def markdown(self, folders: list[str], hidden: bool, most: int | None = None) -> Iterator[tuple[str, bool, int, int]]:
        """Markdown files below folders; beyond `most` entries looked at, the folders that are left instead."""
        left, seen = list(folders), 0
        while left:
            if most is not None and seen >= most:
                yield from ((f, True, 0, 0) for f in left)
                return
            for source, is_folder, size, micros in self.listed(left.pop()):
                seen += 1
                if not hidden and skipped(source.rsplit("/", 1)[-1]):
                    continue
                if is_folder:
                    left.append(source)
                elif source.endswith(MARKDOWN):
                    yield source, False, size, micros


def skipped(name: str) -> bool:
    """Whether Spark's file source leaves a name out."""
    return name[0] == "." or name[0] == "_" and "=" not in name


def can_list(root: str) -> bool:
    """Whether Python can list a root: local ones, and URIs that Arrow has a file system for."""
    try:
        Tree(root)
        return True
    except (OSError, ValueError, ImportError, NotImplementedError):
        return False
