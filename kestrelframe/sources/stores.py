"""Byte access to any store that Arrow's file systems know, from the driver and from tasks."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):  # one slash or three
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_below(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """``(path, size)`` of a file, or of the files below a folder, hidden ones left out."""
    store, root = opened(path.rstrip("/"))
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(suffix) and not i.base_name.startswith((".", "_")))
