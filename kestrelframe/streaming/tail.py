"""Lines of growing log files as a stream, by byte position.

``spark.dataSource.register(LineTail)``, then ``readStream.format("line_tail")`` with the
options ``path`` (a folder), ``suffix`` and ``chunkBytes``. The offset of a batch is the
byte position in every file up to which whole lines exist, so a line that is half
written is not read before its end is there, and is then read once. What a batch adds to
a file is read in chunks of ``chunkBytes`` by as many tasks: a chunk begins after the
first line end in it, and reads on to the end of the line that it began.

Rows are ``(file, at, line)``: the path below the folder, the position where the line
begins, and its text without the line end (bytes that are not UTF-8 are replaced). A
file that shrinks below its position is read no more until it has grown past it; files
are found again in every batch and never removed from the offset. The folder is opened
through Arrow's file systems, so any store that they know will do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.stores import opened

SCHEMA = "file string, at long, line string"
CHUNK = 16 << 20
_BLOCK = 1 << 16
_ROWS = 4096


def whole_until(store: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The position after the last line end in ``[start, size)``; ``start`` if there is none."""
    end = size
    with store.open_input_file(path) as f:
        while end > start:
            a = max(start, end - _BLOCK)
            f.seek(a)
            cut = f.read(end - a).rfind(b"\n")
            if cut >= 0:
                return a + cut + 1
            end = a
    return start


@dataclass
class Span(InputPartition):
    """Bytes ``[start, end)`` of one file's whole lines ``[first, last)``."""

    file: str
    first: int
    start: int
    end: int
    last: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.chunk = int(options.get("chunkbytes", CHUNK))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = opened(self.path)
        out = dict(self.seen)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix) or info.base_name.startswith((".", "_")):
                continue
            name = info.path[len(root) :].lstrip("/")
            at = out.get(name, 0)
            if info.size > at:
                out[name] = whole_until(store, info.path, at, info.size)
        self.seen = {name: at for name, at in out.items() if at}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for name in sorted(end):
            a, b = int(start.get(name, 0)), int(end[name])
            out += [Span(name, a, k, min(b, k + self.chunk), b) for k in range(a, b, self.chunk)]
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as f:
            at = partition.start
            if at > partition.first:  # a line that begins at the chunk's first byte is the chunk's own
                at = self._after_line_end(f, at - 1, partition.last)
            rest, rows = b"", []
            f.seek(at)
            pos = at
            while at < partition.end:
                block = f.read(min(_BLOCK, partition.last - pos))
                if not block:
                    break
                pos += len(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if at >= partition.end:
                        break
                    rows.append((partition.file, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                    at += len(line) + 1
                    if len(rows) >= _ROWS:
                        yield self._batch(rows)
                        rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _after_line_end(f: pa.NativeFile, at: int, last: int) -> int:
        f.seek(at)
        while at < last:
            block = f.read(min(_BLOCK, last - at))
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(block)
        return last

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "at", "line"])

    def commit(self, end: dict) -> None:
        pass


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)
