"""Point files of fixed-size records, read in byte ranges by as many tasks as they need, and written in parallel.

``spark.dataSource.register(PointRecords)``, then ``read.format("point_records")`` with the
options ``path`` (a file or a folder), ``kind`` and ``records`` (records of a task):

* ``las``: LAS 1.0 to 1.3, point formats 0 to 3: ``(file, pos, x, y, z, intensity, classification, gps_time, red, green, blue)``, null where a format lacks a field;
* ``ply_vertices``: little-endian PLY: ``(file, pos, x, y, z)``;
* ``ply_faces``: little-endian PLY whose faces are all triangles with nothing else: ``(file, pos, v0, v1, v2)``.

``pos`` is the record's place in its file. The driver reads headers only.

``write.format("point_records")`` with ``path``, ``kind`` ``las`` and ``scale`` writes one LAS 1.2 file
of format 0 for each task: the records first, beside the target, then the header with
their number and bounds and the records behind it; what tasks wrote is moved to its
place when all have ended, and removed if one fails. Rows are ``(x, y, z, intensity,
classification)``; null intensities and classes are 0 and 1. Null coordinates are refused.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .stores import files_below, opened

RECORDS = 1 << 20
_BATCH = 1 << 16
_SCHEMAS = {
    "las": "file string, pos long, x double, y double, z double, intensity int, classification int, gps_time double, red int, green int, blue int",
    "ply_vertices": "file string, pos long, x double, y double, z double",
    "ply_faces": "file string, pos long, v0 long, v1 long, v2 long",
}
_WRITTEN = "x double, y double, z double, intensity int, classification int"

# fixed values: the layout of LAS point records and of the public header block, and PLY's types
_POINT = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_TIME, _COLOUR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
_FORMATS = {0: _POINT, 1: _POINT + _TIME, 2: _POINT + _COLOUR, 3: _POINT + _TIME + _COLOUR}
_HEADER = "<4sHH16sBB32s32sHHHIIBHI5I12d"
_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


@dataclass
class Layout:
    """Where a file's records are, and what is in them."""

    start: int
    count: int
    fields: list
    size: int
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)
    offset: tuple[float, ...] = (0.0, 0.0, 0.0)


def las_layout(head: bytes, name: str) -> Layout:
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError(f"{name}: no LAS header")
    h = struct.unpack(_HEADER, head[: struct.calcsize(_HEADER)])
    minor, start, kind, size, count = h[5], h[11], h[13] & 0x3F, h[14], h[15]
    if minor > 3 or kind not in _FORMATS:
        raise ValueError(f"{name}: LAS 1.{minor} with point format {kind} is not read")
    return Layout(start, count, _FORMATS[kind], size, h[21:24], h[24:27])


def ply_layout(head: bytes, name: str, element: str) -> Layout:
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError(f"{name}: no PLY header in its first {len(head)} bytes")
    start = head.index(b"\n", end) + 1
    elements: list[tuple[str, int, list]] = []
    for line in head[:end].decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"] and w[1] != "binary_little_endian":
            raise ValueError(f"{name}: {w[1]} is not read in ranges")
        if w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    for found, count, properties in elements:
        if element == "face" and found == "face":
            if len(properties) != 1 or properties[0][0] != "list":
                raise ValueError(f"{name}: faces with more than a list of corners are not read in ranges")
            fields = [("n", "<" + _PLY[properties[0][1]]), ("v", "<" + _PLY[properties[0][2]], 3)]
            return Layout(start, count, fields, np.dtype(fields).itemsize)
        if any(p[0] == "list" for p in properties):
            raise ValueError(f"{name}: records of {found} have no fixed size")
        fields = [(p[1], "<" + _PLY[p[0]]) for p in properties]
        if found == element:
            return Layout(start, count, fields, np.dtype(fields).itemsize)
        start += count * np.dtype(fields).itemsize
    return Layout(start, 0, [("x", "<f8")], 8)


@dataclass
class Records(InputPartition):
    file: str
    layout: Layout
    first: int
    last: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.records = options["path"], options.get("kind", "las"), int(options.get("records", RECORDS))

    def _layout(self, name: str, size: int) -> Layout:
        store, _ = opened(self.path)
        with store.open_input_file(name) as f:
            head = f.read(min(size, 1 << 16))
        out = las_layout(head, name) if self.kind == "las" else ply_layout(head, name, "vertex" if self.kind == "ply_vertices" else "face")
        if out.start + out.count * out.size > size:
            raise ValueError(f"{name}: {out.count} records of {out.size} bytes do not fit in {size} bytes")
        return out

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for name, size in files_below(self.path, ".las" if self.kind == "las" else ".ply"):
            layout = self._layout(name, size)
            out += [Records(name, layout, k, min(layout.count, k + self.records)) for k in range(0, layout.count, self.records)]
        return out or [Records("", Layout(0, 0, [("x", "<f8")], 8), 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        store, _ = opened(self.path)
        at, kind = partition.layout, np.dtype(partition.layout.fields)
        wide = np.dtype({"names": kind.names, "formats": [kind.fields[n][0] for n in kind.names], "offsets": [kind.fields[n][1] for n in kind.names], "itemsize": at.size})
        with store.open_input_file(partition.file) as f:
            for k in range(partition.first, partition.last, _BATCH):
                n = min(_BATCH, partition.last - k)
                f.seek(at.start + k * at.size)
                rows = np.frombuffer(f.read(n * at.size), wide, n)
                columns = {"file": pa.array([partition.file] * n, pa.string()), "pos": pa.array(np.arange(k, k + n))}
                if self.kind == "ply_faces":
                    if (rows["n"] != 3).any():
                        raise ValueError(f"{partition.file}: polygons other than triangles are not read in ranges")
                    columns |= {f"v{j}": pa.array(rows["v"][:, j].astype(np.int64)) for j in range(3)}
                else:
                    columns |= {c: pa.array(rows[c].astype(float) * at.scale[j] + at.offset[j]) for j, c in enumerate("xyz")}
                if self.kind == "las":
                    columns |= {c: pa.array(rows[c].astype(np.int32)) for c in ("intensity", "classification")}
                    columns["gps_time"] = pa.array(rows["gps_time"].astype(float)) if "gps_time" in kind.names else pa.nulls(n, pa.float64())
                    columns |= {c: pa.array(rows[c].astype(np.int32)) if c in kind.names else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue")}
                yield pa.RecordBatch.from_pydict(columns)


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class LasWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.scale = options["path"].rstrip("/"), float(options.get("scale", 0.001))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = opened(self.path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        name = uuid.uuid4().hex
        body, whole = f"{root}/_temporary/{name}.body", f"{root}/_temporary/{name}.las"
        count, low, high, offset = 0, np.full(3, np.inf), np.full(3, -np.inf), None
        with store.open_output_stream(body) as out:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=1)
                if not np.isfinite(xyz).all():
                    raise ValueError("a point without finite coordinates cannot be written")
                offset = np.floor(xyz.min(axis=0)) if offset is None else offset
                whole_numbers = np.rint((xyz - offset) / self.scale)
                if np.abs(whole_numbers).max() >= 2**31:
                    raise ValueError(f"coordinates span more than a scale of {self.scale} can hold")
                rows = np.zeros(len(xyz), np.dtype(_POINT))
                for j, c in enumerate("xyz"):
                    rows[c] = whole_numbers[:, j]
                rows["flags"] = 0b001001  # the first of one return
                for c, missing in (("intensity", 0), ("classification", 1)):
                    rows[c] = batch.column(c).fill_null(missing).to_numpy(zero_copy_only=False)
                stored = whole_numbers * self.scale + offset
                low, high, count = np.minimum(low, stored.min(axis=0)), np.maximum(high, stored.max(axis=0)), count + len(rows)
                out.write(rows.tobytes())
        if not count:
            store.delete_file(body)
            return Written(None, None)
        bounds = [v for j in range(3) for v in (high[j], low[j])]
        head = struct.pack(_HEADER, b"LASF", 0, 0, bytes(16), 1, 2, b"", b"", 1, 2000, 227, 227, 0, 0, np.dtype(_POINT).itemsize, count, count, 0, 0, 0, 0, *[self.scale] * 3, *offset, *bounds)
        with store.open_output_stream(whole) as out, store.open_input_stream(body) as records:
            out.write(head)
            while block := records.read(1 << 20):
                out.write(block)
        store.delete_file(body)
        return Written(whole, f"{root}/part-{name}.las")

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None and m.temporary:
                store.move(m.temporary, m.final)
        store.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list) -> None:
        store, root = opened(self.path)
        store.delete_dir(f"{root}/_temporary")


class PointRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "point_records"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("kind", "las")]

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if self.options.get("kind", "las") != "las":
            raise ValueError("only LAS is written")
        return LasWriter(self.options)
