"""PCD files as a Spark data source: spark.read.format("pcd").load(path), df.write.format("pcd").save(folder).

ascii, binary and binary_compressed bodies.  The driver lists files and reads their headers; a binary file is read by many
tasks, each of a range of points (option pointsPerTask), ascii and compressed ones by a task each, batch by batch.  With
option filters, which needs spark.sql.python.filterPushdown.enabled, those on x, y and z leave rows out before they are made;
load_cloud gives it where that is set.  A path with a scheme is read through Hadoop's file systems by a binaryFile scan, a whole file at a time.

Each task writes a binary file of its own, which appears under its name once all have ended well.
"""

from __future__ import annotations

import glob
import io
import itertools
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from levelground.schema import CLOUD

_KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}


def lzf_decompress(data: bytes, size: int) -> bytes:
    """The LZF format: literal runs, and back references of at least three bytes."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[i]
            i += 1
        start = len(out) - ((c & 31) << 8) - data[i] - 1
        i += 1
        if start < 0:
            raise ValueError("a back reference before the start")
        n += 2
        again = bytes(out[start : start + n])  # shorter where it runs into what it makes
        out += again if len(again) == n else (again * (n // len(again) + 1))[:n]
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes where {size} were announced")
    return bytes(out)


#: Points of a range of a binary file that a task reads by default, and of a batch.
PER_TASK, PER_BATCH = 2_000_000, 100_000
COLUMNS = ("x", "y", "z", "intensity")


@dataclass(frozen=True)
class Header:
    names: tuple[str, ...]
    counts: tuple[int, ...]
    kinds: tuple[str, ...]
    points: int
    how: str
    at: int  # bytes of the header

    @property
    def row(self) -> np.dtype:
        return np.dtype([(str(i), kind, (c,)) for i, (kind, c) in enumerate(zip(self.kinds, self.counts))])


def read_header(f: BinaryIO) -> Header:
    found: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in found:
        line = f.readline(1 << 16)
        if not line.endswith(b"\n"):
            raise ValueError("not a PCD file: its header has no DATA line")
        at += len(line)
        words = line.decode("ascii", "replace").split()
        if words and not words[0].startswith("#"):
            found[words[0].upper()] = words[1:]
    names, how = tuple(found["FIELDS"]), found["DATA"][0].lower()
    missing = {"x", "y", "z"} - set(names)
    if missing:
        raise ValueError(f"a cloud without {', '.join(sorted(missing))}")
    if how not in ("ascii", "binary", "binary_compressed"):
        raise ValueError(f"DATA {how} is not a PCD encoding")
    n = int(found["POINTS"][0]) if "POINTS" in found else int(found["WIDTH"][0]) * int(found["HEIGHT"][0])
    kinds = tuple(_KINDS[t, int(s)] for t, s in zip(found["TYPE"], found["SIZE"]))
    return Header(names, tuple(map(int, found.get("COUNT", ["1"] * len(names)))), kinds, n, how, at)


def _chosen(header: Header, of: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """x, y, z and intensity (0 where the file has none) as float32."""
    return {c: np.asarray(of[c] if c in of else np.zeros(n), np.float32) for c in COLUMNS}


def _unpacked(f: BinaryIO, header: Header) -> dict[str, np.ndarray]:
    """The columns of a compressed body, which stand one after the other."""
    packed, size = np.frombuffer(f.read(8), "<u4").tolist()
    raw, columns, place = lzf_decompress(f.read(packed), size), {}, 0
    for name, kind, c in zip(header.names, header.kinds, header.counts):
        part = np.frombuffer(raw, kind, header.points * c, place)
        columns[name] = part.reshape(-1, c)[:, 0]
        place += part.nbytes
    return columns


def batches(f: BinaryIO, header: Header, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(place of the first point, columns) of the points from start to stop, some PER_BATCH at a time; f stands behind the header."""
    stop = header.points if stop is None else min(stop, header.points)
    if header.how == "binary_compressed":
        columns = _unpacked(f, header)
        for i in range(start, stop, PER_BATCH):
            of = {name: c[i : min(i + PER_BATCH, stop)] for name, c in columns.items()}
            yield i, _chosen(header, of, len(of["x"]))
        return
    row, places = header.row, np.cumsum([0, *header.counts])
    if header.how == "binary":
        f.seek(start * row.itemsize, os.SEEK_CUR)
    for i in range(start, stop, PER_BATCH):
        n = min(PER_BATCH, stop - i)
        if header.how == "binary":
            raw = f.read(n * row.itemsize)
            table = np.frombuffer(raw, row, len(raw) // row.itemsize)
            of = {name: table[str(c)][:, 0] for c, name in enumerate(header.names)}
        else:
            table = np.array([line.split() for line in itertools.islice(f, n)], "S").astype(float).reshape(-1, places[-1])
            of = {name: table[:, places[c]] for c, name in enumerate(header.names)}
        if len(table) < n:
            raise ValueError(f"{i + len(table)} points where {header.points} were announced")
        yield i, _chosen(header, of, n)


def parse(data: bytes) -> dict[str, np.ndarray]:
    """The columns x, y, z and intensity of a PCD file's bytes."""
    f = io.BytesIO(data)
    parts = [of for _, of in batches(f, read_header(f))]
    return {c: np.concatenate([of[c] for of in parts]) if parts else np.zeros(0, np.float32) for c in COLUMNS}


def _batch(cloud_id: str, columns: dict[str, np.ndarray], pid: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(columns["x"])
    return pa.RecordBatch.from_arrays([pa.array([cloud_id] * n, pa.string()), pa.array(np.arange(n) if pid is None else pid), *map(pa.array, columns.values())], ["cloud_id", "pid", *columns])


@dataclass
class PcdPart(InputPartition):
    path: str
    header: Header
    start: int
    stop: int


#: Comparisons as Spark makes them, NaN being greater than any number.
_TESTS = {
    GreaterThan: lambda c, v: (c > v) | np.isnan(c),
    GreaterThanOrEqual: lambda c, v: (c >= v) | np.isnan(c),
    LessThan: lambda c, v: c < v,
    LessThanOrEqual: lambda c, v: c <= v,
}


class PcdReader(DataSourceReader):
    def __init__(self, path: str, per_task: int) -> None:
        self.path, self.per_task, self.tests = path.removeprefix("file://"), per_task, []

    def partitions(self) -> list[PcdPart]:
        found = sorted(glob.glob(os.path.join(self.path, "**/*.pcd"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        parts = []
        for path in found:
            with open(path, "rb") as f:
                header = read_header(f)
            step = self.per_task if header.how == "binary" else max(header.points, 1)
            parts += [PcdPart(path, header, i, min(i + step, header.points)) for i in range(0, header.points, step)]
        return parts or [PcdPart(found[0], header, 0, 0)]

    def read(self, partition: PcdPart) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            f.seek(partition.header.at)
            for start, columns in batches(f, partition.header, partition.start, partition.stop):
                pid = np.arange(start, start + len(columns["x"]))
                if self.tests:
                    keep = np.logical_and.reduce([_TESTS[kind](columns[c].astype(float), value) for kind, c, value in self.tests])
                    columns, pid = {c: v[keep] for c, v in columns.items()}, pid[keep]
                yield _batch(partition.path, columns, pid)


class PcdFilteringReader(PcdReader):
    """Leaves rows out before they are made; Spark lets a reader do so only where filterPushdown is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("x", "y", "z") and isinstance(value, (int, float)) and value == value:
                self.tests.append((type(f), f.attribute[0], float(value)))
            else:
                yield f


@dataclass
class PcdWritten(WriterCommitMessage):
    path: str | None = None


def _head(n: int | str, how: str) -> bytes:
    return f"VERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {how}\n".encode()


@dataclass
class PcdWriter(DataSourceArrowWriter):
    """x, y, z and intensity (0 where there is none) of each task as a binary file; other columns are left out.  A file has its
    name when the job ends well, so what lost or repeated tasks wrote is not read."""

    folder: str
    names: list[str] = field(default_factory=list)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PcdWritten:
        os.makedirs(self.folder, exist_ok=True)
        path, n = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.pcd"), 0
        with open(f"{path}.writing", "wb") as f:
            f.write(_head("0" * 19, "binary"))
            for batch in iterator:
                zeros = np.zeros(batch.num_rows, "<f4")
                f.write(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("<f4") if c in self.names else zeros for c in COLUMNS], axis=1).tobytes())
                n += batch.num_rows
            f.seek(0)
            f.write(_head(f"{n:019d}", "binary"))  # as long as before
        return PcdWritten(path)

    def commit(self, messages: list[PcdWritten | None]) -> None:
        for m in messages:
            os.replace(f"{m.path}.writing", m.path)

    def abort(self, messages: list[PcdWritten | None]) -> None:
        for m in filter(None, messages):
            os.remove(f"{m.path}.writing")


class PcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> StructType:
        return CLOUD

    def reader(self, schema: StructType) -> PcdReader:
        kind = PcdFilteringReader if self.options.get("filters", "false").lower() == "true" else PcdReader
        return kind(self.options["path"], int(self.options.get("pointsPerTask", PER_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> PcdWriter:
        if overwrite:
            raise ValueError("a folder of clouds is written to, never replaced: mode append")
        return PcdWriter(self.options["path"].removeprefix("file://"), schema.names)


def save_cloud(cloud: DataFrame, folder: str) -> None:
    """Writes a cloud as binary PCD files, one of each partition, to a folder that the driver and all executors share."""
    cloud.sparkSession.dataSource.register(PcdSource)
    cloud.write.format("pcd").mode("append").save(folder)


def load_cloud(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A cloud from a path (PCD, or Parquet with its columns) or a DataFrame, which passes through.  A path that cannot be
    read raises."""
    if isinstance(source, DataFrame):
        return source
    if "://" in source and not source.startswith("file://"):  # a store that only Spark reads
        files = spark.read.format("binaryFile").load(source).select("path", "content")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    yield _batch(path, parse(content))

        return spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else files.mapInArrow(rows, CLOUD)
    if source.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(source)
    spark.dataSource.register(PcdSource)
    return spark.read.format("pcd").option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(source)


def encode(columns: dict[str, np.ndarray], how: str = "ascii") -> bytes:
    """PCD bytes of x, y, z, intensity columns."""
    head = _head(len(columns["x"]), how)
    table = np.stack([np.asarray(columns[c], "<f4") for c in ("x", "y", "z", "intensity")], axis=1)
    if how == "ascii":
        return head + b"".join(" ".join(repr(float(v)) for v in row).encode() + b"\n" for row in table)
    if how == "binary":
        return head + table.tobytes()
    raw = table.T.tobytes()
    packed = b"".join(bytes([len(raw[i : i + 32]) - 1]) + raw[i : i + 32] for i in range(0, len(raw), 32))  # literals only
    return head + np.array([len(packed), len(raw)], "<u4").tobytes() + packed
