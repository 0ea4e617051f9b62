"""Array and skeleton files as Spark data sources: ``event_arrays``, ``pose_arrays``, ``depth_text``.

``spark.read.format("pose_arrays").load(path)`` after :func:`register`. An array file is read in
ranges of rows of about ``rangeBytes``, so one large file is many tasks and no file has to fit into a
row; small files share a task. The options ``pathPattern``, ``firstRow`` and ``endRow`` choose files and
rows before anything is read, and a ``schema`` of fewer columns leaves the others unbuilt. (They are
options and not pushed filters: Spark 4.1 shows a filter that one query pushed into a Python source to
other queries of the same ``load``, which then miss rows.) Members of archives are read as a stream by
one task each.

Files are opened through Arrow's file systems (local, S3, GCS, HDFS); the listing and the headers of
arrays are read on the driver, the contents by the tasks.
"""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinetable.dims import NUM_JOINTS
from kinetable.operators.events import FIELD_ALIASES, field_names
from kinetable.sources.text import skeleton_rows

RANGE_BYTES = 64 << 20
#: Rows of a result batch, files whose headers are read at a time.
EVENTS, FRAMES, BODIES, HEADERS = 200_000, 2_000, 2_000, 32
WIDTH = NUM_JOINTS * 3


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path inside it."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def reachable(path: str) -> bool:
    """Whether Arrow has a file system for the path; Spark may know others."""
    try:
        system, place = file_system(path)
        return system.get_file_info(place).type != pafs.FileType.NotFound
    except (ValueError, NotImplementedError, OSError):
        return False


def listed(path: str, glob: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files below ``path`` whose names match; hidden ones are left out."""
    system, place = file_system(path)
    scheme = "file:" if system.type_name == "local" else path[: path.index(":") + 1] + "//"
    info = system.get_file_info(place)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        found = [f for f in system.get_file_info(pafs.FileSelector(place, recursive=True)) if f.type == pafs.FileType.File]
        below = [f.path[len(place.rstrip("/")) :] for f in found]
        found = [f for f, name in zip(found, below, strict=True) if not re.search(r"/[._]", name)]
    return sorted((scheme + f.path, f.size) for f in found if fnmatch.fnmatchcase(f.base_name, glob))


@dataclass
class Layout:
    """Where the rows of an array lie: ``start`` is the byte after the header."""

    shape: tuple[int, ...]
    fortran: bool
    dtype: np.dtype
    start: int

    @staticmethod
    def of(file: BinaryIO) -> Layout:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(file)
        if dtype.hasobject:
            raise ValueError("arrays of Python objects are not read")
        return Layout(shape, fortran, dtype, file.tell())

    @property
    def row(self) -> int:
        """Values of a row."""
        return int(np.prod(self.shape[1:], dtype=np.int64))

    def rows(self, file: BinaryIO, low: int, high: int) -> np.ndarray:
        """Rows [low, high); of a column-major array one stretch for every value of a row."""
        size = self.dtype.itemsize
        if not self.fortran:
            file.seek(self.start + low * self.row * size)
            return np.frombuffer(file.read((high - low) * self.row * size), self.dtype).reshape(high - low, *self.shape[1:])
        out = np.empty((self.row, high - low), self.dtype)
        for j in range(self.row):
            file.seek(self.start + (j * self.shape[0] + low) * size)
            out[j] = np.frombuffer(file.read((high - low) * size), self.dtype)
        return out.T.reshape((high - low, *self.shape[1:]), order="F")


@dataclass
class Ranges(InputPartition):
    """Ranges of rows (file, first, last) that one task reads; the last is -1 for a whole file."""

    parts: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    """Lists files, cuts them into ranges and packs the ranges into tasks."""

    glob = "*"
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path = options["path"]
        self.glob = options.get("pathGlobFilter", self.glob)
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.pattern = re.compile(options.get("pathPattern", ""))
        self.arrow = to_arrow_schema(schema)
        self.names = schema.fieldNames()
        self.low, self.high = int(options.get("firstRow", 0)), int(options.get("endRow", 1 << 62))

    def layout(self, path: str) -> Layout | None:
        """The array's layout, or None for a file that only streams."""
        return None

    def partitions(self) -> Sequence[InputPartition]:
        found = [(p, n) for p, n in listed(self.path, self.glob) if self.pattern.search(p)]
        with ThreadPoolExecutor(HEADERS) as pool:
            layouts = list(pool.map(lambda f: self.layout(f[0]), found))
        tasks, held, size = [], [], 0
        for (path, length), layout in zip(found, layouts, strict=True):
            if layout is None:
                ranges = [(path, 0, -1, length)]
            else:
                each = max(1, layout.row * layout.dtype.itemsize)
                step = max(1, self.range_bytes // each)
                low, high = min(self.low, layout.shape[0]), min(self.high, layout.shape[0])
                ranges = [(path, at, min(at + step, high), (min(at + step, high) - at) * each) for at in range(low, high, step)]
                ranges = ranges or ([(path, 0, 0, 0)] if self.head else [])
            for *part, weight in ranges:
                if held and size + weight > self.range_bytes:
                    tasks.append(Ranges(held))
                    held, size = [], 0
                held.append(tuple(part))
                size += weight
        return [*tasks, Ranges(held)] if held else tasks or [Ranges([])]

    head = False

    def batch(self, columns: dict[str, object]) -> pa.RecordBatch:
        arrays = [c() if callable(c := columns[name]) else c for name in self.names]
        made = [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, self.arrow.types, strict=True)]
        return pa.RecordBatch.from_arrays(made, schema=self.arrow)


def _named(path: str, rows: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(rows, np.int32)), [path])


class EventReader(_Reader):
    glob = "*.npy"

    def layout(self, path: str) -> Layout:
        system, place = file_system(path)
        with system.open_input_file(place) as file:
            try:
                found = Layout.of(file)
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from error
        if not found.dtype.names and (len(found.shape) != 2 or found.shape[1] != len(FIELD_ALIASES)):
            raise ValueError(f"{path}: an event array has four columns, this one has the shape {found.shape}")
        return found

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, low, high in partition.parts:
            system, place = file_system(path)
            with system.open_input_file(place) as file:
                layout = Layout.of(file)
                if layout.dtype.names:
                    fields = field_names(list(layout.dtype.names), f"{path}: ")
                for at in range(low, high, EVENTS):
                    rows = layout.rows(file, at, min(at + EVENTS, high))
                    if layout.dtype.names:
                        columns = {out: (lambda n=name, r=rows: r[n].ravel().astype(float)) for out, name in fields.items()}
                    else:
                        columns = {out: (lambda i=i, r=rows: r[:, i].astype(float)) for i, (out, _) in enumerate(FIELD_ALIASES)}
                    yield self.batch({"path": lambda p=path, n=len(rows): _named(p, n), **columns})


class PoseReader(_Reader):
    glob = "*.np[yz]"

    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        #: Also a row without a frame for every file, so that clips without frames or people keep their length.
        self.head = options.get("heads", "false").lower() == "true"

    @staticmethod
    def _checked(path: str, shape: tuple[int, ...]) -> None:
        if not (len(shape) == 4 and shape[2:] == (NUM_JOINTS, 3) or len(shape) == 3 and shape[2] == WIDTH):
            raise ValueError(f"{path}: keypoints need shape (T, M, 17, 3) or (T, M, 51), found {shape}")

    def layout(self, path: str) -> Layout | None:
        if path.endswith(".npz"):
            return None
        system, place = file_system(path)
        with system.open_input_file(place) as file:
            found = Layout.of(file)
        self._checked(path, found.shape)
        return found

    def _rows(self, path: str, total: int, low: int, values: np.ndarray) -> pa.RecordBatch:
        count, people = values.shape[:2]
        n = count * people
        flat = values.reshape(n, WIDTH)
        points = lambda: pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(np.float64).ravel()), WIDTH)
        return self.batch(
            {
                "path": lambda: _named(path, n),
                "num_frames": np.full(n, total, np.int32),
                "frame": lambda: np.repeat(np.arange(low, low + count, dtype=np.int32), people),
                "person": lambda: np.tile(np.arange(people, dtype=np.int32), count),
                "keypoints": points,
            }
        )

    def _blocks(self, layout: Layout, path: str, low: int, high: int, take) -> Iterator[pa.RecordBatch]:
        if self.head and low == 0:
            yield self.batch({"path": [path], "num_frames": [layout.shape[0]], "frame": [None], "person": [None], "keypoints": [None]})
        for at in range(low, high, FRAMES):
            rows = take(at, min(at + FRAMES, high))
            if rows.size:
                yield self._rows(path, layout.shape[0], at, rows)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, low, high in partition.parts:
            system, place = file_system(path)
            with system.open_input_file(place) as file:
                if high >= 0:
                    layout = Layout.of(file)
                    yield from self._blocks(layout, path, low, high, lambda a, b, f=file, x=layout: x.rows(f, a, b))
                    continue
                with zipfile.ZipFile(file) as archive:
                    names = archive.namelist()
                    member = "keypoints.npy" if "keypoints.npy" in names else names[0]
                    with archive.open(member) as stream:
                        layout = Layout.of(stream)
                        self._checked(path, layout.shape)
                        first, last = min(self.low, layout.shape[0]), min(self.high, layout.shape[0])
                        # The member is unpacked as it is read; a column-major one only as a whole.
                        whole = io.BytesIO(stream.read()) if layout.fortran else None
                        if whole is not None:
                            layout.start = 0
                        else:
                            stream.seek(layout.start + first * layout.row * layout.dtype.itemsize)
                            layout.start = stream.tell() - first * layout.row * layout.dtype.itemsize
                        yield from self._blocks(layout, path, first, last, lambda a, b, f=whole or stream, x=layout: x.rows(f, a, b))


class DepthReader(_Reader):
    glob = "*.skeleton"

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, _, _ in partition.parts:
            system, place = file_system(path)
            with system.open_input_stream(place) as file:
                words = (word for line in io.TextIOWrapper(file, "utf-8") for word in line.split())
                rows = skeleton_rows(words)
                while held := list(islice(rows, BODIES)):
                    columns = dict(zip(("num_frames", "frame", "pos", "body_id", "values"), zip(*held, strict=True), strict=True))
                    yield self.batch({"path": lambda p=path, n=len(held): _named(p, n), **columns})


class _Source(DataSource):
    columns = ""
    reader_type: type[_Reader]

    @classmethod
    def name(cls) -> str:
        raise NotImplementedError

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_type(schema, self.options)


class EventArrays(_Source):
    columns, reader_type = "path string, t_us double, x double, y double, p double", EventReader

    @classmethod
    def name(cls) -> str:
        return "event_arrays"


class PoseArrays(_Source):
    columns, reader_type = "path string, num_frames int, frame int, person int, keypoints array<double>", PoseReader

    @classmethod
    def name(cls) -> str:
        return "pose_arrays"


class DepthText(_Source):
    columns, reader_type = "path string, num_frames int, frame int, pos int, body_id string, values array<double>", DepthReader

    @classmethod
    def name(cls) -> str:
        return "depth_text"


def load(spark: SparkSession, name: str, path: str, glob: str, **options: str) -> DataFrame:
    """The format's rows below ``path``; raises if no file matches."""
    register(spark)
    if not listed(path, glob):
        raise FileNotFoundError(f"no {glob} files under {path}")
    return spark.read.format(name).options(pathGlobFilter=glob, **options).load(path)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for source in (EventArrays, PoseArrays, DepthText):
        spark.dataSource.register(source)
