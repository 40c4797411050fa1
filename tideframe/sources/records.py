"""Length-framed binary files as a Spark data source: frames of a grid, one array a variable, read in slices of points.

Each record of such a file stands between two copies of its length. Where the arrays lie follows from a frame's few small
header records, so planning reads these alone and jumps over the data; a partition is a range of points of one frame, and
a task reads the bytes of the variables that the schema names, and of no others. One large file is therefore read by many
tasks, each of bounded memory. Byte order and precision are told by the lengths.

Two layouts: ``frames`` (title; iteration, time, dimensions, parameters, variables; sizes; parameters if any; names;
coordinates; one record a variable; again for the next frame) and ``blocks`` (version; sizes; number of variables; their
names; time; one record a variable).

Files are opened by pyarrow's file systems, so paths are local (shared by all executors) or of a scheme it knows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType, TimestampNTZType

#: Points of a slice, of one batch within it, and the points and slices that one partition reads.
SLICE, BATCH, TOGETHER, MOST = 1 << 20, 1 << 16, 1 << 18, 4096
#: Files whose headers are read at the same time when a read is planned.
READERS = 16

FRAME = StructType().add("path", StringType()).add("frame", IntegerType()).add("title", StringType()).add("iteration", IntegerType()).add("run_time", DoubleType()).add("point", LongType())
BLOCK = StructType().add("path", StringType()).add("frame", IntegerType()).add("time", TimestampNTZType()).add("version", DoubleType())
BLOCK = BLOCK.add("i", IntegerType()).add("j", IntegerType()).add("k", IntegerType()).add("point", LongType())


@dataclass
class Frame:
    """Where a frame's arrays lie: ``arrays`` has the offset of each variable's first value."""

    path: str
    frame: int
    kind: str
    points: int
    shape: tuple[int, ...]
    constants: dict = field(default_factory=dict)
    arrays: dict[str, int] = field(default_factory=dict)


class Walker:
    """Reads records by their length markers; ``take`` gives a record's bytes, ``skip`` its first byte, without reading it."""

    def __init__(self, path: str):
        self.path = path
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(inner)
        self.size, self.at = self.file.size(), 0
        head = self.file.read_at(min(4, self.size), 0)
        self.order = next((o for o in "<>" if self._closed(head, o)), None)
        if self.order is None:
            raise ValueError(f"{path}: not a file of length-framed records")

    def _closed(self, head: bytes, order: str) -> bool:
        """Whether the first record, read in this byte order, ends with the marker it began with."""
        if len(head) < 4:
            return False
        n = int(np.frombuffer(head, f"{order}i4")[0])
        return 0 <= n <= self.size - 8 and self.file.read_at(4, 4 + n) == head

    def skip(self) -> tuple[int, int]:
        """(first byte, length) of the next record."""
        if self.at + 8 > self.size:
            raise ValueError(f"{self.path}: ends within a frame, at byte {self.at}")
        head = self.file.read_at(4, self.at)
        n = int(np.frombuffer(head, f"{self.order}i4")[0])
        if n < 0 or self.at + 8 + n > self.size or self.file.read_at(4, self.at + 4 + n) != head:
            raise ValueError(f"{self.path}: the record at byte {self.at} does not end with its length")
        start, self.at = self.at + 4, self.at + 8 + n
        return start, n

    def take(self) -> bytes:
        start, n = self.skip()
        return self.file.read_at(n, start)

    def numbers(self, kind: str) -> np.ndarray:
        return np.frombuffer(self.take(), f"{self.order}{kind}")

    def more(self) -> bool:
        return self.at < self.size


def frames_of(path: str) -> list[Frame]:
    """The frames of a file in the ``frames`` layout."""
    w, out = Walker(path), []
    while w.more():
        title = w.take().decode("utf-8", "replace").strip()
        head = w.take()
        real = f"{w.order}f{8 if len(head) > 20 else 4}"
        step, time, dims, parameters, variables = np.frombuffer(head, [("a", f"{w.order}i4"), ("b", real), ("c", f"{w.order}i4"), ("d", f"{w.order}i4"), ("e", f"{w.order}i4")])[0].tolist()
        shape = tuple(int(n) for n in w.numbers("i4"))
        if parameters > 0:
            w.skip()
        names = w.take().decode("utf-8", "replace").split()
        points, width = abs(int(np.prod(shape))), int(real[-1])
        frame = Frame(path, len(out), real, points, shape, {"title": title, "iteration": step, "run_time": time})
        start, length = w.skip()
        if length != abs(dims) * points * width:
            raise ValueError(f"{path}: frame {len(out)} has {length} bytes of coordinates in place of {abs(dims) * points * width}")
        frame.arrays = {name: start + k * points * width for k, name in enumerate(names[: abs(dims)])}
        for name in names[abs(dims) : abs(dims) + variables]:
            frame.arrays[name], length = w.skip()
            if length != points * width:
                raise ValueError(f"{path}: {name} of frame {len(out)} has {length} bytes in place of {points * width}")
        out.append(frame)
    return out


def block_of(path: str) -> list[Frame]:
    """The one frame of a file in the ``blocks`` layout."""
    w = Walker(path)
    version = w.take()
    real = f"{w.order}f{8 if len(version) > 4 else 4}"
    shape = tuple(int(n) for n in w.numbers("i4"))
    count = int(w.numbers("i4")[0])
    names = [w.take().decode("utf-8", "replace").replace("[", "").replace("]", "").strip() for _ in range(count)]
    *whole, milli = (int(x) for x in w.numbers("i4"))
    points = int(np.prod(shape))
    frame = Frame(path, 0, real, points, shape, {"version": float(np.frombuffer(version, real)[0]), "time": dt.datetime(*whole) + dt.timedelta(milliseconds=milli)})
    for name in names:
        frame.arrays[name], length = w.skip()
        if length != points * int(real[-1]):
            raise ValueError(f"{path}: {name} has {length} bytes in place of {points * int(real[-1])}")
    return [frame]


LAYOUTS = {"frames": (FRAME, frames_of), "blocks": (BLOCK, block_of)}


def files_of(paths: list[str]) -> list[str]:
    """Files as they are, folders by the files below them, in order of names; names that begin with a dot or a line are left out."""
    out = []
    for path in paths:
        uri = "://" in path or path.startswith("file:")
        system, inner = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            below = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.base_name[:1] not in "._")
            out += [path.rstrip("/") + f[len(inner.rstrip("/")) :] for f in below]
        elif info.type == fs.FileType.File:
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return out


@dataclass
class Slice:
    frame: Frame
    low: int
    high: int


@dataclass
class Slices(InputPartition):
    """Slices that one task reads; small ones go together, so that there are not as many tasks as slices."""

    parts: list[Slice]


class FrameReader(DataSourceReader):
    def __init__(self, paths: list[str], layout: str, points: int, schema: StructType):
        self.paths, self.layout, self.points, self.schema = paths, layout, points, schema
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Conditions on the frame's number and path decide which partitions there are; the rest is Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and f.attribute in (("frame",), ("path",)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, frame: Frame) -> bool:
        for f in self.tests:
            x, v = getattr(frame, f.attribute[0]), f.value
            kept = {EqualTo: lambda: x == v, In: lambda: x in v, GreaterThan: lambda: x > v, GreaterThanOrEqual: lambda: x >= v, LessThan: lambda: x < v, LessThanOrEqual: lambda: x <= v}[type(f)]()
            if not kept:
                return False
        return True

    def partitions(self) -> list[Slices]:
        with ThreadPoolExecutor(READERS) as pool:
            found = [f for frames in pool.map(LAYOUTS[self.layout][1], files_of(self.paths)) for f in frames if self._wanted(f)]
        out = [Slice(f, low, min(low + self.points, f.points)) for f in found for low in range(0, f.points, self.points)]
        together, held = [], 0
        for s in out:
            if not together or held + s.high - s.low > TOGETHER or len(together[-1].parts) >= MOST:
                together.append(Slices([]))
                held = 0
            together[-1].parts.append(s)
            held += s.high - s.low
        return together or [Slices([])]

    def read(self, part: Slices) -> Iterator[pa.RecordBatch]:
        for s in part.parts:
            yield from self._slice(s)

    def _slice(self, part: Slice) -> Iterator[pa.RecordBatch]:
        f, width = part.frame, int(part.frame.kind[-1])
        if part.low >= part.high:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        file = Walker(f.path).file
        for low in range(part.low, part.high, BATCH):
            n = min(BATCH, part.high - low)
            point = np.arange(low, low + n)
            place = dict(zip("ijk", np.unravel_index(point, f.shape, order="F"), strict=False)) if self.layout == "blocks" else {}
            columns = []
            for c in schema:
                if c.name in f.arrays:
                    columns.append(pa.array(np.frombuffer(file.read_at(n * width, f.arrays[c.name] + low * width), f.kind).astype(np.float64)).cast(c.type))
                elif c.name == "point" or c.name in place:
                    columns.append(pa.array(place.get(c.name, point)).cast(c.type))
                else:
                    value = {"path": f.path, "frame": f.frame, **f.constants}.get(c.name)
                    columns.append(pa.repeat(pa.scalar(value, c.type), n))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class RecordFrames(DataSource):
    """``spark.read.format("record_frames")``; options ``paths`` (a JSON list) or ``path``, ``layout`` and ``points`` of a partition.

    The schema names what is read: constants of a frame, ``point``, for blocks ``i``, ``j``, ``k``, and variables as doubles; a
    variable that a frame lacks is null. Without one, it has all variables of the first frame.
    """

    @classmethod
    def name(cls) -> str:
        return "record_frames"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def _layout(self) -> str:
        return self.options.get("layout", "frames")

    def schema(self) -> StructType:
        base, walk = LAYOUTS[self._layout()]
        out = StructType(list(base.fields))
        for path in files_of(self._paths())[:1]:
            for name in walk(path)[0].arrays:
                out = out.add(name, DoubleType())
        return out

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self._paths(), self._layout(), int(self.options.get("points", SLICE)), schema)


def read_record_frames(spark: SparkSession, paths: str | list[str], variables: list[str] | None = None, layout: str = "frames", points: int = SLICE) -> DataFrame:
    """Points of the frames in files or folders, with the named ``variables`` (all of the first frame's if none are named)."""
    spark.dataSource.register(RecordFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("record_frames").option("paths", json.dumps([paths] if isinstance(paths, str) else paths)).option("layout", layout).option("points", str(points))
    if variables is not None:
        schema = StructType(list(LAYOUTS[layout][0].fields))
        for name in variables:
            schema = schema.add(name, DoubleType())
        reader = reader.schema(schema)
    return reader.load()


def framed(parts: list[bytes], order: str = "<") -> bytes:
    """Records with their lengths before and behind."""
    mark = lambda p: np.array([len(p)], f"{order}i4").tobytes()
    return b"".join(mark(p) + p + mark(p) for p in parts)


def write_record_frames(df: DataFrame, folder: str, file: str, frame: str, point: str, coordinates: list[str], variables: list[str], double: bool = False, order: str = "<") -> DataFrame:
    """(path, frames) of files written below ``folder``, one for each value of ``file``, in order of ``frame`` and ``point``.

    A frame's number becomes its iteration and time. Tasks hold one frame at a time and write each file under its final name only when
    it is whole, so that a task that is run again leaves the same file.
    """
    names, real = [*coordinates, *variables], np.dtype(f"{order}f{8 if double else 4}")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        state: dict = {"file": None, "frame": None, "rows": [], "out": None, "n": 0}
        done: list[tuple[str, int]] = []

        def close_frame() -> None:
            if state["rows"]:
                values = np.concatenate(state["rows"]).astype(real)
                head = np.array([(state["frame"], state["frame"], len(coordinates), 0, len(variables))], [("a", f"{order}i4"), ("b", real), ("c", f"{order}i4"), ("d", f"{order}i4"), ("e", f"{order}i4")])
                sizes = np.array([len(values)] + [1] * (len(coordinates) - 1), f"{order}i4")
                parts = [b"points".ljust(79), head.tobytes(), sizes.tobytes(), " ".join(names).encode().ljust(79), values[:, : len(coordinates)].T.tobytes()]
                state["out"].write(framed(parts + [values[:, len(coordinates) + k].tobytes() for k in range(len(variables))], order))
                state["n"] += 1
            state["rows"] = []

        def close_file() -> None:
            if state["file"] is not None:
                close_frame()
                state["out"].close()
                system.move(f"{inner}/.{state['file']}.part-{state['token']}", f"{inner}/{state['file']}.out")
                done.append((f"{folder}/{state['file']}.out", state["n"]))

        import uuid

        for batch in batches:
            files, frames_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(names))], 1)
            cuts = [0, *(i for i in range(1, len(files)) if (files[i], frames_[i]) != (files[i - 1], frames_[i - 1])), len(files)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low < high:
                    if files[low] != state["file"]:
                        close_file()
                        state |= {"file": files[low], "frame": None, "n": 0, "token": uuid.uuid4().hex}
                        system.create_dir(inner, recursive=True)
                        state["out"] = system.open_output_stream(f"{inner}/.{files[low]}.part-{state['token']}")
                    if frames_[low] != state["frame"]:
                        close_frame()
                        state["frame"] = frames_[low]
                    state["rows"].append(values[low:high])
        close_file()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int32())], ["path", "frames"])

    rows = df.select(F.col(file).cast("string").alias("_file"), F.col(frame).cast("int").alias("_frame"), *(F.col(c).cast("double").alias(c) for c in names), F.col(point).alias("_point"))
    return rows.repartition("_file").sortWithinPartitions("_file", "_frame", "_point").mapInArrow(job, "path string, frames int")
