"""Parallel load of netCDF-3 files (classic and 64-bit offset) as Spark tables and streams.

Files are read in place, from any store that Arrow's file systems reach by the path's scheme:
a mounted folder, hdfs, s3, gs or abfs. The driver reads headers only; each partition is one
file and a range of time steps. Conditions on time, plevel, lat and lon become byte ranges:
partitions without a wanted step are not made, and a task reads the wanted stretches of the
wanted variables, no others.

Conditions come with ``where`` when a table is read, and not by Spark's push-down: Spark 4.1
keeps one set of pushed conditions for each table a Python source has loaded, so a union or
self-join of two selections of one table would read the last one's rows for both.
"""

from __future__ import annotations

import fnmatch
import json
import math
import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

# Fixed values of the file format: number types by code.
NUMBER_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
AXES = {1: ("plevel",), 3: ("time", "lat", "lon"), 4: ("time", "plevel", "lat", "lon")}


# A stretch nobody asked for is read too when it is shorter than this: one request instead of two.
GAP_BYTES = 4096


def _store(path: str):
    """(file system, path inside it) of a path with or without a scheme."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def open_input(path: str):
    store, inner = _store(path)
    return store.open_input_file(inner)


def matching(pattern: str) -> list[str]:
    """Files of one folder whose names match, in the order of their names, with their scheme."""
    folder, name = pattern.rsplit("/", 1) if "/" in pattern else (".", pattern)
    store, inner = _store(folder)
    head = folder[:folder.index("://") + 3] if "://" in folder else ""
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.is_file and fnmatch.fnmatch(f.base_name, name))
    return [f"{folder}/{n}" if head or folder != "." else f"{inner}/{n}" for n in names]


@dataclass
class Variable:
    name: str
    shape: tuple
    dtype: str
    begin: int
    stride: int | None  # bytes from one record to the next; None if not by record
    attributes: dict


class _Header:
    def __init__(self, path):
        with open_input(path) as self.f:
            magic = self.f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2):
                raise ValueError(f"{path} is not a netCDF-3 file")
            self.wide = magic[3] == 2
            records = self._int()
            dims = self._list(lambda: (self._name(), self._int()))
            self._list(self._attribute)
            found = self._list(self._variable)
        of_record = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
        record = sum(v[4] for v in of_record)
        if len(of_record) == 1:
            # A record variable on its own is not padded to four bytes.
            _, ids, _, code, _, _ = of_record[0]
            record = math.prod(dims[i][1] for i in ids[1:]) * np.dtype(NUMBER_TYPES[code]).itemsize
        self.variables = {}
        for name, ids, attributes, code, size, begin in found:
            by_record = bool(ids) and dims[ids[0]][1] == 0
            shape = tuple(dims[i][1] or records for i in ids)
            self.variables[name] = Variable(name, shape, NUMBER_TYPES[code], begin,
                                            record if by_record else None, attributes)

    def _int(self):
        return struct.unpack(">i", self.f.read(4))[0]

    def _padded(self, size):
        return self.f.read(size + -size % 4)[:size]

    def _name(self):
        return self._padded(self._int()).decode("utf-8")

    def _list(self, item):
        self._int()  # tag: zero for an absent list, which then has no items
        return [item() for _ in range(self._int())]

    def _attribute(self):
        name, code, count = self._name(), self._int(), self._int()
        dtype = np.dtype(NUMBER_TYPES[code])
        raw = self._padded(count * dtype.itemsize)
        return name, raw.decode("utf-8") if code == 2 else np.frombuffer(raw, dtype).tolist()

    def _variable(self):
        name, ids = self._name(), [self._int() for _ in range(self._int())]
        attributes = dict(self._list(self._attribute))
        code, size = self._int(), self._int()
        begin = struct.unpack(">q", self.f.read(8))[0] if self.wide else self._int()
        return name, ids, attributes, code, size, begin


def variables_of(path: str) -> dict[str, Variable]:
    return _Header(path).variables


def _values(f, v: Variable, step: int, cells: np.ndarray | None) -> np.ndarray:
    """Numbers of one entry along the first axis: all, or those at the sorted places ``cells``."""
    dtype = np.dtype(v.dtype)
    size = int(np.prod(v.shape[1:], dtype=np.int64))
    start = v.begin + step * (size * dtype.itemsize if v.stride is None else v.stride)
    if cells is None or len(cells) == size:
        f.seek(start)
        return np.frombuffer(f.read(size * dtype.itemsize), dtype).astype(np.float64)
    cuts = np.flatnonzero(np.diff(cells) * dtype.itemsize > GAP_BYTES) + 1
    parts = []
    for run in np.split(cells, cuts):
        f.seek(start + int(run[0]) * dtype.itemsize)
        raw = np.frombuffer(f.read(int(run[-1] - run[0] + 1) * dtype.itemsize), dtype)
        parts.append(raw[run - run[0]])
    return np.concatenate(parts).astype(np.float64) if len(cells) else np.zeros(0)


@dataclass
class GridPartition(InputPartition):
    path: str
    start: int
    stop: int
    offset: int  # added to the time index
    wanted: dict = field(default_factory=dict)


def selected(size: int, wanted, offset: int = 0) -> np.ndarray:
    """Places 0 … size-1 of an axis whose coordinate (place + offset) is wanted.

    That is a number, a list of numbers, a half-open range {"from": …, "to": …}, or all if None.
    """
    places = np.arange(offset, size + offset)
    if isinstance(wanted, dict):
        unknown = set(wanted) - {"from", "to"}
        if unknown:
            raise ValueError(f"a range goes from and to, not {sorted(unknown)}")
        keep = (places >= wanted.get("from", -np.inf)) & (places < wanted.get("to", np.inf))
    else:
        keep = np.isin(places, wanted) if wanted is not None else np.ones(size, bool)
    return np.flatnonzero(keep)


class GridReader(DataSourceReader):
    CHOICE = ("time", "plevel", "lat", "lon")

    def __init__(self, paths, names, steps, in_line, where=None):
        self.paths, self.names, self.steps, self.in_line = paths, names, steps, in_line
        self.wanted = where or {}
        unknown = set(self.wanted) - set(self.CHOICE)
        if unknown:
            raise ValueError(f"no condition can be set on {sorted(unknown)}")

    def partitions(self):
        found, before = [], 0
        for path in self.paths:
            length = variables_of(path)[self.names[0]].shape[0]
            found += self._parts(path, 0, length, before)
            if self.in_line:
                before += length
        return found

    def _parts(self, path, first, last, before):
        """Partitions of the steps [first, last) of a file that hold a wanted one."""
        # The first axis is time, but for a level coordinate, which has that one only.
        times = self.wanted.get("time")
        starts = range(first, last, self.steps)
        return [GridPartition(path, s, min(s + self.steps, last), before, self.wanted) for s in starts
                if times is None or len(selected(min(s + self.steps, last) - s, times, s + before))]

    def read(self, part):
        known = variables_of(part.path)
        wanted = [known[n] for n in self.names]
        shape = wanted[0].shape
        if any(v.shape != shape for v in wanted):
            raise ValueError(f"variables of different shapes: {self.names}")
        axes = AXES[len(shape)]
        source = os.path.basename(part.path)
        # What is chosen of the later axes is the same in every step.
        chosen = [selected(n, part.wanted.get(a)) for a, n in zip(axes[1:], shape[1:])]
        grid = np.meshgrid(*chosen, indexing="ij") if chosen else [np.zeros(1, np.int64)]
        index = [g.ravel().astype(np.int32) for g in grid] if chosen else []
        size = int(np.prod([len(c) for c in chosen])) if chosen else 1
        cells = None
        if chosen and size < np.prod(shape[1:]):
            cells = np.ravel_multi_index([i.astype(np.int64) for i in index], shape[1:]) if size else np.zeros(0, np.int64)
        first = selected(part.stop - part.start, part.wanted.get(axes[0]), part.start + part.offset) + part.start
        if not size:
            return
        names = pa.array([source] * size)
        later = [pa.array(i) for i in index]
        with open_input(part.path) as f:
            for t in first:
                at = pa.array(np.full(size, t + part.offset, np.int32))
                columns = [names, at, *later, *(pa.array(_values(f, v, int(t), cells)) for v in wanted)]
                yield pa.RecordBatch.from_arrays(columns, ["source", *axes, *self.names])


class ColumnReader(GridReader):
    """Vertical columns: a time step holds all levels, so no shuffle is needed to join them."""

    CHOICE = ("time", "lat", "lon")

    def read(self, part):
        known = variables_of(part.path)
        wanted = [known[n] for n in self.names]
        shape = wanted[0].shape[-2:]
        lat, lon = (g.ravel() for g in np.meshgrid(*[
            selected(n, part.wanted.get(a)) for a, n in zip(("lat", "lon"), shape)], indexing="ij"))
        size = len(lat)
        times = selected(part.stop - part.start, part.wanted.get("time"), part.start + part.offset) + part.start
        if not size:
            return
        source = pa.array([os.path.basename(part.path)] * size)
        place = lat * shape[1] + lon
        whole = size == shape[0] * shape[1]
        with open_input(part.path) as f:
            for t in times:
                columns = [source, pa.array(np.full(size, t + part.offset, np.int32)),
                           pa.array(lat.astype(np.int32)), pa.array(lon.astype(np.int32))]
                for v in wanted:
                    levels = v.shape[1] if len(v.shape) == 4 else 1
                    level = np.arange(levels)[:, None] * (shape[0] * shape[1])
                    values = _values(f, v, int(t), None if whole else (level + place).ravel())
                    if len(v.shape) == 4:
                        offsets = np.arange(0, values.size + 1, levels, dtype=np.int32)
                        values = values.reshape(levels, size).T.ravel()
                        columns.append(pa.ListArray.from_arrays(offsets, values))
                    else:
                        columns.append(pa.array(values))
                yield pa.RecordBatch.from_arrays(columns, ["source", "time", "lat", "lon", *self.names])


class GridStream(DataSourceStreamReader):
    """Time steps as they arrive. An offset is (file, its steps read, steps of the files before).

    New files sort after those that were there, and appear complete; the newest may gain steps.
    """

    def __init__(self, pattern, reader):
        self.pattern, self.reader = pattern, reader

    def initialOffset(self):
        return {"file": "", "steps": 0, "before": 0}

    def _lengths(self, after: str):
        """(name, path, steps) of the files from ``after`` on."""
        for path in matching(self.pattern):
            name = os.path.basename(path)
            if name >= after:
                yield name, path, variables_of(path)[self.reader.names[0]].shape[0]

    def latestOffset(self):
        last = getattr(self, "last", self.initialOffset())
        for name, _, steps in self._lengths(last["file"]):
            before = last["before"] + (last["steps"] if name > last["file"] and self.reader.in_line else 0)
            last = {"file": name, "steps": steps, "before": before}
        self.last = last
        return last

    def partitions(self, start, end):
        found, before = [], start["before"]
        for name, path, steps in self._lengths(start["file"]):
            if name > end["file"]:
                break
            known = start["steps"] if name == start["file"] else 0
            stop = end["steps"] if name == end["file"] else steps
            if name > start["file"] and name == end["file"]:
                before = end["before"]
            found += self.reader._parts(path, known, stop, before)
            if self.reader.in_line:
                before += steps
        return found

    def read(self, part):
        return self.reader.read(part)


class GridSource(DataSource):
    """format("grid") with options path (a glob), variables (comma list), steps, in_line."""

    @classmethod
    def name(cls):
        return "grid"

    def _paths(self):
        paths = matching(self.options["path"])
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return paths

    def _names(self):
        return [n.strip() for n in self.options["variables"].split(",")]

    def schema(self):
        names = self._names()
        axes = AXES[len(variables_of(self._paths()[0])[names[0]].shape)]
        fields = ["source STRING", *(f"{a} INT" for a in axes), *(f"{n} DOUBLE" for n in names)]
        return ", ".join(fields)

    READER = GridReader

    def _reader(self, paths):
        in_line = self.options.get("in_line", "false").lower() == "true"
        return self.READER(paths, self._names(), int(self.options.get("steps", "8")), in_line,
                           json.loads(self.options.get("where", "{}")))

    def reader(self, schema):
        return self._reader(self._paths())

    def streamReader(self, schema):
        return GridStream(self.options["path"], self._reader([]))


class ColumnSource(GridSource):
    """format("grid_columns"), same options: four-axis variables become arrays by level."""

    @classmethod
    def name(cls):
        return "grid_columns"

    READER = ColumnReader

    def schema(self):
        known = variables_of(self._paths()[0])
        kind = {4: "ARRAY<DOUBLE>", 3: "DOUBLE"}
        fields = [f"{n} {kind[len(known[n].shape)]}" for n in self._names()]
        return ", ".join(["source STRING", "time INT", "lat INT", "lon INT", *fields])


def _load(spark, kind, path, variables, steps, in_line, where=None, stream=False):
    spark.dataSource.register(kind)
    return ((spark.readStream if stream else spark.read).format(kind.name()).option("path", path)
            .option("variables", ",".join(variables)).option("steps", str(steps))
            .option("in_line", str(in_line)).option("where", json.dumps(where or {})).load())


def stream_columns(spark: SparkSession, path: str, variables, steps: int = 8, in_line: bool = False,
                   where: dict | None = None) -> DataFrame:
    """Vertical columns of the files of a glob as a stream: those there, then those that appear.

    At least one file must be there, for its header. Names of new files sort after old ones.
    """
    return _load(spark, ColumnSource, path, variables, steps, in_line, where, stream=True)


def stream_grid(spark: SparkSession, path: str, variables, steps: int = 8, in_line: bool = False,
                where: dict | None = None) -> DataFrame:
    """The same as cells."""
    return _load(spark, GridSource, path, variables, steps, in_line, where, stream=True)


def read_columns(spark: SparkSession, path: str, variables, steps: int = 8, in_line: bool = False,
                 where: dict | None = None) -> DataFrame:
    """Vertical columns (source, time, lat, lon, …) straight from the files, without a shuffle.

    Variables may have four axes (arrays by level) or three (plain numbers). ``where`` as in
    :func:`read_grid`, but for plevel.
    """
    return _load(spark, ColumnSource, path, variables, steps, in_line, where)


def read_grid(spark: SparkSession, path: str, variables, steps: int = 8, in_line: bool = False,
              where: dict | None = None) -> DataFrame:
    """Cells of variables that share a shape, from every file of the glob.

    Four axes give (source, time, plevel, lat, lon, …), three a surface without plevel,
    one a level coordinate. ``steps`` time steps make one partition. With ``in_line``,
    the time axes of the files follow each other in the order of their names. ``where`` maps
    time, plevel, lat or lon to a number, a list of numbers or a range {"from": 3, "to": 6};
    nothing else is read.
    """
    return _load(spark, GridSource, path, variables, steps, in_line, where)


def read_levels(spark: SparkSession, path: str, name: str = "level") -> DataFrame:
    """The level coordinate of one file: plevel, hpa."""
    return read_grid(spark, path, [name]).select("plevel", F.col(name).alias("hpa"))


def count_columns(path: str, variable: str) -> int:
    """Vertical columns in all files of the glob, from their headers."""
    shapes = [variables_of(p)[variable].shape for p in matching(path)]
    return sum(s[0] * s[-2] * s[-1] for s in shapes)


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    """The variable dimension of one file: name, long name, units, valid range."""
    rows = [(v.name, v.attributes.get("long_name", ""), v.attributes.get("units", ""),
             str(v.attributes.get("valid_range", ""))) for v in variables_of(path).values()]
    return spark.createDataFrame(rows, "name STRING, long_name STRING, units STRING, valid_range STRING")
