"""NPZ archives of states as a Spark data source, read by ranges of rows and written by tasks.

    spark.dataSource.register(NpzSource)
    spark.read.format("npz").load(folder)
    df.write.format("npz").mode("append").save(folder)

An archive holds arrays of equal length. A one-dimensional one is a column of numbers or strings, a two-dimensional
one of arrays, and complex numbers are struct<re, im>; `pos` is a row's place in its archive and `archive` its name.
Headers tell the shapes, so that arrays that are stored as they are get read by ranges of rows, one task a range, with
a seek in each array. Compressed arrays have no such places: an archive that has one is one task, which inflates all of its
arrays side by side, a range at a time. Filters on `pos` and `archive` drop ranges with option
pushdown, for which spark.sql.python.filterPushdown.enabled must be set; rows are filtered again either way.

A written folder has one archive a task and `checksums.json` with each archive's digest, which is written last: a
folder without it has no archives, and what failed or repeated tasks have left is never read. With option verify (the
default where the file is there) a task hashes its archive through before it takes a row from the same open file; each
archive is then one task, so write many. A wrong byte, a missing archive or arrays of unequal length raise.

Paths are opened with pyarrow where the tasks run: folders of a cluster must be of a store that all machines reach.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

CHECKSUMS = "checksums.json"
PIECE = 1 << 22


def _store(path: str):
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _archives(path: str, verify: str | None) -> list[tuple[str, str | None]]:
    """(path, expected digest) of each archive."""
    from pyarrow import fs

    store, inner = _store(path)
    if inner.endswith(".npz"):
        return [(inner, None)]
    listed = posixpath.join(inner, CHECKSUMS)
    if verify != "false" and store.get_file_info(listed).type == fs.FileType.File:
        with store.open_input_stream(listed) as f:
            return sorted((posixpath.join(inner, k), v) for k, v in json.loads(f.read()).items())
    if verify == "true":
        raise ValueError(f"{path} has no {CHECKSUMS}")
    found = store.get_file_info(fs.FileSelector(inner, recursive=False))
    return sorted((f.path, None) for f in found if f.path.endswith(".npz"))


@dataclass
class _Array:
    """An array of an archive by its header: its numbers begin at `start` of the file, if they are not compressed."""

    name: str
    member: str
    rows: int
    width: int | None
    dtype: np.dtype
    header: int
    start: int | None

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * (1 if self.width is None else self.width)


def _headers(file) -> list[_Array]:
    out = []
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            with z.open(info) as f:
                version = np.lib.format.read_magic(f)
                shape, columns_first, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                header = f.tell()
            if dtype.hasobject or len(shape) not in (1, 2) or (columns_first and len(shape) == 2):
                raise ValueError(f"{info.filename} is no array of rows: {shape} {dtype}")
            start = None
            if info.compress_type == zipfile.ZIP_STORED:
                file.seek(info.header_offset + 26)
                name, extra = np.frombuffer(file.read(4), "<u2")
                start = info.header_offset + 30 + int(name) + int(extra) + header
            out.append(_Array(info.filename.removesuffix(".npy"), info.filename, shape[0], shape[1] if len(shape) == 2 else None, dtype, header, start))
    if len({a.rows for a in out}) > 1:
        raise ValueError(f"arrays of unequal length: {[(a.name, a.rows) for a in out]}")
    return out


def _type(a: _Array) -> pa.DataType:
    kind = a.dtype.kind
    one = pa.string() if kind in "US" else pa.float64() if kind == "f" else pa.float64() if kind == "c" else pa.bool_() if kind == "b" else pa.int64()
    rows = one if a.width is None else pa.list_(one)
    return pa.struct([("re", rows), ("im", rows)]) if kind == "c" else rows


def _column(a: _Array, raw: np.ndarray) -> pa.Array:
    def plain(x: np.ndarray) -> pa.Array:
        if x.dtype.kind == "S":
            x = np.char.decode(x, "utf-8")
        flat = pa.array(x.reshape(-1).tolist(), pa.string()) if x.dtype.kind == "U" else pa.array(np.ascontiguousarray(x).reshape(-1))
        flat = flat if x.dtype.kind in "bU" else flat.cast(pa.int64() if x.dtype.kind in "iu" else pa.float64())
        if a.width is None:
            return flat
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * a.width), flat)

    if a.dtype.kind == "c":
        re, im = plain(raw.real), plain(raw.imag)
        return pa.StructArray.from_arrays([re, im], ["re", "im"])
    return plain(raw)


@dataclass
class _Rows(InputPartition):
    path: str
    first: int
    stop: int
    digest: str | None
    whole: bool


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = schema.names, options
        self.low, self.high, self.names = 0, None, None

    def partitions(self):
        out = []
        size = int(self.options.get("range_bytes", 32 << 20))
        store, _ = _store(self.options["path"])
        for path, digest in _archives(self.options["path"], self.options.get("verify")):
            if self.names is not None and posixpath.basename(path) not in self.names:
                continue
            with store.open_input_file(path) as f:
                arrays = _headers(f)
            rows = arrays[0].rows if arrays else 0
            first, stop = min(self.low, rows), rows if self.high is None else min(self.high, rows)
            if digest or any(a.start is None for a in arrays):
                out += [_Rows(path, first, stop, digest, True)] if first < stop else []
                continue
            step = max(1, size // max(1, sum(a.row_bytes for a in arrays)))
            out += [_Rows(path, at, min(at + step, stop), None, False) for at in range(first, stop, step)]
        return out or [_Rows("", 0, 0, None, False)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.stop:
            return
        store, _ = _store(self.options["path"])
        with store.open_input_file(partition.path) as file:
            if partition.digest:
                seen = hashlib.sha256()
                while piece := file.read(PIECE):
                    seen.update(piece)
                if seen.hexdigest() != partition.digest:
                    raise ValueError(f"{partition.path} does not have the expected digest")
                file.seek(0)
            arrays = {a.name: a for a in _headers(file)}
            wanted = [a for a in arrays.values() if a.name in self.columns]
            step = max(1, PIECE // max(1, sum(a.row_bytes for a in wanted)))
            opened: dict = {}
            with zipfile.ZipFile(file) as z:
                for a in wanted:
                    if a.start is None:
                        opened[a.name] = z.open(a.member)
                        _skip(opened[a.name], a.header + partition.first * a.row_bytes)
                for at in range(partition.first, partition.stop, step):
                    n = min(step, partition.stop - at)
                    columns = {"pos": pa.array(np.arange(at, at + n)), "archive": pa.array([posixpath.basename(partition.path)] * n)}
                    for a in wanted:
                        if a.name not in opened:
                            file.seek(a.start + at * a.row_bytes)
                        raw = (opened[a.name] if a.name in opened else file).read(n * a.row_bytes)
                        if len(raw) != n * a.row_bytes:
                            raise ValueError(f"{partition.path} ends within {a.name}")
                        values = np.frombuffer(raw, a.dtype)
                        columns[a.name] = _column(a, values if a.width is None else values.reshape(n, a.width))
                    yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], self.columns)


class PushingNpzReader(NpzReader):
    """Spark takes a reader with this method only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if column == ("pos",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                top = value + (not isinstance(f, LessThan))
                self.high = top if self.high is None else min(self.high, top)
            if column == ("archive",) and isinstance(f, (EqualTo, In)):
                names = {value} if isinstance(f, EqualTo) else set(value)
                self.names = names if self.names is None else self.names & names
            yield f  # ranges are coarser than rows


def _skip(f, size: int) -> None:
    while size:
        piece = f.read(min(size, PIECE))
        if not piece:
            raise ValueError("an array ends before its rows")
        size -= len(piece)


class NpzWriter(DataSourceWriter):
    """A task's rows as one archive; the task holds them, since a header tells their number."""

    def __init__(self, schema: StructType, options: dict):
        self.types, self.options = to_arrow_schema(schema), options

    def write(self, rows: Iterator) -> WriterCommitMessage:
        columns: dict[str, list] = {name: [] for name in self.types.names}
        for r in rows:
            for name in columns:
                columns[name].append(r[name])
        if not columns or not next(iter(columns.values())):
            return _Written("", "")
        store, inner = _store(self.options["path"])
        store.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}.npz"
        with store.open_output_stream(posixpath.join(inner, name)) as out:
            hashed = _Hashed(out)
            np.savez(hashed, **{k: _array(k, v, self.types.field(k).type) for k, v in columns.items()})
        return _Written(name, hashed.seen.hexdigest())

    def commit(self, messages) -> None:
        store, inner = _store(self.options["path"])
        store.create_dir(inner, recursive=True)
        known = {m.name: m.digest for m in messages if m and m.name}
        listed = posixpath.join(inner, CHECKSUMS)
        if store.get_file_info(listed).is_file:
            with store.open_input_stream(listed) as f:
                known = json.loads(f.read()) | known
        staged = f"{listed}.{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as f:
            f.write(json.dumps(known, sort_keys=True, indent=0).encode())
        store.move(staged, listed)

    def abort(self, messages) -> None:
        store, inner = _store(self.options["path"])
        for m in messages:
            if m and m.name:
                store.delete_file(posixpath.join(inner, m.name))


@dataclass
class _Written(WriterCommitMessage):
    name: str
    digest: str


class _Hashed:
    """A file that can only be written on, whose bytes are hashed as they pass."""

    def __init__(self, out):
        self.out, self.seen, self.at = out, hashlib.sha256(), 0

    def write(self, data) -> int:
        data = bytes(data)
        self.out.write(data)
        self.seen.update(data)
        self.at += len(data)
        return len(data)

    def read(self, *_):
        raise OSError("write only")

    def flush(self) -> None:
        self.out.flush()


def _array(name: str, values: list, kind: pa.DataType) -> np.ndarray:
    if any(v is None for v in values):
        raise ValueError(f"{name} has a null, which an array cannot hold")
    if pa.types.is_struct(kind):
        return np.array([v["re"] for v in values]) + 1j * np.array([v["im"] for v in values])
    lengths = {len(v) for v in values} if pa.types.is_list(kind) else {0}
    if len(lengths) > 1:
        raise ValueError(f"{name} has rows of unequal length")
    out = np.array(values)
    return out if out.dtype.kind in "fiubU" else np.array(values, str)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        """Of the first archive's headers; all archives of a folder have the same arrays."""
        path = self.options["path"]
        archives = _archives(path, self.options.get("verify"))
        if not archives:
            raise ValueError(f"no archive in {path}")
        with _store(path)[0].open_input_file(archives[0][0]) as f:
            arrays = _headers(f)
        return from_arrow_schema(pa.schema([("archive", pa.string()), ("pos", pa.int64()), *((a.name, _type(a)) for a in arrays)]))

    def reader(self, schema: StructType) -> DataSourceReader:
        pushing = self.options.get("pushdown") == "true"
        return (PushingNpzReader if pushing else NpzReader)(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are only added; choose another folder")
        return NpzWriter(schema, dict(self.options))


def read_npz(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(NpzSource)
    options = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | options
    return spark.read.format("npz").options(**options).load(path)


def write_npz(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(NpzSource)
    df.write.format("npz").mode("append").save(path)


def read_npz_states(spark: SparkSession, path: str, manifest: str, split: str | None = None, **options) -> DataFrame:
    """States in the manifest's splits: (parameter_id, label, split, place, state columns).

    The manifest is JSON with `records` of parameter_id, label and split, whose place in it is their order. Ids must be
    the same on both sides and once each, labels equal. With a split the manifest is filtered before the join, so that other
    states are dropped there, and only that split's ids are checked.
    """
    from ketframe.sources.tables import join_manifest

    record = "array<struct<parameter_id: string, label: int, split: string>>"
    records = spark.read.schema(f"records {record}").option("multiLine", "true").json(manifest)
    listed = records.select(F.posexplode("records").alias("place", "r")).select("r.*", "place")
    states = read_npz(spark, path, **options)
    states = states.withColumnsRenamed({"parameter_ids": "parameter_id", "labels": "label", "states": "state"}).drop("archive", "pos")
    if split:
        listed = listed.where(F.col("split") == split)
        states = states.join(listed.select("parameter_id"), "parameter_id", "left_semi")
    return join_manifest(states, listed)
