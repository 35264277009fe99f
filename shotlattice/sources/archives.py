"""NumPy archives (.npz) as a table: a folder of archives, one an item, each with named arrays. Reading and writing are Spark data sources.

``spark.dataSource.register(ArrayArchives)``, then ``spark.read.format("arrays").load(folder)`` gives (item, array, shape, values). A filter on ``item`` or ``array`` is pushed into the source: archives of
other items are not planned, and of an archive only the members asked for are read, as it is a zip file. Writing (item, array, shape, values) makes one archive an item; rows of an item must lie together in a
task, see ``write_archives``.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "item string, array string, shape array<int>, values array<double>"
#: Bytes of archives that one task reads, about.
TASK_BYTES = 64 << 20


def _files(path: str):
    """The file system of a path or address, and the path on it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Archives(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path.rstrip("/"), task_bytes
        self.items: set | None = None
        self.arrays: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in ("item", "array"):
                yield f
            elif not isinstance(f, IsNotNull):  # neither is ever null
                wanted = set(f.value if isinstance(f, In) else [f.value])
                mine = "items" if name == "item" else "arrays"
                have = getattr(self, mine)
                setattr(self, mine, wanted if have is None else have & wanted)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, at = _files(self.path)
        found = [f for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.type == FileType.File and f.path.endswith(".npz")]
        found = sorted((f.path, f.size) for f in found if self.items is None or _item(f.path) in self.items)
        out, size = [_Archives([])], 0
        for path, n in found:
            if out[-1].paths and size + n > self.task_bytes:
                out.append(_Archives([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: _Archives) -> Iterator[tuple]:
        fs, _ = _files(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for member in sorted(z.namelist()):
                    name = member.removesuffix(".npy")
                    if self.arrays is None or name in self.arrays:
                        values = np.load(io.BytesIO(z.read(member)), allow_pickle=False)
                        yield _item(path), name, list(values.shape), values.astype(float).ravel().tolist()


def _item(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npz")


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Archives are written under passing names and get their own when the whole job has succeeded, so a task that is run again leaves nothing twice."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        fs, at = _files(self.path)
        fs.create_dir(at, recursive=True)
        moves, item, arrays, seen = [], None, {}, set()

        def done() -> None:
            if item is not None:
                if item in seen:
                    raise ValueError(f"the rows of {item} do not lie together")
                seen.add(item)
                passing = f"{at}/.{self.job}-{uuid.uuid4().hex}"
                held = io.BytesIO()
                np.savez_compressed(held, **arrays)
                with fs.open_output_stream(passing) as f:
                    f.write(held.getvalue())
                moves.append((passing, f"{at}/{item}.npz"))

        for r in rows:
            if r["item"] != item:
                done()
                item, arrays = r["item"], {}
            arrays[r["array"]] = np.asarray(r["values"], float).reshape(r["shape"])
        done()
        return _Written(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, at = _files(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(FileSelector(at)):
                if f.path.endswith(".npz"):
                    fs.delete_file(f.path)
        for m in messages:
            for passing, name in m.moves if m else []:
                fs.move(passing, name)
        self._sweep(fs, at)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._sweep(*_files(self.path))

    def _sweep(self, fs, at: str) -> None:
        from pyarrow.fs import FileSelector

        for f in fs.get_file_info(FileSelector(at, allow_not_found=True)):
            if f.path.rsplit("/", 1)[-1].startswith(f".{self.job}-"):
                fs.delete_file(f.path)


class ArrayArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The arrays of a folder of archives; filters on item and array reach the source (``spark.sql.python.filterPushdown.enabled`` is switched on)."""
    spark.dataSource.register(ArrayArchives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("arrays").options(**options).load(path)


def write_archives(df: DataFrame, path: str, mode: str = "append") -> None:
    """One archive an item from (item, array, shape, values); an item's rows are brought together first. Null values are NaN; an item's array named twice keeps the last in order."""
    df.sparkSession.dataSource.register(ArrayArchives)
    whole = df.select("item", "array", "shape", F.transform("values", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("values"))
    whole.repartition("item").sortWithinPartitions("item", "array").write.format("arrays").mode(mode).save(path)
