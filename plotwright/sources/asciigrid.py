"""ASCII elevation grids as a data source: ``spark.read.format("asciigrid")``.

Lines of such a file differ in length, so where a row stands is not known beforehand. ``line_index`` finds it once: it
counts the lines that start in each stretch of each file, in as many tasks as there are stretches, and numbers
stretches by those before them; no line is shuffled. With that index a read has one task a stretch, and a window of
rows opens only the stretches that hold its lines; without one a file is read by one task, line by line, up to the
last row of the window. Files are opened by pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .grids import HEADER

STRETCH = 32 << 20
CELLS = 1 << 18  # of a batch
MOST = (1 << 31) - 1
SCHEMA = "dem_id string, row int, col int, z double"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its path there; Spark writes local ones as file:/x."""
    local = path.removeprefix("file:") if path.startswith("file:") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(local)


def lines(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines with words in them that start at start or behind it and before end."""
    at = max(0, start - 1)
    file.seek(at)
    rest, first = b"", start > 0
    size = file.size()
    while at < size:
        block = file.read(1 << 20)
        parts = (rest + block).split(b"\n")
        begin = at - len(rest)
        at += len(block)
        rest = parts.pop()
        if at >= size:
            parts, rest = [*parts, rest], b""
        for part in parts:
            if first:  # the end of a line that starts before
                first = False
            elif begin >= end:
                return
            elif part.strip():
                yield part
            begin += len(part) + 1
        if not first and begin >= end:
            return


def head(file: pa.NativeFile) -> tuple[dict[str, str], int]:
    """Keys of a grid's header, in lower case, and the number of its lines."""
    found: dict[str, str] = {}
    n = 0
    for line in lines(file, 0, MOST):
        words = line.split()
        if words[0].lower().decode("ascii", "replace") not in HEADER:
            break
        found[words[0].lower().decode()] = words[1].decode("ascii", "replace") if len(words) > 1 else ""
        n += 1
    return found, n


def line_index(spark: SparkSession, path: str, to: str, stretch: int = STRETCH) -> str:
    """Write to a folder the stretches of the files below path (path, start, end, before: the lines that start before it); gives that folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for row in batch.to_pylist():
                system, name = _opened(row["path"])
                with system.open_input_file(name) as file:
                    n.append(sum(1 for _ in lines(file, row["start"], row["end"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    stretches = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(stretch).cast("long"))).alias("start"), "length")
    each = stretches.select("path", "start", F.least(F.col("start") + stretch, "length").alias("end")).repartition("path", "start")
    counted = each.mapInArrow(count, "path string, start long, end long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counted.select("path", "start", "end", before.alias("before"), "n").where("n > 0").write.mode("overwrite").parquet(to)
    return to


@dataclass
class Stretch(InputPartition):
    path: str
    dem_id: str
    start: int
    end: int
    row: int  # of its first line; below zero in the header
    nodata: float


def _numbers(words: list[bytes]) -> np.ndarray:
    try:
        return np.array(words).astype(float)
    except ValueError:
        return np.array([_number(w) for w in words], float)


def _number(word: bytes) -> float:
    try:
        return float(word)
    except ValueError:
        return np.nan


class GridReader(DataSourceReader):
    """Cells of grids within a window of rows and columns, told by options row0, rows, col0, cols or by filters on row and col."""

    def __init__(self, options: dict[str, str]):
        self.path, self.index = options["path"], options.get("index")
        self.low = {"row": int(options.get("row0", 0)), "col": int(options.get("col0", 0))}
        self.high = {"row": self.low["row"] + int(options.get("rows", MOST)) - 1, "col": self.low["col"] + int(options.get("cols", MOST)) - 1}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in self.low or type(f) not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low[column] = max(self.low[column], f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high[column] = min(self.high[column], f.value - isinstance(f, LessThan))

    def partitions(self) -> list[Stretch]:
        out, heads = [], {}
        for path, start, end, before, n in self._stretches():
            if path not in heads:
                system, name = _opened(path)
                with system.open_input_file(name) as file:
                    heads[path] = head(file)
            keys, above = heads[path]
            row = before - above
            if row <= self.high["row"] and (n is None or row + n > self.low["row"]):
                folder, name = path.rsplit("/", 2)[-2:]
                dem = folder.removeprefix("dem_id=") if folder.startswith("dem_id=") else name.rsplit(".", 1)[0]
                nodata = _number(keys.get("nodata_value", "").encode())
                out.append(Stretch(path, dem, start, end, row, -9999.0 if np.isnan(nodata) else nodata))
        return out or [Stretch("", "", 0, 0, 0, 0.0)]

    def _stretches(self) -> Iterator[tuple]:
        if self.index:
            system, name = _opened(self.index)
            parts = [f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(".parquet")]
            for batch in ds.dataset(parts, filesystem=system, format="parquet").to_batches():
                yield from zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "before", "n")))
            return
        system, name = _opened(self.path)
        found = system.get_file_info(name)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        for f in files:
            if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")):
                yield scheme + f.path, 0, f.size, 0, None

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        if not stretch.path:
            return
        system, name = _opened(stretch.path)
        low, high = self.low["col"], self.high["col"] + 1
        rows, values, cells = [], [], 0
        with system.open_input_file(name) as file:
            row = stretch.row - 1
            for line in lines(file, stretch.start, stretch.end):
                row += 1
                if row < max(0, self.low["row"]):
                    continue
                if row > self.high["row"]:
                    break
                rows.append(row)
                values.append(_numbers(line.split()[max(0, low) : max(0, high)]))
                cells += len(values[-1])
                if cells >= CELLS:
                    yield self._batch(stretch, rows, values)
                    rows, values, cells = [], [], 0
        if rows:
            yield self._batch(stretch, rows, values)

    def _batch(self, stretch: Stretch, rows: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(v) for v in values]
        z, row = np.concatenate(values), np.repeat(np.array(rows, np.int32), sizes)
        col = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) + np.int32(max(0, self.low["col"]))
        none = np.isnan(z) | (z == stretch.nodata)
        return pa.RecordBatch.from_arrays([pa.array([stretch.dem_id] * len(z), pa.string()), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(z, mask=none)], names=["dem_id", "row", "col", "z"])


class AsciiGrids(DataSource):
    @classmethod
    def name(cls) -> str:
        return "asciigrid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def load(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """Cells (dem_id, row, col, z) of the grids below a path; filters on row and col reach the reader.

    dem_id is the folder's (dem_id=x), else the file's name without its ending; no-data (-9999 if not said) and words that
    are no numbers are null; lines without words are passed over; an empty file gives no cells.
    """
    spark.dataSource.register(AsciiGrids)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("asciigrid")
    return (read.option("index", index) if index else read).load(path)
