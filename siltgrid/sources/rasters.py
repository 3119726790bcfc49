"""Raster files as Spark tables: a Python data source that reads row blocks side by side.

Options: path (a file), width, length (else from its size), dtype (c64, c32s, f4, f8, u1), endian (little, big), bands, band,
scheme (BIL, BIP, BSQ), skip (bytes), block (rows of an input partition). Sidecar XML gives what options leave out.
"""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

#: NumPy types of complex float, complex short and real samples.
DTYPES = {"c64": ("f4", 2), "c32s": ("i2", 2), "f4": ("f4", 1), "f8": ("f8", 1), "u1": ("u1", 1)}
#: Sample types as sidecars spell them.
XML_TYPES = {"FLOAT": "f4", "REAL4": "f4", "DOUBLE": "f8", "REAL8": "f8", "CFLOAT": "c64", "BYTE": "u1"}


def file_size(path: str) -> int:
    """Bytes of a file, local or on any file system that the path names by its scheme."""
    if "://" not in path:
        return os.path.getsize(path)
    system, name = fs.FileSystem.from_uri(path)
    return system.get_file_info(name).size


def read_bytes(path: str, start: int, size: int) -> bytes:
    """Up to `size` bytes of a file from `start`."""
    if "://" not in path:
        with open(path, "rb") as file:
            file.seek(start)
            return file.read(size)
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        size = max(0, min(size, file.size() - start))
        return file.read_at(size, start) if size else b""


def sidecar(path: str) -> dict[str, str]:
    """Properties of path.xml by lower-case name; empty where there is none or it can't be read."""
    try:
        root = ET.parse(path + ".xml").getroot()
    except (OSError, ET.ParseError):
        return {}
    return {p.get("name", "").lower(): v.text.strip() for p in root.iter("property") if (v := p.find("value")) is not None and v.text}


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> StructType:
        kind = self._layout()["dtype"]
        values = [StructField("re", FloatType()), StructField("im", FloatType())] if kind.startswith("c") else [StructField("value", DoubleType() if kind == "f8" else FloatType())]
        return StructType([StructField("az", IntegerType()), StructField("rg", IntegerType()), *values])

    def _layout(self) -> dict:
        path = self.options["path"]
        if path.endswith(".vrt"):
            raise ValueError(f"{path}: virtual rasters are not read; give the file they point to")
        xml = sidecar(path)
        kind = self.options.get("dtype") or XML_TYPES.get(xml.get("data_type", "").upper(), "f4")
        width = int(self.options.get("width") or xml["width"])
        bands = int(self.options.get("bands") or xml.get("number_bands", 1))
        base, parts = DTYPES[kind]
        size = np.dtype(base).itemsize * parts * bands
        skip = int(self.options.get("skip", 0))
        # a short last row is padded with zeros
        length = int(self.options.get("length") or -(-max(0, file_size(path) - skip) // (width * size)))
        return {
            "path": path, "dtype": kind, "width": width, "length": length, "bands": bands, "band": int(self.options.get("band", 1)), "skip": skip,
            "scheme": (self.options.get("scheme") or xml.get("scheme", "BIL")).upper(), "endian": ">" if self.options.get("endian", "little") == "big" else "<",
            "block": int(self.options.get("block", 256)),
        }

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(self._layout())


class RasterReader(DataSourceReader):
    def __init__(self, layout: dict):
        self.layout = layout

    def partitions(self):
        n, step = self.layout["length"], self.layout["block"]
        return [Rows(i, min(n, i + step)) for i in range(0, n, step)] or [Rows(0, 0)]

    def read(self, partition: Rows):
        o = self.layout
        base, parts = DTYPES[o["dtype"]]
        dtype, width, bands = np.dtype(o["endian"] + base), o["width"], o["bands"]
        per_row = width * bands * parts
        rows = partition.last - partition.first
        if not rows:
            return
        if o["scheme"] == "BSQ" and bands > 1:
            want = rows * width * parts
            first = (o["band"] - 1) * o["length"] * width * parts + partition.first * width * parts
        else:
            want, first = rows * per_row, partition.first * per_row
        raw = read_bytes(o["path"], o["skip"] + first * dtype.itemsize, want * dtype.itemsize)
        v = np.frombuffer(raw[: len(raw) // dtype.itemsize * dtype.itemsize], dtype)
        v = np.pad(v, (0, want - len(v)))
        if o["scheme"] == "BSQ" or bands == 1:
            v = v.reshape(rows, width, parts)
        elif o["scheme"] == "BIP":
            v = v.reshape(rows, width, bands, parts)[:, :, o["band"] - 1]
        else:
            v = v.reshape(rows, bands, width, parts)[:, o["band"] - 1]
        az = np.repeat(np.arange(partition.first, partition.last, dtype=np.int32), width)
        rg = np.tile(np.arange(width, dtype=np.int32), rows)
        out = np.float64 if o["dtype"] == "f8" else np.float32
        names = ["re", "im"] if parts == 2 else ["value"]
        yield pa.RecordBatch.from_arrays([pa.array(az), pa.array(rg), *(pa.array(v[..., k].ravel().astype(out)) for k in range(parts))], names=["az", "rg", *names])


#: Bytes of samples that one task of a stack holds at a time.
TASK_BYTES = 32 << 20


class StackSource(DataSource):
    """Several rasters of one shape as one table: a task reads the same rows of every file, so what belongs to a pixel comes out in one row and
    needs no shuffle. Options: paths (a JSON list), width, length, dtype, endian."""

    @classmethod
    def name(cls) -> str:
        return "raster_stack"

    def schema(self) -> StructType:
        parts = ["re", "im"] if self.options.get("dtype", "c64").startswith("c") else ["v"]
        return StructType([StructField("az", IntegerType()), StructField("rg", IntegerType()), *(StructField(c, ArrayType(DoubleType())) for c in parts)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return StackReader(dict(self.options))


class StackReader(DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.paths, self.width = json.loads(o["paths"]), int(o["width"])
        base, self.parts = DTYPES[o.get("dtype", "c64")]
        self.dtype = np.dtype((">" if o.get("endian", "little") == "big" else "<") + base)
        self.row = self.width * self.parts * self.dtype.itemsize
        self.length = int(o.get("length") or -(-max((file_size(p) for p in self.paths), default=0) // self.row))

    def partitions(self):
        step = max(1, TASK_BYTES // max(1, self.width * self.parts * 8 * len(self.paths)))
        return [Rows(i, min(self.length, i + step)) for i in range(0, self.length, step)] or [Rows(0, 0)]

    def read(self, partition: Rows):
        rows, k = partition.last - partition.first, len(self.paths)
        if not rows:
            return
        z = np.zeros((k, rows * self.width * self.parts))
        for n, path in enumerate(self.paths):
            raw = read_bytes(path, partition.first * self.row, rows * self.row)
            v = np.frombuffer(raw[: len(raw) // self.dtype.itemsize * self.dtype.itemsize], self.dtype)
            z[n, : len(v)] = v  # a file that ends early is padded with zeros
        z = z.reshape(k, rows * self.width, self.parts)
        at = pa.array(np.arange(0, rows * self.width * k + 1, k, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(z[:, :, p].T).ravel())) for p in range(self.parts)]
        az = np.repeat(np.arange(partition.first, partition.last, dtype=np.int32), self.width)
        rg = np.tile(np.arange(self.width, dtype=np.int32), rows)
        yield pa.RecordBatch.from_arrays([pa.array(az), pa.array(rg), *lists], names=["az", "rg", *(["re", "im"] if self.parts == 2 else ["v"])])


def read_stack(spark: SparkSession, paths: list[str], width: int, **options) -> DataFrame:
    """(az, rg, re array, im array) or (az, rg, v array) over the files, in their order."""
    spark.dataSource.register(StackSource)
    reader = spark.read.format("raster_stack").option("paths", json.dumps([str(p) for p in paths])).option("width", str(width))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def phase_table(spark: SparkSession, path: str, n: int, columns: int) -> DataFrame:
    """(row, ph array) of a file of complex samples column by column: n candidates of each image after another.

    The file's size must be that of n times columns samples.
    """
    if file_size(path) != n * columns * 8:
        raise ValueError(f"{path}: {file_size(path)} bytes are not {n} candidates of {columns} images")
    schema = StructType([StructField("row", IntegerType()), StructField("ph", ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            first, last = (batch.column(c).to_pylist() for c in ("first", "last"))
            for a, b in zip(first, last):
                ph = np.angle(np.stack([np.frombuffer(read_bytes(path, 8 * (k * n + a), 8 * (b - a)), "<c8") for k in range(columns)], 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ph.size + 1, columns, dtype=np.int32)), pa.array(ph.ravel().astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int32)), lists], names=schema.names)

    step = max(1, TASK_BYTES // (8 * columns))
    blocks = [(a, min(n, a + step)) for a in range(0, n, step)]
    return spark.createDataFrame(blocks, "first int, last int").repartition(max(1, len(blocks))).mapInArrow(run, schema)


def read_raster(spark: SparkSession, path: str, **options) -> DataFrame:
    """(az, rg, value) or (az, rg, re, im) of a raster file on storage that all executors see."""
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("raster").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def gather(points: DataFrame, raster: DataFrame, names: dict[str, str]) -> DataFrame:
    """points with the raster's values at their az and rg; null beyond the raster."""
    return points.join(raster.select("az", "rg", *(raster[a].alias(b) for a, b in names.items())), ["az", "rg"], "left")


def unmasked(samples: DataFrame, mask: DataFrame) -> DataFrame:
    """samples whose mask is 0 or missing."""
    masked = mask.where("value <> 0").select("az", "rg")
    return samples.join(masked, ["az", "rg"], "left_anti")
