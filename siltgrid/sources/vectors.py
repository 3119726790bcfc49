"""Sinks of exported points: CSV, GeoJSON lines, well-known binary in Parquet, GeoPackage and Shapefile."""

from __future__ import annotations

import sqlite3
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A point in little-endian well-known binary.
_WKB = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])
#: Features of one transaction.
BATCH = 25_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def geojson(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature a row, made in the JVM."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    shape = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str) -> None:
    geojson(df).write.mode("overwrite").text(path)


def with_wkb(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with the points as well-known binary, as Parquet readers of geometries take it."""

    schema = T.StructType([*df.schema.fields, T.StructField("geometry", T.BinaryType())])
    at = (df.columns.index(lon), df.columns.index(lat))

    def run(batches):
        for batch in batches:
            flat = np.zeros(batch.num_rows, _WKB)
            flat["order"], flat["kind"] = 1, 1
            for name, k in zip("xy", at):
                flat[name] = batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)
            offsets = pa.py_buffer(np.arange(0, flat.nbytes + 1, _WKB.itemsize, dtype=np.int32).tobytes())
            shapes = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, shapes], names=schema.names)

    return df.mapInArrow(run, schema)


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A stage's table: Parquet, by patch where there are patches."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_geopackage(df: DataFrame, path: str, layer: str = "points", lon: str = "lon", lat: str = "lat") -> int:
    """Points as a GeoPackage layer in EPSG:4326; features come to the driver a batch at a time and are committed by batches.

    One file has one writer by its nature; large exports belong in Parquet or GeoJSON.
    """
    Path(path).unlink(missing_ok=True)
    rest = [c for c in df.columns if c not in (lon, lat)]
    kind = {k: "INTEGER" if t in ("int", "bigint") else "REAL" if t in ("double", "float") else "TEXT" for k, t in df.dtypes}
    con = sqlite3.connect(path)
    con.execute("PRAGMA application_id = 1196444487")
    con.executescript(
        """CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84"]', '');
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);"""
    )
    con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, {", ".join(f"""\"{c}\" {kind[c]}""" for c in rest)})')
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '', NULL, NULL, NULL, NULL, 4326)", (layer, layer))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', 4326, 0, 0)", (layer,))
    n, batch = 0, []
    insert = f'INSERT INTO "{layer}" (geom, {", ".join(f"""\"{c}\"""" for c in rest)}) VALUES ({", ".join("?" * (len(rest) + 1))})'

    def flush():
        con.executemany(insert, batch)
        con.commit()
        batch.clear()

    for row in df.select(lon, lat, *rest).toLocalIterator():
        head = b"GP\x00\x01" + struct.pack("<i", 4326)
        batch.append((head + struct.pack("<BIdd", 1, 1, row[0], row[1]), *row[2:]))
        n += 1
        if len(batch) >= BATCH:
            flush()
    flush()
    con.close()
    return n


#: Fixed value: the geographic system of the layers.
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def write_shapefile(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> int:
    """Points as a Shapefile (.shp, .shx, .dbf, .prj) in WGS 84; names of columns are cut to ten characters and kept apart by a number.

    The format holds one file of at most 2 GB with one writer, so features come to the driver a batch at a time; larger exports belong in Parquet.
    """
    stem, rest = Path(path).with_suffix(""), [c for c in df.columns if c not in (lon, lat)]
    names: list[str] = []
    for c in rest:
        short, k = c[:10], 1
        while short in names:
            short, k = f"{c[: 10 - len(str(k))]}{k}", k + 1
        names.append(short)
    kinds = dict(df.dtypes)
    fields = [(n, b"N", 20, 0) if kinds[c] in ("int", "bigint", "smallint", "tinyint") else (n, b"N", 24, 10) if kinds[c] in ("double", "float") else (n, b"C", 80, 0) for n, c in zip(names, rest)]
    row_size = 1 + sum(f[2] for f in fields)
    n, box = 0, [float("inf"), float("inf"), float("-inf"), float("-inf")]

    def cell(value, kind, size, digits):
        if kind == b"C":
            return str("" if value is None else value).encode("latin-1", "replace")[:size].ljust(size)
        if value is None or value != value:
            return b" " * size
        return (f"{value:.{digits}f}" if abs(value) < 1e12 else f"{value:.10e}").encode()[:size].rjust(size) if digits else str(int(value)).encode()[:size].rjust(size)

    with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
        shp.write(bytes(100))
        shx.write(bytes(100))
        head = 32 + 32 * len(fields) + 1
        dbf.write(bytes(32) + b"".join(name.encode("latin-1", "replace").ljust(11, b"\0") + kind + bytes(4) + bytes([size, digits]) + bytes(14) for name, kind, size, digits in fields) + b"\r")
        for r in df.select(lon, lat, *rest).toLocalIterator():
            x, y = float(r[0]), float(r[1])
            box = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
            shx.write(struct.pack(">ii", 50 + 14 * n, 10))
            n += 1
            shp.write(struct.pack(">ii", n, 10) + struct.pack("<idd", 1, x, y))
            dbf.write(b" " + b"".join(cell(v, *f[1:]) for v, f in zip(r[2:], fields)))
        dbf.write(b"\x1a")
        box = box if n else [0.0] * 4
        for file, words in ((shp, 50 + 14 * n), (shx, 50 + 4 * n)):
            file.seek(0)
            file.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii4d", 1000, 1, *box) + bytes(32))
        dbf.seek(0)
        dbf.write(struct.pack("<4BIHH", 3, 124, 1, 1, n, head, row_size))
    stem.with_suffix(".prj").write_text(WGS84)
    return n
