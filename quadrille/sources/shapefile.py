"""Shapefiles as a Spark data source and sink, and through Spark's own file readers.

    spark.dataSource.register(Shapefile); spark.read.format("quadrille-shp").load(path)

Geometry (.shp) and attributes (.dbf) are joined by record number inside the
reader.  The .shx index gives record offsets, so every task reads its own range of
records; with option pushdown (and spark.sql.python.filterPushdown.enabled) filters on
id narrow the ranges.
Rows: id, kind, parts array<array<struct<x,y>>>, attrs map<string,string>; null shapes
have no parts, deleted attribute records are read like others.  A folder is read as
all its shapefiles, ids counted on from file to file.  The data source opens files by
path, so its folder must be mounted where tasks run; read_files() takes any store that
Spark reads, a task for each file (a shapefile has 2 GB at most), with typed columns.
The sink writes one shapefile for each task.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "id long, kind string, parts array<array<struct<x:double,y:double>>>, attrs map<string,string>"
# Shape type codes, their Z and M kin in the tens.
KINDS = {0: "null", 1: "point", 3: "linestring", 5: "polygon", 8: "multipoint"}
CODES = {"point": 1, "linestring": 3, "polygon": 5}
# The text of a .prj file of Web Mercator, and of longitudes and latitudes.
PROJECTIONS = {
    "3857": 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Mercator_Auxiliary_Sphere"],UNIT["Meter",1.0]]',
    "4326": 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]',
}


def parse_shape(body: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    code = struct.unpack_from("<i", body)[0]
    kind = KINDS[code % 10 if code >= 10 else code]
    if kind == "null":
        return kind, []
    if kind == "point":
        return kind, [[struct.unpack_from("<2d", body, 4)]]
    if kind == "multipoint":
        n = struct.unpack_from("<i", body, 36)[0]
        return kind, [[struct.unpack_from("<2d", body, 40 + 16 * i)] for i in range(n)]
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
    return kind, [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


def header(data: bytes) -> tuple[str, int, tuple[float, float, float, float]]:
    """(kind, bytes in the file, (xmin, ymin, xmax, ymax)) from the first 100 bytes of a .shp or .shx file."""
    if struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("no shapefile")
    return KINDS[struct.unpack_from("<i", data, 32)[0] % 10], 2 * struct.unpack_from(">i", data, 24)[0], struct.unpack_from("<4d", data, 36)


def dbf_fields(head: bytes) -> list[tuple[str, int, str]]:
    """(name, width, type): C text, N and F numbers (n: without decimals), D dates, L logical."""
    out, at = [], 32
    while head[at] != 0x0D:
        kind = chr(head[at + 11])
        out.append((head[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), head[at + 16], "n" if kind == "N" and not head[at + 17] else kind))
        at += 32
    return out


def typed(text: str, kind: str):
    """An attribute as Python value; blank, starred and unreadable ones are null."""
    if kind == "C":
        return text
    if not text or set(text) <= {"*", "?"}:
        return None
    try:
        return int(text) if kind == "n" else float(text) if kind in "NF" else text.upper() in ("T", "Y") if kind == "L" else text
    except ValueError:
        return None


class Records(InputPartition):
    def __init__(self, base: str, first: int, last: int, start: int):
        super().__init__(first)
        self.base, self.first, self.last, self.start = base, first, last, start


class Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        path = path.removeprefix("file:")
        self.bases = [path.removesuffix(".shp")] if not os.path.isdir(path) else sorted(os.path.join(path, f.removesuffix(".shp")) for f in os.listdir(path) if f.endswith(".shp"))
        self.rows, self.low, self.high = rows, 0, 1 << 62

    def partitions(self):
        out, start = [], 0
        for base in self.bases:
            n = (os.path.getsize(base + ".shx") - 100) // 8
            first, last = max(0, self.low - start), min(n, self.high - start)
            out += [Records(base, a, min(last, a + self.rows), start) for a in range(first, last, self.rows)]
            start += n
        return out or [Records("", 0, 0, 0)]

    def read(self, part):
        if part.first >= part.last:
            return
        with open(part.base + ".shx", "rb") as index, open(part.base + ".shp", "rb") as shapes, open(part.base + ".dbf", "rb") as table:
            table.seek(8)
            start, width = struct.unpack("<HH", table.read(4))
            table.seek(0)
            fields = dbf_fields(table.read(start))
            index.seek(100 + 8 * part.first)
            for k in range(part.first, part.last):
                offset, words = struct.unpack(">2i", index.read(8))
                shapes.seek(2 * offset + 8)
                kind, parts = parse_shape(shapes.read(2 * words))
                table.seek(start + k * width + 1)
                raw, attrs, at = table.read(width - 1), {}, 0
                for name, size, _ in fields:
                    attrs[name] = raw[at : at + size].decode("utf-8", "replace").strip()
                    at += size
                yield part.start + k, kind, [[{"x": x, "y": y} for x, y in p] for p in parts], attrs


class FilteredReader(Reader):
    """A reader that reads only the records that filters on id allow."""

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute == ("id",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f


class Written(WriterCommitMessage):
    def __init__(self, base: str | None):
        self.base = base


class Writer(DataSourceWriter):
    """Rows (kind, parts, attrs) as one shapefile for each task; options kind and fields ('name:width,...')."""

    def __init__(self, options):
        self.folder = options["path"].removeprefix("file:")
        self.kind, self.srs = options.get("kind", "polygon"), options.get("srs", "3857")
        self.fields = [(n, int(w)) for n, _, w in (f.partition(":") for f in options.get("fields", "").split(",") if f)]

    def write(self, rows: Iterator):
        from pyspark import TaskContext

        features = [([[(v["x"], v["y"]) for v in p] for p in r["parts"]], r["attrs"] or {}) for r in rows if r["parts"]]
        if not features:
            return Written(None)
        os.makedirs(self.folder, exist_ok=True)
        context = TaskContext.get()
        base = f"{self.folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        write(base + ".shp", self.kind, features, self.fields, self.srs)
        return Written(base)

    def commit(self, messages):
        pass

    def abort(self, messages):
        for m in messages:
            if m is not None and m.base:
                for end in (".shp", ".shx", ".dbf", ".prj", ".cpg"):
                    if os.path.exists(m.base + end):
                        os.remove(m.base + end)


class Shapefile(DataSource):
    @classmethod
    def name(cls):
        return "quadrille-shp"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        kind = FilteredReader if self.options.get("pushdown", "false").lower() == "true" else Reader
        return kind(self.options["path"], int(self.options.get("rowsPerPartition", 100_000)))

    def writer(self, schema, overwrite):
        return Writer(self.options)


def write(path: str, kind: str, features, fields: list[tuple[str, int]], srs: str = "3857") -> None:
    """Write one shapefile (.shp .shx .dbf .prj .cpg) from (parts, attributes)."""
    base, code = path.removesuffix(".shp"), CODES[kind]
    shapes, index, rows, box = [], [], [], [1e300, 1e300, -1e300, -1e300]
    at = 50
    for n, (parts, attrs) in enumerate(features, 1):
        flat = [p for part in parts for p in part]
        x, y = [p[0] for p in flat], [p[1] for p in flat]
        own = min(x), min(y), max(x), max(y)
        box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        if kind == "point":
            body = struct.pack("<i2d", code, *flat[0])
        else:
            starts, total = [], 0
            for part in parts:
                starts.append(total)
                total += len(part)
            body = struct.pack("<i4d2i", code, *own, len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *starts) + struct.pack(f"<{2 * len(flat)}d", *(v for p in flat for v in p))
        index.append(struct.pack(">2i", at, len(body) // 2))
        shapes.append(struct.pack(">2i", n, len(body) // 2) + body)
        at += 4 + len(body) // 2
        rows.append(b" " + b"".join(str(attrs.get(f, "")).encode()[:w].ljust(w) for f, w in fields))
    box = box if rows else [0.0] * 4
    for suffix, data in ((".shp", b"".join(shapes)), (".shx", b"".join(index))):
        with open(base + suffix, "wb") as f:
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(data) // 2) + struct.pack("<2i8d", 1000, code, *box, 0, 0, 0, 0) + data)
    with open(base + ".dbf", "wb") as f:
        head = b"".join(name.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for name, w in fields)
        f.write(struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(fields), 1 + sum(w for _, w in fields)) + head + b"\r" + b"".join(rows) + b"\x1a")
    for suffix, text in ((".prj", PROJECTIONS[srs]), (".cpg", "UTF-8")):
        with open(base + suffix, "w") as f:
            f.write(text)


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, shp, dbf): the contents of the shapefiles in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(folder)
    files = files.select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.col("path").endswith(".shp").alias("_shp"), "content")
    return files.groupBy("stem").agg(F.max(F.when(F.col("_shp"), F.col("content"))).alias("shp"), F.max(F.when(~F.col("_shp"), F.col("content"))).alias("dbf")).where("shp is not null")


def extents(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, kind, n_bytes, xmin, ymin, xmax, ymax) from the headers of the shapefiles in a folder."""

    def run(frames):
        for f in frames:
            got = [header(bytes(h)) for h in f["h"]]
            yield pd.DataFrame([(s, k, n, *b) for s, (k, n, b) in zip(f["stem"], got, strict=True)], columns=["stem", "kind", "n_bytes", "xmin", "ymin", "xmax", "ymax"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(folder)
    heads = files.select(F.regexp_replace("path", r"\.shp$", "").alias("stem"), F.substring("content", 1, 100).alias("h"))
    return heads.mapInPandas(run, "stem string, kind string, n_bytes long, xmin double, ymin double, xmax double, ymax double")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, id, kind, parts, attributes as typed columns) of the shapefiles in a folder of any store; the fields are those of the first file."""
    files = _members(spark, folder)
    head = files.orderBy("stem").select(F.substring("dbf", 1, 1 << 16).alias("h")).first()  # 64 KB at most
    fields = dbf_fields(bytes(head.h)) if head is not None and head.h is not None else []
    kinds = {"n": "long", "N": "double", "F": "double", "L": "boolean"}
    columns = ["stem", "id", "kind", "parts", *(n for n, _, _ in fields)]

    def run(frames):
        for f in frames:
            for stem, shp, dbf in zip(f["stem"], f["shp"], f["dbf"], strict=True):
                shp, dbf, at, rows = bytes(shp), bytes(dbf or b""), 100, []
                start, width = struct.unpack_from("<HH", dbf, 8) if dbf else (0, 1)
                own = dbf_fields(dbf[:start]) if dbf else []
                while at < len(shp):
                    n, words = struct.unpack_from(">2i", shp, at)
                    kind, parts = parse_shape(shp[at + 8 : at + 8 + 2 * words])
                    at += 8 + 2 * words
                    raw, place, attrs = dbf[start + (n - 1) * width + 1 : start + n * width], 0, {}
                    for name, size, t in own:
                        attrs[name] = typed(raw[place : place + size].decode("utf-8", "replace").strip(), t)
                        place += size
                    rows.append((stem, n - 1, kind, [[{"x": x, "y": y} for x, y in p] for p in parts], *(attrs.get(c) for c in columns[4:])))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    schema = "stem string, id long, kind string, parts array<array<struct<x:double,y:double>>>" + "".join(f", `{n}` {kinds.get(t, 'string')}" for n, _, t in fields)
    return files.mapInPandas(run, schema)


def read_csv(spark, path: str, lon: str = "lon", lat: str = "lat", srs: str = "4326", schema: str | None = None) -> DataFrame:
    """Points (x, y, other columns) of CSV files (a file or folder named *.csv) with a head line; 4326 is projected to Web Mercator."""
    from quadrille.functions import geo
    from quadrille.functions.style import check_input

    check_input(path, "point", srs)
    rows = spark.read.csv(path, header=True, schema=schema)
    x, y = f"CAST(`{lon}` AS DOUBLE)", f"CAST(`{lat}` AS DOUBLE)"
    if srs == "4326":
        x, y = geo.mercator_x(x), geo.mercator_y(y)
    keep = [F.col(c) for c in rows.columns if c not in (lon, lat)]
    return rows.select(F.expr(x).alias("x"), F.expr(y).alias("y"), *keep)
