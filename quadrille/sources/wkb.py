"""Well-known binary: features to bytes and back, and tables of a database that hold them.

Kinds are point, linestring, polygon, multipoint, multilinestring and multipolygon, in
either byte order; Z, M and an SRID, as some databases add them, are read over.  Rows
come back as (kind, parts array<array<struct<x,y>>>): a part is a point, a line or a
ring, so rings of all polygons follow each other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of the kinds.
KINDS = {1: "point", 2: "linestring", 3: "polygon", 4: "multipoint", 5: "multilinestring", 6: "multipolygon"}
CODES = {k: c for c, k in KINDS.items()}
PARTS = "array<array<struct<x:double,y:double>>>"


def encode(kind: str, parts: list[list[tuple[float, float]]]) -> bytes:
    """Little-endian bytes of one feature; parts are points, lines or rings."""
    head = lambda k: struct.pack("<BI", 1, CODES[k])
    run = lambda p: struct.pack("<I", len(p)) + b"".join(struct.pack("<2d", *v) for v in p)
    if kind == "point":
        return head(kind) + struct.pack("<2d", *parts[0][0])
    if kind == "linestring":
        return head(kind) + run(parts[0])
    if kind == "polygon":
        return head(kind) + struct.pack("<I", len(parts)) + b"".join(map(run, parts))
    single = kind.removeprefix("multi")
    return head(kind) + struct.pack("<I", len(parts)) + b"".join(encode(single, [p]) for p in parts)


def decode(data: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    """(kind, parts) of one feature."""
    kind, parts, end = _read(data, 0)
    if end > len(data):
        raise ValueError("truncated geometry")
    return kind, parts


def _read(data: bytes, at: int) -> tuple[str, list[list[tuple[float, float]]], int]:
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if code & 0x20000000:  # an SRID
        at += 4
    more = bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[(code & 0xFFFF) // 1000]
    kind, width = KINDS[(code & 0xFFFF) % 1000], 2 + more

    def run(at: int, n: int) -> tuple[list[tuple[float, float]], int]:
        flat = struct.unpack_from(f"{order}{n * width}d", data, at)
        return [(flat[i], flat[i + 1]) for i in range(0, n * width, width)], at + 8 * n * width

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == "point":
        p, at = run(at, 1)
        return kind, [p], at
    n, at = count(at)
    if kind == "linestring":
        p, at = run(at, n)
        return kind, [p], at
    parts = []
    for _ in range(n):
        if kind == "polygon":
            m, at = count(at)
            p, at = run(at, m)
            parts.append(p)
        else:
            _, own, at = _read(data, at)
            parts += own
    return kind, parts, at


def with_wkb(features: DataFrame, kind: str, parts: str = "parts", into: str = "wkb") -> DataFrame:
    """features with one more column: the geometry's bytes; null parts give null."""

    @F.pandas_udf("binary")
    def made(column: pd.Series) -> pd.Series:
        return column.map(lambda ps: None if ps is None else encode(kind, [[(v["x"], v["y"]) for v in p] for p in ps]))

    return features.withColumn(into, made(F.col(parts)))


def from_wkb(rows: DataFrame, column: str = "wkb") -> DataFrame:
    """rows with kind and parts instead of the bytes; null bytes give null."""

    @F.pandas_udf(f"struct<kind:string,parts:{PARTS}>")
    def read(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for c in columns:
            got = [(None, None) if b is None else decode(bytes(b)) for b in c]
            yield pd.DataFrame({"kind": [k for k, _ in got], "parts": [None if ps is None else [[{"x": x, "y": y} for x, y in p] for p in ps] for _, ps in got]})

    kept = [c for c in rows.columns if c not in (column, "kind", "parts")]
    return rows.select(*kept, read(F.col(column)).alias("_g")).select(*kept, "_g.kind", "_g.parts")


def read_table(spark: SparkSession, url: str, table: str, column: str, **options) -> DataFrame:
    """Features of a database table over JDBC, its geometry column as bytes (for PostGIS select ST_AsBinary of it in a subquery).

    options go to Spark's reader; partitionColumn, lowerBound, upperBound and
    numPartitions split the table among tasks.
    """
    return from_wkb(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), column)
