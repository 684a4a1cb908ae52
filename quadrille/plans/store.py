"""Stored pyramids: cells of all levels as one table that answers from whole cells and the features at a border.

The table (level, field, item, ty, tx, col, row, topo, m) lies in a folder for each
level, ordered by field and block of 256 x 256 cells, so a tile reads a few row groups.
field '' holds all features whatever their attributes, item is the attribute's text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators import features as ft
from quadrille.plans import cells

#: Cells along the longer side of a box that range statistics read at most.
SIDE = 256
KEYS = ["field", "item"]


@dataclass
class Store:
    path: str
    coarsest: int
    finest: int
    fields: tuple[str, ...]

    def cells(self, spark, level: int, field: str, cols: tuple[int, int], rows: tuple[int, int]) -> DataFrame:
        """(col, row, item, topo, m) of a range of cells: filters on folders, blocks and cells."""
        got = spark.read.parquet(self.path).where((F.col("level") == level) & (F.col("field") == field))
        for block, cell, (a, b) in (("tx", "col", cols), ("ty", "row", rows)):
            got = got.where(F.col(block).between(a >> 8, b >> 8) & F.col(cell).between(a, b))
        return got.select("col", "row", "item", "topo", "m")

    def has(self, level: int, field: str) -> bool:
        return self.coarsest <= level <= self.finest and field in ("", *self.fields)


def itemised(features: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row for each feature and field, and one for all features (field '')."""
    kinds = [F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("item")), *(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("item")) for f in fields)]
    return features.withColumn("_f", F.explode(F.array(*kinds))).select("*", "_f.field", "_f.item").drop("_f")


def build(features: DataFrame, geometry: str, path: str, coarsest: int, finest: int, fields: tuple[str, ...] = ()) -> Store:
    """Write the cells of the finest level, then the coarser ones from them in one pass (rings: each level from the rings, as insideness does not roll up)."""
    spark, base = features.sparkSession, f"{path}-finest"
    if geometry == "polygon":
        edges = ft.explode_segments(features.select("id", "coords", *fields))
        out = None
        for level in range(coarsest, finest + 1):
            part = itemised(cells.ring_cells(edges, level, list(fields)), fields).groupBy("col", "row", *KEYS).agg(F.sum("m").alias("m"), F.min("topo").alias("topo"))
            part = part.withColumn("level", F.lit(level))
            out = part if out is None else out.unionByName(part)
        cells.persist(out, path, *KEYS)
        return Store(path, coarsest, finest, tuple(fields))
    if geometry == "point":
        lowest = cells.point_cells(itemised(features, fields), finest, KEYS)
    else:
        lowest = cells.line_cells(itemised(ft.explode_segments(features), fields), finest, KEYS)
    lowest.write.mode("overwrite").parquet(base)
    lowest = spark.read.parquet(base)
    steps = F.explode(F.sequence(F.lit(0), F.lit(finest - coarsest))).alias("_up")
    rolled = lowest.select("*", steps).withColumn("level", F.lit(finest) - F.col("_up"))
    rolled = rolled.groupBy("level", F.expr("shiftright(col, _up)").alias("col"), F.expr("shiftright(row, _up)").alias("row"), *KEYS).agg(F.sum("m").alias("m"))
    cells.persist(rolled.withColumn("topo", F.lit("i")), path, *KEYS)
    return Store(path, coarsest, finest, tuple(fields))


def inner_cells(store: Store, box) -> tuple[int, tuple[int, int], tuple[int, int]] | None:
    """(level, columns, rows) of whole cells well inside a box; None if there are none."""
    level = store.finest
    while level > store.coarsest and max(box[2] - box[0], box[3] - box[1]) > SIDE * geo.width(level):
        level -= 1
    w, last = geo.width(level), 2**level - 1
    # one cell is left at each side, so rounding at cell borders cannot matter
    cols = max(0, math.ceil((box[0] + geo.L) / w) + 1), min(last, math.floor((box[2] + geo.L) / w) - 2)
    rows = max(0, math.ceil((geo.L - box[3]) / w) + 1), min(last, math.floor((geo.L - box[1]) / w) - 2)
    return (level, cols, rows) if cols[0] <= cols[1] and rows[0] <= rows[1] else None


def cells_box(level: int, cols: tuple[int, int], rows: tuple[int, int]) -> tuple[float, float, float, float]:
    w = geo.width(level)
    return cols[0] * w - geo.L, geo.L - (rows[1] + 1) * w, (cols[1] + 1) * w - geo.L, geo.L - rows[0] * w


def measured(features: DataFrame, geometry: str, store: Store, field: str, box) -> DataFrame | None:
    """(item, m) rows whose sums are those of the features in the box; None if the store cannot help.

    Whole cells come from the store; of the features only those that are not wholly in
    whole cells are measured, by what they have in the box but not in those cells.
    """
    inner = inner_cells(store, box) if store.has(store.finest, field) else None
    if inner is None:
        return None
    level, cols, rows = inner
    whole = store.cells(features.sparkSession, level, field, cols, rows).select("item", "m")
    item = F.col(field).cast("string") if field else F.lit(None).cast("string")
    if geometry == "point":
        at = f"({geo.col('x', level)} BETWEEN {cols[0]} AND {cols[1]} AND {geo.row('y', level)} BETWEEN {rows[0]} AND {rows[1]})"
        rest = features.where(geo.point_in_box("x", "y", box)).where(f"{geo.in_world('x', 'y')} AND NOT {at}").select(item.alias("item"), F.lit(1).cast("long").alias("m"))
        return whole.union(rest)
    cut, core = tuple(map(geo.num, box)), cells_box(*inner)
    near = ft.with_mbb(features).where(geo.mbb_touches(box)).where(f"NOT {geo.mbb_within(core)}")
    edges = ft.explode_segments(near.select("id", "coords", item.alias("item")))
    core = tuple(map(geo.num, core))
    if geometry == "line":
        rest = edges.select("item", F.expr(f"{geo.length_km()} * ({geo.clip_share(*cut)} - {geo.clip_share(*core)})").alias("m"))
    else:
        rest = edges.groupBy("id", "item").agg(F.expr(f"(abs(sum({geo.edge_area(*cut)})) - abs(sum({geo.edge_area(*core)}))) / 1e6").alias("m")).select("item", "m")
    return whole.union(rest)
