"""The entry points: named layers, stored pyramids, tiles, range statistics, catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.functions.style import parse_style
from quadrille.operators import features as ft, raster, vector
from quadrille.plans import cells, stats, store
from quadrille.sources import png


@dataclass
class Layer:
    """features: points (id, x, y, ...) or lines and rings (id, coords, ...) in Web Mercator; store: its pyramid, if it has been built."""

    features: DataFrame
    geometry: str  # point, line, polygon
    switch_level: int = 12
    store: store.Store | None = None


class Engine:
    def __init__(self, layers: dict[str, Layer]):
        for layer in layers.values():
            if layer.geometry not in ("point", "line", "polygon"):
                raise ValueError(f"unknown geometry {layer.geometry}")
        self.layers = layers

    def _get(self, name: str) -> Layer:
        if name not in self.layers:
            raise ValueError(f"unknown layer {name}")
        return self.layers[name]

    def build(self, name: str, path: str, finest: int, coarsest: int = 8, fields: tuple[str, ...] = ()) -> None:
        """Write the layer's pyramid to a folder that all executors see; tiles and statistics of the given fields read it from then on."""
        layer = self._get(name)
        layer.store = store.build(layer.features, layer.geometry, path, coarsest, finest, tuple(fields))

    def _measured(self, layer: Layer, field: str, box) -> DataFrame:
        """(item, m): count, km or km2 of the features in the box."""
        got = store.measured(layer.features, layer.geometry, layer.store, field, box) if layer.store and box is not None else None
        if got is not None:
            return got
        item = F.col(field).cast("string") if field in layer.features.columns else F.lit(None).cast("string")
        if layer.geometry == "point":
            return stats.measured(layer.features.withColumn("item", item), "point", box).select("item", "m")
        near = ft.with_mbb(layer.features).where(geo.mbb_touches(box)).withColumn("item", item)
        return stats.measured(ft.explode_segments(near.select("id", "coords", "item")), layer.geometry, box).select("item", "m")

    def _roots(self, layer: Layer, field: str) -> DataFrame:
        """(item, m): count, km or km2 of whole features."""
        item = F.col(field).cast("string") if field in layer.features.columns else F.lit(None).cast("string")
        f = layer.features.withColumn("item", item)
        if layer.geometry == "point":
            return f.select("item", F.lit(1).cast("long").alias("m"))
        return (ft.line_length(f).withColumnRenamed("km", "m") if layer.geometry == "line" else ft.ring_area(f).withColumnRenamed("km2", "m")).select("item", "m")

    def field_items(self, name: str, field: str) -> DataFrame:
        """(item, m): the values of a field with the count, km or km2 of their features; none for an unknown field."""
        layer = self._get(name)
        rows = self._roots(layer, field)
        if field not in layer.features.columns:
            rows = rows.limit(0)
        return rows.groupBy("item").agg(F.sum("m").alias("m")).orderBy("item")

    def meta(self, name: str) -> DataFrame:
        """(kind, srs, n, xmin, ymin, xmax, ymax, total, fields): one row; total in km or km2, for points their number."""
        layer = self._get(name)
        f = layer.features if layer.geometry == "point" else ft.with_mbb(layer.features)
        lows, highs = (("x", "y"), ("x", "y")) if layer.geometry == "point" else (("xmin", "ymin"), ("xmax", "ymax"))
        if layer.geometry == "point":
            f = f.withColumn("m", F.lit(1.0))
        else:
            f = (ft.line_length(f).withColumnRenamed("km", "m") if layer.geometry == "line" else ft.ring_area(f).withColumnRenamed("km2", "m"))
        fields = ", ".join(f"{n}-{t}" for n, t in layer.features.dtypes if n not in ("id", "x", "y", "coords", "part", "ring"))
        return f.agg(
            F.lit(layer.geometry).alias("kind"), F.lit("3857").alias("srs"), F.count("*").alias("n"),
            F.min(lows[0]).alias("xmin"), F.min(lows[1]).alias("ymin"), F.max(highs[0]).alias("xmax"), F.max(highs[1]).alias("ymax"),
            F.coalesce(F.sum("m"), F.lit(0.0)).alias("total"), F.lit(fields).alias("fields"),
        )

    def range_stats(self, name: str, style: str, box) -> DataFrame:
        layer, s = self._get(name), parse_style(style)
        m = self._measured(layer, s.field or "", box)
        if s.kind == "single":
            return stats.total(m)
        return stats.by_class(m, "item", list(s.items)) if s.kind == "classified" else stats.by_rule(m, "item", list(s.rules))

    def text(self, name: str, style: str, box) -> DataFrame:
        """(text): the statistics in one line, items in the style's order."""
        s = parse_style(style)
        got = self.range_stats(name, style, box)
        if s.kind == "single":
            return stats.as_text(got)
        by = "item" if s.kind == "classified" else "rule"
        return stats.as_text(got, by, list(s.items) if s.kind == "classified" else [r.op + r.value for r in s.rules])

    def _cells(self, layer: Layer, field: str, z: int, x: int, y: int, margin: int) -> tuple[DataFrame, DataFrame | None]:
        """(col, row, item, m[, topo]) at level z + 8 of a tile and a margin of cells, and the child masks of lines and rings.

        From the store where it has both levels; else from the features near the tile.
        """
        level, w = z + 8, geo.width(z + 8) * margin
        if layer.store and layer.store.has(level, field) and (layer.geometry == "point" or layer.store.has(level + 1, "")):
            span = lambda t, k: (k * (256 * t - margin), k * (256 * t + 255 + margin) + k - 1)
            spark = layer.features.sparkSession
            got = layer.store.cells(spark, level, field, span(x, 1), span(y, 1))
            # children that an edge or segment meets; cells inside a ring are none
            masks = None if layer.geometry == "point" else cells.children_mask(layer.store.cells(spark, level + 1, "", span(x, 2), span(y, 2)).where("topo = 'i'").select("col", "row").distinct())
            return got, masks
        box = geo.tile_box(z, x, y)
        box = box[0] - w, box[1] - w, box[2] + w, box[3] + w
        item = F.col(field).cast("string") if field in layer.features.columns else F.lit(None).cast("string")
        f = layer.features.withColumn("item", item)
        if layer.geometry == "point":
            return cells.point_cells(f.where(geo.point_in_box("x", "y", box)), level, ["item"]), None
        edges = ft.explode_segments(ft.with_mbb(f).where(geo.mbb_touches(box)).select("id", "coords", "item"))
        if layer.geometry == "line":
            edges = edges.where(f"least(x0, x1) <= {geo.num(box[2])} AND greatest(x0, x1) >= {geo.num(box[0])} AND least(y0, y1) <= {geo.num(box[3])} AND greatest(y0, y1) >= {geo.num(box[1])}")
            got = cells.line_cells(edges, level, ["item"])
        else:
            got = cells.ring_cells(edges, level, ["item"]).groupBy("col", "row", "item").agg(F.sum("m").alias("m"), F.min("topo").alias("topo"))
        return got, cells.children_mask(cells.segment_cells(edges, level + 1).select("col", "row").distinct())

    def tile(self, name: str, style: str, z: int, x: int, y: int, box=None) -> DataFrame:
        """(pi, pj, r, g, b, a); cells up to the switch level, exact features beyond it; a box around the whole tile is dropped."""
        layer, s = self._get(name), parse_style(style)
        t = geo.tile_box(z, x, y)
        if box is not None and box[0] <= t[0] and box[1] <= t[1] and box[2] >= t[2] and box[3] >= t[3]:
            box = None
        if s.kind == "heat" and layer.geometry == "polygon":
            raise ValueError("no heat for polygons")
        if s.kind == "heat":
            return self._heat(layer, s, z, x, y, box)
        if z > layer.switch_level:
            item = F.col(s.field).cast("string") if s.field in layer.features.columns else F.lit(None).cast("string")
            return vector.draw(layer.features.withColumn("item", item), s, layer.geometry, z, x, y, box)
        margin = max(1, *(raster.reach(p.width, layer.geometry == "polygon") for p in s.paints))
        got, masks = self._cells(layer, s.field or "", z, x, y, margin)
        return raster.render(got, s, layer.geometry, z, x, y, box, masks)

    def _heat(self, layer: Layer, s, z: int, x: int, y: int, box) -> DataFrame:
        """Heat of cells: the maximum is that of the view, so the cells of all its tiles are read.

        Points beyond the switch level: heat of the points themselves; the maximum is that
        of the finest cells, halved with each further zoom, 1 at least.
        """
        if z > layer.switch_level and layer.geometry == "point":
            level = layer.switch_level + 8
            x0, x1, y0, y1 = s.view
            span = lambda a, b: (a << (level - z), ((b + 1) << (level - z)) - 1) if level >= z else (a >> (z - level), b >> (z - level))
            cols, rows = span(x0, x1), span(y0, y1)
            if layer.store and layer.store.has(level, ""):
                found = layer.store.cells(layer.features.sparkSession, level, "", cols, rows)
            else:
                b = store.cells_box(level, cols, rows)
                found = cells.point_cells(layer.features.where(geo.point_in_box("x", "y", b)), level, []).where(F.col("col").between(*cols) & F.col("row").between(*rows))
            top = found.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.max("m"), F.lit(0)) / 2 ** (z - layer.switch_level))).alias("top"))
            return raster.data_heat(layer.features, s, top, z, x, y, box).select("pi", "pj", *raster.shades(s, "point"))
        margin = max(1, raster.reach(s.radius))
        if layer.store and layer.store.has(z + 8, ""):
            spark, last = layer.features.sparkSession, 2 ** (z + 8) - 1
            if layer.geometry == "point":
                x0, x1, y0, y1 = s.view
                cols, rows = (256 * min(x0, x) - margin, 256 * max(x1, x) + 255 + margin), (256 * min(y0, y) - margin, 256 * max(y1, y) + 255 + margin)
            else:
                cols = rows = (0, last)
            return raster.heat(layer.store.cells(spark, z + 8, "", cols, rows), s, layer.geometry, z, x, y, box)
        f = layer.features
        got = cells.point_cells(f, z + 8, []) if layer.geometry == "point" else cells.line_cells(ft.explode_segments(f), z + 8, [])
        return raster.heat(got, s, layer.geometry, z, x, y, box)

    def tile_png(self, name: str, style: str, z: int, x: int, y: int, box=None) -> DataFrame:
        return png.tiles(self.tile(name, style, z, x, y, box))
