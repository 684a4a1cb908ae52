"""Feature geometry as column expressions: boxes, lengths, areas, segments, tests and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo


def with_mbb(features: DataFrame) -> DataFrame:
    e = [f"array_{f}(transform(coords, p -> p.{a})) AS {a}{f}" for a in "xy" for f in ("min", "max")]
    return features.selectExpr("*", *e)


def explode_segments(features: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, seg, x0, y0, x1, y1, attributes) for each pair of neighbouring vertices, within the row: no shuffle."""
    keep = [c for c in features.columns if c not in ("coords", *drop)]
    pairs = features.where("size(coords) > 1").select(*keep, F.col("coords"), F.explode(F.expr("sequence(0, size(coords) - 2)")).alias("seg"))
    return pairs.selectExpr(*keep, "seg", "coords[seg].x AS x0", "coords[seg].y AS y0", "coords[seg + 1].x AS x1", "coords[seg + 1].y AS y1")


def parts_to_rings(polygons: DataFrame) -> DataFrame:
    """Polygons (id, parts array<array<ring>>) to one row for each ring: (id, part, ring, coords, attributes)."""
    keep = [c for c in polygons.columns if c != "parts"]
    p = polygons.select(*keep, F.posexplode("parts").alias("part", "_rings"))
    return p.select(*keep, "part", F.posexplode("_rings").alias("ring", "coords"))


def line_length(features: DataFrame) -> DataFrame:
    step = "sqrt((coords[i + 1].x - coords[i].x) * (coords[i + 1].x - coords[i].x) + (coords[i + 1].y - coords[i].y) * (coords[i + 1].y - coords[i].y))"
    return features.withColumn("km", F.expr(f"aggregate(sequence(0, size(coords) - 2), 0e0, (acc, i) -> acc + {step}) / 1000e0"))


def signed_area(coords: str = "coords") -> str:
    """Shoelace, m2 around the first vertex (keeps the numbers small); positive: counter-clockwise."""
    x, y = (lambda i: f"({coords}[{i}].x - {coords}[0].x)"), (lambda i: f"({coords}[{i}].y - {coords}[0].y)")
    return f"aggregate(sequence(0, size({coords}) - 2), 0e0, (acc, i) -> acc + ({x('i')} * {y('i + 1')} - {x('i + 1')} * {y('i')})) / 2e0"


def ring_area(rings: DataFrame) -> DataFrame:
    return rings.withColumn("km2", F.expr(f"abs({signed_area()}) / 1e6"))


def polygon_area(rings: DataFrame, holes: str = "add") -> DataFrame:
    """(id, km2): ring areas of a polygon; holes 'add' (each ring counts) or 'subtract' (rings after the first of a part are taken off)."""
    sign = F.lit(1) if holes == "add" else F.when(F.col("ring") == 0, 1).otherwise(-1)
    return ring_area(rings).groupBy("id").agg(F.sum(F.col("km2") * sign).alias("km2"))


def wkt(features: DataFrame, geometry: str) -> DataFrame:
    text = "array_join(transform(coords, p -> concat(format_string('%.2f', p.x), ' ', format_string('%.2f', p.y))), ',')"
    head, tail = ("LINESTRING(", ")") if geometry == "line" else ("POLYGON((", "))")
    return features.withColumn("wkt", F.concat(F.lit(head), F.expr(text), F.lit(tail)))


def inside_ring(rings: DataFrame, x: float, y: float) -> DataFrame:
    """The rings that hold a point (even-odd, half-open)."""
    test = geo.crossing(geo.num(x), geo.num(y))
    for a, b in (("x0", "coords[i].x"), ("y0", "coords[i].y"), ("x1", "coords[i + 1].x"), ("y1", "coords[i + 1].y")):
        test = test.replace(a, b)
    return rings.where(f"aggregate(sequence(0, size(coords) - 2), 0, (acc, i) -> acc + {test}) % 2 = 1")


def touches_point(x: float, y: float) -> str:
    """Over segments: does the point lie on the segment?"""
    px, py = geo.num(x), geo.num(y)
    return f"((x1 - x0) * ({py} - y0) = (y1 - y0) * ({px} - x0) AND {px} BETWEEN least(x0, x1) AND greatest(x0, x1) AND {py} BETWEEN least(y0, y1) AND greatest(y0, y1))"


def distance_to_point(x: float, y: float) -> str:
    """Over segments: distance to a point (m)."""
    px, py = geo.num(x), geo.num(y)
    d2 = "((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
    t = f"least(1e0, greatest(0e0, CASE WHEN {d2} = 0e0 THEN 0e0 ELSE (({px} - x0) * (x1 - x0) + ({py} - y0) * (y1 - y0)) / {d2} END))"
    dx, dy = f"({px} - (x0 + {t} * (x1 - x0)))", f"({py} - (y0 + {t} * (y1 - y0)))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def in_range(features: DataFrame, box) -> DataFrame:
    """Features whose bounding box touches the box (closed); for points, the coordinate."""
    if "coords" in features.columns:
        return with_mbb(features).where(geo.mbb_touches(box))
    return features.where(geo.point_in_box("x", "y", box))


def closed(coords: str = "coords") -> str:
    """A ring with its first vertex at its end, too."""
    return f"CASE WHEN size({coords}) > 0 AND {coords}[0] <> element_at({coords}, -1) THEN concat({coords}, array({coords}[0])) ELSE {coords} END"


def build_lines(vertices: DataFrame, order: str, attrs: tuple[str, ...] = ()) -> DataFrame:
    """(id, coords, attrs) from vertices (id, x, y, order, attrs); attributes are those of the first vertex."""
    v = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), "x", "y", *attrs)))
    rows = vertices.groupBy("id").agg(v.alias("_v"))
    return rows.select("id", F.expr("transform(_v, p -> named_struct('x', p.x, 'y', p.y))").alias("coords"), *(F.col("_v")[0][a].alias(a) for a in attrs))


def build_rings(vertices: DataFrame, order: str, ring: str | None = None) -> DataFrame:
    """(id, ring, coords) from vertices: closed, outer rings (number 0) clockwise and holes counter-clockwise."""
    number = F.col(ring) if ring else F.lit(0)
    v = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), "x", "y")))
    rows = vertices.groupBy("id", number.alias("ring")).agg(v.alias("_v")).withColumn("_c", F.expr("transform(_v, p -> named_struct('x', p.x, 'y', p.y))"))
    rows = rows.withColumn("_c", F.expr(closed("_c"))).withColumn("_a", F.expr(signed_area("_c")))
    turned = (F.col("ring") == 0) == (F.col("_a") > 0)
    return rows.select("id", "ring", F.when(turned & (F.col("_a") != 0), F.reverse("_c")).otherwise(F.col("_c")).alias("coords"))


def quad_code(level: int, c: str = "col", r: str = "row") -> str:
    """The path of a cell from the root as digits 0 left up, 1 right up, 2 left down, 3 right down; the root is empty."""
    if level == 0:
        return "''"
    return f"array_join(transform(sequence({level - 1}, 0, -1), k -> CAST((shiftright({c}, k) & 1) + 2 * (shiftright({r}, k) & 1) AS STRING)), '')"


def join_boxes(features: DataFrame, boxes: DataFrame, level: int) -> DataFrame:
    """(box, id): the features whose bounding box touches each of many boxes (box, bx0, by0, bx1, by1), closed.

    Both are spread over the cells of a level and joined by cell; a pair counts in the
    first cell (west, then north) that both cover, so it comes once.
    """
    spread = lambda x0, x1, y0, y1, i: (F.explode(F.expr(f"sequence({geo.col(x0, level)}, {geo.col(x1, level)})")).alias(f"col{i}"), F.expr(f"sequence({geo.row(y1, level)}, {geo.row(y0, level)})").alias(f"_rows{i}"))
    f = features if "xmin" in features.columns else with_mbb(features) if "coords" in features.columns else features.selectExpr("*", "x AS xmin", "x AS xmax", "y AS ymin", "y AS ymax")
    names = ["id", "xmin", "ymin", "xmax", "ymax"]
    f = f.select(*names, *spread("xmin", "xmax", "ymin", "ymax", 0)).select(*names, F.col("col0").alias("_c"), F.explode("_rows0").alias("_r"))
    sides = ["box", "bx0", "by0", "bx1", "by1"]
    b = boxes.select(*sides, *spread("bx0", "bx1", "by0", "by1", 1)).select(*sides, F.col("col1").alias("_c"), F.explode("_rows1").alias("_r"))
    first_col, first_row = geo.col("greatest(xmin, bx0)", level), geo.row("least(ymax, by1)", level)
    return f.join(b, ["_c", "_r"]).where("xmin <= bx1 AND xmax >= bx0 AND ymin <= by1 AND ymax >= by0").where(f"_c = {first_col} AND _r = {first_row}").select("box", "id")
