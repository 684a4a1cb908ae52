"""Tiles as pixel tables, driven by cells: own pixels in full colour, others by the best coverage of a neighbour.

A stencil lists, for every class and set of existing child cells, the offsets at
which a neighbour covers a pixel, how much, and in which order they are tried;
it is a few hundred rows, computed on the driver.  Occupied cells scatter through
it and each pixel keeps the largest coverage, the earliest offset at ties.
Global pixel numbers are used throughout, so marks cross tile borders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.functions.style import Paint, Rule, Style, gradient

CHILD = [(1, -0.25, 0.25), (2, 0.25, 0.25), (4, -0.25, -0.25), (8, 0.25, -0.25)]


def reach(width: float, polygon: bool = False) -> int:
    edge = width + math.sqrt(2) / 4 - 0.5
    return 0 if width == 0 and not polygon else math.ceil(edge) if polygon else int(edge) + 1


def coverage(x: float, y: float, width: float) -> int:
    """Quarters of a pixel at the origin that a disc of this radius at (x, y) covers."""
    d = math.hypot(x, y)
    if d < width - math.sqrt(2) / 4:
        return 4
    if d < width + math.sqrt(2) / 4:
        return sum(math.hypot(x - a, y - b) < width for a in (-0.25, 0.25) for b in (-0.25, 0.25))
    return 0


def stencil(widths: list[float], geometry: str) -> list[tuple[int, int, int, int, int, int]]:
    """(class, mask, m, n, coverage, order); mask 0 for points."""
    out = []
    for k, width in enumerate(widths):
        for mask in [0] if geometry == "point" else range(1, 16):
            order, far = 0, max(0, reach(width, geometry == "polygon"))
            for ring in range(1, far + 1):
                for m in range(-ring, ring + 1):
                    for n in range(-ring, ring + 1):
                        if max(abs(m), abs(n)) == ring:
                            order += 1
                            places = [(m, n)] if not mask else [(m + dx, n + dy) for bit, dx, dy in CHILD if mask & bit]
                            cov = coverage(*min(places, key=lambda p: math.hypot(*p)), width)
                            if cov:
                                out.append((k, mask, m, n, cov, order))
    return out


def alpha_own(p: Paint) -> int:
    return math.floor(p.alpha * 255)


def alpha_covered(p: Paint, cov: int) -> int:
    return max(0, math.floor(p.alpha * cov * 64 - 1))


def classed(cells: DataFrame, style: Style) -> DataFrame:
    """(col, row, k): the class of each cell; null if it holds none of the requested ones.

    cells: (col, row, item, m).  Classified: the requested item with the largest
    measure, the smallest name at ties.  Ruled: that item among those which any
    rule matches, then the last rule it matches.
    """
    if style.kind == "single":
        return cells.groupBy("col", "row").agg(F.lit(0).alias("k"))
    if style.kind == "classified":
        k = F.coalesce(*(F.when(F.col("item") == i, n) for n, i in enumerate(style.items)))
    else:
        k = last_rule(style.rules)
    named = cells.withColumn("k", k)
    rank = F.when(F.col("k").isNotNull(), F.struct((-F.col("m")).alias("m"), F.col("item").alias("i"), F.col("k").alias("k")))
    return named.groupBy("col", "row").agg(F.min(rank).alias("_w")).select("col", "row", F.col("_w.k").alias("k"))


def last_rule(rules: tuple[Rule, ...]):
    k = F.lit(None).cast("int")
    for n, r in enumerate(rules):
        k = F.when(r.matches(F.col("item")), n).otherwise(k)
    return k


def window(cells: DataFrame, z: int, x: int, y: int, margin: int) -> DataFrame:
    """The cells of a tile and of a margin around it."""
    return cells.where(f"col BETWEEN {256 * x - margin} AND {256 * x + 255 + margin} AND row BETWEEN {256 * y - margin} AND {256 * y + 255 + margin}")


def in_box(df: DataFrame, z: int, box) -> DataFrame:
    return df if box is None else df.where(geo.boxes_overlap(geo.cell_box("col", "row", z + 8), box))


def render(cells: DataFrame, style: Style, geometry: str, z: int, x: int, y: int, box=None, masks: DataFrame | None = None) -> DataFrame:
    """(pi, pj, r, g, b, a) of the non-empty pixels of a tile.

    cells: (col, row, item, m[, topo]) at level z + 8; masks: (col, row, mask) for
    lines and polygons.  With a box, own and neighbour pixels must overlap it.
    """
    spark = cells.sparkSession
    far = max(0, *(reach(p.width, geometry == "polygon") for p in style.paints))
    near = in_box(window(cells, z, x, y, far), z, box)
    own = classed(near.select("col", "row", "item", "m"), style)
    if geometry == "polygon":
        topo = near.groupBy("col", "row").agg(F.min("topo").alias("topo"))  # i before w
        own = own.join(topo, ["col", "row"])
    else:
        own = own.withColumn("topo", F.lit("i"))
    sources = own.where("topo = 'i' and k is not null")
    sources = sources.withColumn("mask", F.lit(0)) if masks is None else sources.join(masks, ["col", "row"])
    rows = stencil([p.width for p in style.paints], geometry)
    split_fill = geometry == "polygon" and style.kind == "single"
    full = own.where("k is not null" + (" and topo = 'i'" if split_fill else "")).select("col", "row", "k", F.lit(None).cast("int").alias("cov"), F.lit(0).alias("ord"))
    if rows:
        table = F.broadcast(spark.createDataFrame(rows, "k int, mask int, m int, n int, cov int, ord int"))  # a few hundred rows
        hit = sources.join(table, ["k", "mask"]).select((F.col("col") - F.col("m")).alias("col"), (F.col("row") + F.col("n")).alias("row"), "k", "cov", "ord")
        full = full.unionByName(hit)
    best = full.groupBy("col", "row").agg(F.max_by("k", F.struct(F.coalesce("cov", F.lit(9)).alias("c"), (-F.col("ord")).alias("o"))).alias("k"), F.max(F.coalesce("cov", F.lit(9))).alias("cov"))
    if split_fill and style.fill is not None:
        within = own.where("topo = 'w'").select("col", "row", F.lit(True).alias("w"))
        best = best.join(within, ["col", "row"], "full")
        filled = F.col("w") & (F.col("cov").isNull() | (F.col("cov") == 1))
        fill_alpha = F.when(F.col("cov") == 1, alpha_covered(style.fill, 1)).otherwise(alpha_own(style.fill))
        best = best.withColumn("k", F.when(filled, len(style.paints)).otherwise(F.col("k"))).withColumn("_fa", fill_alpha)
    paints = [*style.paints, *([style.fill] if split_fill and style.fill else [])]
    pick = lambda f: F.element_at(F.array(*(F.lit(f(p)) for p in paints)), F.col("k") + 1)
    shades = F.element_at(F.array(*(F.array(*(F.lit(v) for v in (0, *(alpha_covered(p, c) for c in (1, 2, 3, 4)), alpha_own(p)))) for p in paints)), F.col("k") + 1)
    a = F.element_at(shades, F.when(F.col("cov") == 9, 6).otherwise(F.coalesce("cov", F.lit(0)) + 1))
    if split_fill and style.fill is not None:
        a = F.when(F.col("k") == len(style.paints), F.col("_fa")).otherwise(a)
    done = window(best, z, x, y, 0).select((F.col("row") - 256 * y).alias("pi"), (F.col("col") - 256 * x).alias("pj"), pick(lambda p: p.r).alias("r"), pick(lambda p: p.g).alias("g"), pick(lambda p: p.b).alias("b"), a.alias("a"))
    return done.where("a > 0").select(*(F.col(c).cast("int") for c in ("pi", "pj", "r", "g", "b", "a")))


def kernel(radius: int) -> list[tuple[int, int, float]]:
    """(m, n, 255 * falloff); radius 0 touches the own pixel only."""
    far = reach(radius)
    if far == 0:
        return [(0, 0, 255.0)]
    return [(m, n, 255.0 * (1 - math.sqrt(m * m + n * n) / far)) for m in range(-far, far + 1) for n in range(-far, far + 1) if math.sqrt(m * m + n * n) < far]


def largest(cells: DataFrame, z: int, view=None, box=None) -> DataFrame:
    """(top): the largest cell measure in a range of tiles (x0, x1, y0, y1), or anywhere."""
    c = cells if view is None else cells.where(f"col BETWEEN {256 * view[0]} AND {256 * view[1] + 255} AND row BETWEEN {256 * view[2]} AND {256 * view[3] + 255}")
    return in_box(c, z, box).agg(F.max("m").alias("top"))


def heat(cells: DataFrame, style: Style, geometry: str, z: int, x: int, y: int, box=None) -> DataFrame:
    """(pi, pj, r, g, b, a); cells: (col, row, m).  Every contribution is floored, so the sum has no order."""
    spark = cells.sparkSession
    far = max(1, reach(style.radius))
    top = largest(cells, z, style.view if geometry == "point" else None, box)
    table = F.broadcast(spark.createDataFrame(kernel(style.radius), "m_ int, n_ int, w double"))  # (2 radius + 1)^2 rows
    near = in_box(window(cells, z, x, y, far), z, box).crossJoin(F.broadcast(top)).crossJoin(table)  # one row; a stencil
    v = F.expr("CASE WHEN top > 0 THEN CAST(floor(w * m / top) AS BIGINT) ELSE 0 END")
    spread = near.select((F.col("col") - F.col("m_")).alias("col"), (F.col("row") + F.col("n_")).alias("row"), v.alias("v"))
    sums = in_box(window(spread, z, x, y, 0), z, box).groupBy("col", "row").agg(F.least(F.sum("v"), F.lit(255)).cast("int").alias("v")).where("v > 0")
    return sums.select((F.col("row") - 256 * y).cast("int").alias("pi"), (F.col("col") - 256 * x).cast("int").alias("pj"), *shades(style, geometry))


def shades(style: Style, geometry: str) -> list:
    """r, g, b, a of a heat value v from 1 to 255."""
    lut = gradient(style.gradient)
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in lut)), F.col("v") + 1)
    a = F.expr("least(150 + CAST(floor(105 * v / 255) AS INT), 255)") if geometry == "point" else F.col("v")
    return [pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), a.alias("a")]


def data_heat(points: DataFrame, style: Style, top: DataFrame, z: int, x: int, y: int, box=None) -> DataFrame:
    """Heat from the points of the tile themselves, for zooms finer than the cells; (pi, pj, v)."""
    spark = points.sparkSession
    x0, y0, x1, y1 = geo.tile_box(z, x, y)
    inside = points.where(geo.point_in_box("x", "y", (x0, y0, x1, y1)))
    if box is not None:
        inside = inside.where(geo.point_in_box("x", "y", box))
    at = inside.select(F.expr(f"CAST(floor(256e0 * (x - {geo.num(x0)}) / {geo.num(x1 - x0)}) AS BIGINT)").alias("col"), F.expr(f"CAST(floor(256e0 - 256e0 * (y - {geo.num(y0)}) / {geo.num(y1 - y0)}) AS BIGINT)").alias("row"))
    own = at.groupBy("col", "row").agg(F.count("*").alias("n"))
    table = F.broadcast(spark.createDataFrame(kernel(style.radius), "m_ int, n_ int, w double"))
    hit = own.crossJoin(F.broadcast(top)).crossJoin(table)
    spread = hit.select((F.col("row") + F.col("n_")).alias("pi"), (F.col("col") + F.col("m_")).alias("pj"), F.expr("CAST(n * floor(w / top) AS BIGINT)").alias("v"))
    out = spread.where("pi BETWEEN 0 AND 255 AND pj BETWEEN 0 AND 255").groupBy("pi", "pj").agg(F.least(F.sum("v"), F.lit(255)).cast("int").alias("v")).where("v > 0")
    return out.select(F.col("pi").cast("int").alias("pi"), F.col("pj").cast("int").alias("pj"), "v")
