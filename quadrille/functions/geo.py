"""Planar Web-Mercator formulas as SQL expression text.

Text, so that a DataFrame (F.expr) and an independent SQL engine evaluate the very
same sequence of floating-point operations.  All stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

# Fixed values.
L = 20037508.3427892
SCALE = 20037508.34
TILE = 256


def num(v: float) -> str:
    """A double literal in both dialects."""
    text = repr(float(v))
    text = text if "e" in text else text + "e0"
    return f"({text})" if v < 0 else text


def width(level: int) -> float:
    return 2 * L / 2**level


def resolution(z: int) -> float:
    return L / (128 << z)


def mercator_x(lon: str) -> str:
    return f"({lon}) * {num(SCALE)} / 180e0"


def mercator_y(lat: str) -> str:
    return f"ln(tan((90e0 + ({lat})) * {num(math.pi)} / 360e0)) / ({num(math.pi)} / 180e0) * {num(SCALE)} / 180e0"


def col(x: str, level: int) -> str:
    """Cell column; ties go left, as closed boxes tested from the left do."""
    return f"greatest(0, CAST(ceil((({x}) + {num(L)}) / {num(width(level))}) AS BIGINT) - 1)"


def row(y: str, level: int) -> str:
    """Cell row, 0 in the north; ties go up."""
    return f"greatest(0, CAST(ceil(({num(L)} - ({y})) / {num(width(level))}) AS BIGINT) - 1)"


def cell_box(c: str, r: str, level: int) -> tuple[str, str, str, str]:
    w = num(width(level))
    return f"(({c}) * {w} - {num(L)})", f"({num(L)} - (({r}) + 1) * {w})", f"((({c}) + 1) * {w} - {num(L)})", f"({num(L)} - ({r}) * {w})"


def in_world(x: str, y: str) -> str:
    return f"(({x}) BETWEEN {num(-L)} AND {num(L)} AND ({y}) BETWEEN {num(-L)} AND {num(L)})"


def point_in_box(x: str, y: str, b) -> str:
    """Closed."""
    return f"(({x}) >= {num(b[0])} AND ({x}) <= {num(b[2])} AND ({y}) >= {num(b[1])} AND ({y}) <= {num(b[3])})"


def boxes_overlap(box: tuple[str, str, str, str], b) -> str:
    """Strict: touching edges do not overlap."""
    x0, y0, x1, y1 = box
    return f"({x0} < {num(b[2])} AND {x1} > {num(b[0])} AND {y0} < {num(b[3])} AND {y1} > {num(b[1])})"


def mbb_within(b) -> str:
    return f"(xmin >= {num(b[0])} AND xmax <= {num(b[2])} AND ymin >= {num(b[1])} AND ymax <= {num(b[3])})"


def mbb_touches(b) -> str:
    """Closed, as an R-tree's intersects."""
    return f"(xmin <= {num(b[2])} AND xmax >= {num(b[0])} AND ymin <= {num(b[3])} AND ymax >= {num(b[1])})"


def length_km() -> str:
    return "(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 1000e0)"


def clip_share(bx0: str, by0: str, bx1: str, by1: str) -> str:
    """Share of the segment (x0,y0)-(x1,y1) inside the box (Liang-Barsky), 0 to 1."""

    def enter(a: str, d: str, lo: str, hi: str) -> str:
        return f"CASE WHEN {d} = 0e0 THEN CASE WHEN {a} >= {lo} AND {a} <= {hi} THEN 0e0 ELSE 2e0 END WHEN {d} > 0e0 THEN ({lo} - {a}) / ({d}) ELSE ({hi} - {a}) / ({d}) END"

    def leave(a: str, d: str, lo: str, hi: str) -> str:
        return f"CASE WHEN {d} = 0e0 THEN 1e0 WHEN {d} > 0e0 THEN ({hi} - {a}) / ({d}) ELSE ({lo} - {a}) / ({d}) END"

    dx, dy = "(x1 - x0)", "(y1 - y0)"
    t0 = f"greatest(0e0, {enter('x0', dx, bx0, bx1)}, {enter('y0', dy, by0, by1)})"
    t1 = f"least(1e0, {leave('x0', dx, bx0, bx1)}, {leave('y0', dy, by0, by1)})"
    return f"greatest(0e0, {t1} - {t0})"


def edge_area(bx0: str, by0: str, bx1: str, by1: str) -> str:
    """Signed share of an edge in the area of ring and box (m2): the integral of clamp(y) - y0 along the edge clipped to the box's columns.

    Summed over a closed ring its absolute value is the clipped area, so no
    polygon is ever built and partial aggregation applies.
    """
    xs, xe = f"least(greatest(x0, {bx0}), {bx1})", f"least(greatest(x1, {bx0}), {bx1})"
    slope = "((y1 - y0) / (x1 - x0))"
    ys, ye = f"(y0 + ({xs} - x0) * {slope})", f"(y0 + ({xe} - x0) * {slope})"

    def g(y: str) -> str:
        return f"CASE WHEN {y} <= {by0} THEN 0e0 WHEN {y} >= {by1} THEN ({by1} - {by0}) * ({by1} - {by0}) / 2e0 + ({y} - {by1}) * ({by1} - {by0}) ELSE ({y} - {by0}) * ({y} - {by0}) / 2e0 END"

    flat = f"({xe} - {xs}) * (least(greatest(({ys} + {ye}) / 2e0, {by0}), {by1}) - {by0})"
    return f"CASE WHEN x0 = x1 THEN 0e0 WHEN abs({ye} - {ys}) < 1e-3 THEN {flat} ELSE ({xe} - {xs}) * ({g(ye)} - {g(ys)}) / ({ye} - {ys}) END"


def crossing(px: str, py: str) -> str:
    """1 if the edge crosses the ray from (px, py) to the right (half-open rule), else 0."""
    a0, a1, b0, b1 = f"(y0 - ({py}))", f"(y1 - ({py}))", f"(x0 - ({px}))", f"(x1 - ({px}))"
    return f"CASE WHEN (({a0} <= 0e0 AND {a1} > 0e0) OR ({a0} > 0e0 AND {a1} <= 0e0)) AND ({b1} * {a0} - {b0} * {a1}) / ({a0} - {a1}) > 0e0 THEN 1 ELSE 0 END"


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    w = TILE * resolution(z)
    return x * w - L, L - (y + 1) * w, (x + 1) * w - L, L - y * w


def data_level(span: float) -> int:
    """Smallest level whose cells are no wider than the extent; at most 22."""
    return next((k for k in range(23) if width(k) <= span), 22)
