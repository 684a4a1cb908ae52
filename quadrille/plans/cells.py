"""Cell tables: features to pyramid cells at one level, and roll-up.

Only the level a query needs is built; coarser ones come from it by shifting cell
numbers, with partial aggregation at each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import geo


def point_cells(points: DataFrame, level: int, items: list[str]) -> DataFrame:
    """(col, row, *items, m): counts; points outside the world belong to no cell."""
    inside = points.where(geo.in_world("x", "y"))
    return inside.groupBy(F.expr(geo.col("x", level)).alias("col"), F.expr(geo.row("y", level)).alias("row"), *items).agg(F.count("*").alias("m"))


def _strips(segments: DataFrame, level: int) -> DataFrame:
    """segments cut into column strips: col, the ends _a and _b of the part in the strip, and the heights _p and _q there."""
    w, half = geo.num(geo.width(level)), geo.num(geo.L)
    s = segments.withColumn("col", F.explode(F.expr(f"sequence({geo.col('least(x0, x1)', level)}, {geo.col('greatest(x0, x1)', level)})")))
    s = s.withColumn("_a", F.expr(f"greatest(least(x0, x1), col * {w} - {half})")).withColumn("_b", F.expr(f"least(greatest(x0, x1), (col + 1) * {w} - {half})"))
    at = lambda x: f"CASE WHEN x0 = x1 THEN {{}} ELSE y0 + ({x} - x0) * ((y1 - y0) / (x1 - x0)) END"
    return s.withColumn("_p", F.expr(at("_a").format("y0"))).withColumn("_q", F.expr(at("_b").format("y1")))


def segment_cells(segments: DataFrame, level: int) -> DataFrame:
    """segments with (col, row) of every cell they meet: by column strip, then the rows inside the strip."""
    rows = f"sequence({geo.row('greatest(_p, _q)', level)}, {geo.row('least(_p, _q)', level)})"
    return _strips(segments, level).withColumn("row", F.explode(F.expr(rows))).drop("_a", "_b", "_p", "_q")


def line_cells(segments: DataFrame, level: int, items: list[str]) -> DataFrame:
    """(col, row, *items, m): clipped length in km."""
    box = geo.cell_box("col", "row", level)
    met = segment_cells(segments, level).withColumn("m", F.expr(f"{geo.length_km()} * {geo.clip_share(*box)}"))
    return met.groupBy("col", "row", *items).agg(F.sum("m").alias("m"))


def boundary_cells(edges: DataFrame, level: int) -> DataFrame:
    """(ring id, col, row): cells that an edge meets."""
    return segment_cells(edges, level).select("id", "col", "row").distinct()


def ring_cells(edges: DataFrame, level: int, attrs: list[str]) -> DataFrame:
    """(id, col, row, topo, m, *attrs): clipped area in km2; topo i on the boundary, w within.

    One pass, linear in the cells: an edge adds its share of area to the cells that it
    meets and carries its width to all cells south of them in the column.  Running sums
    down each column of a ring turn carries into areas; where the sum is a whole cell's
    width, the cells up to the next boundary cell lie within.
    """
    width = geo.num(geo.width(level))
    box = geo.cell_box("col", "row", level)
    north, south = geo.row("greatest(_p, _q)", level), geo.row("least(_p, _q)", level)
    met = _strips(edges, level).withColumn("_south", F.expr(south)).withColumn("row", F.explode(F.expr(f"sequence({north}, _south)")))
    carry = "CASE WHEN row < _south THEN 0e0 WHEN x1 >= x0 THEN _b - _a ELSE _a - _b END"
    parts = met.select("id", "col", "row", *attrs, F.expr(geo.edge_area(*box)).alias("_part"), F.expr(carry).alias("_carry"))
    # dealt by column of a ring once, for the sums and the windows
    border = parts.repartition("id", "col").groupBy("id", "col", "row", *attrs).agg(F.sum("_part").alias("_part"), F.sum("_carry").alias("_carry"))
    down = Window.partitionBy("id", "col").orderBy("row")
    border = border.withColumn("_above", F.coalesce(F.sum("_carry").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_next", F.lead("row").over(down))
    inside = f"abs(_above + _carry) > {width} / 2e0 AND _next > row + 1"
    cells = F.expr(f"""concat(array(named_struct('row', row, 'topo', 'i', 'm', abs(_part + _above * {width}) / 1e6)),
      CASE WHEN {inside} THEN transform(sequence(row + 1, _next - 1), r -> named_struct('row', r, 'topo', 'w', 'm', {geo.num(geo.width(level) * geo.width(level) / 1e6)})) ELSE array() END)""")
    return border.select("id", "col", F.explode(cells).alias("_c"), *attrs).select("id", "col", "_c.row", "_c.topo", "_c.m", *attrs)


def roll_up(cells: DataFrame, steps: int, items: list[str]) -> DataFrame:
    """The same table `steps` levels coarser."""
    return cells.groupBy(F.expr(f"shiftright(col, {steps})").alias("col"), F.expr(f"shiftright(row, {steps})").alias("row"), *items).agg(F.sum("m").alias("m"))


def pyramid(finest: DataFrame, level: int, coarsest: int, items: list[str]) -> DataFrame:
    """(level, col, row, *items, m) of all levels; each is rolled up from the one below it."""
    out, now = None, finest.select("col", "row", *items, "m")
    for k in range(level, coarsest - 1, -1):
        part = now.withColumn("level", F.lit(k))
        out = part if out is None else out.unionByName(part)
        if k > coarsest:
            now = roll_up(now, 1, items)
    return out


def persist(cells: DataFrame, path: str, *keys: str) -> None:
    """A pyramid as Parquet, a folder for each level, cells in order of blocks of 256 x 256 (ty, tx): level and block filters prune files and row groups.

    Cells are dealt by range, so a level with nearly all cells is written by many tasks.
    """
    order = ["level", *keys, "ty", "tx", "row", "col"]
    blocks = cells.withColumn("ty", F.expr("shiftright(row, 8)")).withColumn("tx", F.expr("shiftright(col, 8)"))
    blocks.repartitionByRange(*order[:-2]).sortWithinPartitions(*order).write.partitionBy("level").mode("overwrite").parquet(path)


def children_mask(cells: DataFrame) -> DataFrame:
    """(col, row, mask) one level coarser: bits 1 left up, 2 right up, 4 left down, 8 right down of the existing children."""
    bit = F.expr("CASE WHEN col % 2 = 0 THEN CASE WHEN row % 2 = 0 THEN 1 ELSE 4 END ELSE CASE WHEN row % 2 = 0 THEN 2 ELSE 8 END END")
    return cells.groupBy(F.expr("shiftright(col, 1)").alias("col"), F.expr("shiftright(row, 1)").alias("row")).agg(F.bit_or(bit).alias("mask"))


def min_cover_cell(box, deepest: int) -> tuple[int, int, int]:
    """(level, col, row) of the deepest cell that holds the box: the common prefix of its corner cells."""
    best = (0, 0, 0)
    for level in range(deepest + 1):
        w = geo.width(level)
        c0, c1 = int((box[0] + geo.L) // w), int((box[2] + geo.L) // w)
        r0, r1 = int((geo.L - box[3]) // w), int((geo.L - box[1]) // w)
        if (c0, r0) != (c1, r1):
            break
        best = level, c0, r0
    return best


def fast_count(points: DataFrame, cells: DataFrame, level: int, box) -> DataFrame:
    """(m): points in the box, from whole cells of the pyramid and exact points of border cells only."""
    b = geo.cell_box("col", "row", level)
    whole = f"({b[0]} > {geo.num(box[0])} AND {b[2]} <= {geo.num(box[2])} AND {b[1]} > {geo.num(box[1])} AND {b[3]} <= {geo.num(box[3])})"
    near = points.withColumn("col", F.expr(geo.col("x", level))).withColumn("row", F.expr(geo.row("y", level)))
    exact = near.where(geo.in_world("x", "y") + " AND " + geo.point_in_box("x", "y", box) + f" AND NOT {whole}").agg(F.count("*").alias("m"))
    return cells.where(whole).select(F.sum("m").alias("m")).union(exact).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
