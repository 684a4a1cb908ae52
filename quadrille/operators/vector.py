"""Data-driven tiles for zooms finer than the cells: features drawn exactly, 4 x 4 samples a pixel.

Marks have radius width + 1 pixels, lines are width + 1 pixels wide with round caps,
polygons are filled first and edged on top.  Features are cut to the tile by their
boxes, drawn in slices (a slice is any set of features), and slices meet by pixel,
so a tile with very many features is not one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.functions.style import Style
from quadrille.operators.raster import last_rule

N, S = 256, 4
GRID = (np.arange(N * S) + 0.5) / S


def _near(ax, ay, bx, by, radius, hit) -> None:
    """Mark the samples within radius of a segment (pixels)."""
    i0, i1 = (int(np.clip(v * S, 0, N * S)) for v in (min(ay, by) - radius, max(ay, by) + radius + 1))
    j0, j1 = (int(np.clip(v * S, 0, N * S)) for v in (min(ax, bx) - radius, max(ax, bx) + radius + 1))
    if i0 >= i1 or j0 >= j1:
        return
    y, x = GRID[i0:i1, None], GRID[None, j0:j1]
    dx, dy = bx - ax, by - ay
    d2 = dx * dx + dy * dy
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / d2, 0, 1) if d2 else 0.0
    hit[i0:i1, j0:j1] |= (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= radius * radius


def _fill(xs, ys, hit) -> None:
    i0, i1 = (int(np.clip(v * S, 0, N * S)) for v in (ys.min(), ys.max() + 1))
    for i in range(i0, i1):
        y = GRID[i]
        up = (ys[:-1] <= y) != (ys[1:] <= y)
        cross = np.sort(xs[:-1][up] + (y - ys[:-1][up]) * (xs[1:][up] - xs[:-1][up]) / (ys[1:][up] - ys[:-1][up]))
        for a, b in zip(cross[::2], cross[1::2], strict=False):
            hit[i] |= (GRID >= a) & (GRID < b)


def draw(features: DataFrame, style: Style, geometry: str, z: int, x: int, y: int, box=None) -> DataFrame:
    """(pi, pj, r, g, b, a): features (x, y, item) or (coords, item) of a tile, later classes on top; outside the box nothing."""
    x0, y0, x1, y1 = geo.tile_box(z, x, y)
    scale, paints = N / (x1 - x0), style.paints
    if style.kind == "single":
        k = F.lit(0)
    elif style.kind == "classified":
        k = F.coalesce(*(F.when(F.col("item") == i, n) for n, i in enumerate(style.items)))
    else:
        k = last_rule(style.rules)
    # features outside the tile are not fetched, so marks end at its border
    if geometry == "point":
        near = features.where(geo.point_in_box("x", "y", (x0, y0, x1, y1))).select(F.expr("array(named_struct('x', x, 'y', y))").alias("coords"), k.alias("k"))
    else:
        from quadrille.operators.features import in_range

        near = in_range(features, (x0, y0, x1, y1)).select("coords", k.alias("k"))
    near = near.where("k is not null")

    def run(frames):
        layers: dict[int, np.ndarray] = {}
        for f in frames:
            for coords, kk in zip(f["coords"], f["k"], strict=True):
                xs = np.array([(c["x"] - x0) * scale for c in coords])
                ys = np.array([(y1 - c["y"]) * scale for c in coords])
                new = lambda key: layers.setdefault(key, np.zeros((N * S, N * S), bool))
                radius = paints[kk].width + 1 if geometry == "point" else (paints[kk].width + 1) / 2
                if geometry == "polygon":
                    _fill(xs, ys, new(2 * kk))
                    if style.kind != "single":
                        continue
                hit = new(2 * kk + 1)
                if geometry == "point":
                    _near(xs[0], ys[0], xs[0], ys[0], radius, hit)
                for a in range(len(xs) - 1):
                    _near(xs[a], ys[a], xs[a + 1], ys[a + 1], radius, hit)
        for layer, hit in layers.items():
            bits = hit.reshape(N, S, N, S).transpose(0, 2, 1, 3).reshape(N, N, 16)
            masks = (bits * (1 << np.arange(16))).sum(2)
            i, j = np.nonzero(masks)
            yield pd.DataFrame({"layer": layer, "pi": i, "pj": j, "mask": masks[i, j]})

    drawn = near.mapInPandas(run, "layer int, pi int, pj int, mask int").groupBy("layer", "pi", "pj").agg(F.bit_or("mask").alias("mask"))
    top = drawn.groupBy("pi", "pj").agg(F.max_by("mask", "layer").alias("mask"), F.max("layer").alias("layer"))
    fill = style.fill or paints[0]
    shades = [c for p in paints for c in ((fill if style.kind == "single" else p), p)]
    pick = lambda f: F.element_at(F.array(*(F.lit(f(p)) for p in shades)), F.col("layer") + 1)
    if box is not None:
        rz = geo.num(geo.resolution(z))
        px = f"({geo.num(x0)} + pj * {rz})", f"({geo.num(y1)} - (pi + 1) * {rz})", f"({geo.num(x0)} + (pj + 1) * {rz})", f"({geo.num(y1)} - pi * {rz})"
        top = top.where(geo.boxes_overlap(px, box))
    a = F.floor(pick(lambda p: p.alpha * 255.0) * F.bit_count("mask") / 16).cast("int")
    out = top.select("pi", "pj", pick(lambda p: p.r).alias("r"), pick(lambda p: p.g).alias("g"), pick(lambda p: p.b).alias("b"), a.alias("a"))
    return out.where("a > 0")
