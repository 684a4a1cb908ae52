"""Range statistics: measure totals in a box, whole, by class or by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.functions.style import Rule


def measured(features: DataFrame, geometry: str, box=None) -> DataFrame:
    """features with m inside the box: count, km of a segment, signed km2 share of an edge (sum and abs per ring)."""
    if geometry == "point":
        f = features if box is None else features.where(geo.in_world("x", "y") + " AND " + geo.point_in_box("x", "y", box))
        return f.withColumn("m", F.lit(1).cast("long"))
    b = tuple(map(geo.num, box))
    if geometry == "line":
        keep = features.where(f"least(x0, x1) <= {b[2]} AND greatest(x0, x1) >= {b[0]} AND least(y0, y1) <= {b[3]} AND greatest(y0, y1) >= {b[1]}")
        return keep.withColumn("m", F.expr(f"{geo.length_km()} * {geo.clip_share(*b)}"))
    # a ring's edges left and right of the box add nothing
    keep = features.where(f"least(x0, x1) <= {b[2]} AND greatest(x0, x1) >= {b[0]}")
    attrs = [c for c in features.columns if c not in ("id", "seg", "x0", "y0", "x1", "y1")]
    return keep.groupBy("id", *attrs).agg(F.expr(f"abs(sum({geo.edge_area(*b)})) / 1e6").alias("m"))


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"))


def by_class(rows: DataFrame, field: str, items: list[str]) -> DataFrame:
    """(item, m) for every requested item, 0 where nothing matches; one pass, no join."""
    if field not in rows.columns:
        rows = rows.withColumn(field, F.lit(None).cast("string"))
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col(field).cast("string") == i, F.col("m"))), F.lit(0)).alias(f"_{k}") for k, i in enumerate(items)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.col(f"_{k}").alias("m")) for k, i in enumerate(items)))).alias("x")).select("x.*")


def by_rule(rows: DataFrame, field: str, rules: list[Rule]) -> DataFrame:
    """(rule, m): independent sums; one feature may count in several rules."""
    item = rows.withColumn("_item", F.col(field).cast("string"))
    sums = item.agg(*(F.coalesce(F.sum(F.when(r.matches(F.col("_item")), F.col("m"))), F.lit(0)).alias(f"_{k}") for k, r in enumerate(rules)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(r.op + r.value).alias("rule"), F.col(f"_{k}").alias("m")) for k, r in enumerate(rules)))).alias("x")).select("x.*")


def as_text(stats: DataFrame, name: str | None = None, order: list[str] | None = None) -> DataFrame:
    """(text): 'Count:n' or 'item:n,item:n' in request order; fractions with six digits."""
    whole = dict(stats.dtypes)["m"] in ("bigint", "int")
    shown = F.col("m").cast("string") if whole else F.format_string("%.6f", F.col("m"))
    if name is None:
        return stats.select(F.concat(F.lit("Count:"), shown).alias("text"))
    # one row for each requested item
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    parts = stats.agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), F.concat(name, F.lit(":"), shown).alias("t")))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda x: x["t"]), ",").alias("text"))


def with_bins(rows: DataFrame, field: str) -> DataFrame:
    """rows with <field>_bin: at most ten equal bins of whole numbers, labelled by offsets from the least value."""
    v = F.expr(f"CAST({field} AS INT)")
    span = rows.agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    joined = rows.crossJoin(F.broadcast(span))  # one row
    seg = "((_mx - _mn) div 10 + 1)"
    k = f"((CAST({field} AS INT) - _mn) div {seg})"
    return joined.withColumn(f"{field}_bin", F.expr(f"concat(CAST({k} * {seg} AS STRING), '~', CAST(({k} + 1) * {seg} AS STRING))")).drop("_mn", "_mx")
