"""The registered queries and, side by side, their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import fixtures as fx
from quadrille.functions import geo, style as st
from quadrille.operators import features as ft, raster
from quadrille.plans import cells, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- the layers in SQL -------------------------------------------------------------------------

POINTS = """points AS (SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS id,
  ((l_orderkey * 7919777 + l_linenumber * 104729 + l_partkey * 31) % 40000000) - 20000000 + 0.37::DOUBLE AS x,
  ((l_partkey * 6151 + l_suppkey * 3571 + l_orderkey * 15485863) % 40000000) - 20000000 + 0.61::DOUBLE AS y,
  l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS INT) AS qty FROM lineitem)"""
VERTICES = """ev AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn,
  ((user_id * 7919000) % 36000000) - 18000000 + ((event_id * 7919) % 200000) - 100000 + 0.37::DOUBLE AS x,
  ((user_id * 6151000) % 36000000) - 18000000 + ((event_id * 3571) % 200000) - 100000 + 0.61::DOUBLE AS y FROM events),
lv0 AS (SELECT user_id * 100000 + CAST(floor(rn / 8) AS BIGINT) AS id, CAST(rn % 8 AS INT) AS vertex, x, y, event_type FROM ev),
lv AS (SELECT id, vertex, x, y, first_value(event_type) OVER (PARTITION BY id ORDER BY vertex) AS etype, count(*) OVER (PARTITION BY id) AS nv FROM lv0)"""
SEGMENTS = VERTICES + """,
segs AS (SELECT * FROM (SELECT id, vertex AS seg, etype, x AS x0, y AS y0, lead(x) OVER (PARTITION BY id ORDER BY vertex) AS x1, lead(y) OVER (PARTITION BY id ORDER BY vertex) AS y1 FROM lv WHERE nv > 1) WHERE x1 IS NOT NULL)"""
PENTAGON = ",".join(f"({k},{dx},{dy})" for k, (dx, dy) in enumerate(fx.PENTAGON))
EDGES = f"""pv AS (SELECT o_orderkey AS id, k AS vertex, o_orderstatus AS status, o_orderpriority AS prio, CAST(o_custkey % 50 AS INT) AS size,
  ((o_orderkey * 7919000) % 36000000) - 18000000 + dx * ((o_custkey % 50) + 5) * 100 + 0.37::DOUBLE AS x,
  ((o_orderkey * 6151000) % 36000000) - 18000000 + dy * ((o_custkey % 50) + 5) * 100 + 0.61::DOUBLE AS y
  FROM orders CROSS JOIN (VALUES {PENTAGON}) t(k, dx, dy)),
edges AS (SELECT * FROM (SELECT id, vertex AS seg, status, x AS x0, y AS y0, lead(x) OVER (PARTITION BY id ORDER BY vertex) AS x1, lead(y) OVER (PARTITION BY id ORDER BY vertex) AS y1 FROM pv) WHERE x1 IS NOT NULL)"""
SOURCE = {"point": POINTS, "line": SEGMENTS, "polygon": EDGES}
TABLE = {"point": "points", "line": "segs", "polygon": "edges"}
SHORT = {"point": "pt", "line": "ln", "polygon": "pg"}
FIELD = {"point": "flag", "line": "etype", "polygon": "status"}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def layer(spark: SparkSession, sf_dir: str, geometry: str) -> DataFrame:
    """Points, or the segments of lines or rings."""
    if geometry == "point":
        return fx.points(spark, sf_dir)
    if geometry == "line":
        return ft.explode_segments(fx.lines(spark, sf_dir))
    return ft.explode_segments(fx.rings(spark, sf_dir).select("id", "coords", "status"))


# --- range statistics --------------------------------------------------------------------------

NAMES = {"point": "count", "line": "length", "polygon": "area"}
ITEMS = {"point": ["A", "N", "R", "Z"], "line": ["click", "view", "purchase", "nothing"], "polygon": ["F", "O", "P", "Z"]}
RULES = [st.Rule(">=", "20"), st.Rule("<=", "10"), st.Rule(">", "30"), st.Rule("<", "5")]
TEXT_RULES = {g: [st.Rule("=", v[0]), st.Rule("!=", v[0])] for g, v in ITEMS.items()}


def measured_sql(geometry: str, box) -> str:
    b = tuple(map(geo.num, box))
    if geometry == "point":
        return f"SELECT *, 1 AS m FROM points WHERE {geo.in_world('x', 'y')} AND {geo.point_in_box('x', 'y', box)}"
    if geometry == "line":
        return f"SELECT *, {geo.length_km()} * {geo.clip_share(*b)} AS m FROM segs"
    return f"SELECT id, status, abs(sum({geo.edge_area(*b)})) / 1e6 AS m FROM edges GROUP BY id, status"


def _stat(geometry: str, shape: Callable[[DataFrame], DataFrame]):
    def run(spark, sf_dir):
        out = shape(stats.measured(layer(spark, sf_dir, geometry), geometry, fx.B1))
        return out if geometry == "point" else out.withColumn("m", F.round("m", 3))

    return run


for _g, _n in NAMES.items():
    _m = "CAST(coalesce(sum(m), 0) AS BIGINT)" if _g == "point" else "round(coalesce(sum(m), 0), 3)"
    _from = f"WITH {SOURCE[_g]}, r AS ({measured_sql(_g, fx.B1)}) "
    _values = ", ".join(f"('{i}')" for i in ITEMS[_g])
    query(f"{_n}_single", _from + f"SELECT {_m} AS m FROM r")(_stat(_g, stats.total))
    query(f"{_n}_classified", _from + f"SELECT v.item, {_m} AS m FROM (VALUES {_values}) v(item) LEFT JOIN r ON r.{FIELD[_g]} = v.item GROUP BY v.item")(_stat(_g, lambda r, g=_g: stats.by_class(r, FIELD[g], ITEMS[g])))
    _rules, _field = (RULES, "qty") if _g == "point" else (TEXT_RULES[_g], FIELD[_g])
    _numeric = {">=": "qty >= 20", "<=": "qty <= 10", ">": "qty > 30", "<": "qty < 5", "=": f"{_field} = '{ITEMS[_g][0]}'", "!=": f"{_field} <> '{ITEMS[_g][0]}'"}
    _union = " UNION ALL ".join(f"SELECT '{r.op}{r.value}' AS rule, {_m} AS m FROM r WHERE {_numeric[r.op]}" for r in _rules)
    query(f"{_n}_ruled", _from + _union)(_stat(_g, lambda r, f=_field, rs=_rules: stats.by_rule(r, f, rs)))

_from = f"WITH {POINTS}, r AS ({measured_sql('point', fx.B1)}) "
for _key, _rule, _field, _test in [("eq", st.Rule("=", "A"), "flag", "flag = 'A'"), ("ne", st.Rule("!=", "A"), "flag", "flag <> 'A'"), ("ge", RULES[0], "qty", "qty >= 20"), ("le", RULES[1], "qty", "qty <= 10"), ("gt", RULES[2], "qty", "qty > 30"), ("lt", RULES[3], "qty", "qty < 5")]:
    query(f"rule_{_key}", _from + f"SELECT '{_rule.op}{_rule.value}' AS rule, count(*) AS m FROM r WHERE {_test}")(_stat("point", lambda r, f=_field, x=_rule: stats.by_rule(r, f, [x])))


@query("rule_bins", f"""WITH {POINTS}, b AS (SELECT CAST(floor((qty - mn) / seg) AS BIGINT) * seg AS start FROM (SELECT qty, mn, (mx - mn) // 10 + 1 AS seg FROM points, (SELECT min(qty) AS mn, max(qty) AS mx FROM points)))
SELECT '>=20' AS rule, count(*) FILTER (start >= 20) AS m FROM b""")
def rule_bins(spark, sf_dir):
    """An ordering rule over binned labels compares the number a label starts with."""
    binned = stats.with_bins(fx.points(spark, sf_dir), "qty")
    return stats.by_rule(binned.withColumn("m", F.lit(1).cast("long")), "qty_bin", [RULES[0]])


@query("filtered_count", _from + "SELECT count(*) AS m FROM r WHERE flag IN ('A', 'R')")
def filtered_count(spark, sf_dir):
    return stats.total(stats.measured(fx.points(spark, sf_dir).where(F.col("flag").isin("A", "R")), "point", fx.B1))


@query("stat_string", _from + "SELECT string_agg(v.item || ':' || n, ',' ORDER BY v.k) AS text FROM (SELECT k, item, (SELECT count(*) FROM r WHERE flag = item) AS n FROM (VALUES (1, 'A'), (2, 'N'), (3, 'R'), (4, 'Z')) t(k, item)) v")
def stat_string(spark, sf_dir):
    got = stats.by_class(stats.measured(fx.points(spark, sf_dir), "point", fx.B1), "flag", ITEMS["point"])
    return stats.as_text(got, "item", ITEMS["point"])


@query("count_empty_box", f"WITH {POINTS} SELECT CAST(count(*) AS BIGINT) AS m FROM points WHERE x >= 3e7")
def count_empty_box(spark, sf_dir):
    return stats.total(stats.measured(fx.points(spark, sf_dir), "point", fx.B3))


@query("count_pyramid", f"WITH {POINTS}, r AS ({measured_sql('point', fx.B1)}) SELECT CAST(count(*) AS BIGINT) AS m FROM r")
def count_pyramid(spark, sf_dir):
    """The box count from whole pyramid cells plus the points of border cells."""
    p = fx.points(spark, sf_dir)
    return cells.fast_count(p, cells.point_cells(p, 7, []), 7, fx.B1)


@query("field_items", f"WITH {POINTS} SELECT flag AS item, count(*) AS m FROM points GROUP BY flag")
def field_items(spark, sf_dir):
    return fx.points(spark, sf_dir).groupBy(F.col("flag").alias("item")).agg(F.count("*").alias("m")).orderBy("item")


@query("dataset_meta", f"WITH {POINTS} SELECT 'point' AS kind, '3857' AS srs, count(*) AS n, round(min(x), 1) AS xmin, round(min(y), 1) AS ymin, round(max(x), 1) AS xmax, round(max(y), 1) AS ymax, 'flag-string, status-string, qty-int' AS fields FROM points")
def dataset_meta(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    fields = ", ".join(f"{n}-{t}" for n, t in p.dtypes if n not in ("id", "x", "y"))
    return p.agg(F.lit("point").alias("kind"), F.lit("3857").alias("srs"), F.count("*").alias("n"), *(F.round(f(c), 1).alias(c + f.__name__) for f, c in ((F.min, "x"), (F.min, "y"), (F.max, "x"), (F.max, "y"))), F.lit(fields).alias("fields"))


@query("load_summary", f"""WITH {POINTS}, {SEGMENTS}, {EDGES}
SELECT 'point' AS layer, count(*) AS features, count(*) AS pieces, 0e0 AS total FROM points
UNION ALL SELECT 'line', count(DISTINCT id), count(*), round(sum({geo.length_km()}), 3) FROM segs
UNION ALL SELECT 'polygon', (SELECT count(DISTINCT id) FROM edges), (SELECT count(*) FROM edges), round(sum(a), 3) FROM (SELECT abs(sum((x0 - fx) * (y1 - fy) - (x1 - fx) * (y0 - fy))) / 2e6 AS a FROM edges JOIN (SELECT id, x AS fx, y AS fy FROM pv WHERE vertex = 0) USING (id) GROUP BY id)""")
def load_summary(spark, sf_dir):
    lines, rings = fx.lines(spark, sf_dir), fx.rings(spark, sf_dir)
    one = F.count("*")
    a = fx.points(spark, sf_dir).agg(F.lit("point").alias("layer"), one.alias("features"), one.alias("pieces"), F.lit(0.0).alias("total"))
    pieces = F.sum(F.size("coords") - 1)
    b = ft.line_length(lines).agg(F.lit("line").alias("layer"), one.alias("features"), pieces.alias("pieces"), F.round(F.sum("km"), 3).alias("total"))
    c = ft.ring_area(rings).agg(F.lit("polygon").alias("layer"), one.alias("features"), pieces.alias("pieces"), F.round(F.sum("km2"), 3).alias("total"))
    return a.union(b).union(c)


# --- projections, features and predicates ------------------------------------------------------

LONLAT = "SELECT id, ((id % 359) - 179) * 1e0 AS lon, ((id % 169) - 84) * 1e0 AS lat FROM points"


@query("reproject", f"WITH {POINTS}, p AS ({LONLAT}) SELECT id, round({geo.mercator_x('lon')}, 3) + 0e0 AS mx, round({geo.mercator_y('lat')}, 3) + 0e0 AS my FROM p")
def reproject(spark, sf_dir):
    p = fx.points(spark, sf_dir).selectExpr("id", "((id % 359) - 179) * 1e0 AS lon", "((id % 169) - 84) * 1e0 AS lat")
    return p.selectExpr("id", f"round({geo.mercator_x('lon')}, 3) + 0e0 AS mx", f"round({geo.mercator_y('lat')}, 3) + 0e0 AS my")


@query("dataset_level", f"WITH {POINTS} SELECT CAST(ceil(log2({geo.num(2 * geo.L)} / span)) AS INT) AS data_level, CAST(ceil(log2({geo.num(2 * geo.L)} / span)) AS INT) + 9 AS switch_level FROM (SELECT greatest(max(x) - min(x), max(y) - min(y)) AS span FROM points)")
def dataset_level(spark, sf_dir):
    span = fx.points(spark, sf_dir).agg(F.expr("greatest(max(x) - min(x), max(y) - min(y))").alias("span"))
    level = F.expr(f"CAST(least(22, greatest(0, ceil(log2({geo.num(2 * geo.L)} / span)))) AS INT)")
    return span.select(level.alias("data_level"), (level + 9).alias("switch_level"))


@query("field_minmax", f"WITH {POINTS} SELECT min(qty) AS lo, max(qty) AS hi FROM points")
def field_minmax(spark, sf_dir):
    return fx.points(spark, sf_dir).agg(F.min("qty").alias("lo"), F.max("qty").alias("hi"))


@query("bin_continuous", f"WITH {POINTS}, b AS (SELECT (qty - mn) // seg AS k, seg FROM (SELECT qty, mn, (mx - mn) // 10 + 1 AS seg FROM points, (SELECT min(qty) AS mn, max(qty) AS mx FROM points))) SELECT (k * seg) || '~' || ((k + 1) * seg) AS bin, count(*) AS m FROM b GROUP BY ALL")
def bin_continuous(spark, sf_dir):
    return stats.with_bins(fx.points(spark, sf_dir), "qty").groupBy(F.col("qty_bin").alias("bin")).agg(F.count("*").alias("m"))


@query("feature_mbb", f"WITH {VERTICES} SELECT id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM lv WHERE nv > 1 GROUP BY id")
def feature_mbb(spark, sf_dir):
    return ft.with_mbb(fx.lines(spark, sf_dir)).select("id", "xmin", "ymin", "xmax", "ymax")


@query("line_length", f"WITH {SEGMENTS} SELECT id, round(sum({geo.length_km()}), 6) AS km FROM segs GROUP BY id")
def line_length(spark, sf_dir):
    return ft.line_length(fx.lines(spark, sf_dir)).select("id", F.round("km", 6).alias("km"))


@query("ring_area", f"WITH {EDGES} SELECT id, round(abs(sum((x0 - fx) * (y1 - fy) - (x1 - fx) * (y0 - fy))) / 2e6, 6) AS km2 FROM edges JOIN (SELECT id, x AS fx, y AS fy FROM pv WHERE vertex = 0) USING (id) GROUP BY id")
def ring_area(spark, sf_dir):
    return ft.ring_area(fx.rings(spark, sf_dir)).select("id", F.round("km2", 6).alias("km2"))


@query("explode_segments", f"WITH {SEGMENTS} SELECT id, seg, x0, y0, x1, y1 FROM segs")
def explode_segments(spark, sf_dir):
    return layer(spark, sf_dir, "line").select("id", "seg", "x0", "y0", "x1", "y1")


@query("cell_assign", f"WITH {POINTS} SELECT id, {geo.col('x', 17)} AS col, {geo.row('y', 17)} AS row FROM points")
def cell_assign(spark, sf_dir):
    return fx.points(spark, sf_dir).selectExpr("id", f"{geo.col('x', 17)} AS col", f"{geo.row('y', 17)} AS row")


_tile = geo.tile_box(4, 9, 6)
_rz = geo.resolution(4)
_pixels = f"i AS pi, j AS pj, {geo.num(_tile[0])} + (j + 0.5e0) * {geo.num(_rz)} AS cx, {geo.num(_tile[3])} - (i + 0.5e0) * {geo.num(_rz)} AS cy"


@query("tile_bbox", f"SELECT CAST(i AS BIGINT) AS pi, CAST(j AS BIGINT) AS pj, {_pixels.split('pj, ')[1]} FROM range(256) a(i), range(256) b(j)")
def tile_bbox(spark, sf_dir):
    """Pixel centres of one tile."""
    return spark.range(65536).selectExpr("id div 256 AS i", "id % 256 AS j").selectExpr(*_pixels.split(", "))


query("point_in_box", f"WITH {POINTS} SELECT id, x, y FROM points WHERE x BETWEEN {fx.B2[0]!r}::DOUBLE AND {fx.B2[2]!r}::DOUBLE AND y BETWEEN {fx.B2[1]!r}::DOUBLE AND {fx.B2[3]!r}::DOUBLE")(lambda spark, sf_dir: fx.points(spark, sf_dir).where(geo.point_in_box("x", "y", fx.B2)).select("id", "x", "y"))
MBB = VERTICES + ", mbb AS (SELECT id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM lv WHERE nv > 1 GROUP BY id)"
query("mbb_within", f"WITH {MBB} SELECT id FROM mbb WHERE xmin >= -9e6 AND xmax <= 7e6 AND ymin >= -8e6 AND ymax <= 11e6")(lambda spark, sf_dir: ft.with_mbb(fx.lines(spark, sf_dir)).where(geo.mbb_within(fx.B1)).select("id"))
query("mbb_overlap", f"WITH {MBB} SELECT id FROM mbb WHERE xmin < 7e6 AND xmax > -9e6 AND ymin < 11e6 AND ymax > -8e6")(lambda spark, sf_dir: ft.with_mbb(fx.lines(spark, sf_dir)).where(geo.boxes_overlap(("xmin", "ymin", "xmax", "ymax"), fx.B1)).select("id"))
query("range_features", f"WITH {MBB} SELECT id FROM mbb WHERE xmin <= 7e6 AND xmax >= -9e6 AND ymin <= 11e6 AND ymax >= -8e6")(lambda spark, sf_dir: ft.in_range(fx.lines(spark, sf_dir), fx.B1).select("id"))
_clip = geo.clip_share(*map(geo.num, fx.B1))
query("segment_box", f"WITH {SEGMENTS} SELECT id, seg, round({_clip}, 9) AS share FROM segs WHERE {_clip} > 0e0")(lambda spark, sf_dir: layer(spark, sf_dir, "line").withColumn("share", F.expr(_clip)).where("share > 0").select("id", "seg", F.round("share", 9).alias("share")))
query("point_in_polygon", f"WITH {EDGES} SELECT id FROM edges GROUP BY id HAVING sum({geo.crossing('-10081000e0', '-11849000e0')}) % 2 = 1")(lambda spark, sf_dir: ft.inside_ring(fx.rings(spark, sf_dir), -10081000.0, -11849000.0).select("id"))
query("geom_to_wkt", f"WITH {VERTICES} SELECT id, 'LINESTRING(' || string_agg(printf('%.2f', x) || ' ' || printf('%.2f', y), ',' ORDER BY vertex) || ')' AS wkt FROM lv WHERE nv > 1 GROUP BY id")(lambda spark, sf_dir: ft.wkt(fx.lines(spark, sf_dir), "line").select("id", "wkt"))


@query("geom_helpers", f"""WITH {EDGES} SELECT id, round(sum((x0 - fx) * (y1 - fy) - (x1 - fx) * (y0 - fy)) / 2e0, 1) AS signed_area, sum((x0 - fx) * (y1 - fy) - (x1 - fx) * (y0 - fy)) < 0 AS is_outer,
  round(min({ft.distance_to_point(0, 0)}), 3) AS distance, bool_or({ft.touches_point(0, 0)}) AS touches
  FROM edges JOIN (SELECT id, x AS fx, y AS fy FROM pv WHERE vertex = 0) USING (id) GROUP BY id""")
def geom_helpers(spark, sf_dir):
    """Signed area, outer ring (clockwise), distance to and contact with the origin, for each ring."""
    rings = fx.rings(spark, sf_dir).withColumn("a", F.expr(ft.signed_area()))
    s = ft.explode_segments(rings.select("id", "a", "coords"))
    return s.groupBy("id", "a").agg(F.round(F.min(F.expr(ft.distance_to_point(0, 0))), 3).alias("distance"), F.bool_or(F.expr(ft.touches_point(0, 0))).alias("touches")).select("id", F.round("a", 1).alias("signed_area"), (F.col("a") < 0).alias("is_outer"), "distance", "touches")


_c = geo.cell_box("col", "row", 4)
_overlap = f"greatest(0e0, least({_c[2]}, 7e6) - greatest({_c[0]}, -9e6)) * greatest(0e0, least({_c[3]}, 11e6) - greatest({_c[1]}, -8e6)) / 1e6"


@query("rect_overlap_area", f"SELECT CAST(i AS BIGINT) AS col, CAST(j AS BIGINT) AS row, round({_overlap.replace('(col)', '(i)').replace('((col', '((i').replace('(row)', '(j)').replace('((row', '((j')}, 3) AS km2 FROM range(16) a(i), range(16) b(j)")
def rect_overlap_area(spark, sf_dir):
    grid = spark.range(256).selectExpr("id div 16 AS col", "id % 16 AS row")
    return grid.selectExpr("col", "row", f"round({_overlap}, 3) AS km2")


@query("min_cover_cell", f"""WITH k AS (SELECT CAST(k AS INT) AS level, floor((1000000 + {geo.L!r}::DOUBLE) * 2 ** k / {2 * geo.L!r}::DOUBLE) AS a, floor((1500000 + {geo.L!r}::DOUBLE) * 2 ** k / {2 * geo.L!r}::DOUBLE) AS b,
  floor(({geo.L!r}::DOUBLE - 2600000) * 2 ** k / {2 * geo.L!r}::DOUBLE) AS c, floor(({geo.L!r}::DOUBLE - 2000000) * 2 ** k / {2 * geo.L!r}::DOUBLE) AS d FROM range(21) t(k))
SELECT level, CAST(a AS BIGINT) AS col, CAST(c AS BIGINT) AS row FROM k WHERE a = b AND c = d ORDER BY level DESC LIMIT 1""")
def min_cover_cell(spark, sf_dir):
    return spark.createDataFrame([cells.min_cover_cell(fx.B2, 20)], "level int, col long, row long")


# --- building, codes, many boxes, binary geometry -----------------------------------------------

_shoelace = "sum((x0 - fx) * (y1 - fy) - (x1 - fx) * (y0 - fy)) / 2e0"


@query("build_rings", f"WITH {EDGES} SELECT id, CAST(count(*) + 1 AS INT) AS n, -round(abs({_shoelace}), 1) AS area FROM edges JOIN (SELECT id, x AS fx, y AS fy FROM pv WHERE vertex = 0) USING (id) GROUP BY id")
def build_rings(spark, sf_dir):
    """Open vertices to closed clockwise rings, whichever way they came (every second ring is given backwards)."""
    v = fx.rings(spark, sf_dir).select("id", F.posexplode("coords").alias("k", "p")).where("k < 5")
    v = v.select("id", F.when(F.col("id") % 2 == 0, -F.col("k")).otherwise(F.col("k")).alias("k"), "p.x", "p.y")
    return ft.build_rings(v, "k").select("id", F.size("coords").alias("n"), F.round(F.expr(ft.signed_area()), 1).alias("area"))


@query("build_lines", f"WITH {VERTICES} SELECT id, etype, CAST(count(*) AS INT) AS n, round(sum(x * vertex), 2) AS x, round(sum(y * vertex), 2) AS y FROM lv WHERE nv > 1 GROUP BY ALL")
def build_lines(spark, sf_dir):
    v = fx.lines(spark, sf_dir).select("id", "etype", F.posexplode("coords").alias("k", "p")).select("id", "etype", "k", "p.x", "p.y")
    built = ft.build_lines(v, "k", ("etype",))
    moment = lambda c: F.round(F.expr(f"aggregate(sequence(0, size(coords) - 1), 0e0, (acc, i) -> acc + i * coords[i].{c})"), 2).alias(c)
    return built.select("id", "etype", F.size("coords").alias("n"), moment("x"), moment("y"))


@query("quad_code", f"WITH {POINTS}, c AS (SELECT DISTINCT {geo.col('x', 9)} AS col, {geo.row('y', 9)} AS row FROM points) SELECT col, row, " + " || ".join(f"CAST(((col >> {k}) & 1) + 2 * ((row >> {k}) & 1) AS VARCHAR)" for k in range(8, -1, -1)) + " AS code FROM c")
def quad_code(spark, sf_dir):
    cells_ = fx.points(spark, sf_dir).selectExpr(f"{geo.col('x', 9)} AS col", f"{geo.row('y', 9)} AS row").distinct()
    return cells_.selectExpr("col", "row", f"{ft.quad_code(9)} AS code")


_BOXES = "SELECT n_nationkey AS box, n_nationkey * 1400000 - 18000000.5e0 AS bx0, n_nationkey * 900000 - 12000000.5e0 AS by0, n_nationkey * 1400000 - 16000000.5e0 AS bx1, n_nationkey * 900000 - 9000000.5e0 AS by1 FROM nation"
_TOUCH = "x1 >= bx0 AND x0 <= bx1 AND y1 >= by0 AND y0 <= by1"


def _boxes(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("_nation")
    return spark.sql(_BOXES.replace("FROM nation", "FROM _nation"))


query("join_boxes_ln", f"WITH {SEGMENTS}, b AS ({_BOXES}), f AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lv WHERE nv > 1 GROUP BY id) SELECT box, id FROM b JOIN f ON {_TOUCH}")(lambda spark, sf_dir: ft.join_boxes(fx.lines(spark, sf_dir), _boxes(spark, sf_dir), 5))
query("join_boxes_pt", f"WITH {POINTS}, b AS ({_BOXES}) SELECT box, count(*) AS n FROM b JOIN points ON x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 GROUP BY box")(lambda spark, sf_dir: ft.join_boxes(fx.points(spark, sf_dir), _boxes(spark, sf_dir), 5).groupBy("box").agg(F.count("*").alias("n")))


@query("geom_wkb", f"WITH {VERTICES} SELECT id, 'linestring' AS kind, CAST(vertex AS INT) AS vertex, x, y FROM lv WHERE nv > 1")
def geom_wkb(spark, sf_dir):
    """Lines to well-known binary and back."""
    from quadrille.sources import wkb

    made = wkb.with_wkb(fx.lines(spark, sf_dir).select("id", F.array("coords").alias("parts")), "linestring").select("id", "wkb")
    return wkb.from_wkb(made).select("id", "kind", F.posexplode(F.col("parts")[0]).alias("vertex", "p")).select("id", "kind", "vertex", "p.x", "p.y")


# --- pyramids ----------------------------------------------------------------------------------

def strip_sql(source: str, level: int, keep: str) -> str:
    """Cells that segments meet."""
    w, half = geo.num(geo.width(level)), geo.num(geo.L)
    at = lambda x, flat: f"CASE WHEN x0 = x1 THEN {flat} ELSE y0 + ({x} - x0) * ((y1 - y0) / (x1 - x0)) END"
    return f"""(SELECT {keep}, x0, y0, x1, y1, col, unnest(generate_series({geo.row('greatest(p, q)', level)}, {geo.row('least(p, q)', level)})) AS row FROM
 (SELECT *, {at('a', 'y0')} AS p, {at('b', 'y1')} AS q FROM (SELECT *, greatest(least(x0, x1), col * {w} - {half}) AS a, least(greatest(x0, x1), (col + 1) * {w} - {half}) AS b FROM
 (SELECT *, unnest(generate_series({geo.col('least(x0, x1)', level)}, {geo.col('greatest(x0, x1)', level)})) AS col FROM {source}))))"""


def rings_sql(level: int, where: str = "TRUE") -> str:
    """CTEs pc: (id, col, row, topo, m, status) of all rings."""
    w, half, box = geo.num(geo.width(level)), geo.num(geo.L), geo.cell_box("col", "row", level)
    centre = f"({half} - (row + 0.5e0) * {w})"
    return f"""em AS (SELECT * FROM edges WHERE {where}),
bc AS (SELECT DISTINCT id, col, row FROM {strip_sql('em', level, 'id')}),
ba AS (SELECT id, col, row, 'i' AS topo, abs(sum({geo.edge_area(*box)})) / 1e6 AS m, any_value(status) AS status FROM bc JOIN em USING (id) GROUP BY id, col, row),
sl AS (SELECT id, row, x0 + ({centre} - y0) * ((x1 - x0) / (y1 - y0)) AS cx FROM (SELECT *, unnest(generate_series({geo.row('greatest(y0, y1)', level)}, {geo.row('least(y0, y1)', level)})) AS row FROM em) WHERE (y0 <= {centre} AND y1 > {centre}) OR (y0 > {centre} AND y1 <= {centre})),
sn AS (SELECT id, row, cx, row_number() OVER w AS k, lead(cx) OVER w AS nx FROM sl WINDOW w AS (PARTITION BY id, row ORDER BY cx)),
ic AS (SELECT id, row, unnest(generate_series(CAST(ceil((cx + {half}) / {w} - 0.5e0) AS BIGINT), CAST(floor((nx + {half}) / {w} - 0.5e0) AS BIGINT))) AS col FROM sn WHERE k % 2 = 1),
pc AS (SELECT * FROM ba UNION ALL SELECT id, col, row, 'w', {geo.num(geo.width(level) * geo.width(level) / 1e6)}, status FROM ic JOIN (SELECT DISTINCT id, status FROM em) USING (id) WHERE (id, col, row) NOT IN (SELECT (id, col, row) FROM bc))"""


_point_levels = " UNION ALL ".join(f"SELECT {k} AS level, {geo.col('x', k)} AS col, {geo.row('y', k)} AS row, flag AS item, count(*) AS m FROM points WHERE {geo.in_world('x', 'y')} GROUP BY ALL" for k in range(8, 3, -1))


@query("point_pyramid", f"WITH {POINTS} {_point_levels}")
def point_pyramid(spark, sf_dir):
    base = cells.point_cells(fx.points(spark, sf_dir).withColumnRenamed("flag", "item"), 8, ["item"])
    return cells.pyramid(base, 8, 4, ["item"]).select("level", "col", "row", "item", "m")


_box9 = geo.cell_box("col", "row", 9)
_line_base = f"lc AS (SELECT col, row, etype AS item, sum({geo.length_km()} * {geo.clip_share(*_box9)}) AS m FROM {strip_sql('segs', 9, 'etype')} GROUP BY ALL)"
_line_levels = " UNION ALL ".join(f"SELECT {9 - k} AS level, col >> {k} AS col, row >> {k} AS row, item, round(sum(m), 3) AS m FROM lc GROUP BY ALL" for k in range(4))


@query("line_pyramid", f"WITH {SEGMENTS}, {_line_base} {_line_levels}")
def line_pyramid(spark, sf_dir):
    base = cells.line_cells(layer(spark, sf_dir, "line").withColumnRenamed("etype", "item"), 9, ["item"])
    return cells.pyramid(base, 9, 6, ["item"]).select("level", "col", "row", "item", F.round("m", 3).alias("m"))


_ring_levels = " UNION ALL ".join(f"SELECT {11 - k} AS level, col >> {k} AS col, row >> {k} AS row, item, round(sum(m), 3) AS m FROM pp GROUP BY ALL" for k in range(4))


@query("polygon_pyramid", f"WITH {EDGES}, {rings_sql(11)}, pp AS (SELECT col, row, status AS item, sum(m) AS m FROM pc GROUP BY ALL) {_ring_levels}")
def polygon_pyramid(spark, sf_dir):
    rings = cells.ring_cells(layer(spark, sf_dir, "polygon"), 11, ["status"])
    base = rings.groupBy("col", "row", F.col("status").alias("item")).agg(F.sum("m").alias("m"))
    return cells.pyramid(base, 11, 8, ["item"]).select("level", "col", "row", "item", F.round("m", 3).alias("m"))


Z, X, Y = 2, 1, 1


def tile_cells(spark, sf_dir, geometry: str, z: int = Z, x: int = X, y: int = Y, margin: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """(cells with item, m, topo; child masks) around a tile: features are cut to its surroundings before any cell is made."""
    level, w = z + 8, geo.width(z + 8) * margin
    box = geo.tile_box(z, x, y)
    box = box[0] - w, box[1] - w, box[2] + w, box[3] + w
    f = layer(spark, sf_dir, geometry)
    if geometry == "point":
        got = cells.point_cells(f.where(geo.point_in_box("x", "y", box)).withColumnRenamed("flag", "item"), level, ["item"])
        return got, None
    if geometry == "line":
        near = f.where(f"least(x0, x1) <= {geo.num(box[2])} AND greatest(x0, x1) >= {geo.num(box[0])} AND least(y0, y1) <= {geo.num(box[3])} AND greatest(y0, y1) >= {geo.num(box[1])}")
        children = cells.segment_cells(near, level + 1).select("col", "row").distinct()
        return cells.line_cells(near.withColumnRenamed("etype", "item"), level, ["item"]), cells.children_mask(children)
    rings = ft.with_mbb(fx.rings(spark, sf_dir).select("id", "coords", "status")).where(geo.mbb_touches(box)).select("id", "coords", "status")
    edges = ft.explode_segments(rings)
    got = cells.ring_cells(edges, level, ["status"]).groupBy("col", "row", F.col("status").alias("item")).agg(F.sum("m").alias("m"), F.min("topo").alias("topo"))
    children = cells.boundary_cells(edges, level + 1).select("col", "row").distinct()
    return got, cells.children_mask(children)


def cells_sql(geometry: str, level: int) -> str:
    """CTEs ci (col, row, item, m, topo) and mk (col, row, mask)."""
    bit = "CASE WHEN col % 2 = 0 THEN CASE WHEN row % 2 = 0 THEN 1 ELSE 4 END ELSE CASE WHEN row % 2 = 0 THEN 2 ELSE 8 END END"
    masks = lambda source: f"mk AS (SELECT col >> 1 AS col, row >> 1 AS row, bit_or({bit}) AS mask FROM (SELECT DISTINCT col, row FROM {source}) GROUP BY ALL)"
    if geometry == "point":
        return f"{POINTS}, ci AS (SELECT {geo.col('x', level)} AS col, {geo.row('y', level)} AS row, flag AS item, count(*) AS m, 'i' AS topo FROM points WHERE {geo.in_world('x', 'y')} GROUP BY ALL), mk AS (SELECT DISTINCT col, row, 0 AS mask FROM ci)"
    if geometry == "line":
        box = geo.cell_box("col", "row", level)
        return f"{SEGMENTS}, ci AS (SELECT col, row, etype AS item, sum({geo.length_km()} * {geo.clip_share(*box)}) AS m, 'i' AS topo FROM {strip_sql('segs', level, 'etype')} GROUP BY ALL), " + masks(strip_sql("segs", level + 1, "id"))
    return f"{EDGES}, {rings_sql(level)}, ci AS (SELECT col, row, status AS item, sum(m) AS m, min(topo) AS topo FROM pc GROUP BY ALL), " + masks(strip_sql("edges", level + 1, "id"))


def tile_sql(geometry: str, style: st.Style, z: int, x: int, y: int, box=None) -> str:
    if style.kind == "single":
        k = "0"
    elif style.kind == "classified":
        k = "CASE " + " ".join(f"WHEN item = '{i}' THEN {n}" for n, i in enumerate(style.items)) + " END"
    else:
        k = "CASE " + " ".join(f"WHEN item {'<>' if r.op == '!=' else '='} '{r.value}' THEN {n}" for n, r in reversed(list(enumerate(style.rules)))) + " END"
    near = "TRUE" if box is None else geo.boxes_overlap(geo.cell_box("col", "row", z + 8), box)
    rows = ", ".join(map(str, raster.stencil([p.width for p in style.paints], geometry))) or "(-1, -1, 0, 0, 0, 0)"
    pick = "min(k)" if style.kind == "single" else "arg_min(k, (-m, item)) FILTER (k IS NOT NULL)"
    split = geometry == "polygon" and style.kind == "single"
    paints = [*style.paints, *([style.fill] if split else [])]
    shade = lambda n: "CASE k " + " ".join(f"WHEN {i} THEN {(p.r, p.g, p.b)[n]}" for i, p in enumerate(paints)) + " END"
    alpha = "CASE " + " ".join(f"WHEN k = {i} AND cov = 9 THEN {raster.alpha_own(p)} " + " ".join(f"WHEN k = {i} AND cov = {c} THEN {raster.alpha_covered(p, c)}" for c in (1, 2, 3, 4)) for i, p in enumerate(paints)) + " END"
    fill = f"SELECT coalesce(b.col, f.col) AS col, coalesce(b.row, f.row) AS row, CASE WHEN f.col IS NOT NULL AND (b.cov IS NULL OR b.cov = 1) THEN {len(style.paints)} ELSE b.k END AS k, coalesce(b.cov, 9) AS cov FROM best b FULL JOIN (SELECT col, row FROM own WHERE topo = 'w') f ON b.col = f.col AND b.row = f.row" if split else "SELECT col, row, k, cov FROM best"
    return f"""WITH {cells_sql(geometry, z + 8)},
ck AS (SELECT *, {k} AS k FROM ci WHERE {near}),
own AS (SELECT col, row, {pick} AS k, min(topo) AS topo FROM ck GROUP BY col, row),
sten(k, mask, m, n, cov, ord) AS (VALUES {rows}),
hits AS (SELECT col, row, k, 9 AS cov, 0 AS ord FROM own WHERE k IS NOT NULL {"AND topo = 'i'" if split else ""}
  UNION ALL SELECT o.col - s.m, o.row + s.n, o.k, s.cov, s.ord FROM own o JOIN mk USING (col, row) JOIN sten s ON s.k = o.k AND s.mask = mk.mask WHERE o.topo = 'i'),
best AS (SELECT col, row, arg_max(k, (cov, -ord)) AS k, max(cov) AS cov FROM hits GROUP BY col, row),
done AS ({fill})
SELECT CAST(row - {256 * y} AS INT) AS pi, CAST(col - {256 * x} AS INT) AS pj, {shade(0)} AS r, {shade(1)} AS g, {shade(2)} AS b, {alpha} AS a FROM done
WHERE col BETWEEN {256 * x} AND {256 * x + 255} AND row BETWEEN {256 * y} AND {256 * y + 255} AND {alpha} > 0"""


STYLES = {}
for _g, _items in ITEMS.items():
    _paints = (st.Paint(255, 0, 0, 1.0, 2.0), st.Paint(0, 0, 255, 0.5, 1.0))
    STYLES[_g] = {
        "single": st.Style("single", paints=(st.Paint(255, 0, 0, 0.5, 2.0),), fill=st.Paint(0, 255, 0, 0.25)),
        "class": st.Style("classified", FIELD[_g], _paints, items=tuple(_items[:2])),
        "rule": st.Style("ruled", FIELD[_g], _paints, rules=(st.Rule("=", _items[0]), st.Rule("!=", _items[1]))),
    }

# a box that cuts the tile
_T = geo.tile_box(Z, X, Y)
CUT = (_T[0] + 3000000.0, _T[1] + 2000000.0, _T[2] - 2500000.0, _T[3] - 1000000.0)


def _tile_query(geometry: str, style: st.Style, box):
    def run(spark, sf_dir):
        got, masks = tile_cells(spark, sf_dir, geometry)
        return raster.render(got, style, geometry, Z, X, Y, box, masks)

    return run


for _g in ITEMS:
    for _kind, _style in STYLES[_g].items():
        for _range, _box in (("", None), ("_range", CUT)):
            query(f"tile_{_kind}{_range}_{SHORT[_g]}", tile_sql(_g, _style, Z, X, Y, _box))(_tile_query(_g, _style, _box))


@query("tile_cells", f"WITH {cells_sql('point', 10)} SELECT col, row, sum(m)::BIGINT AS m FROM ci WHERE col BETWEEN 256 AND 511 AND row BETWEEN 256 AND 511 GROUP BY ALL")
def tile_cells_query(spark, sf_dir):
    """The cells that are the pixels of a tile."""
    base = cells.point_cells(fx.points(spark, sf_dir), Z + 8, [])
    return raster.window(base, Z, X, Y, 0).select("col", "row", "m")


@query("pixel_majority", f"WITH {cells_sql('point', 8)} SELECT col, row, arg_min(item, (-m, item)) AS item FROM ci WHERE item IN ('A', 'N') GROUP BY ALL")
def pixel_majority(spark, sf_dir):
    got = cells.point_cells(fx.points(spark, sf_dir).withColumnRenamed("flag", "item"), 8, ["item"])
    style = STYLES["point"]["class"]
    return raster.classed(got, style).where("k is not null").select("col", "row", F.element_at(F.array(*map(F.lit, style.items)), F.col("k") + 1).alias("item"))


@query("pixel_rule", f"WITH {cells_sql('point', 8)} SELECT col, row, arg_min(CASE WHEN item <> 'N' THEN 1 WHEN item = 'A' THEN 0 END, (-m, item)) FILTER (item <> 'N' OR item = 'A') AS k FROM ci GROUP BY ALL HAVING k IS NOT NULL")
def pixel_rule(spark, sf_dir):
    got = cells.point_cells(fx.points(spark, sf_dir).withColumnRenamed("flag", "item"), 8, ["item"])
    return raster.classed(got, STYLES["point"]["rule"]).where("k is not null").select("col", "row", "k")


# --- heat --------------------------------------------------------------------------------------

HEAT = st.Style("heat", gradient="Jet", radius=3, view=(0, 3, 0, 3))


def heat_sql(geometry: str, box=None) -> str:
    near = "TRUE" if box is None else geo.boxes_overlap(geo.cell_box("col", "row", Z + 8), box)
    kern = ", ".join(f"({m}, {n}, {geo.num(w)})" for m, n, w in raster.kernel(HEAT.radius))
    lut = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(st.gradient(HEAT.gradient)))
    alpha = "CAST(least(150 + (105 * v) // 255, 255) AS INT)" if geometry == "point" else "v"
    return f"""WITH {cells_sql(geometry, Z + 8)}, hc AS (SELECT col, row, sum(m) AS m FROM ci WHERE {near} GROUP BY ALL), tp AS (SELECT max(m) AS top FROM hc),
kn(m_, n_, w) AS (VALUES {kern}), lut(v, r, g, b) AS (VALUES {lut}),
sp AS (SELECT col - m_ AS col, row + n_ AS row, CASE WHEN top > 0 THEN CAST(floor(w * m / top) AS BIGINT) ELSE 0 END AS v FROM hc, tp, kn),
s AS (SELECT col, row, CAST(least(sum(v), 255) AS INT) AS v FROM sp WHERE col BETWEEN {256 * X} AND {256 * X + 255} AND row BETWEEN {256 * Y} AND {256 * Y + 255} AND {near} GROUP BY ALL)
SELECT CAST(row - {256 * Y} AS INT) AS pi, CAST(col - {256 * X} AS INT) AS pj, r, g, b, {alpha} AS a FROM s JOIN lut USING (v) WHERE v > 0"""


def _heat_query(geometry: str, box=None):
    def run(spark, sf_dir):
        if geometry == "point":
            got = cells.point_cells(fx.points(spark, sf_dir), Z + 8, [])
        else:
            got = cells.line_cells(layer(spark, sf_dir, "line"), Z + 8, [])
        return raster.heat(got, HEAT, geometry, Z, X, Y, box)

    return run


query("tile_heat_pt", heat_sql("point"))(_heat_query("point"))
query("tile_heat_range_pt", heat_sql("point", CUT))(_heat_query("point", CUT))
# line measures are fractions whose sums may differ in the last bit between engines: rounded before they are floored
query("tile_heat_ln", heat_sql("line").replace("sum(m) AS m FROM ci", "round(sum(m), 6) AS m FROM ci"))(lambda spark, sf_dir: raster.heat(cells.line_cells(layer(spark, sf_dir, "line"), Z + 8, []).withColumn("m", F.round("m", 6)), HEAT, "line", Z, X, Y))
query("heat_max", f"WITH {cells_sql('point', 10)} SELECT CAST(max(m) AS BIGINT) AS top FROM (SELECT sum(m) AS m FROM ci GROUP BY col, row)")(lambda spark, sf_dir: raster.largest(cells.point_cells(fx.points(spark, sf_dir), 10, []), Z, (0, 3, 0, 3)))
query("heat_max_range", f"WITH {cells_sql('point', 10)} SELECT CAST(max(m) AS BIGINT) AS top FROM (SELECT sum(m) AS m FROM ci WHERE {geo.boxes_overlap(geo.cell_box('col', 'row', 10), CUT)} GROUP BY col, row)")(lambda spark, sf_dir: raster.largest(cells.point_cells(fx.points(spark, sf_dir), 10, []), Z, (0, 3, 0, 3), CUT))


def gradient_sql() -> str:
    """All 256 entries by linear interpolation in SQL: a segment between two stops has its share of the entries, the last one the rest."""
    tables = {**st.GRADIENTS, "grey": st.GREY}
    stops = ", ".join(f"('{n}', {k}, {r}, {g}, {b})" for n, (colours, _) in tables.items() for k, (r, g, b) in enumerate(colours))
    shares = ", ".join(f"('{n}', {k}, {v!r}::DOUBLE)" for n, (_, parts) in tables.items() for k, v in enumerate(parts))
    shade = lambda c: f"CAST(trunc(a.{c} + (b.{c} - a.{c})::DOUBLE / (l.n - 1) * i) AS INT) & 255 AS {c}"
    return f"""WITH stop(name, k, r, g, b) AS (VALUES {stops}), share(name, k, v) AS (VALUES {shares}),
sized AS (SELECT name, k, CAST(floor(v * 256) AS INT) AS n, k = max(k) OVER (PARTITION BY name) AS ends FROM share),
l AS (SELECT name, k, CASE WHEN ends THEN 256 - (sum(n) OVER w - n) ELSE n END AS n, sum(n) OVER w - n AS start FROM sized WINDOW w AS (PARTITION BY name ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT name, CAST(l.start + i AS INT) AS v, {shade('r')}, {shade('g')}, {shade('b')}
FROM (SELECT *, unnest(generate_series(0, CAST(n AS INT) - 1)) AS i FROM l) l JOIN stop a USING (name, k) JOIN stop b ON b.name = l.name AND b.k = l.k + 1"""


query("gradient_lut", gradient_sql())(lambda spark, sf_dir: spark.createDataFrame([(g, k, *c) for g in (*st.GRADIENTS, "grey") for k, c in enumerate(st.gradient(g))], "name string, v int, r int, g int, b int"))

VZ, VX, VY = 6, 21, 20
_vt = geo.tile_box(VZ, VX, VY)
VCUT = (_vt[0] + 100000.0, _vt[1] + 50000.0, _vt[2] - 80000.0, _vt[3] - 120000.0)


def data_heat_sql(box=None) -> str:
    kern = ", ".join(f"({m}, {n}, {geo.num(w)})" for m, n, w in raster.kernel(3))
    near = "TRUE" if box is None else geo.point_in_box("x", "y", box)
    return f"""WITH {POINTS}, kn(m_, n_, w) AS (VALUES {kern}),
hp AS (SELECT CAST(floor(256e0 * (x - {geo.num(_vt[0])}) / {geo.num(_vt[2] - _vt[0])}) AS BIGINT) AS col, CAST(floor(256e0 - 256e0 * (y - {geo.num(_vt[1])}) / {geo.num(_vt[3] - _vt[1])}) AS BIGINT) AS row FROM points WHERE {geo.point_in_box('x', 'y', _vt)} AND {near}),
s AS (SELECT row + n_ AS pi, col + m_ AS pj, sum(CAST(floor(w / 1) AS BIGINT)) AS v FROM hp, kn GROUP BY ALL)
SELECT CAST(pi AS INT) AS pi, CAST(pj AS INT) AS pj, CAST(least(v, 255) AS INT) AS v FROM s WHERE v > 0 AND pi BETWEEN 0 AND 255 AND pj BETWEEN 0 AND 255"""


for _suffix, _box in (("", None), ("_range", VCUT)):
    query(f"vtile_heat{_suffix}_pt", data_heat_sql(_box))(lambda spark, sf_dir, b=_box: raster.data_heat(fx.points(spark, sf_dir), st.Style("heat", radius=3), spark.range(1).select(F.lit(1).alias("top")), VZ, VX, VY, b))

# a tile deep inside the pentagon of order 1: z so fine that the tile is one colour
_ip = geo.width(17)
IX, IY = int((7919000 - 18000000 + geo.L) // geo.width(14)), int((geo.L - (6151000 - 18000000)) // geo.width(14))
_near = tuple(v + d * geo.width(14) for v, d in zip(geo.tile_box(14, IX, IY), (-1, -1, 1, 1), strict=True))


@query("tile_interior_pg", f"""WITH {EDGES}, {rings_sql(14, f"id IN (SELECT id FROM edges GROUP BY id HAVING max(x0) >= {_near[0]!r}::DOUBLE AND min(x0) <= {_near[2]!r}::DOUBLE AND max(y0) >= {_near[1]!r}::DOUBLE AND min(y0) <= {_near[3]!r}::DOUBLE)")} SELECT topo, status, CAST(count(*) AS BIGINT) AS n FROM pc WHERE col = {IX} AND row = {IY} GROUP BY ALL""")
def tile_interior_pg(spark, sf_dir):
    """Rings whose interior or boundary holds the cell of a tile: interior ones fill it with one colour."""
    rings = ft.with_mbb(fx.rings(spark, sf_dir).select("id", "coords", "status")).where(geo.mbb_touches(_near)).select("id", "coords", "status")
    got = cells.ring_cells(ft.explode_segments(rings), 14, ["status"]).where((F.col("col") == IX) & (F.col("row") == IY))
    return got.groupBy("topo", "status").agg(F.count("*").alias("n"))


# --- the engine and its stored pyramids ---------------------------------------------------------

FIELDS = {"point": ("flag",), "line": ("etype",), "polygon": ("status",)}
FINEST = {"point": 10, "line": 11, "polygon": 11}
_engines: dict[tuple, object] = {}


def features_of(spark, sf_dir, geometry: str) -> DataFrame:
    if geometry == "polygon":
        return fx.rings(spark, sf_dir).select("id", "coords", "status")
    return fx.points(spark, sf_dir) if geometry == "point" else fx.lines(spark, sf_dir)


def engine(spark, sf_dir, geometry: str):
    """An engine with a stored pyramid of one layer, built once for a session and folder."""
    from quadrille.engine import Engine, Layer

    key = spark.sparkContext.applicationId, sf_dir, geometry
    if key not in _engines:
        e = Engine({geometry: Layer(features_of(spark, sf_dir, geometry), geometry)})
        e.build(geometry, _folder(spark), FINEST[geometry], 8, FIELDS[geometry])
        _engines[key] = e
    return _engines[key]


def _style_text(style: st.Style) -> str:
    paint = lambda p: f"{p.r},{p.g},{p.b},{p.alpha},{p.width}"
    if style.kind == "single":
        return f"single-{paint(style.paints[0])}" + (f",{style.fill.r},{style.fill.g},{style.fill.b},{style.fill.alpha}" if style.fill else "")
    if style.kind == "heat":
        return f"heat-{style.gradient}-{style.radius}-{','.join(map(str, style.view))}"
    rows = style.items if style.kind == "classified" else [r.op + r.value for r in style.rules]
    return f"{style.kind}-{style.field}-string-" + "-".join(f"{i},{paint(p)}" for i, p in zip(rows, style.paints, strict=True))


for _g, _n in NAMES.items():
    _whole = _g == "point"
    for _kind in ("single", "classified", "ruled"):
        if _whole and _kind == "ruled":
            continue  # its rules are over a field without cells
        _style = {"single": "single-1,1,1,1,1", "classified": f"classified-{FIELD[_g]}-string-" + "-".join(f"{i},1,1,1,1,1" for i in ITEMS[_g]), "ruled": f"ruled-{FIELD[_g]}-string-" + "-".join(f"{r.op}{r.value},1,1,1,1,1" for r in TEXT_RULES[_g])}[_kind]
        query(f"engine_{_n}_{_kind}", SQL[f"{_n}_{_kind}"])(lambda spark, sf_dir, g=_g, t=_style, w=_whole: (lambda out: out if w else out.withColumn("m", F.round("m", 3)))(engine(spark, sf_dir, g).range_stats(g, t, fx.B1)))
    for _kind in ("single", "class", "rule"):
        for _range, _box in (("", None), ("_range", CUT)):
            query(f"engine_tile_{_kind}{_range}_{SHORT[_g]}", SQL[f"tile_{_kind}{_range}_{SHORT[_g]}"])(lambda spark, sf_dir, g=_g, t=_style_text(STYLES[_g][_kind]), b=_box: engine(spark, sf_dir, g).tile(g, t, Z, X, Y, b))
query("engine_heat_pt", SQL["tile_heat_pt"])(lambda spark, sf_dir: engine(spark, sf_dir, "point").tile("point", _style_text(HEAT), Z, X, Y))
query("engine_text", SQL["stat_string"])(lambda spark, sf_dir: engine(spark, sf_dir, "point").text("point", "classified-flag-string-" + "-".join(f"{i},1,1,1,1,1" for i in ITEMS["point"]), fx.B1))

_AREAS = "SELECT id, any_value(status) AS status, abs(sum((x0 - fx) * (y1 - fy) - (x1 - fx) * (y0 - fy))) / 2e6 AS m FROM edges JOIN (SELECT id, x AS fx, y AS fy FROM pv WHERE vertex = 0) USING (id) GROUP BY id"
_LENGTHS = f"SELECT id, any_value(etype) AS etype, sum({geo.length_km()}) AS m FROM segs GROUP BY id"
for _g, _ctes, _sizes in (("line", SEGMENTS, _LENGTHS), ("polygon", EDGES, _AREAS)):
    query(f"field_items_{SHORT[_g]}", f"WITH {_ctes}, f AS ({_sizes}) SELECT {FIELD[_g]} AS item, round(sum(m), 3) AS m FROM f GROUP BY ALL")(lambda spark, sf_dir, g=_g: _plain_engine(spark, sf_dir, g).field_items(g, FIELD[g]).withColumn("m", F.round("m", 3)))
    _table, _fields = ("segs", "etype-string") if _g == "line" else ("edges", "status-string")
    query(f"engine_meta_{SHORT[_g]}", f"WITH {_ctes}, f AS ({_sizes}) SELECT '{_g}' AS kind, '3857' AS srs, (SELECT count(*) FROM f) AS n, min(least(x0, x1)) AS xmin, min(least(y0, y1)) AS ymin, max(greatest(x0, x1)) AS xmax, max(greatest(y0, y1)) AS ymax, (SELECT round(sum(m), 3) FROM f) AS total, '{_fields}' AS fields FROM {_table}")(lambda spark, sf_dir, g=_g: _plain_engine(spark, sf_dir, g).meta(g).withColumn("total", F.round("total", 3)))
query("engine_meta_pt", f"WITH {POINTS} SELECT 'point' AS kind, '3857' AS srs, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, count(*)::DOUBLE AS total, 'flag-string, status-string, qty-int' AS fields FROM points")(lambda spark, sf_dir: _plain_engine(spark, sf_dir, "point").meta("point"))


def _plain_engine(spark, sf_dir, geometry: str):
    from quadrille.engine import Engine, Layer

    return Engine({geometry: Layer(features_of(spark, sf_dir, geometry), geometry)})


# --- drawn tiles, files ------------------------------------------------------------------------


def vtile_sql(geometry: str, style: st.Style, z: int, x: int, y: int, box=None) -> str:
    """Drawn tiles by sets of samples: every sample within the radius of a mark or segment, or between two crossings of a ring."""
    x0, y0, x1, y1 = geo.tile_box(z, x, y)
    px, py = (lambda c: f"(({c} - {geo.num(x0)}) * {geo.num(256 / (x1 - x0))})"), (lambda c: f"(({geo.num(y1)} - {c}) * {geo.num(256 / (x1 - x0))})")
    item = FIELD[geometry]
    if style.kind == "single":
        k = "0"
    elif style.kind == "classified":
        k = "CASE " + " ".join(f"WHEN {item} = '{i}' THEN {n}" for n, i in enumerate(style.items)) + " END"
    else:
        k = "CASE " + " ".join(f"WHEN {item} {'<>' if r.op == '!=' else '='} '{r.value}' THEN {n}" for n, r in reversed(list(enumerate(style.rules)))) + " END"
    radius = "CASE k " + " ".join(f"WHEN {n} THEN {geo.num(p.width + 1 if geometry == 'point' else (p.width + 1) / 2)}" for n, p in enumerate(style.paints)) + " END"
    touch = f"max(greatest(x0, x1)) >= {geo.num(x0)} AND min(least(x0, x1)) <= {geo.num(x1)} AND max(greatest(y0, y1)) >= {geo.num(y0)} AND min(least(y0, y1)) <= {geo.num(y1)}"
    if geometry == "point":
        source = f"{POINTS}, f AS (SELECT id, {k} AS k, x AS x0, y AS y0, x AS x1, y AS y1 FROM points WHERE {geo.point_in_box('x', 'y', (x0, y0, x1, y1))})"
    else:
        table, ctes = ("segs", SEGMENTS) if geometry == "line" else ("edges", EDGES)
        source = f"{ctes}, f AS (SELECT id, {k} AS k, x0, y0, x1, y1 FROM {table} WHERE id IN (SELECT id FROM {table} GROUP BY id HAVING {touch}))"
    first, stop = (lambda v: f"CAST(trunc(least(greatest(({v}) * 4, 0e0), 1024e0)) AS INT)"), (lambda v: f"CAST(trunc(least(greatest(({v}) * 4, 0e0), 1024e0)) AS INT) - 1")
    t = "CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE least(greatest((((j + 0.5e0) / 4 - ax) * dx + ((i + 0.5e0) / 4 - ay) * dy) / (dx * dx + dy * dy), 0e0), 1e0) END"
    marks = f"""SELECT DISTINCT 2 * k + 1 AS layer, i, j FROM (SELECT *, (j + 0.5e0) / 4 - ax - {t} * dx AS u, (i + 0.5e0) / 4 - ay - {t} * dy AS v FROM
 (SELECT *, unnest(generate_series({first('least(ax, ex) - rd')}, {stop('greatest(ax, ex) + rd + 1')})) AS j FROM
 (SELECT *, ex - ax AS dx, ey - ay AS dy, unnest(generate_series({first('least(ay, ey) - rd')}, {stop('greatest(ay, ey) + rd + 1')})) AS i FROM s))) WHERE u * u + v * v <= rd * rd"""
    fill = f"""SELECT DISTINCT 2 * k AS layer, i, j FROM (SELECT k, i, a, b, unnest(generate_series(CAST(floor(least(greatest(a * 4 - 1, 0e0), 1024e0)) AS INT), CAST(least(ceil(least(b * 4 + 1, 1024e0)), 1023e0) AS INT))) AS j FROM
 (SELECT k, i, c AS a, lead(c) OVER w AS b, row_number() OVER w AS n FROM (SELECT id, k, i, ax + ((i + 0.5e0) / 4 - ay) * (ex - ax) / (ey - ay) AS c FROM
  (SELECT *, unnest(generate_series({first('least(ay, ey)')}, {stop('greatest(ay, ey) + 1')})) AS i FROM s) WHERE (ay <= (i + 0.5e0) / 4) <> (ey <= (i + 0.5e0) / 4))
 WINDOW w AS (PARTITION BY id, i ORDER BY c)) WHERE n % 2 = 1) WHERE (j + 0.5e0) / 4 >= a AND (j + 0.5e0) / 4 < b"""
    drawn = marks if geometry != "polygon" else fill if style.kind != "single" else f"{fill} UNION ALL {marks}"
    fills = style.fill or style.paints[0]
    shades = [c for p in style.paints for c in ((fills if style.kind == "single" else p), p)]
    pick = lambda f: "CASE layer " + " ".join(f"WHEN {n} THEN {f(p)}" for n, p in enumerate(shades)) + " END"
    rz = geo.num(geo.resolution(z))
    pixel = f"({geo.num(x0)} + pj * {rz})", f"({geo.num(y1)} - (pi + 1) * {rz})", f"({geo.num(x0)} + (pj + 1) * {rz})", f"({geo.num(y1)} - pi * {rz})"
    where = "TRUE" if box is None else geo.boxes_overlap(pixel, box)
    alpha = f"CAST(floor({pick(lambda p: geo.num(p.alpha * 255.0))} * n / 16) AS INT)"
    return f"""WITH {source},
s AS (SELECT id, k, {px('x0')} AS ax, {py('y0')} AS ay, {px('x1')} AS ex, {py('y1')} AS ey, {radius} AS rd FROM f WHERE k IS NOT NULL),
d AS ({drawn}),
c AS (SELECT layer, i // 4 AS pi, j // 4 AS pj, count(*) AS n FROM d GROUP BY ALL),
top AS (SELECT pi, pj, arg_max(n, layer) AS n, max(layer) AS layer FROM c GROUP BY ALL)
SELECT CAST(pi AS INT) AS pi, CAST(pj AS INT) AS pj, {pick(lambda p: p.r)} AS r, {pick(lambda p: p.g)} AS g, {pick(lambda p: p.b)} AS b, {alpha} AS a FROM top WHERE {where} AND {alpha} > 0"""


VSTYLE = {g: {"single": s["single"], "class": s["class"], "rule": s["rule"]} for g, s in STYLES.items()}


def _draw_query(geometry: str, style: st.Style, box):
    def run(spark, sf_dir):
        from quadrille.operators import vector

        if geometry == "point":
            return vector.draw(fx.points(spark, sf_dir).withColumn("item", F.col("flag")), style, geometry, VZ, VX, VY, box)
        f = fx.lines(spark, sf_dir).withColumnRenamed("etype", "item") if geometry == "line" else fx.rings(spark, sf_dir).select("id", "coords", F.col("status").alias("item"))
        return vector.draw(f, style, geometry, Z, X, Y, None if box is None else CUT)

    return run


for _g in ITEMS:
    for _kind, _style in VSTYLE[_g].items():
        for _range, _box in (("", None), ("_range", VCUT)):
            _at = (VZ, VX, VY) if _g == "point" else (Z, X, Y)
            query(f"vtile_{_kind}{_range}_{SHORT[_g]}", vtile_sql(_g, _style, *_at, _box if _g == "point" or _box is None else CUT))(_draw_query(_g, _style, _box))


def engine_heat_sql(top: str, box=None) -> str:
    """Data heat with a maximum and colours."""
    lut = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(st.gradient("Jet")))
    return f"""WITH h AS ({data_heat_sql(box).replace('floor(w / 1)', f'floor(w / ({top}))')}), lut(v, r, g, b) AS (VALUES {lut})
SELECT pi, pj, r, g, b, CAST(least(150 + (105 * v) // 255, 255) AS INT) AS a FROM h JOIN lut USING (v)"""


# the largest cell of level 9 in 5 x 5 tiles around the drawn one, halved five times: the layer's switch level is 1
_TOP = f"""SELECT greatest(1, floor(max(n) / 32)) FROM (SELECT count(*) AS n FROM points WHERE {geo.col('x', 9)} BETWEEN {(VX - 2) << 3} AND {((VX + 3) << 3) - 1} AND {geo.row('y', 9)} BETWEEN {(VY - 2) << 3} AND {((VY + 3) << 3) - 1} GROUP BY {geo.col('x', 9)}, {geo.row('y', 9)})"""
for _suffix, _box in (("", None), ("_range", VCUT)):
    query(f"engine_data_heat{_suffix}_pt", engine_heat_sql(_TOP, _box))(lambda spark, sf_dir, b=_box: _dense_engine(spark, sf_dir).tile("point", f"heat-Jet-3-{VX - 2},{VX + 2},{VY - 2},{VY + 2}", VZ, VX, VY, b))


def _dense_engine(spark, sf_dir):
    """Points drawn as data from zoom 2 on."""
    from quadrille.engine import Engine, Layer

    return Engine({"point": Layer(fx.points(spark, sf_dir), "point", 1)})


@query("tile_png", f"""WITH t AS ({SQL['tile_single_pt']}) SELECT sha256(string_agg(CASE WHEN a IS NULL THEN '00000000' ELSE printf('%02x%02x%02x%02x', r, g, b, a) END, '' ORDER BY i, j)) AS pixels_sha256, CAST(count(a) AS BIGINT) AS n
FROM range(256) x(i), range(256) y(j) LEFT JOIN t ON t.pi = i AND t.pj = j""")
def tile_png(spark, sf_dir):
    """The pixels that the PNG of a tile holds once decoded (hexadecimal, row by row), as a digest."""
    import hashlib

    from quadrille.sources import png

    @F.udf("struct<pixels_sha256:string,n:long>")
    def read(data):
        raw = png.decode(bytes(data))
        return hashlib.sha256(raw.hex().encode()).hexdigest(), sum(a > 0 for a in raw[3::4])

    return png.tiles(QUERIES["tile_single_pt"](spark, sf_dir)).select(read("png").alias("x")).select("x.*")


def _folder(spark) -> str:
    """A new folder where all executors see it: in spark.checkpoint.dir, in local mode under the warehouse if that is unset."""
    import re
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/catalog-{uuid.uuid4().hex}"


@query("pyramid_persist", f"WITH {POINTS} {_point_levels}")
def pyramid_persist(spark, sf_dir):
    path = _folder(spark)
    base = cells.point_cells(fx.points(spark, sf_dir).withColumnRenamed("flag", "item"), 8, ["item"])
    cells.persist(cells.pyramid(base, 8, 4, ["item"]), path)
    return spark.read.parquet(path).select("level", "col", "row", "item", "m")


@query("scan_csv", f"WITH {POINTS} SELECT id, x, y, flag FROM points")
def scan_csv(spark, sf_dir):
    from quadrille.sources import shapefile

    path = _folder(spark) + ".csv"
    fx.points(spark, sf_dir).select("id", "x", "y", "flag").write.csv(path, header=True)
    return shapefile.read_csv(spark, path, "x", "y", "3857", "id long, x double, y double, flag string").select("id", "x", "y", "flag")


SHAPE_SQL = f"""WITH {VERTICES} SELECT id, 'linestring' AS kind, etype, CAST(vertex AS INT) AS vertex, x, y FROM lv WHERE nv > 1"""


def _as_shapes(spark, sf_dir) -> str:
    """A folder of shapefiles with all lines, one for each task that wrote."""
    from quadrille.sources import shapefile

    path = _folder(spark)
    spark.dataSource.register(shapefile.Shapefile)
    rows = fx.lines(spark, sf_dir).select("id", F.lit("linestring").alias("kind"), F.array("coords").alias("parts"), F.create_map(F.lit("line"), F.col("id").cast("string"), F.lit("etype"), F.col("etype")).alias("attrs"))
    rows.write.format("quadrille-shp").option("kind", "linestring").option("fields", "line:20,etype:20").mode("append").save(path)
    return path


def _vertices(shapes: DataFrame, line, etype) -> DataFrame:
    return shapes.select(line.cast("long").alias("id"), "kind", etype.alias("etype"), F.posexplode(F.col("parts")[0]).alias("vertex", "p")).select("id", "kind", "etype", "vertex", "p.x", "p.y")


@query("scan_shapefile", SHAPE_SQL)
def scan_shapefile(spark, sf_dir):
    """All lines written by the sink and read by the data source."""
    path = _as_shapes(spark, sf_dir)
    return _vertices(spark.read.format("quadrille-shp").load(path), F.col("attrs")["line"], F.col("attrs")["etype"])


@query("scan_shapefile_bytes", SHAPE_SQL)
def scan_shapefile_bytes(spark, sf_dir):
    """The same through Spark's file reader."""
    from quadrille.sources import shapefile

    return _vertices(shapefile.read_files(spark, _as_shapes(spark, sf_dir)), F.col("line"), F.col("etype"))


@query("shapefile_extent", f"WITH {VERTICES} SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM lv WHERE nv > 1")
def shapefile_extent(spark, sf_dir):
    from quadrille.sources import shapefile

    got = shapefile.extents(spark, _as_shapes(spark, sf_dir))
    return got.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
