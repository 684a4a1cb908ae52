"""Queries against their SQL in DuckDB, and properties of the plans."""

import os
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import catalog, fixtures as fx
from quadrille.engine import Engine, Layer
from quadrille.functions import geo, style as st
from quadrille.operators import features as ft, raster
from quadrille.plans import cells, stats
from quadrille.sources import png, shapefile, wkb
from quadrille.streaming import live

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else float(v) if not isinstance(v, (str, bytes, list)) else v
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ["count_single", "count_classified", "count_ruled", "length_classified", "area_ruled", "rule_bins", "stat_string", "count_pyramid", "load_summary", "bin_continuous", "feature_mbb", "geom_to_wkt", "geom_helpers", "point_pyramid", "line_pyramid", "tile_single_range_pt", "tile_class_pt", "tile_rule_pt", "tile_heat_pt", "tile_interior_pg"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(c.sql(catalog.SQL[name]).df())


def test_interior_tile_sees_every_ring(spark):
    """Rings around the centre of the tile, by ray casting over all orders of sf0.1."""
    big = "/root/testdata/sf0.1"
    o = spark.read.parquet(f"{big}/orders.parquet").select("o_orderkey", "o_custkey").toPandas()
    x0, y0, x1, y1 = geo.tile_box(14, catalog.IX, catalog.IY)
    px, py, size = (x0 + x1) / 2, (y0 + y1) / 2, (o.o_custkey % 50 + 5) * 100.0
    cx, cy = (o.o_orderkey * 7919000) % 36000000 - 18000000 + 0.37, (o.o_orderkey * 6151000) % 36000000 - 18000000 + 0.61
    inside = np.zeros(len(o), bool)
    for (ax, ay), (bx, by) in zip(fx.PENTAGON, fx.PENTAGON[1:], strict=False):
        ax, ay, bx, by = cx + ax * size, cy + ay * size, cx + bx * size, cy + by * size
        inside ^= ((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay))
    got = catalog.QUERIES["tile_interior_pg"](spark, big).collect()
    assert inside.sum() > 1 and sum(r.n for r in got if r.topo == "w") <= inside.sum() <= sum(r.n for r in got)


def test_gradients_are_whole(spark):
    got = {(r.name, r.v): (r.r, r.g, r.b) for r in catalog.QUERIES["gradient_lut"](spark, SF).collect()}
    assert got == {(g, k): tuple(c) for g in (*st.GRADIENTS, "grey") for k, c in enumerate(st.gradient(g))} and len(got) == 256 * (len(st.GRADIENTS) + 1)
    c = duckdb.sql(catalog.SQL["gradient_lut"]).fetchall()
    assert c and all(got[n, v] == (r, g, b) for n, v, r, g, b in c)


def test_every_query_is_listed_once():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 80


def test_children_add_up(spark):
    p = cells.point_cells(fx.points(spark, SF), 8, [])
    got = cells.pyramid(p, 8, 5, []).groupBy("level").agg(F.sum("m")).collect()
    assert len({r[1] for r in got}) == 1


def test_equal_and_unequal_rules_add_up(spark):
    m = stats.measured(fx.points(spark, SF), "point", fx.B1)
    parts = {r.rule: r.m for r in stats.by_rule(m, "flag", [st.Rule("=", "A"), st.Rule("!=", "A")]).collect()}
    assert sum(parts.values()) == stats.total(m).first().m


def test_text_never_matches_an_order_rule(spark):
    df = spark.createDataFrame([("x",), ("12~20",), (None,)], "item string").withColumn("m", F.lit(1))
    assert stats.by_rule(df, "item", [st.Rule(">", "5")]).first().m == 1


def test_missing_field_gives_zeros(spark):
    m = stats.measured(fx.points(spark, SF), "point", fx.B1)
    assert [r.m for r in stats.by_class(m, "nothing", ["a", "b"]).collect()] == [0, 0]


def test_points_beyond_the_world_are_in_no_cell(spark):
    df = spark.createDataFrame([(1, 0.5, 3e7), (2, 0.5, 0.5)], "id long, x double, y double")
    assert cells.point_cells(df, 3, []).agg(F.sum("m")).first()[0] == 1


def test_hole_adds_or_subtracts(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    outer, hole = ring((0, 0), (0, 4000), (4000, 4000), (4000, 0), (0, 0)), ring((1000, 1000), (2000, 1000), (2000, 2000), (1000, 2000), (1000, 1000))
    df = spark.createDataFrame([(1, [[outer, hole]])], "id long, parts array<array<array<struct<x:double,y:double>>>>")
    rings = ft.parts_to_rings(df)
    assert ft.polygon_area(rings).first().km2 == 17 and ft.polygon_area(rings, "subtract").first().km2 == 15


def test_ring_area_over_cells_is_the_whole(spark):
    rings = fx.rings(spark, SF).where("id <= 40")
    edges = ft.explode_segments(rings.select("id", "coords", "status"))
    by_cell = cells.ring_cells(edges, 12, []).agg(F.sum("m")).first()[0]
    assert abs(by_cell - ft.ring_area(rings).agg(F.sum("km2")).first()[0]) < 1e-6


def test_a_ring_of_very_many_vertices(spark):
    """100,000 edges: work in proportion to edges and cells, whole area kept."""
    n, r = 100_000, 3_000_000.0
    ring = spark.range(1).selectExpr("id", f"transform(sequence(0, {n}), i -> named_struct('x', {r} * cos(2 * pi() * (i % {n}) / {n}) * (1 + 0.1D * sin(40 * pi() * i / {n})) + 5e5D, 'y', {r} * sin(2 * pi() * (i % {n}) / {n}))) AS coords")
    by_cell = cells.ring_cells(ft.explode_segments(ring), 9, [])
    got = by_cell.groupBy("topo").agg(F.sum("m").alias("m"), F.count("*").alias("n"), F.count_distinct("col", "row").alias("d")).collect()
    assert {x.topo for x in got} == {"i", "w"} and all(x.n == x.d for x in got)
    assert abs(sum(x.m for x in got) - ft.ring_area(ring).first().km2) < 1


@pytest.mark.parametrize("geometry", ["point", "line", "polygon"])
def test_stored_pyramid_answers_as_features_do(spark, tmp_path, geometry):
    f = catalog.features_of(spark, SF, geometry)
    field, items = catalog.FIELD[geometry], catalog.ITEMS[geometry]
    stored, plain = Engine({"a": Layer(f, geometry)}), Engine({"a": Layer(f, geometry)})
    stored.build("a", str(tmp_path / geometry), 11, 9, (field,))
    styles = ["single-255,0,0,0.5,2", f"classified-{field}-string-{items[0]},255,0,0,1,2-{items[1]},0,0,255,0.5,1", f"ruled-{field}-string-={items[0]},255,0,0,1,2-!={items[1]},0,0,255,0.5,1"]
    for style in styles:
        for box in (None, catalog.CUT):
            a, b = (e.tile("a", style, 1, 0, 1, box) for e in (stored, plain))
            assert a.exceptAll(b).count() == 0 and a.count() == b.count()
        for box in (fx.B1, fx.B2, (-3e7, -3e7, 3e7, 3e7)):
            a, b = ([tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in e.range_stats("a", style, box).collect()] for e in (stored, plain))
            assert sorted(a) == sorted(b)
        assert stored.text("a", style, fx.B1).first() == plain.text("a", style, fx.B1).first()
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    scan = stored.layers["a"].store.cells(spark, 10, field, (256, 511), (0, 255))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(level" in scan and "GreaterThanOrEqual(tx,1)" in scan and "EqualTo(field," in scan
    assert len(os.listdir(tmp_path / geometry / "level=11")) >= 1


def test_fine_levels_are_written_by_many_tasks(spark, tmp_path):
    base = cells.point_cells(fx.points(spark, SF), 10, [])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which makes one task of so few cells
    cells.persist(cells.pyramid(base, 10, 9, []), str(tmp_path / "p"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(tmp_path / "p" / "level=10") if f.endswith(".parquet")]) > 1


def test_heat_equals_brute_force(spark):
    df = spark.createDataFrame([(300, 300, 4), (302, 301, 2)], "col long, row long, m long")
    style = st.Style("heat", gradient="Jet", radius=3, view=(0, 3, 0, 3))
    got = {(r.pi, r.pj): r.a for r in raster.heat(df, style, "point", 2, 1, 1).collect()}
    want = np.zeros((256, 256), int)
    for c, r, m in [(300, 300, 4), (302, 301, 2)]:
        for a, b, w in raster.kernel(3):
            want[r - 256 + b, c - 256 + a] += int(w * m / 4)
    assert got == {(i, j): min(150 + 105 * min(v, 255) // 255, 255) for (i, j), v in np.ndenumerate(want) if v}


def test_style_grammar():
    s = st.parse_style("ruled-code-int-%3E=20,255,0,0,1,2-!=7,0,255,0,1,2")
    assert [(r.op, r.value) for r in s.rules] == [(">=", "20"), ("!=", "7")] and s.paints[0].width == 2
    assert st.parse_style("heat-Jet-5-10,15,20,25").view == (10, 15, 20, 25)
    assert st.parse_fields("a-s,b-i") == {"a": "classify", "b": "continuous"} and st.parse_fields("null") == {}
    assert all(len(st.gradient(g)) == 256 for g in (*st.GRADIENTS, "jet"))
    with pytest.raises(ValueError):
        st.parse_style("unknown-1")
    with pytest.raises(ValueError):
        st.check_input("a.shp", "point", "9999")


def test_png_round_trip(spark):
    pixels = spark.createDataFrame([(3, 5, 9, 8, 7, 255)], "pi int, pj int, r int, g int, b int, a int")
    raw = png.decode(bytes(png.tiles(pixels).first().png))
    at = 4 * (256 * 3 + 5)
    assert raw[at : at + 4] == bytes([9, 8, 7, 255]) and sum(raw) == 279
    assert sum(png.decode(bytes(png.tiles(pixels.limit(0)).first().png))) == 0


def test_shapefile_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.shp")
    shapefile.write(path, "linestring", [([[(0.0, 1.0), (2.0, 3.0)], [(4.0, 5.0), (6.0, 7.0)]], {"n": "x"}), ([[(1.0, 1.0), (2.0, 2.0)]], {"n": "yé"})], [("n", 10)])
    spark.dataSource.register(shapefile.Shapefile)
    got = spark.read.format("quadrille-shp").option("rowsPerPartition", 1).load(path).orderBy("id").collect()
    assert [len(r.parts) for r in got] == [2, 1] and [r.attrs["n"] for r in got] == ["x", "yé"] and got[0].parts[1][0].x == 4.0
    assert shapefile.parse_shape(struct.pack("<i", 0)) == ("null", [])


def test_shapefile_folder_types_and_ids(spark, tmp_path):
    for k in range(2):
        shapefile.write(str(tmp_path / f"f{k}.shp"), "point", [([[(k + 0.5 * i, 1.0)]], {"n": f"{k}{i}"}) for i in range(3)], [("n", 4)])
    data = bytearray((tmp_path / "f0.dbf").read_bytes())
    data[32 + 11 : 32 + 12], data[32 + 17] = b"N", 0
    (tmp_path / "f0.dbf").write_bytes(data)
    spark.dataSource.register(shapefile.Shapefile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("quadrille-shp").option("pushdown", "true").option("rowsPerPartition", 2).load(str(tmp_path))
        assert [r.id for r in load().orderBy("id").collect()] == list(range(6))
        assert [r.attrs["n"] for r in load().where("id > 1 AND id <= 3").orderBy("id").collect()] == ["02", "10"] and load().where("id = 9").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    got = shapefile.read_files(spark, str(tmp_path))
    assert dict(got.dtypes)["n"] == "bigint" and sorted(r.n for r in got.collect()) == [0, 1, 2, 10, 11, 12]
    e = shapefile.extents(spark, str(tmp_path)).orderBy("stem").first()
    assert (e.kind, e.n_bytes, e.xmin, e.xmax) == ("point", os.path.getsize(tmp_path / "f0.shp"), 0.0, 1.0)
    assert (tmp_path / "f0.prj").read_text().startswith("PROJCS") and (tmp_path / "f0.cpg").read_text() == "UTF-8"
    assert shapefile.typed("***", "N") is None and shapefile.typed("2.50", "N") == 2.5 and shapefile.typed("T", "L") is True and shapefile.typed("x", "n") is None


def test_well_known_binary(spark):
    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, 3.0)
    assert wkb.encode("linestring", [[(0.0, 1.0), (2.0, 3.0)]]) == line and wkb.decode(line) == ("linestring", [[(0.0, 1.0), (2.0, 3.0)]])
    rings = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]
    for kind in ("polygon", "multilinestring", "multipolygon"):
        assert wkb.decode(wkb.encode(kind, rings)) == (kind, rings)
    assert wkb.decode(wkb.encode("multipoint", [[(1.0, 2.0)], [(3.0, 4.0)]])) == ("multipoint", [[(1.0, 2.0)], [(3.0, 4.0)]])
    assert wkb.decode(struct.pack(">BI2d", 0, 1, 5.0, 6.0)) == ("point", [[(5.0, 6.0)]])
    assert wkb.decode(struct.pack("<BII3d", 1, 0xA0000001, 4326, 5.0, 6.0, 7.0)) == ("point", [[(5.0, 6.0)]])
    assert wkb.decode(struct.pack("<BI4d", 1, 3001, 5.0, 6.0, 7.0, 8.0)) == wkb.decode(struct.pack("<BI3d", 1, 2001, 5.0, 6.0, 7.0)) == ("point", [[(5.0, 6.0)]])
    df = spark.createDataFrame([(1, bytearray(line)), (2, None)], "id long, wkb binary")
    got = wkb.from_wkb(df).orderBy("id").collect()
    assert got[0].kind == "linestring" and got[0].parts[0][1].y == 3.0 and got[1].parts is None
    assert wkb.with_wkb(wkb.from_wkb(df), "linestring").where("id = 1").first().wkb == line


def test_table_of_a_database(spark, tmp_path):
    """Geometry bytes over JDBC, with the database that Spark brings along."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(k, bytearray(wkb.encode("point", [[(k * 1.0, 2.0)]]))) for k in range(5)], "id long, geom binary")
    try:
        df.write.jdbc(url, "shapes", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    except Exception as e:  # no such driver in this installation
        pytest.skip(str(e)[:80])
    got = wkb.read_table(spark, url, "shapes", "geom", driver="org.apache.derby.jdbc.EmbeddedDriver", partitionColumn="id", lowerBound=0, upperBound=5, numPartitions=2)
    assert sorted((r.id if "id" in got.columns else r.ID, r.parts[0][0].x) for r in got.collect()) == [(k, float(k)) for k in range(5)]


def test_quotes_in_a_rule(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), (None,)], "item string").withColumn("m", F.lit(1))
    got = {r.rule: r.m for r in stats.by_rule(df, "item", [st.Rule("=", "it's"), st.Rule("!=", "a\\b")]).collect()}
    assert got == {"=it's": 1, "!=a\\b": 1}


def test_built_rings_are_closed_and_wound(spark):
    v = [(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 4)])] + [(1, 1, k, float(x), float(y)) for k, (x, y) in enumerate([(1, 1), (1, 2), (2, 2), (1, 1)])]
    got = {r.ring: [(p.x, p.y) for p in r.coords] for r in ft.build_rings(spark.createDataFrame(v, "id long, ring int, k int, x double, y double"), "k", "ring").collect()}
    assert got[0] == [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)] and got[1] == [(1.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def test_stream_equals_batch(spark, tmp_path):
    p = fx.points(spark, SF)
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.append_to(live.cell_counts(stream, 6, ["flag"]), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = live.merged(spark, str(tmp_path / "out"))
    want = cells.point_cells(p, 6, ["flag"])
    assert got.select("col", "row", "flag", "m").exceptAll(want.select("col", "row", "flag", "m")).count() == 0 and got.count() == want.count()


def test_engine(spark):
    e = Engine({"p": Layer(fx.points(spark, SF), "point")})
    assert e.range_stats("p", "single-255,0,0,1,2", fx.B1).first().m == catalog.QUERIES["count_single"](spark, SF).first().m
    assert e.tile("p", "classified-flag-string-A,255,0,0,1,1", 2, 1, 1, (-3e7, -3e7, 3e7, 3e7)).count() > 0
    assert e.field_items("p", "nothing").count() == 0
    with pytest.raises(ValueError):
        e.tile("q", "single-1,1,1,1,1", 0, 0, 0)
    assert geo.data_level(2 * geo.L) == 0
