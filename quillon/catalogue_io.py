"""Registered queries of packages, containers, graphs, spatial layers and ingest: what is written is read back."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans import spatial
from quillon.plans.containers import Experiment, MultiAssay
from quillon.plans.graph import Graph
from quillon.plans.matrix import SparseMatrix
from quillon.sources import fields, files, packages, writer
from quillon.streaming import ingest


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- packages -------------------------------------------------------------------------------


def roundtrip_table(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "package")
    packages.write_tables({"supplier": table(spark, d, "supplier"), "nation": table(spark, d, "nation")}, path)
    return packages.read_package(spark, path)["supplier"].drop(writer.INDEX)


def _sales(spark: SparkSession, d: str) -> SparseMatrix:
    lines = table(spark, d, "lineitem")
    cells = files.dealt(lines.select("l_partkey", "l_suppkey", "l_quantity"), lines.count(), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return SparseMatrix.attach(cells, table(spark, d, "part").select("p_partkey", "p_brand"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "l_partkey", "l_suppkey", "q")


def _experiment(spark: SparkSession, d: str) -> Experiment:
    m = _sales(spark, d)
    return Experiment(m.features, m.samples, {"sales": m}, {"title": "sales", "nested": {"units": ["pieces"]}})


def roundtrip_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "package")
    packages.write_experiment(_experiment(spark, d), path, grid=(32, 512))
    e = packages.read_package(spark, path)
    f, s = (n.withColumn("name", F.col("name").cast("long")) for n in (e.feature_names(), e.sample_names()))
    return e.assays["sales"].cells.join(f.withColumnRenamed("name", "part"), "feature").join(s.withColumnRenamed("name", "supplier"), "sample").select("part", "supplier", "value")


def roundtrip_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    samples = rows.select(F.col("vec_id").alias("sample"), "label")
    e = Experiment(spark.range(1).select(F.col("id").alias("feature")), samples, embeddings={"vector": rows.select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("embedding"))})
    path = files.scratch(spark, "package")
    packages.write_experiment(e, path)
    back = packages.read_package(spark, path)
    out = back.embeddings["vector"].join(back.samples, "sample")
    return out.select(F.col("name").cast("long").alias("vec_id"), "label", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def roundtrip_multipart(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "parts")
    orders = table(spark, d, "orders")
    ingest.write_blocks([orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'none such'"), orders.where("o_orderstatus <> 'F'")], path, "orders", index_max=1 << 40)
    back = spark.read.parquet(path)
    last = back.agg(F.max(writer.INDEX).alias("rows"))
    return back.crossJoin(last).select("o_orderkey", "o_custkey", "o_orderstatus", "rows")


def roundtrip_partition_prune(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "grid")
    r = writer.write_array(_sales(spark, d).cells, path, ["sample", "feature"], grid=(16, 256), name="sales") | {"grid": {"sample": 16, "feature": 256}}
    return packages.read_array(spark, path.rsplit("/", 1)[0], r, {"sample": (1, 40)}).select("feature", "sample", "value")


def roundtrip_factor(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "package")
    customers = fields.categorical(table(spark, d, "customer"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], True)
    packages.write_tables({"customer": customers}, path)
    back = packages.read_package(spark, path)["customer"]
    levels = back.schema["c_mktsegment"].metadata["categories"]
    code = F.array_position(F.array(*map(F.lit, levels)), F.col("c_mktsegment"))
    return back.groupBy("c_mktsegment", code.alias("code")).agg(F.count("*").alias("n"))


def ingest_foreach_batch(spark: SparkSession, d: str) -> DataFrame:
    path, events = files.scratch(spark, "stream"), table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    ingest.ingest(stream, path, files.scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _curve_written(spark: SparkSession, d: str, curve: str) -> DataFrame:
    """Parts of different places on the curve, with the row numbers that they were written with."""
    path = files.scratch(spark, "curve")
    parts = table(spark, d, "part").groupBy("p_size", "p_retailprice").agg(F.min("p_partkey").alias("p_partkey"))
    writer.write_table(parts, path, cluster_by=curve, cluster_columns=["p_size", "p_retailprice"])
    return spark.read.parquet(path).select("p_partkey", F.col(writer.INDEX).alias("place"))


def zorder_written(spark: SparkSession, d: str) -> DataFrame:
    return _curve_written(spark, d, "zorder")


def hilbert_written(spark: SparkSession, d: str) -> DataFrame:
    return _curve_written(spark, d, "hilbert")


#: Both curves bit by bit: Hilbert's by the walk through the quadrants from the highest bit down.
_SCALED = """WITH RECURSIVE e AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part),
u AS (SELECT p_size, p_retailprice, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2),
s AS (SELECT p_partkey, CAST(floor((p_size - a) / (b - a) * 65535) AS BIGINT) AS x, CAST(floor((p_retailprice - c) / (d - c) * 65535) AS BIGINT) AS y FROM u, e)"""
_ZORDER = f"""{_SCALED}, z AS (SELECT p_partkey, CAST(sum(((x >> b) & 1) * (1::BIGINT << (2 * b + 1)) + ((y >> b) & 1) * (1::BIGINT << (2 * b))) AS BIGINT) AS code FROM s, range(16) AS t(b) GROUP BY 1)
SELECT p_partkey, row_number() OVER (ORDER BY code) AS place FROM z"""
_HILBERT = f"""{_SCALED}, h AS (SELECT p_partkey, x, y, 15 AS b, 0::BIGINT AS code FROM s UNION ALL
SELECT p_partkey, CASE WHEN (y >> b) & 1 = 1 THEN x & m WHEN (x >> b) & 1 = 1 THEN m - (y & m) ELSE y & m END,
  CASE WHEN (y >> b) & 1 = 1 THEN y & m WHEN (x >> b) & 1 = 1 THEN m - (x & m) ELSE x & m END,
  b - 1, code * 4 + CASE WHEN (x >> b) & 1 = 0 THEN (y >> b) & 1 WHEN (y >> b) & 1 = 1 THEN 2 ELSE 3 END
FROM (SELECT *, (1::BIGINT << b) - 1 AS m FROM h WHERE b >= 0))
SELECT p_partkey, row_number() OVER (ORDER BY code) AS place FROM h WHERE b = -1"""


def roundtrip_ranges(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "package")
    ranges = table(spark, d, "orders").select(F.col("o_orderpriority").alias("seqnames"), (F.col("o_orderkey") + 1).alias("start"), (F.col("o_orderkey") + 10).alias("end"), F.lit("+").alias("strand"), F.lit(10).alias("width"), "o_custkey")
    r = writer.write_ranges(ranges, path, "ranges")
    return packages.read_resource(spark, path.rsplit("/", 1)[0], r).drop(writer.INDEX)


def roundtrip_ranges_list(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "package")
    orders = table(spark, d, "orders").groupBy("o_custkey")
    grouped = orders.agg(F.collect_list("o_orderpriority").alias("seqnames"), F.collect_list("o_orderkey").alias("start"), F.collect_list(F.col("o_orderkey") + 9).alias("end"), F.collect_list(F.lit("*")).alias("strand"))
    r = writer.write_ranges(grouped, path, "ranges", grouped=True)
    back = packages.read_resource(spark, path.rsplit("/", 1)[0], r)
    one = F.explode(F.arrays_zip("seqname", "start", "end", "strand")).alias("r")
    return back.select("o_custkey", F.size("start").cast("long").alias("n"), one).select("o_custkey", "n", "r.*")


def roundtrip_transposed(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "package")
    wide = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias(writer.NAME), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    r = writer.write_transposed(wide, path, "wide")
    return packages.read_resource(spark, path.rsplit("/", 1)[0], r).select(F.col(writer.NAME).alias("sample"), "feature", "value")


def roundtrip_graph(spark: SparkSession, d: str) -> DataFrame:
    path, g = files.scratch(spark, "package"), _supplier_graph(spark, d)
    r = writer.write_graph(g.edges, path, "graph", "sample", g.n_nodes)
    back = packages.read_resource(spark, path.rsplit("/", 1)[0], r)
    return back.edges.withColumn("nodes", F.lit(len(back)).cast("long"))


def roundtrip_labels(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "labels")
    writer.label_image(table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").alias("column"), (F.col("p_size") % 3).alias("value")), path, "labels")
    return spark.read.parquet(path)


def roundtrip_metadata(spark: SparkSession, d: str) -> DataFrame:
    path, e = files.scratch(spark, "package"), _experiment(spark, d)
    e.metadata = {"title": "sales", "deep": {"nations": table(spark, d, "nation"), "units": ["pieces"]}}
    packages.write_experiment(e, path)
    back = packages.read_package(spark, path).metadata
    return back["deep"]["nations"].select("n_nationkey", "n_name", F.lit(back["title"]).alias("title"), F.lit(back["deep"]["units"][0]).alias("unit"))


def append_array(spark: SparkSession, d: str) -> DataFrame:
    path, cells = files.scratch(spark, "grid"), _sales(spark, d).cells
    n = table(spark, d, "supplier").count()
    for k in range(2):
        writer.write_array(cells, path, ["sample", "feature"], grid=(16, 256), append=k > 0, along="sample", offset=k * n, group_offset=k * (n // 16 + 1))
    return spark.read.parquet(path).groupBy("sample").agg(F.sum("value").alias("total"))


def _multi(spark: SparkSession, d: str) -> MultiAssay:
    """Sales, and order lines, by supplier; the suppliers' nations are the subjects."""
    e = _experiment(spark, d)
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("n"))
    other = SparseMatrix.attach(lines, e.features, e.samples, "l_partkey", "l_suppkey", "n")
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("primary"), F.col("s_suppkey").cast("string").alias("colname"))
    links = suppliers.select(F.lit("sales").alias("assay"), "primary", "colname").unionAll(suppliers.select(F.lit("lines").alias("assay"), "primary", "colname"))
    subjects = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("subject"), "n_regionkey")
    return MultiAssay({"sales": e, "lines": Experiment(e.features, e.samples, {"lines": other})}, subjects, links)


def roundtrip_multi_assay(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "package")
    packages.write_multi_assay(_multi(spark, d), path)
    back = packages.read_package(spark, path)
    own = back.subset_subjects(back.subjects.where("n_regionkey = 1").select("subject"))
    totals = [e.assays[n].sums("sample").join(e.sample_names(), "sample").select(F.lit(n).alias("assay"), F.col("name").cast("long").alias("supplier"), F.round("sum", 6).alias("total")) for n, e in own.experiments.items()]
    return totals[0].unionAll(totals[1])


def roundtrip_spatial(spark: SparkSession, d: str) -> DataFrame:
    path, x = files.scratch(spark, "package"), _layers(spark, d)
    packages.write_spatial(x, path)
    back = packages.read_package(spark, path)
    return spatial.element_join(back, "points/parts", "shapes/zones").select("instance_id", F.col("shape_instance_id").alias("zone"))


def container_subset(spark: SparkSession, d: str) -> DataFrame:
    """Everything keyed by samples follows a subset: embeddings, tables and graphs."""
    e = _experiment(spark, d)
    balance = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.array("s_acctbal").alias("embedding"))
    e = e.set_member("embeddings", "balance", balance).set_member("col_tables", "accounts", balance.select("sample", F.element_at("embedding", 1).alias("balance"))).set_member("col_graphs", "orders", _supplier_graph(spark, d))
    own = e.subset_samples(F.col("s_nationkey") < 5)
    out = own.embeddings["balance"].join(own.col_tables["accounts"], "sample").join(own.assays["sales"].sums("sample"), "sample")
    return out.crossJoin(own.col_graphs["orders"].edges.agg(F.count("*").alias("edges"))).select("sample", "balance", F.round("sum", 6).alias("total"), "edges")


# --- graphs ---------------------------------------------------------------------------------


def _supplier_graph(spark: SparkSession, d: str) -> Graph:
    """Suppliers that have sold the same part in the same order line number; nodes numbered by key."""
    lines = table(spark, d, "lineitem")
    n = lines.count()
    pairs = files.dealt(lines.select("l_orderkey", F.col("l_suppkey").alias("s")), n, "l_orderkey").distinct()
    met = pairs.alias("a").join(pairs.alias("b"), "l_orderkey").where("a.s < b.s").select((F.col("a.s") + 1).alias("from"), (F.col("b.s") + 1).alias("to"))
    edges = files.dealt(met, 2 * n, "from", "to").groupBy("from", "to").agg(F.count("*").alias("orders"))  # few pairs meet twice in one part
    return Graph(edges, table(spark, d, "supplier").count())


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_nationkey < 5").select((F.col("s_suppkey") + 1).alias("node"))


_EDGES = """WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey + 1 AS s FROM lineitem), e AS (SELECT a.s AS f, b.s AS t, count(*) AS orders FROM o a JOIN o b USING (l_orderkey) WHERE a.s < b.s GROUP BY 1, 2),
n AS (SELECT s_suppkey + 1 AS node, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier WHERE s_nationkey < 5) """


def graph_subset(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    numbered = writer.positions(nodes, "node")
    return _supplier_graph(spark, d).subset(numbered).edges


# --- spatial --------------------------------------------------------------------------------

SQUARES = {"low": [(0, 900), (20, 900), (20, 930), (0, 930)], "mid": [(15, 925), (35, 925), (35, 960), (15, 960)], "slope": [(30, 950), (50, 950), (50, 1000)]}


def _layers(spark: SparkSession, d: str) -> spatial.SpatialExperiment:
    """Parts as points (size, price), three polygons as shapes, and suppliers' sales as the mapped assay."""
    points = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("instance_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    shapes = spark.createDataFrame([(n, [{"x": float(a), "y": float(b)} for a, b in ring]) for n, ring in SQUARES.items()], T.StructType([T.StructField("instance_id", T.StringType()), T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))]))
    e = _experiment(spark, d)
    m = SparseMatrix(e.assays["sales"].cells, e.features, e.samples).transpose()
    parts = Experiment(m.features, m.samples, {"sales": m})
    smap = table(spark, d, "part").select(F.lit("sales").alias("assay"), F.col("p_partkey").cast("string").alias("colname"), F.lit("points").alias("element_type"), F.lit("parts").alias("region"), F.col("p_partkey").cast("string").alias("instance_id"))
    ghost = spark.createDataFrame([("sales", "no such", "points", "parts", "no such"), ("sales", "0", "shapes", "ghost", "0")], smap.schema)
    subjects = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("subject"))
    links = subjects.select(F.lit("sales").alias("assay"), F.col("subject").alias("primary"), F.col("subject").alias("colname"))
    transforms = {"points/parts": {"global": {"type": "identity"}, "scaled": {"type": "scale", "scale": [2, 0.5]}}}
    return spatial.SpatialExperiment({"sales": parts}, subjects, links, points={"parts": points}, shapes={"zones": shapes}, spatial_map=smap.unionAll(ghost), transforms=transforms)


def _inside(ring: list[tuple[float, float]], x: str = "p_size", y: str = "p_retailprice") -> str:
    """Ray casting with borders, as SQL."""
    crossings, borders = [], []
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        borders.append(f"(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}) = 0 AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        if ay != by:
            crossings.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < ({bx} - {ax})::DOUBLE * ({y} - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END")
    return f"({' OR '.join(borders)} OR ({' + '.join(crossings)}) % 2 = 1)"


_HITS = " UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS instance_id, '{n}' AS zone FROM part WHERE {_inside(r)}" for n, r in SQUARES.items())


def bbox_subset(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.subset_by_box(_layers(spark, d), 10, 30, 910, 980)
    m = out.experiments["sales"].assays["sales"]
    return m.sums("sample").select(F.col("sample").alias("part"), F.round("sum", 6).alias("total"))


def polygon_subset(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.subset_by_polygon(_layers(spark, d), "POLYGON ((30 950, 50 950, 50 1000, 30 950))")
    return out.points["parts"].select("instance_id", "x", "y")


def _squares(spark: SparkSession, d: str) -> DataFrame:
    """A square around each part's point."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("instance_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    corners = F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    return p.select("instance_id", corners.alias("geometry"))


def shapes_join(spark: SparkSession, d: str) -> DataFrame:
    """Shapes with shapes: squares that meet a zone."""
    zones = _layers(spark, d).shapes["zones"].where("instance_id <> 'slope'")
    return spatial.spatial_join(_squares(spark, d), zones).select("instance_id", F.col("shape_instance_id").alias("zone"))


def spatial_join_left(spark: SparkSession, d: str) -> DataFrame:
    """Points without a zone, and points with an unknown column, stay; equal points stay apart."""
    x = _layers(spark, d)
    points = x.points["parts"].withColumn("note", F.when(F.col("x") > 20, F.lit("far"))).drop("instance_id")
    return spatial.spatial_join(points.unionByName(points), x.shapes["zones"], how="left").select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "note", F.col("shape_instance_id").alias("zone"))


def spatial_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = _layers(spark, d)
    points = x.points["parts"].withColumn("instance_id", F.col("instance_id").cast("long"))
    return spatial.spatial_pairs(points, x.shapes["zones"], "instance_id", "instance_id")


def polygon_subset_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes that hold the polygon, cross it or lie in it."""
    x = _layers(spark, d)
    x.shapes["squares"] = _squares(spark, d)
    out = spatial.subset_by_polygon(x, "POLYGON ((5 902, 30.5 902, 30.5 912.5, 5 912.5, 5 902))")
    return out.shapes["squares"].select("instance_id").unionByName(out.shapes["zones"].select("instance_id"))


def geo_layer(spark: SparkSession, d: str) -> DataFrame:
    """Squares with a square hole, written as well-known binary: points in a hole are not in the shape."""
    path = files.scratch(spark, "geo")
    ring = lambda r: struct.pack("<I", 5) + b"".join(struct.pack("<dd", *p) for p in ((-r, 900 - r), (r, 900 - r), (r, 900 + r), (-r, 900 + r), (-r, 900 - r)))
    data = bytearray(struct.pack("<BII", 1, 3, 2) + ring(40.0) + ring(20.0))
    spark.createDataFrame([("frame", data), ("none", None)], "instance_id string, geometry binary").write.parquet(path)
    zones = spatial.read_geo_layer(spark, path)
    return spatial.spatial_join(_layers(spark, d).points["parts"], zones).select("instance_id", F.col("shape_instance_id").alias("zone"))


_ZONE_BOXES = "(VALUES ('low', 0, 20, 900, 930), ('mid', 15, 35, 925, 960)) AS z(zone, x0, x1, y0, y1)"
_FRAME = "p_size <= 40 AND p_retailprice BETWEEN 860 AND 940 AND NOT (p_size < 20 AND p_retailprice > 880 AND p_retailprice < 920)"


def region_aggregate(spark: SparkSession, d: str) -> DataFrame:
    x = spatial.annotate_with_regions(_layers(spark, d), "parts", "zones")
    return spatial.aggregate_by_region(x, "sales", "sales", "sum", "annotation").select(F.col("feature").alias("supplier"), F.col("region").alias("zone"), F.round("value", 6).alias("value"))


def spatial_views(spark: SparkSession, d: str) -> DataFrame:
    views = spatial.spatial_views(_layers(spark, d))
    return spark.sql(f"SELECT count(*) AS n, round(sum(p.x), 2) AS x FROM {views['points/parts']} p JOIN {views['spatial_map']} m ON m.instance_id = p.instance_id AND m.element_type = 'points'")


def entries() -> dict:
    return {
        "roundtrip_table": (roundtrip_table, "SELECT * FROM supplier"),
        "roundtrip_matrix": (roundtrip_matrix, "SELECT l_partkey AS part, l_suppkey AS supplier, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"),
        "roundtrip_embedding": (roundtrip_embedding, "SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0::DOUBLE AS total FROM embeddings"),
        "roundtrip_multipart": (roundtrip_multipart, "SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM orders) AS rows FROM orders"),
        "roundtrip_partition_prune": (roundtrip_partition_prune, "SELECT l_partkey AS feature, l_suppkey AS sample, sum(l_quantity) AS value FROM lineitem WHERE l_suppkey BETWEEN 1 AND 40 GROUP BY 1, 2"),
        "roundtrip_factor": (roundtrip_factor, "SELECT c_mktsegment, CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS BIGINT) AS code, count(*) AS n FROM customer GROUP BY 1, 2"),
        "ingest_foreach_batch": (ingest_foreach_batch, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"),
        "zorder_written": (zorder_written, _ZORDER),
        "hilbert_written": (hilbert_written, _HILBERT),
        "graph_subset": (graph_subset, f'{_EDGES} SELECT a.position AS "from", b.position AS "to", orders FROM e JOIN n a ON a.node = f JOIN n b ON b.node = t'),
        "graph_induced": (lambda s, d: _supplier_graph(s, d).induced(_nodes(s, d)), f'{_EDGES} SELECT f AS "from", t AS "to", orders FROM e WHERE f IN (SELECT node FROM n) AND t IN (SELECT node FROM n)'),
        "graph_degree": (lambda s, d: _supplier_graph(s, d).degrees(), f"{_EDGES} SELECT node, count(*) AS degree FROM (SELECT f AS node FROM e UNION ALL SELECT t FROM e) GROUP BY 1"),
        "link_map": (lambda s, d: spatial.link_map(_layers(s, d), region="parts"), "SELECT 'sales' AS assay, CAST(p_partkey AS VARCHAR) AS colname, 'points' AS element_type, 'parts' AS region, CAST(p_partkey AS VARCHAR) AS instance_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part"),
        "validate_map": (lambda s, d: spatial.validate_map(_layers(s, d)), "SELECT * FROM (VALUES ('unknown_layer', NULL, NULL, 'shapes', 'ghost', NULL), ('orphan_instance', 'sales', 'no such', 'points', 'parts', 'no such'), ('orphan_colname', 'sales', 'no such', 'points', 'parts', 'no such')) AS t(violation, assay, colname, element_type, region, instance_id)"),
        "coordinate_systems": (lambda s, d: s.createDataFrame([(c,) for c in _layers(s, d).coordinate_systems()], "system string"), "SELECT * FROM (VALUES ('global'), ('scaled')) AS t(system)"),
        "aligned_points": (lambda s, d: spatial.aligned(_layers(s, d), "points/parts", "scaled").select("instance_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")), "SELECT CAST(p_partkey AS VARCHAR) AS instance_id, round(p_size * 2.0::DOUBLE, 4) AS x, round(p_retailprice * 0.5::DOUBLE, 4) AS y FROM part"),
        "spatial_overlaps": (lambda s, d: spatial.overlaps(_layers(s, d).points["parts"], SQUARES["slope"]).select("instance_id", "overlaps"), f"SELECT CAST(p_partkey AS VARCHAR) AS instance_id, {_inside(SQUARES['slope'])} AS overlaps FROM part"),
        "spatial_join": (lambda s, d: spatial.element_join(_layers(s, d), "points/parts", "shapes/zones").select("instance_id", F.col("shape_instance_id").alias("zone")), _HITS),
        "shapes_join": (shapes_join, f"SELECT CAST(p_partkey AS VARCHAR) AS instance_id, zone FROM part JOIN {_ZONE_BOXES} ON p_size + 1 >= x0 AND p_size - 1 <= x1 AND p_retailprice + 1 >= y0 AND p_retailprice - 1 <= y1"),
        "spatial_join_left": (spatial_join_left, f"SELECT round(p_size::DOUBLE, 4) AS x, round(p_retailprice, 4) AS y, CASE WHEN p_size > 20 THEN 'far' END AS note, zone FROM part LEFT JOIN ({_HITS}) h ON instance_id = CAST(p_partkey AS VARCHAR) CROSS JOIN range(2)"),
        "spatial_pairs": (spatial_pairs, f"WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS instance_id, row_number() OVER (ORDER BY p_partkey) AS row FROM part) SELECT row, CASE zone WHEN 'low' THEN 1::BIGINT WHEN 'mid' THEN 2 ELSE 3 END AS column FROM a JOIN ({_HITS}) h USING (instance_id)"),
        "polygon_subset_shapes": (polygon_subset_shapes, "SELECT CAST(p_partkey AS VARCHAR) AS instance_id FROM part WHERE p_size + 1 >= 5 AND p_size - 1 <= 30.5 AND p_retailprice + 1 >= 902 AND p_retailprice - 1 <= 912.5 UNION ALL SELECT 'low'"),
        "geo_layer": (geo_layer, f"SELECT CAST(p_partkey AS VARCHAR) AS instance_id, 'frame' AS zone FROM part WHERE {_FRAME}"),
        "polygon_match": (lambda s, d: spatial.spatial_match(_layers(s, d).points["parts"], _layers(s, d).shapes["zones"], "instance_id", "instance_id"), f"SELECT CAST(p_partkey AS VARCHAR) AS instance_id, min(zone) AS match FROM part LEFT JOIN ({_HITS}) h ON h.instance_id = CAST(p_partkey AS VARCHAR) GROUP BY 1"),
        "bbox_subset": (bbox_subset, "SELECT p_partkey AS part, coalesce(sum(l_quantity), 0::DOUBLE) AS total FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 910 AND 980 GROUP BY 1"),
        "polygon_subset": (polygon_subset, f"SELECT CAST(p_partkey AS VARCHAR) AS instance_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE {_inside(SQUARES['slope'])}"),
        "region_aggregate": (region_aggregate, f"WITH z AS (SELECT instance_id, min(zone) AS zone FROM ({_HITS}) GROUP BY 1), q AS (SELECT l_suppkey, zone, sum(l_quantity) AS v FROM lineitem JOIN z ON instance_id = CAST(l_partkey AS VARCHAR) GROUP BY 1, 2) SELECT s_suppkey AS supplier, zs.zone, coalesce(v, 0::DOUBLE) AS value FROM supplier CROSS JOIN (SELECT DISTINCT zone FROM z) zs LEFT JOIN q ON q.l_suppkey = s_suppkey AND q.zone = zs.zone"),
        "region_mean": (lambda s, d: spatial.aggregate_by_region(spatial.annotate_with_regions(_layers(s, d), "parts", "zones"), "sales", "sales", "mean", "annotation").select(F.col("feature").alias("supplier"), F.col("region").alias("zone"), F.round("value", 6).alias("value")), f"WITH z AS (SELECT instance_id, min(zone) AS zone FROM ({_HITS}) GROUP BY 1), q AS (SELECT l_suppkey, zone, sum(l_quantity) AS v FROM lineitem JOIN z ON instance_id = CAST(l_partkey AS VARCHAR) GROUP BY 1, 2) SELECT s_suppkey AS supplier, zs.zone, round(coalesce(v, 0::DOUBLE) / zs.n, 6) AS value FROM supplier CROSS JOIN (SELECT zone, count(*) AS n FROM z GROUP BY 1) zs LEFT JOIN q ON q.l_suppkey = s_suppkey AND q.zone = zs.zone"),
        "instance_filter": (lambda s, d: spatial.filter_by_instances(_layers(s, d).points["parts"], table(s, d, "lineitem").where("l_quantity = 50").select("l_partkey")), "SELECT CAST(p_partkey AS VARCHAR) AS instance_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)"),
        "layer_extent": (lambda s, d: s.createDataFrame([spatial.extent([_layers(s, d).points["parts"]])]).select("x_min", "x_max", "y_min", "y_max"), "SELECT min(p_size)::DOUBLE AS x_min, max(p_size)::DOUBLE AS x_max, min(p_retailprice) AS y_min, max(p_retailprice) AS y_max FROM part"),
        "matrix_sums": (lambda s, d: _sales(s, d).map(lambda v: (v > 20).cast("double"), 0.0).sums("feature").select("feature", F.col("sum").cast("long").alias("above")), "SELECT p_partkey AS feature, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_partkey = p_partkey GROUP BY 1 HAVING sum(l_quantity) > 20)) AS above FROM part"),
        "roundtrip_ranges": (roundtrip_ranges, "SELECT o_orderpriority AS seqname, o_orderkey + 1 AS start, o_orderkey + 10 AS \"end\", '+' AS strand, o_custkey FROM orders"),
        "roundtrip_ranges_list": (roundtrip_ranges_list, "SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderpriority AS seqname, o_orderkey AS start, o_orderkey + 9 AS \"end\", '*' AS strand FROM orders"),
        "roundtrip_transposed": (roundtrip_transposed, "SELECT CAST(s_suppkey AS VARCHAR) AS sample, 'balance' AS feature, s_acctbal AS value FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'nation', s_nationkey::DOUBLE FROM supplier"),
        "roundtrip_graph": (roundtrip_graph, f'{_EDGES} SELECT f AS "from", t AS "to", orders, (SELECT count(*) FROM supplier) AS nodes FROM e'),
        "roundtrip_labels": (roundtrip_labels, "SELECT p_partkey AS row, p_size AS column, p_size % 3 AS value FROM part WHERE p_size % 3 <> 0"),
        "roundtrip_metadata": (roundtrip_metadata, "SELECT n_nationkey, n_name, 'sales' AS title, 'pieces' AS unit FROM nation"),
        "append_array": (append_array, "WITH q AS (SELECT l_suppkey AS s, sum(l_quantity) AS total FROM lineitem GROUP BY 1) SELECT s AS sample, total FROM q UNION ALL SELECT s + (SELECT count(*) FROM supplier), total FROM q"),
        "roundtrip_multi_assay": (roundtrip_multi_assay, "WITH k AS (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1) SELECT 'sales' AS assay, s_suppkey AS supplier, coalesce(sum(l_quantity), 0::DOUBLE) AS total FROM k LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 2 UNION ALL SELECT 'lines', s_suppkey, count(l_suppkey)::DOUBLE FROM k LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 2"),
        "roundtrip_spatial": (roundtrip_spatial, _HITS),
        "container_subset": (container_subset, f"{_EDGES} SELECT s_suppkey AS sample, s_acctbal AS balance, coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey), 0::DOUBLE) AS total, (SELECT count(*) FROM e WHERE f IN (SELECT node FROM n) AND t IN (SELECT node FROM n)) AS edges FROM supplier WHERE s_nationkey < 5"),
        "spatial_views": (spatial_views, "SELECT count(*) AS n, round(sum(p_size), 2) AS x FROM part"),
    }
