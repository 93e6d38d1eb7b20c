import datetime
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from quillon.functions import geometry as G
from quillon.plans import spatial
from quillon.plans.containers import Experiment, MultiAssay
from quillon.plans.graph import Graph
from quillon.plans.matrix import SparseMatrix
from quillon.sources import fields, manifest, packages, writer
from quillon.streaming import ingest


def experiment(spark, n=6, tag="S"):
    features = spark.createDataFrame([(f"G{i}", "chr1", i, i + 5, "+") for i in range(1, 5)], "feature string, seqname string, start long, end long, strand string")
    samples = spark.createDataFrame([(f"{tag}{j}", ("ctrl", "treat")[j % 2], (float(j), "q")) for j in range(1, n + 1)], "sample string, grp string, nest struct<u:double,v:string>")
    cells = spark.createDataFrame([(f"G{i}", f"{tag}{j}", float(i * j)) for i in range(1, 5) for j in range(1, n + 1) if (i + j) % 2], "feature string, sample string, value double")
    pca = samples.select("sample", F.array(F.length("sample").cast("double"), F.lit(2.0)).alias("embedding"))
    loadings = features.select("feature", F.array(F.lit(1.0), F.lit(3.0)).alias("embedding"))
    graph = Graph(spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7), (2, 3, 0.7), (4, 4, 1.0)], "from long, to long, w double"), n)
    return Experiment(features, samples, {"counts": SparseMatrix(cells, features, samples)}, loadings={"pcs": loadings}, embeddings={"PCA": pca}, col_graphs={"knn": graph}, main_name="rna")


def cells_by_name(e, assay="counts"):
    f, s = (n.withColumnRenamed("name", c) for n, c in ((e.feature_names(), "f"), (e.sample_names(), "s")))
    return {(r["f"], r["s"]): r["value"] for r in e.assays[assay].cells.join(f, "feature").join(s, "sample").collect()}


def test_single_cell_round_trip(spark, tmp_path):
    e = experiment(spark)
    e.alternatives["protein"] = experiment(spark)
    e.metadata = {"title": "t", "n": [1, 2], "deep": {"a": {"table": spark.range(3)}, "b": True}, "when": datetime.date(2020, 1, 2)}
    path = str(tmp_path / "p")
    made = packages.write_package(e, path, grid=(2, 2))
    assert made["model"] == packages.SINGLE_CELL and made["main_exp_name"] == "rna"
    with pytest.warns(UserWarning):
        packages.metadata.serialize({"bad": object()}, path)
    back = packages.read_package(spark, path)
    assert cells_by_name(back) == cells_by_name(e) == cells_by_name(back.alternatives["protein"])
    assert back.metadata["title"] == "t" and back.metadata["deep"]["a"]["table"].count() == 3 and back.metadata["when"] == "2020-01-02"
    assert {tuple(r["embedding"]) for r in back.embeddings["PCA"].collect()} == {(2.0, 2.0)} and back.loadings["pcs"].count() == 4
    assert back.col_tables["nest"].count() == 6 and back.col_graphs["knn"].n_nodes == 6 and back.col_graphs["knn"].edges.count() == 4
    assert "nest" not in back.samples.columns and {"seqname", "start", "end", "strand"} <= set(back.features.columns)
    part = next(r for r in made["resources"] if r["name"] == "counts")["schema"]["partitioning"]
    assert part == ["__sample__group__", "__feature__group__"]
    half = back.subset_samples(F.col("name").isin("S1", "S2", "S3"))
    assert half.assays["counts"].n_samples == 3 and half.embeddings["PCA"].count() == 3 and half.col_graphs["knn"].edges.count() == 3 and half.alternatives["protein"].samples.count() == 3


def test_lists_and_multi_assay_round_trip(spark, tmp_path):
    exps = {"one": experiment(spark, 4, "A"), "two": experiment(spark, 6, "B")}
    packages.write_package(exps, str(tmp_path / "list"))
    assert {n: e.samples.count() for n, e in packages.read_package(spark, str(tmp_path / "list")).items()} == {"one": 4, "two": 6}
    subjects = spark.createDataFrame([("p1", 30), ("p2", 40)], "subject string, age int")
    smap = spark.createDataFrame([("one", "p1", "A1"), ("one", "p2", "A2"), ("two", "p1", "B3")], "assay string, primary string, colname string")
    packages.write_package(MultiAssay(exps, subjects, smap, {"k": 1}), str(tmp_path / "multi"))
    back = packages.read_package(spark, str(tmp_path / "multi"))
    assert back.metadata == {"k": 1} and back.sample_map.schema["assay"].metadata["categories"] == ["one", "two"]
    own = back.subset_subjects(spark.createDataFrame([("p1",)], "subject string"))
    assert {n: e.samples.count() for n, e in own.experiments.items()} == {"one": 1, "two": 1}


def square(x, y, side=1.0):
    return [{"x": x, "y": y}, {"x": x + side, "y": y}, {"x": x + side, "y": y + side}, {"x": x, "y": y + side}]


def layers(spark):
    points = spark.createDataFrame([("1", 1.5, 1.5), ("2", 2.5, 2.5), ("3", 3.5, 3.5)], "instance_id string, x double, y double")
    shapes = spark.createDataFrame([("a", square(1.0, 1.0)), ("b", square(2.0, 1.0)), ("c", square(2.0, 2.0))], f"instance_id string, geometry {G.POLYGON}")
    smap = spark.createDataFrame([("one", f"A{k}", "points", "cells", str(k)) for k in (1, 2, 3)], "assay string, colname string, element_type string, region string, instance_id string")
    subjects = spark.createDataFrame([("p",)], "subject string")
    links = spark.createDataFrame([("one", "p", "A1")], "assay string, primary string, colname string")
    transforms = {"points/cells": {"global": {"type": "identity"}, "scaled": {"type": "scale", "scale": [2, 2]}}, "scaled": {"far": {"type": "affine", "affine": [[1, 0, 10], [0, 1, 20], [0, 0, 1]]}}}
    return spatial.SpatialExperiment({"one": experiment(spark, 4, "A")}, subjects, links, points={"cells": points}, shapes={"zones": shapes}, spatial_map=smap, transforms=transforms)


def test_spatial_round_trip_and_queries(spark, tmp_path):
    x = layers(spark)
    png = tmp_path / "slide.png"
    png.write_bytes(b"png")
    x.images, x.labels = {"slide": {"path": str(png), "scale": 2}}, {"mask": spark.createDataFrame([(1, 1, 0), (1, 2, 7)], "row int, column int, value int"), "ref": {"path": "x.zarr"}}
    packages.write_package(x, str(tmp_path / "s"))
    back = packages.read_package(spark, str(tmp_path / "s"))
    assert back.images == {"slide": {"path": "slide.png", "scale": 2}} and (tmp_path / "s/images/slide/slide.png").exists()
    assert back.labels["ref"] == {"path": "x.zarr"} and [r["value"] for r in back.labels["mask"].collect()] == [7]
    for y in (x, back):
        assert y.coordinate_systems() == ["far", "global", "scaled"]
        assert [r["x"] for r in spatial.aligned(y, "points/cells", "scaled").sort("instance_id").collect()] == [3.0, 5.0, 7.0]
        assert [r["x"] for r in spatial.aligned(y, "points/cells", "far").sort("instance_id").collect()] == [13.0, 15.0, 17.0]
        assert {(r["instance_id"], r["shape_instance_id"]) for r in spatial.element_join(y, "points/cells", "shapes/zones").collect()} == {("1", "a"), ("2", "c")}
        assert {r["instance_id"]: r["match"] for r in spatial.spatial_match(y.points["cells"], y.shapes["zones"], "instance_id", "instance_id").collect()} == {"1": "a", "2": "c", "3": None}
        assert spatial.link_map(y).count() == 3 and spatial.validate_map(y, strict=True).count() == 0
        small = spatial.subset_by_box(y, 1, 2.5, 1, 2.5)
        assert small.spatial_map.count() == 2 and small.experiments["one"].samples.count() == 2
        assert spatial.subset_by_polygon(y, "POLYGON ((3 3, 4 3, 4 4, 3 4, 3 3))").experiments["one"].samples.count() == 1
        empty = spatial.subset_by_box(y, 90, 91, 90, 91)
        assert empty.experiments["one"].samples.count() == 0
        with pytest.warns(UserWarning):
            assert spatial.subset_by_box(y, 90, 91, 90, 91, keep_unmapped=True).experiments["one"].samples.count() == 4
        for statistic in ("sum", "mean", "count"):
            assert spatial.aggregate_by_region(y, "one", "counts", statistic).count() == 4
    with pytest.raises(KeyError):
        spatial.transform_path(x, "points/cells", "nowhere")
    twice = x.points["cells"].unionAll(x.points["cells"].where("x < 2"))
    x.points = {"cells": twice}
    assert [r["violation"] for r in spatial.validate_map(x).collect()] == ["duplicate_instance"]


def test_borders_and_predicates(spark):
    points = spark.createDataFrame([(0.0, 0.0), (6.0, 3.0), (3.0, 6.0), (7.0, 7.0), (6.1, 3.0), (None, 1.0)], "x double, y double")
    got = [r["overlaps"] for r in spatial.overlaps(points, "POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0))").collect()]
    assert got == [True, True, True, False, False, False]
    ring = [(0.0, 0.0), (2.0, 0.0), (1.0, 3.0)]
    assert [tuple(v) for v in G.from_wkb(G.to_wkb(ring))] == ring
    near = lambda shape, x, y: x < 1000  # noqa: E731  any predicate on pairs that share a cell
    shapes = spark.createDataFrame([("a", square(0.0, 0.0, 6.0))], f"instance_id string, geometry {G.POLYGON}")
    assert spatial.spatial_join(points, shapes, near).count() >= 3
    assert spatial.spatial_join(points, shapes, how="left").count() == 6


def test_graph_errors(spark):
    g = Graph(spark.createDataFrame([(1, 2), (2, 3)], "from long, to long"), 3)
    assert len(g) == 3 and {tuple(r) for r in g[[3, 2]].edges.collect()} == {(2, 1)}
    for wrong in (lambda: g[1, 2], lambda: g.__setitem__(1, 2), lambda: g + g):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(IndexError):
        g[[9]]


def test_member_setters(spark):
    e = experiment(spark)
    with pytest.raises(ValueError):
        e.set_member("loadings", "x", e.features.select("feature", F.array(F.lit(1.0))).limit(2))
    with pytest.raises(ValueError):
        e.set_member("row_tables", "x", spark.range(2))
    e = e.set_member("row_tables", "notes", e.features.select("feature", F.lit("n").alias("note")))
    e = e.set_member("row_graphs", 0, spark.createDataFrame([(1, 2)], "from long, to long"))
    assert e.row_tables.names == ["notes"] and e.row_graphs[0].n_nodes == 4 and e.loadings.renamed(["q"]).names == ["q"]


def test_manifests(spark, tmp_path):
    one = {"name": "a", "path": "a"}
    made = manifest.write_manifest(spark, None, [one, None], str(tmp_path / "m"), annotations={"k": [1, None]})
    assert json.loads((tmp_path / "m" / manifest.FILE).read_text()) == made == manifest.read_manifest(spark, str(tmp_path / "m")) and list(made)[0] == "$schema"
    for wrong in ([one, one], [{"name": "a"}], [{"name": 1, "path": "b"}]):
        with pytest.raises(ValueError):
            manifest.write_manifest(spark, None, wrong, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        writer.resource("a", "a", "elsewhere", "data_frame")
    manifest.write_manifest(spark, "unheard of", [one], str(tmp_path / "m"))
    with pytest.raises(ValueError):
        packages.read_package(spark, str(tmp_path / "m"))


def test_fields_and_constraints(spark, tmp_path):
    df = spark.sql("SELECT true a, 1Y b, 2L c, 3.5D d, 's' e, date'2020-01-01' f, timestamp'2020-01-01 00:00:00' g, X'00' h, array(1.0D) i, interval '1' day j, map(1,2) k")
    kinds = [f["type"] for f in fields.table_schema(df, "data_frame", None, None)["fields"]]
    assert kinds == ["boolean", "integer", "integer", "number", "string", "date", "datetime", "string", "array", "duration", "any"]
    ranges = spark.createDataFrame([("chr1", 0, 5, "+", 6), (None, 2, 3, "x", 2)], "seqname string, start long, end long, strand string, width long")
    r = writer.write_ranges(ranges, str(tmp_path / "r"), "r")
    assert r["schema"]["genomicCoords"] == {"seqname": "seqname", "start": "start", "end": "end", "strand": "strand"}
    assert {(x["field"], x["n"]) for x in fields.violations(ranges, r["schema"]["fields"]).collect()} == {("start", 1), ("seqname", 1), ("strand", 1)}
    assert "width" not in spark.read.parquet(str(tmp_path / "r")).columns
    for f, c in zip(fields.table_schema(df, "data_frame", None, None)["fields"], df.columns):
        df.select(fields.cast_to(f, F.col(c)).alias(c)).collect()


def test_parts_blocks_and_wide_indexes(spark, tmp_path):
    blocks = [spark.range(k).withColumnRenamed("id", "v") for k in (3, 0, 2)]
    path = str(tmp_path / "b")
    with pytest.warns(UserWarning, match="wider index"):
        made = ingest.write_blocks(lambda i: blocks[i] if i < 3 else None, path, expected_rows=5)
    back = spark.read.parquet(path)
    assert made["n_rows"] == 5 and sorted(r[writer.INDEX] for r in back.collect()) == [1, 2, 3, 4, 5]
    assert {f.name.split("-")[1] for f in (tmp_path / "b").glob("part-*")} == {"000000", "000001"}
    with pytest.raises(FileExistsError):
        writer.write_table(blocks[0], path, append=True, part=1, offset=5)
    with pytest.raises(ValueError, match="misaligned"):
        ingest.write_blocks([blocks[0]], str(tmp_path / "c"), dimension_table=spark.range(2))
    with pytest.warns(UserWarning, match="expected"):
        ingest.write_blocks([blocks[0]], str(tmp_path / "d"), expected_rows=9)
    assert ingest.write_blocks([blocks[1]], str(tmp_path / "e")) is None
    ingest.write_blocks([blocks[0]], str(tmp_path / "f"), offset=3_000_000_000, index_max=4_000_000_000)
    assert min(r[0] for r in spark.read.parquet(str(tmp_path / "f")).select(writer.INDEX).collect()) == 3_000_000_001
    with pytest.raises(ValueError):
        ingest.write_blocks([blocks[0]], str(tmp_path / "g"), offset=3, index_max=4)


def test_append_along_an_axis(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, float(i + j)) for i in range(1, 5) for j in range(1, 6)], "index1 int, index2 int, value double")
    path = str(tmp_path / "a")
    writer.write_array(cells, path, ["index1", "index2"], grid=(2, 3))
    writer.write_array(cells, path, ["index1", "index2"], grid=(2, 3), append=True, along="index2", offset=5, group_offset=2)
    back = spark.read.parquet(path)
    assert back.count() == 40 and back.agg(F.max("index2")).first()[0] == 10 and {r[0] for r in back.select("index2_group").distinct().collect()} == {1, 2, 3, 4}


def test_transposed_tables(spark, tmp_path):
    wide = spark.createDataFrame([("s1", 1.0, 2.0), ("s2", 3.0, 4.0)], "__name__ string, g1 double, g2 double")
    r = writer.write_transposed(wide, str(tmp_path / "t"), "t")
    got = packages.read_resource(spark, str(tmp_path), r)
    assert {(x["feature"], x["value"]) for x in got.collect()} == {("g1", 1.0), ("g2", 2.0), ("g1", 3.0), ("g2", 4.0)}


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    sink = ingest.parts_sink(str(tmp_path / "out"))
    sink(spark.range(10, 20), 1)  # delivered again
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_stored_polygons_keep_their_holes(spark, tmp_path):
    import struct

    outer, hole = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]
    for order, flag in (("<", 1), (">", 0)):
        wkb = struct.pack("B", flag) + struct.pack(f"{order}II", 3, 2) + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}dd", *p) for p in r) for r in (outer, hole))
        spark.createDataFrame([("a", bytearray(wkb))], "instance_id string, geometry binary").write.parquet(path := f"{tmp_path}/{flag}")
        points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 5.0), (3, 3.0, 4.0), (4, 9.5, 1.0), (5, 7.0, 4.5), (6, 1.5, 1.5)], "id int, x double, y double")
        assert {r["id"] for r in spatial.spatial_join(points, spatial.read_geo_layer(spark, path)).collect()} == {1, 3, 5, 6}


def test_polygon_subset_keeps_shapes_that_cross_or_hold_it(spark):
    def box(x0, x1, y0, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]

    none = (None, None)
    holed = [*box(-5.0, 9.0, -5.0, 9.0), (-5.0, -5.0), none, *box(-1.0, 5.0, -1.0, 5.0), (-1.0, -1.0), none]
    rows = [("in", box(1.0, 2.0, 1.0, 2.0)), ("holds", box(-9.0, 9.0, -9.0, 9.0)), ("crosses", box(-9.0, 9.0, 1.0, 2.0)), ("touches", box(4.0, 6.0, 0.0, 1.0)), ("far", box(5.0, 6.0, 5.0, 6.0)), ("in its hole", holed)]
    shapes = spark.createDataFrame(rows, f"instance_id string, geometry {G.POLYGON}")
    got = spatial.subset_by_polygon(spatial.SpatialExperiment({}, None, None, shapes={"zones": shapes}), "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))").shapes["zones"]
    assert {r["instance_id"] for r in got.collect()} == {"in", "holds", "crosses", "touches"}


def test_long_axes_keep_their_labels(spark, tmp_path):
    from quillon.sources import writer

    labels = [f"g{i}" for i in range(100_001)]
    made = writer.write_array(spark.createDataFrame([(1, 2, 3.0)], "i long, j long, value double"), f"{tmp_path}/a", ["i", "j"], labels={"i": labels})
    field = next(f for f in made["schema"]["fields"] if f["name"] == "i")
    assert [c["label"][0] for c in field["categories"]] == labels


def brute_intersects(a, b):
    """Polygons without holes, as lists of vertices."""

    def side(u, v, w):
        return (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])

    def meet(p, q, r, s):
        apart = any(max(p[k], q[k]) < min(r[k], s[k]) or min(p[k], q[k]) > max(r[k], s[k]) for k in (0, 1))
        return not apart and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0

    def inside(poly, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    edges = [list(zip(p, p[1:] + p[:1])) for p in (a, b)]
    return any(meet(*e, *f) for e in edges[0] for f in edges[1]) or inside(a, *b[0]) or inside(b, *a[0])


def test_shapes_with_shapes_against_brute_force(spark):
    import random

    rng = random.Random(3)

    def polygon(cx, cy, r):
        turns = sorted(rng.random() * 6.283 for _ in range(rng.randrange(3, 8)))
        return [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in turns]

    def some(n):  # sizes from a dot to nearly everything
        return {f"s{k}": polygon(rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([0.1, 1, 5, 60])) for k in range(n)}

    a, b = some(40), some(50)
    frames = [spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in p]) for n, p in shapes.items()] + [("null", None)], f"instance_id string, geometry {G.POLYGON}") for shapes in (a, b)]
    want = sorted((i, j) for i in a for j in b if brute_intersects(a[i], b[j]))
    got = spatial.spatial_join(*frames).select("instance_id", "shape_instance_id")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    left = spatial.spatial_join(*frames, how="left").select("instance_id", "shape_instance_id").collect()
    met = {i for i, _ in want}
    assert sorted(tuple(r) for r in left if r[1]) == want and sorted(r[0] for r in left if r[1] is None) == sorted({*a, "null"} - met)
    match = {r["instance_id"]: r["match"] for r in spatial.spatial_match(*frames, "instance_id", "instance_id").collect()}
    assert match == {i: min((j for k, j in want if k == i), default=None) for i in [*a, "null"]}
    hit = spatial.overlaps(frames[0], [(20, 20), (60, 20), (60, 60)]).where("overlaps").collect()
    assert sorted(r["instance_id"] for r in hit) == sorted(i for i in a if brute_intersects(a[i], [(20, 20), (60, 20), (60, 60)]))
    points = spark.createDataFrame([(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(200)], "instance_id long, x double, y double")
    one = lambda r, p: spatial.overlaps(points.where(F.col("instance_id") == r["instance_id"]), p).first()["overlaps"]
    joined = spatial.spatial_join(points, frames[1]).select("instance_id", "shape_instance_id").collect()
    for r in points.limit(3).collect():
        assert sorted(j for i, j in joined if i == r["instance_id"]) == sorted(j for j in b if one(r, b[j]))


def test_kinds_of_binary_geometries(spark, tmp_path):
    ring = lambda pts: struct.pack("<I", len(pts) + 1) + b"".join(struct.pack("<dd", *p) for p in [*pts, pts[0]])
    low, high, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(10, 10), (12, 10), (11, 12)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    two = struct.pack("<BII", 1, 6, 2) + struct.pack("<BII", 1, 3, 2) + ring(low) + ring(hole) + struct.pack("<BII", 1, 3, 1) + ring(high)
    big = struct.pack(">BIdd", 0, 1, 5.0, 6.0)
    flat = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<ddd", x, y, 9.0) for x, y in [(0, 0), (2, 0), (0, 2), (0, 0)])
    spark.createDataFrame([("two", bytearray(two)), ("point", bytearray(big)), ("deep", bytearray(flat)), ("null", None)], "instance_id string, geometry binary").write.parquet(str(tmp_path / "geo"))
    layer = spatial.read_geo_layer(spark, str(tmp_path / "geo"))
    got = {r["instance_id"]: r["geometry"] for r in layer.collect()}
    assert got["null"] is None and [tuple(v) for v in got["point"]] == [(5.0, 6.0)] and [tuple(v) for v in got["deep"]] == [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]
    points = spark.createDataFrame([("corner", 0.5, 0.5), ("hole", 2.0, 2.0), ("second", 11.0, 11.0), ("point", 5.0, 6.0), ("edge", 1.0, 2.0)], "name string, x double, y double")
    hits = sorted((r["name"], r["shape_instance_id"]) for r in spatial.spatial_join(points, layer).collect())
    assert hits == [("corner", "deep"), ("corner", "two"), ("edge", "two"), ("point", "point"), ("second", "two")]
    with pytest.raises(ValueError):
        G.from_wkb(struct.pack("<BII", 1, 2, 0))


def test_many_blocks_need_few_files(spark, tmp_path):
    cells = spark.range(1600).select((F.col("id") % 40 + 1).alias("i"), (F.col("id") / 40 + 1).cast("long").alias("j"), (F.col("id") + 1.0).alias("value"))
    path = f"{tmp_path}/a"
    made = writer.write_array(cells, path, ["i", "j"], grid=(1, 1), name="a") | {"grid": {"i": 1, "j": 1}}
    writer.write_array(cells.where("j <= 2"), path, ["i", "j"], grid=(1, 1), append=True, along="j", offset=40, group_offset=40)
    files = [p for p in (tmp_path / "a").rglob("*") if p.suffix == ".parquet" or p.is_dir()]
    assert len(files) < 20 and not [p for p in tmp_path.iterdir() if p.name != "a"]
    back = spark.read.parquet(path)
    assert made["schema"]["partitioning"] == ["i_group", "j_group"] and back.where("i = i_group AND j = j_group").count() == 1680
    got = packages.read_array(spark, str(tmp_path), made, {"i": (3, 4), "j": (40, 41)})
    assert sorted(map(tuple, got.collect())) == [(3, 40, 1563.0), (3, 41, 3.0), (4, 40, 1564.0), (4, 41, 4.0)]
    with pytest.raises(FileExistsError):
        writer.write_array(cells, path, ["i", "j"], grid=(1, 1))
