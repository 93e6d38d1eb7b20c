"""Spatial layers of a multi-assay experiment: points and shapes, the map from observations to them, and queries over both.

Layers meet in grids: a shape goes to the cells that its box touches in the finest grid where these are few, and to those in the
coarser grids that are in use; a point to its own cell of each. The exact predicate runs on pairs whose boxes meet, each once. The
finest cells have the mean extent of the boxes; each further grid has cells of twice the side.
"""

from __future__ import annotations

import warnings
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import geometry as G
from quillon.plans.containers import MultiAssay
from quillon.sources import files
from quillon.sources.writer import positions

MAP = ("assay", "colname", "element_type", "region", "instance_id")


@dataclass
class SpatialExperiment(MultiAssay):
    """points, shapes: layers by name, frames with x, y (points) or geometry (shapes: polygons) and instance_id. spatial_map:
    columns assay, colname, element_type, region, instance_id. images, labels: references by name. transforms:
    {"points/<name>": {system: {"type": "identity" | "scale" | "affine" | "sequence", ...}}}."""

    points: dict[str, DataFrame] = field(default_factory=dict)
    shapes: dict[str, DataFrame] = field(default_factory=dict)
    spatial_map: DataFrame | None = None
    images: dict[str, dict] = field(default_factory=dict)
    labels: dict[str, object] = field(default_factory=dict)
    transforms: dict[str, dict] = field(default_factory=dict)

    def layer(self, element: str) -> DataFrame:
        """The layer of "<type>/<region>"."""
        kind, _, region = element.partition("/")
        if kind not in ("points", "shapes") or region not in getattr(self, kind):
            raise KeyError(f"no layer {element!r}")
        return getattr(self, kind)[region]

    def coordinate_systems(self) -> list[str]:
        return sorted({s for by in self.transforms.values() for s in by})


class ViewRegistry(dict):
    """Names of registered views by layer."""

    def __repr__(self) -> str:
        return "spatial views:\n" + "".join(f"  {k}: {v}\n" for k, v in self.items())


def spatial_views(x: SpatialExperiment, prefix: str = "spatial_") -> ViewRegistry:
    """Register every layer that has rows, and the map, as temporary views for SQL."""
    out = ViewRegistry()
    for kind in ("points", "shapes"):
        for name, layer in getattr(x, kind).items():
            if layer.take(1):
                layer.createOrReplaceTempView(view := f"{prefix}{kind}_{name}")
                out[f"{kind}/{name}"] = view
    if x.spatial_map is not None:
        x.spatial_map.createOrReplaceTempView(view := f"{prefix}spatial_map")
        out["spatial_map"] = view
    return out


def _filtered_map(x: SpatialExperiment, assay: str | None, element_type: str | None, region: str | None) -> DataFrame:
    if x.spatial_map is None:
        raise ValueError("there is no spatial map")
    m = x.spatial_map
    for c, v in (("assay", assay), ("element_type", element_type), ("region", region)):
        if v is not None:
            m = m.where(F.col(c) == v)
    return m


def link_map(x: SpatialExperiment, assay: str | None = None, element_type: str | None = None, region: str | None = None) -> DataFrame:
    """Rows of the map with the columns of the one layer that they are in."""
    m = _filtered_map(x, assay, element_type, region)
    layers = m.select("element_type", "region").distinct().take(2)
    if len(layers) != 1:
        raise ValueError("the map has no such rows" if not layers else "rows of one layer are needed: choose element_type and region")
    layer = x.layer(f"{layers[0]['element_type']}/{layers[0]['region']}")
    own = layer.select(F.col("instance_id").cast("string").alias("__id"), *(c for c in layer.columns if c != "instance_id" and not c.startswith("__")))
    return m.select(*MAP).join(own, F.col("instance_id").cast("string") == F.col("__id")).drop("__id")


def validate_map(x: SpatialExperiment, strict: bool = False) -> DataFrame:
    """(violation, assay, colname, element_type, region, instance_id): unknown layers, instances that their layer lacks, columns
    that their assay lacks, and instances that a layer has more than once."""
    m = _filtered_map(x, None, None, None).select(*MAP)
    found = []

    def report(kind: str, rows: DataFrame) -> None:
        found.append(rows.select(F.lit(kind).alias("violation"), *((F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in MAP)))

    used = [(r["element_type"], r["region"]) for r in m.select("element_type", "region").distinct().collect()]  # layers
    for kind, region in sorted(used, key=str):
        own = m.where(F.col("element_type").eqNullSafe(F.lit(kind)) & F.col("region").eqNullSafe(F.lit(region)))
        if kind not in ("points", "shapes") or region not in getattr(x, kind):
            report("unknown_layer", own.select("element_type", "region").distinct())
            continue
        layer = getattr(x, kind)[region]
        if "instance_id" not in layer.columns:
            continue
        ids = layer.select(F.col("instance_id").cast("string").alias("instance_id"))
        report("orphan_instance", own.join(ids, "instance_id", "left_anti"))
        twice = ids.groupBy("instance_id").count().where("count > 1").select("instance_id")
        report("duplicate_instance", twice.withColumn("element_type", F.lit(kind)).withColumn("region", F.lit(region)))
    for name, e in x.experiments.items():
        report("orphan_colname", m.where(F.col("assay") == name).join(e.sample_names().select(F.col("name").alias("colname")), "colname", "left_anti"))
    report("orphan_colname", m.where(~F.col("assay").isin(list(x.experiments)) | F.col("assay").isNull()))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if strict and (first := out.take(1)):
        raise ValueError(f"the spatial map is not valid: {first[0]['violation']}")
    return out


# --- coordinates ----------------------------------------------------------------------------


def transform_path(x: SpatialExperiment, element: str, system: str) -> list[dict]:
    """Transforms from an element to a coordinate system, by the shortest way."""
    waiting, seen = deque([(element, [])]), {element}
    while waiting:
        at, way = waiting.popleft()
        if at == system:
            return way
        for to, t in x.transforms.get(at, {}).items():
            if to not in seen:
                seen.add(to)
                waiting.append((to, [*way, t]))
    raise KeyError(f"no way from {element!r} to {system!r}")


def apply_transform(t: dict, x: Column, y: Column) -> tuple[Column, Column]:
    kind = t.get("type", "identity")
    if kind == "identity":
        return x, y
    if kind == "scale":
        return x * float(t["scale"][0]), y * float(t["scale"][1])
    if kind == "translation":
        return x + float(t["translation"][0]), y + float(t["translation"][1])
    if kind == "affine":
        (a, b, c), (d, e, f) = t["affine"][0][:3], t["affine"][1][:3]
        return x * float(a) + y * float(b) + float(c), x * float(d) + y * float(e) + float(f)
    if kind == "sequence":
        for one in t["transformations"]:
            x, y = apply_transform(one, x, y)
        return x, y
    raise ValueError(f"no transform {kind!r}")


def aligned(x: SpatialExperiment, element: str, system: str) -> DataFrame:
    """A layer with its coordinates in another system."""
    layer = x.layer(element)
    for t in transform_path(x, element, system):
        if "geometry" in layer.columns:
            layer = layer.withColumn("geometry", F.transform("geometry", lambda p, t=t: F.struct(*(c.alias(n) for n, c in zip("xy", apply_transform(t, p["x"], p["y"]), strict=True)))))
        if {"x", "y"} <= set(layer.columns):
            a, b = apply_transform(t, F.col("x"), F.col("y"))
            layer = layer.withColumns({"x": a, "y": b})
    return layer


# --- joins ----------------------------------------------------------------------------------


def overlaps(layer: DataFrame, shape: str | list | Column, x: str = "x", y: str = "y", geometry: str = "geometry") -> DataFrame:
    """The layer with a boolean column overlaps: whether the point, or the shape, has a point in common with the shape (WKT, a ring, or
    a polygon column)."""
    ring = G.parse_wkt(shape) if isinstance(shape, str) else shape
    ring = ring if isinstance(ring, Column) else G.polygon(ring)
    hit = G.intersects(F.col(geometry), ring) if geometry in layer.columns else G.contains(ring, F.col(x), F.col(y))
    return layer.withColumn("overlaps", F.coalesce(hit, F.lit(False)))


_BOX = ("__x0", "__x1", "__y0", "__y1")


def _boxed(layer: DataFrame, x: str, y: str, geometry: str) -> DataFrame:
    """With the box of each row (__x0, ...); rows without one drop out."""
    ends = G.box(F.col(geometry)) if geometry in layer.columns else (F.col(x), F.col(x), F.col(y), F.col(y))
    return layer.withColumns(dict(zip(_BOX, (e.cast("double") for e in ends), strict=True))).dropna(subset=list(_BOX))


def spatial_join(layer: DataFrame, shapes: DataFrame, predicate=None, x: str = "x", y: str = "y", geometry: str = "geometry", how: str = "inner") -> DataFrame:
    """Columns of a layer (points, or shapes if it has a geometry) and of shapes (prefixed shape_) of all pairs for which the predicate
    holds: of (shape, x, y) for points, of (shape, geometry) for shapes; by default, that they have a point in common. Null
    coordinates and geometries meet nothing. how: ``inner``, or ``left``, which keeps rows of the layer that meet nothing."""
    if how not in ("inner", "left"):
        raise ValueError(f"no join {how!r}")
    columns = [*(F.col(f"`{c}`") for c in layer.columns), *(F.col(f"shape_{c}") for c in shapes.columns)]
    numbered = files.written(layer.withColumn("__row", F.monotonically_increasing_id()), "spatial-left") if how == "left" else layer
    a = _boxed(numbered, x, y, geometry)
    b = _boxed(shapes, x, y, geometry).select(*(F.col(c).alias(f"shape_{c}") for c in shapes.columns), *(F.col(c).alias(f"__s{c[2:]}") for c in _BOX))
    mean = b.agg(F.avg(F.col("__sx1") - F.col("__sx0")).alias("w"), F.avg(F.col("__sy1") - F.col("__sy0")).alias("h")).first()
    w, h = (float(v) if v else 1.0 for v in (mean["w"], mean["h"]))

    def level(x0: str, x1: str, y0: str, y1: str) -> Column:
        """The finest grid in which a box meets three cells a side at most."""
        size = F.greatest((F.col(x1) - F.col(x0)) / w, (F.col(y1) - F.col(y0)) / h) / 2
        return F.when(size > 1, F.ceil(F.log2(size))).otherwise(0).cast("int")

    a, b = a.withColumn("__la", level(*_BOX)), b.withColumn("__lb", level("__sx0", "__sx1", "__sy0", "__sy1"))
    used = sorted({r[0] for d, c in ((a, "__la"), (b, "__lb")) for r in d.select(c).distinct().collect()})  # one for each power of two

    def celled(df: DataFrame, own: str, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
        df = df.withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"), lambda k: k >= F.col(own))))
        side = F.pow(F.lit(2.0), F.col("__level"))
        for name, lo, hi, size in (("__cx", x0, x1, w), ("__cy", y0, y1, h)):
            df = df.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / (side * size)).cast("long"), F.floor(F.col(hi) / (side * size)).cast("long"))))
        return df

    met = celled(a, "__la", *_BOX).join(celled(b, "__lb", "__sx0", "__sx1", "__sy0", "__sy1"), ["__level", "__cx", "__cy"])
    side = F.pow(F.lit(2.0), F.col("__level"))
    low = (F.greatest("__x0", "__sx0"), F.greatest("__y0", "__sy0"))
    # In the coarser of the two grids, at the cell of the first corner that both boxes have.
    once = (F.col("__level") == F.greatest("__la", "__lb")) & (F.col("__cx") == F.floor(low[0] / (side * w))) & (F.col("__cy") == F.floor(low[1] / (side * h)))
    boxes = (F.col("__x0") <= F.col("__sx1")) & (F.col("__x1") >= F.col("__sx0")) & (F.col("__y0") <= F.col("__sy1")) & (F.col("__y1") >= F.col("__sy0"))
    shape = F.col(f"shape_{geometry}")
    if geometry in layer.columns:
        test = (predicate or G.intersects)(shape, F.col(geometry))
    else:
        test = (predicate or G.contains)(shape, F.col(x), F.col(y))
    met = met.where(once & boxes & test)
    if how == "inner":
        return met.select(*columns)
    found = met.select("__row", *columns[len(layer.columns) :])
    return numbered.join(found, "__row", "left").select(*columns)


def spatial_match(layer: DataFrame, shapes: DataFrame, layer_id: str, shape_id: str, predicate=None, **options) -> DataFrame:
    """(layer_id, match): the smallest id of a shape that the point or shape meets, or null."""
    hits = spatial_join(layer, shapes, predicate, **options).groupBy(layer_id).agg(F.min(f"shape_{shape_id}").alias("match"))
    return layer.select(layer_id).join(hits, layer_id, "left")


def spatial_pairs(layer: DataFrame, shapes: DataFrame, layer_id: str, shape_id: str, predicate=None, **options) -> DataFrame:
    """(row, column): the pairs of spatial_join() as places, from 1, of the rows of both layers in the order of their ids."""
    a = positions(layer.select(F.col(layer_id).alias("id")), "id").select(F.col("id").alias(layer_id), F.col("position").alias("row"))
    b = positions(shapes.select(F.col(shape_id).alias("id")), "id").select(F.col("id").alias(f"shape_{shape_id}"), F.col("position").alias("column"))
    met = spatial_join(layer, shapes, predicate, **options).select(layer_id, f"shape_{shape_id}")
    return met.join(a, layer_id).join(b, f"shape_{shape_id}").select("row", "column")


def element_join(x: SpatialExperiment, points: str, shapes: str, coordinate_system: str | None = None, predicate=None) -> DataFrame:
    """spatial_join() of two layers, both brought to a coordinate system first if one is given."""
    a, b = (aligned(x, e, coordinate_system) if coordinate_system else x.layer(e) for e in (points, shapes))
    return spatial_join(a, b, predicate)


# --- subsets and annotation -----------------------------------------------------------------


def annotate_with_regions(x: SpatialExperiment, points: str, shapes: str, region_col: str = "annotation", predicate=None) -> SpatialExperiment:
    """The map with a column: the shape (its smallest instance_id) that a row's point is in."""
    match = spatial_match(x.points[points], x.shapes[shapes], "instance_id", "instance_id", predicate)
    match = match.select(F.col("instance_id").cast("string").alias("__id"), F.col("match").cast("string").alias(region_col))
    mine = (F.col("element_type") == "points") & (F.col("region") == points) & (F.col("instance_id").cast("string") == F.col("__id"))
    return replace(x, spatial_map=x.spatial_map.drop(region_col).join(match, mine, "left").drop("__id"))


def _retained(x: SpatialExperiment, points: dict, shapes: dict, keep_unmapped: bool) -> SpatialExperiment:
    """x with smaller layers: rows of the map whose instances are left, and of every mapped assay the columns that they name."""
    out = replace(x, points=points, shapes=shapes)
    if x.spatial_map is None:
        return out
    m, parts = x.spatial_map, []
    for kind, layers in (("points", points), ("shapes", shapes)):
        for name, layer in layers.items():
            own = m.where((F.col("element_type") == kind) & (F.col("region") == name))
            parts.append(own.join(layer.select(F.col("instance_id").cast("string").alias("instance_id")).distinct(), "instance_id", "left_semi") if "instance_id" in layer.columns else own)
    left = parts[0]
    for p in parts[1:]:
        left = left.unionByName(p)
    mapped = {r["assay"] for r in m.select("assay").distinct().collect()}
    if keep_unmapped and not left.take(1):
        warnings.warn("no mapped observation is left; assays stay as they are", stacklevel=3)
        return replace(out, spatial_map=left)
    experiments = {n: e.subset_samples(left.where(F.col("assay") == n).select(F.col("colname").alias("name"))) if n in mapped else e for n, e in x.experiments.items()}
    return replace(out, spatial_map=left, experiments=experiments)


def subset_by_box(x: SpatialExperiment, x_min: float, x_max: float, y_min: float, y_max: float, x_col: str = "x", y_col: str = "y", keep_unmapped: bool = False) -> SpatialExperiment:
    """Points in the box, borders included; shapes whose box meets it; and what the map leads to."""
    points = {n: p.where(F.col(x_col).between(x_min, x_max) & F.col(y_col).between(y_min, y_max)) for n, p in x.points.items()}
    shapes = {}
    for n, s in x.shapes.items():
        a, b, c, d = G.box(F.col("geometry"))
        shapes[n] = s.where((b >= x_min) & (a <= x_max) & (d >= y_min) & (c <= y_max))
    return _retained(x, points, shapes, keep_unmapped)


def subset_by_polygon(x: SpatialExperiment, shape: str | list, x_col: str = "x", y_col: str = "y", keep_unmapped: bool = False) -> SpatialExperiment:
    """Points in the polygon; shapes that have a point in common with it."""
    own = G.parse_wkt(shape) if isinstance(shape, str) else shape
    ring = G.polygon(own)
    points = {n: p.where(G.contains(ring, F.col(x_col), F.col(y_col))) for n, p in x.points.items()}
    shapes = {n: s.where(G.intersects(F.col("geometry"), own)) for n, s in x.shapes.items()}
    return _retained(x, points, shapes, keep_unmapped)


def aggregate_by_region(x: SpatialExperiment, assay: str, matrix: str, statistic: str = "sum", by: str = "region") -> DataFrame:
    """(feature, region, value): sum, mean or count of an assay's cells over the observations that the map puts in a region."""
    e = x.experiments[assay]
    m = e.assays[matrix]
    names = e.sample_names().withColumnRenamed("name", "colname")
    where = x.spatial_map.where(F.col("assay") == assay).select("colname", F.col(by).alias("region")).dropna().distinct().join(names, "colname").select("sample", "region")
    sizes = where.groupBy("region").agg(F.count("*").alias("n"))
    got = m.cells.join(where, "sample").groupBy("feature", "region").agg(F.sum("value").alias("s"), F.count("*").alias("k"), F.count_if(F.col("value") != 0).alias("d"))
    grid = m.features.select("feature").crossJoin(sizes).join(got, ["feature", "region"], "left")
    rest = F.col("n") - F.coalesce("k", F.lit(0))
    total = F.coalesce("s", F.lit(0.0)) + rest * m.fill
    value = {"sum": total, "mean": total / F.col("n"), "count": F.coalesce("d", F.lit(0)) + rest * int(m.fill != 0)}[statistic]
    return grid.select("feature", "region", value.cast("double").alias("value"))


def filter_by_instances(layer: DataFrame, ids: DataFrame | Iterable | None) -> DataFrame:
    """Rows whose instance_id, as text, is among the ids; none without ids; all where the layer has no such column."""
    if "instance_id" not in layer.columns:
        return layer
    if ids is None:
        return layer.where("false")
    if not isinstance(ids, DataFrame):
        ids = layer.sparkSession.createDataFrame([(str(i),) for i in ids], "id string")
    return layer.join(ids.select(F.col(ids.columns[0]).cast("string").alias("__id")).distinct(), F.col("instance_id").cast("string") == F.col("__id"), "left_semi")


def extent(layers: Iterable[DataFrame], x: str = "x", y: str = "y") -> dict | None:
    """Least and largest coordinates over the layers."""
    out = None
    for layer in layers:
        one = layer.select(x, y)
        out = one if out is None else out.unionByName(one)
    return out.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max")).first().asDict() if out is not None else None


def read_layer(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet layer, lazily, whatever its size, with only the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_geo_layer(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """A geo-Parquet layer: its well-known-binary points, polygons and multipolygons as vertex arrays."""
    df = spark.read.parquet(path)
    return df.withColumn(geometry, G.wkb_polygons(geometry))
