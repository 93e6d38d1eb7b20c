"""Whole packages: experiments written as a folder of Parquet tables with one manifest, and read back lazily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import geometry as G
from quillon.plans.containers import Experiment, MultiAssay
from quillon.plans.graph import Graph
from quillon.plans.matrix import SparseMatrix
from quillon.plans.spatial import SpatialExperiment
from quillon.sources import fields, files, manifest, metadata
from quillon.sources.writer import INDEX, NAME, label_image, positions, resource, write_embedding, write_graph, write_matrix, write_ranges, write_table

FEATURE, SAMPLE = "__feature__", "__sample__"
# Names of models.
SUMMARIZED, SINGLE_CELL, MULTI, SPATIAL, LIST = "summarized_experiment", "single_cell_experiment", "multi_assay_experiment", "multi_assay_spatial_experiment", "experiment_list"


# --- writing --------------------------------------------------------------------------------


def _axis_table(e: Experiment, axis: str, pos: DataFrame, path: str) -> dict:
    """The table of an axis: position, name and annotation; with genomic coordinates as ranges."""
    dim, names = getattr(e, f"{axis}s"), getattr(e, f"{axis}_names")()
    index = FEATURE if axis == "feature" else SAMPLE
    rest = [c for c in dim.columns if c not in (axis, "name")]
    df = dim.join(pos, axis).join(names.withColumnRenamed("name", NAME), axis).select(F.col("position").alias(index), NAME, *rest).sort(index)
    where = files.join(path, f"{axis}s")
    if axis == "feature" and {"start", "end"} <= set(rest) and {"seqname", "seqnames"} & set(rest):
        return write_ranges(df, where, f"{axis}s", axis, index_col=index)
    return write_table(df, where, f"{axis}s", axis, index_col=index) or {}


def write_experiment(e: Experiment, path: str, grid: Sequence[int] | None = None, write_manifest: bool = True) -> dict:
    """Write an experiment; returns its manifest. Assays are stored by sample, then feature; grid: (samples, features) of a block."""
    spark, e = e.features.sparkSession, e.unnested()
    pos = {axis: files.written(positions(getattr(e, f"{axis}s"), axis), "positions") for axis in ("feature", "sample")}
    refs = [{"fields": SAMPLE, "reference": {"resource": "samples", "fields": SAMPLE}}, {"fields": FEATURE, "reference": {"resource": "features", "fields": FEATURE}}]
    resources = [_axis_table(e, "feature", pos["feature"], path), _axis_table(e, "sample", pos["sample"], path)]
    for name, m in e.assays.items():
        resources.append(write_matrix(m, files.join(path, f"assay_{files.safe(name)}"), pos["feature"], pos["sample"], name, grid, refs) | ({"fill": m.fill} if m.fill else {}))

    def placed(df: DataFrame, axis: str) -> DataFrame:
        index = FEATURE if axis == "feature" else SAMPLE
        return df.join(pos[axis], axis).select(F.col("position").alias(index), *(c for c in df.columns if c != axis)).sort(index)

    for axis, member in (("feature", "loadings"), ("sample", "embeddings")):
        own = getattr(e, member)
        if own:
            df = None
            for name, t in own.items():
                one = placed(t.select(axis, F.col(next(c for c in t.columns if c != axis)).alias(name)), axis)
                df = one if df is None else df.join(one, FEATURE if axis == "feature" else SAMPLE)
            index = FEATURE if axis == "feature" else SAMPLE
            first, *_ = own
            resources.append(write_embedding(df, files.join(path, f"{axis}_embeddings"), f"{axis}_embeddings", axis, first, index_col=index))
    for name, alt in e.alternatives.items():
        made = write_experiment(alt, files.join(path, f"experiment_{files.safe(name)}"), grid)
        resources.append(resource(name, f"experiment_{files.safe(name)}", "crossed", "nested_experiment") | {"model": made["model"]})
    for axis, tables, graphs in (("feature", e.row_tables, e.row_graphs), ("sample", e.col_tables, e.col_graphs)):
        for name, t in tables.items():
            resources.append(write_table(placed(t, axis), files.join(path, f"{axis}_table_{files.safe(name)}"), name, axis, "nested_data_frame", index_col=FEATURE if axis == "feature" else SAMPLE))
        for name, g in graphs.items():
            resources.append(write_graph(g.edges, files.join(path, f"{axis}_graph_{files.safe(name)}"), name, axis, g.n_nodes))
    notes, extra = metadata.serialize(e.metadata, path)
    model = SINGLE_CELL if e.single_cell else SUMMARIZED
    return manifest.write_manifest(spark, model, [*resources, *extra], path, e.main_name, notes) if write_manifest else {"model": model, "resources": resources}


def write_tables(tables: dict[str, DataFrame], path: str) -> dict:
    """A package without a model: named tables."""
    spark = next(iter(tables.values())).sparkSession
    return manifest.write_manifest(spark, None, [write_table(t, files.join(path, f"unbound_{files.safe(n)}"), n) for n, t in tables.items()], path)


def _experiments(experiments: dict[str, Experiment], path: str) -> list[dict]:
    out = []
    for name, e in experiments.items():
        made = write_experiment(e, files.join(path, f"experiment_{files.safe(name)}"))
        out.append(resource(name, f"experiment_{files.safe(name)}", "crossed", "nested_experiment") | {"model": made["model"]})
    return out


def write_experiments(experiments: dict[str, Experiment], path: str) -> dict:
    spark = next(iter(experiments.values())).features.sparkSession
    return manifest.write_manifest(spark, LIST, _experiments(experiments, path), path)


def _multi_assay(x: MultiAssay, path: str) -> list[dict]:
    key = x.subjects.columns[0]
    subjects = x.subjects.withColumnRenamed(key, NAME).sort(NAME)
    sample_map = fields.categorical(x.sample_map.withColumn("assay", F.col("assay").cast("string")), "assay", list(x.experiments))
    refs = [{"fields": "primary", "reference": {"fields": NAME, "resource": "subjects"}}]
    return [
        *_experiments(x.experiments, path),
        write_table(subjects, files.join(path, "subjects"), "subjects", "sample"),
        write_table(sample_map, files.join(path, "sample_map"), "sample_map", refs=refs),
    ]


def write_multi_assay(x: MultiAssay, path: str) -> dict:
    notes, extra = metadata.serialize(x.metadata, path)
    return manifest.write_manifest(x.subjects.sparkSession, MULTI, [*_multi_assay(x, path), *extra], path, None, notes)


def _raster(spark: SparkSession, kind: str, name: str, ref: dict, path: str) -> dict:
    """A reference to a raster: its metadata as JSON; a local PNG is copied beside it."""
    import json

    where = files.join(path, kind, files.safe(name))
    ref = dict(ref)
    source = str(ref.get("path", ""))
    if source.endswith(".png") and files.exists(spark, source):
        files.copy(spark, source, files.join(where, source.rsplit("/", 1)[-1]))
        ref["path"] = source.rsplit("/", 1)[-1]
    files.write_text(spark, files.join(where, "metadata.json"), json.dumps(ref))
    return {"name": f"{kind}/{name}", "path": f"{kind}/{files.safe(name)}", "dimension": "unbound", "layout": "spatial_raster_ref", "format": "json", "mediatype": "application/json"}


def write_spatial(x: SpatialExperiment, path: str) -> dict:
    """A multi-assay package with layers, references to rasters, label images as coordinates, and the spatial map."""
    spark, resources = x.subjects.sparkSession, []
    for kind, layers in (("points", x.points), ("shapes", x.shapes)):
        for name, layer in layers.items():
            resources.append(write_table(layer, files.join(path, f"sample_{kind}_{files.safe(name)}"), name, "sample", f"spatial_{kind}"))
    for name, ref in x.images.items():
        resources.append(_raster(spark, "images", name, ref, path))
    for name, pixels in x.labels.items():
        if isinstance(pixels, DataFrame):
            resources.append(label_image(pixels, files.join(path, "labels", files.safe(name), "coord"), f"labels/{name}") | {"path": f"labels/{files.safe(name)}/coord"})
        else:
            resources.append(_raster(spark, "labels", name, pixels, path))
    if x.spatial_map is not None:
        resources.append(write_table(x.spatial_map, files.join(path, "spatial_map"), "spatial_map"))
    notes, extra = metadata.serialize({**x.metadata, **({"transforms": x.transforms} if x.transforms else {})}, path)
    return manifest.write_manifest(spark, SPATIAL, [*resources, *_multi_assay(x, path), *extra], path, None, notes)


def write_package(x, path: str, **options) -> dict:
    """Write whatever container it is."""
    for kind, write in ((SpatialExperiment, write_spatial), (MultiAssay, write_multi_assay), (Experiment, write_experiment)):
        if isinstance(x, kind):
            return write(x, path, **options)
    if isinstance(x, dict) and x:
        return (write_experiments if all(isinstance(v, Experiment) for v in x.values()) else write_tables)(x, path)
    raise TypeError(f"{type(x).__name__} can't be written as a package")


# --- reading --------------------------------------------------------------------------------


def read_resource(spark: SparkSession, path: str, r: dict):
    """A resource by its layout: a frame, a graph, an experiment, or a raster's reference."""
    where, layout = files.join(path, r["path"]), r.get("layout")
    if layout == "nested_experiment":
        return read_package(spark, where)
    if layout == "spatial_raster_ref":
        import json

        return json.loads(files.read_text(spark, files.join(where, "metadata.json")))
    if layout not in fields.LAYOUTS:
        raise ValueError(f"no layout {layout!r}")
    df = spark.read.parquet(where)
    schema = r.get("schema", {})
    if layout == "graph_edges":
        role = schema["graphEdges"]
        rest = [c for c in fields.roles(r)["data"] if c in df.columns]
        return Graph(df.select(F.col(role["from"]).alias("from"), F.col(role["to"]).alias("to"), *rest), int(role["nnode"]))
    if layout.startswith("genomic_ranges"):
        df = df.select(*(F.col(c).alias(next((role for role, own in schema.get("genomicCoords", {}).items() if own == c), c)) for c in df.columns))
    if layout == "transposed_data_frame":
        keys = [c for c in dict.fromkeys([*fields.roles(r)["keys"], INDEX, NAME]) if c in df.columns]
        values = [c for c in df.columns if c not in keys]
        df = df.unpivot(keys, values, "feature", "value")
    if layout == "spatial_shapes" and (geom := schema.get("spatialCoords", {}).get("geometry")) and dict(df.dtypes)[geom] == "binary":
        df = df.withColumn(geom, G.wkb_polygons(geom))
    return fields.with_fields(df, schema.get("fields", []))


def read_array(spark: SparkSession, path: str, r: dict, within: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """A coordinate table without its partition columns. within: least and largest key of axes; of a grid, only blocks that meet
    the range are read."""
    df = spark.read.parquet(files.join(path, r["path"]))
    parts = r["schema"].get("partitioning", [])
    for axis, (low, high) in (within or {}).items():
        group = next((p for p in parts if p in (f"{axis}_group", f"{axis}group__")), None)
        if group:
            extent = r.get("grid", {}).get(axis)
            if extent:
                df = df.where(F.col(group).between((low - 1) // extent + 1, (high - 1) // extent + 1))
        df = df.where(F.col(axis).between(low, high))
    return df.drop(*parts)


def _dim(df: DataFrame, index: str, axis: str) -> DataFrame:
    return df.select(F.col(index).alias(axis), *([F.col(NAME).alias("name")] if NAME in df.columns else []), *(c for c in df.columns if c not in (index, NAME)))


def _read_experiment(spark: SparkSession, path: str, m: dict) -> Experiment:
    by_name = {r["name"]: r for r in m["resources"] if r.get("dimension") in ("feature", "sample") and r["name"] in ("features", "samples")}
    features, samples = (_dim(read_resource(spark, path, by_name[f"{axis}s"]), index, axis) for axis, index in (("feature", FEATURE), ("sample", SAMPLE)))
    out = Experiment(features, samples, main_name=m.get("main_exp_name"))
    refs = set()

    def load(name: str) -> DataFrame:
        refs.add(name)
        r = next(x for x in m["resources"] if x["name"] == name)
        return read_resource(spark, path, r).drop(INDEX)

    out.metadata = metadata.deserialize(m.get("annotations"), load)
    for r in m["resources"]:
        name, dimension, layout = r["name"], r.get("dimension"), r.get("layout")
        axis, index = ("feature", FEATURE) if dimension == "feature" else ("sample", SAMPLE)
        if layout == "coord_array":
            cells = read_array(spark, path, r).select(F.col(FEATURE).alias("feature"), F.col(SAMPLE).alias("sample"), "value")
            out.assays[name] = SparseMatrix(cells, features, samples, float(r.get("fill", 0.0)))
        elif layout == "nested_experiment":
            out.alternatives[name] = read_resource(spark, path, r)
        elif layout == "embedding_table":
            df = read_resource(spark, path, r).withColumnRenamed(index, axis)
            members = out.loadings if dimension == "feature" else out.embeddings
            for c in df.columns:
                if c not in (axis, INDEX, NAME):
                    members[c] = df.select(axis, F.col(c).alias("embedding"))
        elif layout == "nested_data_frame":
            (out.row_tables if dimension == "feature" else out.col_tables)[name] = read_resource(spark, path, r).withColumnRenamed(index, axis)
        elif layout == "graph_edges":
            (out.row_graphs if dimension == "feature" else out.col_graphs)[name] = read_resource(spark, path, r)
    return out


def _parts(spark: SparkSession, path: str, m: dict) -> dict:
    by = {r["name"]: r for r in m["resources"]}
    subjects = read_resource(spark, path, by["subjects"]).drop(INDEX).withColumnRenamed(NAME, "subject")
    sample_map = read_resource(spark, path, by["sample_map"]).drop(INDEX)
    experiments = {r["name"]: read_resource(spark, path, r) for r in m["resources"] if r.get("layout") == "nested_experiment"}
    notes = metadata.deserialize(m.get("annotations"), lambda n: read_resource(spark, path, by[n]).drop(INDEX))
    return {"experiments": experiments, "subjects": subjects, "sample_map": sample_map, "metadata": notes}


def _read_spatial(spark: SparkSession, path: str, m: dict) -> SpatialExperiment:
    parts = _parts(spark, path, m)
    out = SpatialExperiment(**parts, transforms=parts["metadata"].pop("transforms", {}))
    for r in m["resources"]:
        name, layout = r["name"], r.get("layout")
        if layout in ("spatial_points", "spatial_shapes"):
            (out.points if layout == "spatial_points" else out.shapes)[name] = read_resource(spark, path, r).drop(INDEX)
        elif layout in ("spatial_raster_ref", "spatial_label_coord"):
            kind, _, short = name.partition("/")
            (out.images if kind == "images" else out.labels)[short] = read_resource(spark, path, r)
        elif name == "spatial_map":
            out.spatial_map = read_resource(spark, path, r).drop(INDEX)
    return out


def read_package(spark: SparkSession, path: str, model: str | None = None):
    """A package as the container that its model names; without a model, its tables by name. Nothing but the manifest is read."""
    m = manifest.read_manifest(spark, path)
    model = model or m.get("model")
    if model in (SUMMARIZED, SINGLE_CELL):
        return _read_experiment(spark, path, m)
    if model == MULTI:
        return MultiAssay(**_parts(spark, path, m))
    if model == SPATIAL:
        return _read_spatial(spark, path, m)
    if model == LIST:
        return {r["name"]: read_resource(spark, path, r) for r in m["resources"]}
    if model is None:
        return {r["name"]: read_resource(spark, path, r) for r in m["resources"] if r.get("layout")}
    raise ValueError(f"no model {model!r}")
