"""Logical field types of a manifest, from Spark schemas and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of manifests.
DIMENSIONS = ("feature", "sample", "crossed", "unbound")
LAYOUTS = (
    "coord_array", "data_frame", "transposed_data_frame", "embedding_table", "genomic_ranges", "genomic_ranges_list", "graph_edges",
    "spatial_points", "spatial_shapes", "spatial_raster_ref", "spatial_label_coord", "nested_data_frame", "nested_experiment",
)
SPATIAL_ROLES = ("x", "y", "z", "instance_id", "geometry")
GEOMETRY_NAMES = ("geometry", "geom", "wkb")
GENOMIC_ROLES = {"seqname": ("seqname", "seqnames"), "start": ("start",), "end": ("end",), "strand": ("strand",)}

_INTEGERS = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64"}
_CASTS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}


def field_type(t: T.DataType) -> dict:
    """The logical type of a column."""
    if isinstance(t, T.BooleanType):
        return {"type": "boolean"}
    if type(t) in _INTEGERS:
        return {"type": "integer", "arrowType": _INTEGERS[type(t)]}
    if isinstance(t, T.DecimalType) and t.scale == 0:
        return {"type": "integer", "arrowType": "uint64" if t.precision == 20 else "int64"}
    if isinstance(t, T.FractionalType):
        return {"type": "number"}
    if isinstance(t, T.StringType):
        return {"type": "string"}
    if isinstance(t, T.DateType):
        return {"type": "date"}
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "datetime"}
    if isinstance(t, T.DayTimeIntervalType):
        return {"type": "duration"}
    if isinstance(t, T.BinaryType):
        return {"type": "string", "format": "binary"}
    if isinstance(t, T.ArrayType):
        item = field_type(t.elementType)["type"]
        return {"type": "array", "arrayItem": {"type": item}} if item in ("boolean", "integer", "number", "string") else {"type": "any"}
    return {"type": "any"}


def field(f: T.StructField) -> dict:
    """A manifest field: name, type, and from the column's metadata its categories and constraints."""
    out = {"name": f.name, **field_type(f.dataType)}
    for key in ("categories", "categoriesOrdered", "constraints"):
        if key in (f.metadata or {}):
            out[key] = f.metadata[key]
    return out


def categorical(df: DataFrame, column: str, levels: Sequence[str], ordered: bool = False) -> DataFrame:
    """df with the levels of a string column kept in its metadata."""
    return df.withMetadata(column, {"categories": list(levels), "categoriesOrdered": ordered})


def with_fields(df: DataFrame, fields: Sequence[dict]) -> DataFrame:
    """df with categories of manifest fields put back into the columns' metadata."""
    for f in fields:
        if f["name"] in df.columns and f.get("categories") and all(isinstance(c, str) for c in f["categories"]):
            df = categorical(df, f["name"], f["categories"], bool(f.get("categoriesOrdered")))
    return df


def cast_to(f: dict, column: Column) -> Column:
    """The column cast to a manifest field's physical type."""
    if f["type"] == "integer" and f.get("arrowType") in _CASTS:
        return column.cast(_CASTS[f["arrowType"]])
    plain = {"boolean": "boolean", "integer": "bigint", "number": "double", "string": "string", "date": "date", "datetime": "timestamp"}
    if f["type"] == "array":
        return column.cast(f"array<{plain[f['arrayItem']['type']]}>")
    if f.get("format") == "binary":
        return column.cast("binary")
    return column.cast(plain[f["type"]]) if f["type"] in plain else column


def constraints(role: str) -> dict:
    """What values of a role must satisfy."""
    return {
        "start": {"required": True, "minimum": 1}, "end": {"required": True, "minimum": 1}, "strand": {"enum": ["+", "-", "*"]},
        "seqname": {"required": True}, "percent": {"minimum": 0, "maximum": 100}, "count": {"minimum": 0}, "index": {"minimum": 0},
    }.get(role, {})


def violations(df: DataFrame, fields: Sequence[dict]) -> DataFrame:
    """(field, n): rows that break the constraints of a field."""
    broken = []
    for f in fields:
        c, rules = F.col(f"`{f['name']}`"), f.get("constraints", {})
        bad = F.lit(False)
        if rules.get("required"):
            bad = bad | c.isNull()
        for key, wrong in (("minimum", lambda v: c < v), ("maximum", lambda v: c > v), ("enum", lambda v: ~c.isin(v))):  # noqa: B023
            if key in rules:
                bad = bad | F.coalesce(wrong(rules[key]), F.lit(False))
        if rules:
            broken.append(F.struct(F.lit(f["name"]).alias("field"), F.count_if(bad).alias("n")))
    if not broken:
        return df.sparkSession.createDataFrame([], "field string, n long")
    return df.agg(F.array(*broken).alias("all")).select(F.explode("all").alias("one")).select("one.*").where("n > 0")


def geometry_column(df: DataFrame) -> str | None:
    return next((f.name for f in df.schema if f.name in GEOMETRY_NAMES and isinstance(f.dataType, (T.BinaryType, T.ArrayType))), None)


def table_schema(df: DataFrame, layout: str, index_col: str | None, key_col: str | None, partitioning: Sequence[str] = (), refs: list | None = None, n_nodes: int | None = None) -> dict:
    """The schema part of a resource: fields and roles."""
    roles = {name: role for role, names in GENOMIC_ROLES.items() for name in names} if layout.startswith("genomic_ranges") else {}
    fields = [field(f) | ({"constraints": rules} if layout == "genomic_ranges" and (rules := constraints(roles.get(f.name, ""))) else {}) for f in df.schema]
    out: dict = {"fields": fields}
    if index_col in df.columns:
        out["sortOrder"] = [{"field": index_col, "direction": "ascending"}]
    if key := next((c for c in (key_col, index_col) if c and c in df.columns), None):
        out["primaryKey"] = key
    if refs:
        out["foreignKeys"] = refs
    if partitioning:
        out["partitioning"] = list(partitioning)
    if layout in ("spatial_points", "spatial_shapes"):
        coords = {r: r for r in SPATIAL_ROLES if r in df.columns}
        if geom := geometry_column(df):
            coords["geometry"] = geom
        if coords:
            out["spatialCoords"] = coords
    if layout.startswith("genomic_ranges"):
        out["genomicCoords"] = {role: next(n for n in names if n in df.columns) for role, names in GENOMIC_ROLES.items() if any(n in df.columns for n in names)}
    if layout == "graph_edges":
        out["graphEdges"] = {"from": "from", "to": "to", "nnode": n_nodes}
    return out


def roles(resource: dict) -> dict[str, list[str]]:
    """Columns of a resource by role: keys, and data (what isn't a key, partition, or coordinate)."""
    schema = resource.get("schema", {})
    primary = schema.get("primaryKey")
    if schema.get("sortOrder"):
        keys = [schema["sortOrder"][0]["field"]]
    elif primary:
        keys = [primary]
    else:
        keys = [k["fields"] for k in schema.get("foreignKeys", [])]
    taken = {*keys, primary, *schema.get("partitioning", []), *schema.get("genomicCoords", {}).values(), *(schema.get("graphEdges", {}).get(k) for k in ("from", "to"))}
    return {"keys": keys, "data": [f["name"] for f in schema.get("fields", []) if f["name"] not in taken]}
