"""Metadata of a package: plain values in the manifest, tables beside it as resources of their own."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession

from quillon.sources import files
from quillon.sources.writer import write_table

TYPE, TABLE, NESTED = "__type__", "parquet_ref", "nested_mapping"


def _plain(value) -> bool:
    try:
        json.dumps(value)
    except (TypeError, ValueError):
        return False
    return True


def _serialized(value, path: str, name: str, resources: list[dict]):
    """(value for the manifest, whether it has tables); raises TypeError for what can't be kept."""
    if hasattr(value, "columns") and hasattr(value, "to_dict") and not isinstance(value, DataFrame):  # a pandas frame
        value = SparkSession.active().createDataFrame(value)
    if isinstance(value, DataFrame):
        resources.append(write_table(value, files.join(path, f"unbound_{files.safe(name)}"), name))
        return {TYPE: TABLE, "resource": name}, True
    if isinstance(value, dict):
        children, tables = {}, False
        for k, v in value.items():
            try:
                children[str(k)], t = _serialized(v, path, f"{name}__{k}", resources)
                tables |= t
            except TypeError as e:
                warnings.warn(f"metadata {name}.{k} is left out: {e}", stacklevel=3)
        return ({TYPE: NESTED, **children} if tables else children), tables
    if _plain(value):
        return value, False
    if hasattr(value, "isoformat"):
        return value.isoformat(), False
    if hasattr(value, "tolist"):
        return _serialized(value.tolist(), path, name, resources)
    raise TypeError(f"{type(value).__name__} can't be written")


def serialize(metadata: dict, path: str) -> tuple[dict | None, list[dict]]:
    """Annotations and the resources that they refer to; what can't be kept is left out with a warning."""
    annotations, resources = {}, []
    for name, value in metadata.items():
        try:
            annotations[name], _ = _serialized(value, path, name, resources)
        except TypeError as e:
            warnings.warn(f"metadata {name} is left out: {e}", stacklevel=2)
    return annotations or None, resources


def deserialize(annotations: dict | None, load) -> dict:
    """The metadata, with tables in their places. load: a resource's frame by name."""

    def value(v):
        if isinstance(v, dict):
            if v.get(TYPE) == TABLE:
                return load(v["resource"])
            return {k: value(x) for k, x in v.items() if k != TYPE}
        return v

    return {k: value(v) for k, v in (annotations or {}).items()}
