"""The JSON manifest of a package: one file that names its resources and how they fit together."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from quillon.sources import files

FILE = "datapackage.json"
PROFILE = "https://datapackage.org/profiles/2.0/datapackage.json"


def checked(resources: list[dict | None]) -> list[dict]:
    """The resources without missing ones; names and paths must be strings, and names unique."""
    out = [r for r in resources if r is not None]
    for r in out:
        if not all(isinstance(r.get(k), str) and r[k] for k in ("name", "path")):
            raise ValueError("a resource needs a name and a path")
    names = [r["name"] for r in out]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"resource names must be unique: {', '.join(twice)}")
    return out


def write_manifest(spark: SparkSession, model: str | None, resources: list[dict | None], path: str, main_exp_name: str | None = None, annotations: dict | None = None) -> dict:
    """Write the manifest into the package's folder and return it."""
    out: dict = {"$schema": PROFILE}
    for key, value in (("model", model), ("main_exp_name", main_exp_name), ("annotations", annotations)):
        if value is not None:
            out[key] = value
    out["resources"] = checked(resources)
    files.write_text(spark, files.join(path, FILE), json.dumps(out, indent=2, default=str))
    return out


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(files.read_text(spark, files.join(path, FILE)))


def select(manifest: dict, dimension: str | None = None, layout: str | None = None) -> list[dict]:
    """Resources of a dimension and a layout; those without a layout (references) only if none is asked for."""
    return [r for r in manifest["resources"] if (dimension is None or r.get("dimension") == dimension) and (layout is None or r.get("layout") == layout)]
