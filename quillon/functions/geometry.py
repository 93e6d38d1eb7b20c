"""Planar predicates as column expressions. A polygon is an array of {x, y} vertices; borders belong to it. With holes it is its
rings one after another, each closed and followed by a vertex of nulls; no edge leads to or from such a vertex."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "array<struct<x:double,y:double>>"


def parse_wkt(text: str) -> list[tuple[float, float]]:
    """The outer ring of POLYGON ((x y, ...)), without its closing vertex."""
    m = re.fullmatch(r"\s*POLYGON\s*\(\(([^()]*)\)\s*\)\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError("a WKT polygon of one ring is needed")
    ring = [(float(x), float(y)) for x, y in (p.split()[:2] for p in m[1].split(","))]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def to_wkb(ring: list[tuple[float, float]]) -> bytes:
    """A polygon of one ring as well-known binary."""
    closed = [*ring, ring[0]]
    return struct.pack("<BIII", 1, 3, 1, len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed)


def from_wkb(data: bytes) -> np.ndarray:
    """Vertices (x, y) of a point, polygon or multipolygon in well-known binary. A point is one vertex; a polygon of one ring that ring,
    without its closing vertex; else all rings, each closed and followed by a vertex of nans, so that no edge leads on."""
    rings, at = [], 0

    def geometry() -> int:
        nonlocal at
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
        width = {0: 2, 1: 3, 2: 3, 3: 4}.get(kind // 1000 % 10)
        at += 5
        if kind & 0x20000000:  # an SRID follows
            at += 4
        if kind & 0xC0000000:
            width = 2 + (kind >> 31 & 1) + (kind >> 30 & 1)
        kind = kind & 0x0FFFFFFF & 0xFFFF
        kind %= 1000

        def vertices(n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, f"{order}f8", n * width, at).reshape(n, width)[:, :2].astype(float)
            at += 8 * n * width
            return out

        if kind == 1:
            rings.append(vertices(1))
        elif kind in (3, 6):
            (count,) = struct.unpack_from(f"{order}I", data, at)
            at += 4
            for _ in range(count):
                if kind == 6:
                    if geometry() != 3:
                        raise ValueError("a multipolygon holds polygons")
                    continue
                (n,) = struct.unpack_from(f"{order}I", data, at)
                at += 4
                rings.append(vertices(n))
        else:
            raise ValueError("a point, polygon or multipolygon is needed")
        return kind

    kind = geometry()
    rings = [r for r in rings if len(r)]
    if kind == 1 or not rings:
        return rings[0] if rings else np.zeros((0, 2))
    if len(rings) > 1:
        gap = np.full((1, 2), np.nan)
        return np.concatenate([part for r in rings for part in (r, r[:1] if (r[0] != r[-1]).any() else r[:0], gap)])
    ring = rings[0]
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def polygons_from_wkb(column: pa.Array) -> pa.Array:
    """The vertex arrays of well-known binary geometries; null for null."""
    found = [None if g is None else from_wkb(g) for g in column.to_pylist()]
    ends = np.cumsum([0, *(0 if f is None else len(f) for f in found)])
    flat = np.concatenate([np.zeros((0, 2)), *(f for f in found if f is not None)])
    gaps = np.isnan(flat).any(axis=1)
    x, y = (pa.array(flat[:, k], mask=gaps) for k in (0, 1))
    offsets = pa.array(ends.astype(np.int32), mask=np.array([*(f is None for f in found), False]))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([x, y], ["x", "y"]))


def wkb_polygons(column: str) -> Column:
    """A column of well-known binary as vertex arrays, an Arrow batch at a time."""

    @F.arrow_udf(POLYGON)
    def parse(geometry: pa.Array) -> pa.Array:
        return polygons_from_wkb(geometry)

    return parse(column)


def polygon(ring: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring)).cast(POLYGON)


def box(shape: Column) -> tuple[Column, Column, Column, Column]:
    """Least and largest x, least and largest y of a polygon."""
    xs, ys = F.transform(shape, lambda p: p["x"]), F.transform(shape, lambda p: p["y"])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def contains(shape: Column, x: Column, y: Column) -> Column:
    """Whether the point is in the polygon or on its border: the parity of crossings of a ray to the right."""
    n = F.size(shape)

    def edge(p: Column, i: Column) -> Column:
        q = F.element_at(shape, F.when(i == 0, n).otherwise(i).cast("int"))  # the vertex before
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        on = (cross == 0) & (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"])) & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))
        spans = (p["y"] > y) != (q["y"] > y)
        hit = spans & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"])
        return F.when(on, F.lit(1 << 20)).when(F.coalesce(hit, F.lit(False)), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.transform(shape, edge), F.lit(0), lambda a, b: a + b)
    return (hits >= 1 << 20) | (hits % 2 == 1)


def intersects(shape: Column, other: Column | list[tuple[float, float]]) -> Column:
    """Whether two polygons have a point in common: a vertex of one is in the other, or edges meet."""
    other = other if isinstance(other, Column) else polygon(other)
    (a, b, c, d), (e, f, g, h) = box(shape), box(other)
    boxed = (b >= e) & (a <= f) & (d >= g) & (c <= h)
    n, m = F.size(shape), F.size(other)

    def before(polygon: Column, size: Column, i: Column) -> Column:
        return F.element_at(polygon, F.when(i == 0, size).otherwise(i).cast("int"))

    def meets(p: Column, i: Column) -> Column:
        q = before(shape, n, i)

        def meet(r: Column, j: Column) -> Column:
            s = before(other, m, j)

            def side(u: Column, v: Column, w: Column) -> Column:
                return F.signum((v["x"] - u["x"]) * (w["y"] - u["y"]) - (v["y"] - u["y"]) * (w["x"] - u["x"]))

            apart = F.lit(False)
            for k in "xy":
                apart = apart | (F.greatest(p[k], q[k]) < F.least(r[k], s[k])) | (F.least(p[k], q[k]) > F.greatest(r[k], s[k]))
            whole = p["x"].isNotNull() & q["x"].isNotNull() & r["x"].isNotNull() & s["x"].isNotNull()
            return whole & ~apart & (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)

        return F.exists(F.transform(other, meet), lambda hit: F.coalesce(hit, F.lit(False)))

    def has_vertex_of(outer: Column, inner: Column) -> Column:
        return F.exists(inner, lambda v: v["x"].isNotNull() & F.coalesce(contains(outer, v["x"], v["y"]), F.lit(False)))

    cross = F.exists(F.transform(shape, meets), lambda hit: hit)
    return F.coalesce(boxed, F.lit(False)) & F.coalesce(has_vertex_of(other, shape) | has_vertex_of(shape, other) | cross, F.lit(False))
