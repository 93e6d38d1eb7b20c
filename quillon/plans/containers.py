"""Experiments: matrices of the same shape with the tables that describe their axes; and lists of experiments."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.graph import Graph
from quillon.plans.matrix import SparseMatrix

#: Members keyed by an axis: its name, and whether they are graphs.
MEMBERS = {"loadings": "feature", "row_tables": "feature", "row_graphs": "feature", "embeddings": "sample", "col_tables": "sample", "col_graphs": "sample"}


class Members(dict):
    """Frames by name, keyed by an axis: they have its key as a column and are replaced by name or place."""

    def __init__(self, axis: str, items: dict | None = None):
        super().__init__()
        self.axis = axis
        for name, value in (items or {}).items():
            self[name] = value

    def __setitem__(self, name: str | int, value: DataFrame | Graph) -> None:
        if isinstance(name, int):
            name = self.names[name] if name < len(self) else f"unnamed{name + 1}"
        if not isinstance(value, Graph) and self.axis not in value.columns:
            raise ValueError(f"a member needs a column {self.axis!r}")
        super().__setitem__(name, value)

    def __getitem__(self, name: str | int):
        return super().__getitem__(self.names[name] if isinstance(name, int) else name)

    @property
    def names(self) -> list[str]:
        return list(self)

    def renamed(self, names: list[str]) -> Members:
        if len(names) != len(self) or len(set(names)) != len(names):
            raise ValueError("as many different names as members are needed")
        return Members(self.axis, dict(zip(names, self.values(), strict=True)))


@dataclass
class Experiment:
    """features, samples: frames whose first columns are the keys feature and sample; a column name labels them. assays: matrices
    over these keys. loadings, embeddings: (key, array); row_tables, col_tables: any frames; row_graphs, col_graphs:
    graphs over positions; alternatives: experiments with the same samples."""

    features: DataFrame
    samples: DataFrame
    assays: dict[str, SparseMatrix] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    loadings: Members = None
    embeddings: Members = None
    row_tables: Members = None
    col_tables: Members = None
    row_graphs: Members = None
    col_graphs: Members = None
    alternatives: dict[str, Experiment] = field(default_factory=dict)
    main_name: str | None = None

    def __post_init__(self):
        for name, axis in MEMBERS.items():
            own = getattr(self, name)
            if not isinstance(own, Members):
                setattr(self, name, Members(axis, own))

    @property
    def single_cell(self) -> bool:
        """Whether it has more than assays and tables of axes."""
        return bool(self.alternatives or self.main_name or any(getattr(self, m) for m in MEMBERS))

    def feature_names(self) -> DataFrame:
        return _names(self.features, "feature")

    def sample_names(self) -> DataFrame:
        return _names(self.samples, "sample")

    def set_member(self, member: str, name: str | int, value: DataFrame | Graph) -> Experiment:
        """A copy with a member set; frames must have a row for each key of their axis. Edges given as a frame become a graph."""
        axis = MEMBERS[member]
        dim = getattr(self, f"{axis}s")
        if member.endswith("graphs") and isinstance(value, DataFrame):
            value = Graph(value, dim.count())
        if member in ("loadings", "embeddings"):
            if value.count() != dim.count():
                raise ValueError(f"as many rows as {axis}s are needed")
            if value.join(dim, axis, "left_anti").take(1):
                warnings.warn(f"{member} {name!r} has other {axis}s", stacklevel=2)
        own = Members(axis, getattr(self, member))
        own[name] = value
        return replace(self, **{member: own})

    def _subset(self, axis: str, keys: DataFrame) -> Experiment:
        dim = getattr(self, f"{axis}s")
        left = dim.join(keys, axis, "left_semi")
        changed: dict = {f"{axis}s": left, "assays": {n: m.subset(**{f"{axis}s": keys}) for n, m in self.assays.items()}}
        for name, own in MEMBERS.items():
            members = getattr(self, name)
            if own != axis or not members:
                continue
            if name.endswith("graphs"):
                changed[name] = Members(axis, {n: g.subset(_kept_positions(dim, left, axis)) for n, g in members.items()})
            else:
                changed[name] = Members(axis, {n: t.join(keys, axis, "left_semi") for n, t in members.items()})
        if axis == "sample":
            changed["alternatives"] = {n: e._subset(axis, keys) for n, e in self.alternatives.items()}
        return replace(self, **changed)

    def subset_features(self, chosen) -> Experiment:
        """Of everything keyed by features only the chosen ones: a condition, a frame (feature) or (name), or a list of keys."""
        return self._subset("feature", _keys(self.features, self.feature_names(), "feature", chosen))

    def subset_samples(self, chosen) -> Experiment:
        return self._subset("sample", _keys(self.samples, self.sample_names(), "sample", chosen))

    def unnested(self) -> Experiment:
        """Struct columns of the tables of axes as tables of their own."""
        out = self
        for axis, member in (("feature", "row_tables"), ("sample", "col_tables")):
            dim = getattr(out, f"{axis}s")
            for f in dim.schema:
                if isinstance(f.dataType, T.StructType):
                    out = out.set_member(member, f.name, dim.select(axis, f"{f.name}.*"))
                    out = replace(out, **{f"{axis}s": getattr(out, f"{axis}s").drop(f.name)})
        return out


@dataclass
class MultiAssay:
    """experiments by name; subjects: a frame (subject, ...); sample_map: (assay, primary, colname), which experiment's column is
    which subject's."""

    experiments: dict[str, Experiment]
    subjects: DataFrame
    sample_map: DataFrame
    metadata: dict = field(default_factory=dict)

    def subset_subjects(self, subjects: DataFrame) -> MultiAssay:
        """Only the chosen subjects, and the columns of experiments that are theirs."""
        key = self.subjects.columns[0]
        keys = subjects.select(F.col(subjects.columns[0]).alias(key)).distinct()
        left = self.sample_map.join(keys, self.sample_map["primary"] == keys[key], "left_semi")
        experiments = {n: e.subset_samples(left.where(F.col("assay") == n).select(F.col("colname").alias("name"))) for n, e in self.experiments.items()}
        return replace(self, subjects=self.subjects.join(keys, key, "left_semi"), sample_map=left, experiments=experiments)


def _names(dim: DataFrame, axis: str) -> DataFrame:
    return dim.select(axis, (F.col("name") if "name" in dim.columns else F.col(axis)).cast("string").alias("name"))


def _keys(dim: DataFrame, names: DataFrame, axis: str, chosen) -> DataFrame:
    if isinstance(chosen, DataFrame):
        if axis in chosen.columns:
            return chosen.select(axis).distinct()
        return names.join(chosen.select("name").distinct(), "name", "left_semi").select(axis)
    if isinstance(chosen, (list, tuple, range)):
        kind = dim.schema[axis].dataType.simpleString()
        return dim.sparkSession.createDataFrame([(k,) for k in sorted(set(chosen))], f"{axis} {kind}")
    return dim.where(chosen).select(axis)


def _kept_positions(dim: DataFrame, left: DataFrame, axis: str) -> DataFrame:
    """(node, position): places of the keys that are left among all, and among themselves."""
    from quillon.sources.writer import positions

    before = positions(dim, axis).withColumnRenamed("position", "node")
    return before.join(positions(left, axis), axis).select("node", "position")
