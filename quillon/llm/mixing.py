"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells of (source, language, topic) by tokens, here words. Every value of a margin has a factor, and a
document is kept with probability min(1, product of the factors of its source, language and topic). Raking sets the factors
of one margin at a time so that the tokens expected from each of its values meet the target, caps included, and goes
round the margins until all of them do. So the sample's expected shares are the targets, not those before clipping. weight is
the probability over ``keep``: the ratio of a cell's expected to its counted share.

Targets: shares by value, for any of the margins. Shares that are not given are the counted tokens raised to ``temper``, but
no value gets more than its tokens: rare values stay whole and a hot one is held back. Where such shares contradict others
they move towards the counted ones, a quarter of the way at a time. A given share above what a value has makes the whole
sample smaller: ``keep`` is lowered to the most that every margin allows, and by further steps of a twentieth where the margins
together can't be met. ``Calibration`` reports targets, expected shares, the keep that was reached, rounds, and whether raking has
converged; if given targets contradict each other it has not, and a warning says so.

A topic stands in for a real one: it is the group, out of ``TOPICS``, that most words of the text hash to (ties: the smallest).
Give a column to use other topics. Sources and languages with less than ``SMALL`` of the tokens that no target names are raked as one
value, so that the cells stay few whatever the input. Draws are a hash of the id and the text, so a run can be repeated.

Nulls: a null source, language or topic is a value of its own; a null text has no words and topic 0. Cells without tokens have
weight 1. Repeated rows (same id, same text) share their fate. An empty table gives an empty result; further columns come back
unchanged.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

MARGINS = ("source", "lang", "topic")
TOPICS, TEMPER, KEEP = 8, 0.7, 0.8
#: Values of a margin with a smaller share of all tokens are raked as one.
SMALL = 1 / 1000
ROUNDS, TOLERANCE = 500, 1e-9
#: Cells up to which their weights are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CELLS = 200_000
_MOST = 1e30


# --- counting -------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in shared.regrouped(batches, "text"):
        one = chunk.combine_chunks().to_batches()[0]
        table = np.zeros((one.num_rows, TOPICS), np.int64)
        for row, data, starts in shared.pieces(one.column("text"), shared.CHUNK_BYTES):
            a, e = shared.word_spans(data)
            doc = np.searchsorted(starts, a, side="right") - 1
            group = (shared.span_hash(data, a, e) % np.uint64(TOPICS)).astype(np.int64)
            table[row : row + len(starts)] += np.bincount(doc * TOPICS + group, minlength=len(starts) * TOPICS).reshape(-1, TOPICS)
        yield pa.RecordBatch.from_arrays(
            [*(one.column(c) for c in ("doc_id", "text_hash", "source", "lang")), pa.array(table.argmax(axis=1).astype(str)) if "topic" not in one.schema.names else one.column("topic"), pa.array(table.sum(axis=1))],
            names=["doc_id", "text_hash", "source", "lang", "topic", "tokens"],
        )


def counted(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, text_hash, source, lang, topic and tokens of each row."""
    given = [] if topic is None else [topic.cast("string").alias("topic")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *given)
    return rows.mapInArrow(_counted, "doc_id long, text_hash long, source string, lang string, topic string, tokens long")


# --- raking ---------------------------------------------------------------------------------


def tempered(counts: np.ndarray, temper: float, keep: float) -> np.ndarray:
    """Target shares: counts raised to a power, none above what it has when keep of all tokens is kept."""
    counts = counts.astype(float)
    total = keep * counts.sum()
    if not total:
        return np.zeros(len(counts))
    raised = np.where(counts > 0, counts**temper, 0.0)
    scale = capped_scale(np.zeros(len(counts), np.int64), counts, np.divide(raised, counts, out=np.zeros(len(counts)), where=counts > 0), np.array([total]))[0]
    goal = np.minimum(counts, raised * scale)
    return goal / goal.sum()


def capped_scale(code: np.ndarray, tokens: np.ndarray, rate: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """For each code the f for which its cells' tokens * min(1, f * rate) sum to its goal; _MOST where all of them are too few."""
    order = np.lexsort((-rate, code))
    c, t, r = code[order], tokens[order], rate[order]
    first = np.searchsorted(c, np.arange(len(goal)))
    count = np.bincount(c, minlength=len(goal))
    # With the k cells of the highest rates at 1, the others share what is left of the goal.
    whole, scaled = np.cumsum(t) - t, np.cumsum(t * r) - t * r
    ends = np.minimum(first + count, len(c)) - 1
    last = np.where(count > 0, (scaled + t * r)[np.maximum(ends, 0)], 0.0) if len(c) else np.zeros(len(goal))
    base_whole, base_scaled = (np.where(count > 0, x[np.minimum(first, len(c) - 1)], 0.0) if len(c) else np.zeros(len(goal)) for x in (whole, scaled))
    left = goal[c] - (whole - base_whole[c])
    f = np.divide(left, last[c] - scaled, out=np.full(len(c), _MOST), where=last[c] - scaled > 0)
    fits = np.flatnonzero((f * r <= 1 + 1e-12) & (left >= 0) & (r > 0))
    out = np.full(len(goal), _MOST)
    found, at = np.unique(c[fits], return_index=True)
    out[found] = np.clip(f[fits[at]], 0.0, _MOST)
    return np.where(goal > 0, out, 0.0)


def raked(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, int, float]:
    """Probabilities of the cells for which the expected tokens of every margin's values meet their goals; rounds, and the
    largest miss as a share of all tokens."""
    factors, total = [np.ones(len(g)) for g in goals], max(float(tokens.sum()), 1.0)
    p, n, miss, before = np.ones(len(tokens)), 0, 0.0, np.inf
    for n in range(1, rounds + 1):
        for m, (code, goal) in enumerate(zip(codes, goals, strict=True)):
            factors[m] = capped_scale(code, tokens, _product(factors, codes, m), goal)
        p = np.minimum(1.0, _product(factors, codes))
        miss = max(float(np.abs(np.bincount(c, tokens * p, len(g)) - g).max(initial=0.0)) for c, g in zip(codes, goals, strict=True)) / total
        if miss <= tolerance:
            break
        if n % 50 == 0:
            if miss > before / 2:  # it gets no nearer
                break
            before = miss
    return p, n, miss


def _product(factors: list[np.ndarray], codes: list[np.ndarray], but: int = -1) -> np.ndarray:
    """Of the factors of each cell's values, for all margins but one."""
    out = np.ones(len(codes[0]))
    for k, (f, c) in enumerate(zip(factors, codes, strict=True)):
        if k != but:
            out = out * np.minimum(f, 1e12)[c]
    return out


@dataclass(frozen=True)
class Calibration:
    """cells: source, lang, topic, tokens, weight, probability. margins: margin, value, counted, target, expected (shares). keep:
    the expected share of all tokens in the sample."""

    cells: pd.DataFrame
    margins: pd.DataFrame
    keep: float
    rounds: int
    converged: bool


def calibrated(cells: pd.DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, keep: float = KEEP) -> Calibration:
    """Probabilities of cells (source, lang, topic, tokens). targets: by margin, shares by value (null: None)."""
    targets = targets or {}
    if unknown := set(targets) - set(MARGINS):
        raise ValueError(f"no margin {sorted(unknown)[0]!r}")
    tokens = cells["tokens"].to_numpy(float)
    total = tokens.sum()
    codes, values, wanted, counted_ = [], [], [], []
    for m in MARGINS:
        code, value = pd.factorize(cells[m], use_na_sentinel=False)
        value = [None if pd.isna(v) else v for v in value]
        has = np.bincount(code, tokens, len(value))
        own, named = has / total if total else has, np.full(len(value), np.nan)
        if m in targets:
            named = np.array([targets[m].get(v, np.nan) for v in value], float)
            if (given := sum(targets[m].values())) > 1 + 1e-9 or min(targets[m].values(), default=0.0) < 0:
                raise ValueError(f"shares of {m} must be 0 or more and add up to 1 at most")
        codes.append(code)
        values.append(value)
        shares = []
        for part in (tempered(has, temper, keep), own):
            rest = part[np.isnan(named)].sum()
            share = np.where(np.isnan(named), part * (max(0.0, 1 - np.nansum(named)) / rest if rest else 0.0), named)
            share = np.where(has > 0, share, 0.0)
            shares.append(share / share.sum() if share.sum() else share)
        wanted.append(shares[0])
        counted_.append(shares[1])
    p, rounds, miss, at, shares = np.ones(len(cells)), 0, 0.0, keep, wanted
    steps = [(0.25 * k, 1.0) for k in range(5)] + [(1.0, 0.95**k) for k in range(1, 60)]
    for to_counted, smaller in steps if total else []:
        shares = [(1 - to_counted) * w + to_counted * c for w, c in zip(wanted, counted_, strict=True)]
        at = smaller * min(keep, *(float((np.bincount(c, tokens, len(s))[s > 0] / (s[s > 0] * total)).min()) for c, s in zip(codes, shares, strict=True)))
        p, rounds, miss = raked(tokens, codes, [s * total * at for s in shares])
        if miss <= max(TOLERANCE, 1e-7 * at):
            break
    if not (converged := miss <= max(TOLERANCE, 1e-7 * at)):
        warnings.warn(f"targets can't be met together; expected shares miss them by {miss / at:.2g} at most", stacklevel=2)
    p = np.where(tokens > 0, p, at)
    cells = cells.assign(weight=p / at if at else 1.0, probability=p)
    kept = tokens * p
    rows = [(m, v, has / total if total else 0.0, t, e / kept.sum() if kept.sum() else 0.0) for m, code, value, share in zip(MARGINS, codes, values, shares, strict=True) for v, has, t, e in zip(value, np.bincount(code, tokens, len(value)), share, np.bincount(code, kept, len(value)), strict=True)]
    return Calibration(cells, pd.DataFrame(rows, columns=["margin", "value", "counted", "target", "expected"]), float(kept.sum() / total) if total else keep, rounds, converged)


# --- documents ------------------------------------------------------------------------------


def _draw() -> Column:
    """A number from 0 to 1 (exclusive) from the id and the text."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(4)), 11) / F.lit(float(1 << 53))


def _pooled(rows: DataFrame, margin: str, named: set, total: float) -> Column:
    """The value under which rows are raked: "=" and their own, "" for null, or "*" for all that are small."""
    held = rows.groupBy(margin).agg(F.sum("tokens").alias("n")).where(F.col("n") >= SMALL * total)
    large = {r[margin] for r in held.collect()} | named  # 1 / SMALL values and those that targets name
    own = F.when(F.col(margin).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(margin)))
    keys = F.array(*(F.lit("" if v is None else f"={v}") for v in sorted(large, key=str))) if large else F.array().cast("array<string>")
    return F.when(F.array_contains(keys, own), own).otherwise("*")


def calibration(rows: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, keep: float = KEEP) -> tuple[Calibration, DataFrame]:
    """That of counted() rows, and the rows with the values under which they are raked (columns r_<margin>)."""
    targets = {m: {None if v is None else str(v): float(s) for v, s in t.items()} for m, t in (targets or {}).items()}
    total = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    rows = rows.withColumns({f"r_{m}": _pooled(rows, m, set(targets.get(m, {})), total) for m in MARGINS})
    cells = rows.groupBy(*(f"r_{m}" for m in MARGINS)).agg(F.sum("tokens").alias("tokens")).toPandas()
    cells = cells.rename(columns={f"r_{m}": m for m in MARGINS}).sort_values(list(MARGINS)).reset_index(drop=True)
    marked = {m: {"" if v is None else f"={v}": s for v, s in t.items()} for m, t in targets.items()}
    return calibrated(cells, marked, temper, keep), rows


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """doc_id, text_hash, source, lang, topic, tokens, weight, probability and selected for each row. targets: shares of tokens
    by margin ("source", "lang", "topic") and value; keep: the share of all tokens that may stay at most."""
    with shared.small_batches(docs.sparkSession):
        rows = shared.written(counted(docs, topic), "mix-rows")
    plan, rows = calibration(rows, targets, temper, keep)
    schema = ", ".join(f"r_{m} string" for m in MARGINS)
    weights = docs.sparkSession.createDataFrame([tuple(r) for r in plan.cells[[*MARGINS, "weight", "probability"]].itertuples(index=False)], f"{schema}, weight double, probability double")
    out = rows.join(F.broadcast(weights) if len(plan.cells) <= BROADCAST_CELLS else weights, [f"r_{m}" for m in MARGINS]).drop(*(f"r_{m}" for m in MARGINS))
    return out.select("doc_id", "text_hash", *MARGINS, "tokens", "weight", "probability", (_draw() < F.col("probability")).alias("selected"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the draw keeps."""
    return shared.chosen_rows(docs, mixed(docs, **options).where("selected"))
