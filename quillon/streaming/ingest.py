"""Incremental ingest: resources pulled block by block, and a Structured Streaming sink that writes numbered parts."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.sources import files
from quillon.sources.writer import INDEX, NAME, write_table

#: Rows beyond which an index needs 64 bits.
WIDE = 2**31 - 1


def write_blocks(
    blocks: Callable[[int], DataFrame | None] | Iterable[DataFrame | None], path: str, name: str | None = None, dimension: str = "unbound", layout: str = "data_frame", index_col: str = INDEX,
    key_col: str = NAME, dimension_table: DataFrame | None = None, expected_rows: int | None = None, index_max: int | None = None, offset: int = 0, digits: int = 6,
    cluster_by: str | Sequence[str] | None = None, cluster_columns: Sequence[str] = (), refs: list | None = None,
) -> dict | None:
    """Write blocks as numbered parts of one table with a running row index. blocks: i -> frame, None at the end; or frames. Empty blocks
    take no number. Rows other than those of the dimension table are an error; other than expected_rows a warning. Returns
    the first part's descriptor with n_rows, or None without rows."""
    if index_max is not None and offset > index_max:
        raise ValueError("rows start beyond index_max")
    pull = blocks if callable(blocks) else (lambda it: lambda i: next(it, None))(iter(blocks))
    first, part, rows, i = None, 0, 0, 0
    while (block := pull(i)) is not None:
        i += 1
        block = files.written(block, "block")  # computed once: what is counted is what is written
        n = block.count()
        if not n:
            continue
        if part == 1 and index_max is None and rows < 65_536:
            warnings.warn("a small first part and no index_max: later parts may need a wider index", stacklevel=2)
        if index_max is not None and offset + rows + n > index_max:
            raise ValueError("more rows than index_max")
        made = write_table(block, path, name, dimension, layout, index_col, key_col, refs=refs, append=part > 0, offset=offset + rows, part=part, digits=digits, cluster_by=cluster_by, cluster_columns=cluster_columns)
        first = first or made
        part += 1
        rows += n
    if dimension_table is not None and (wanted := dimension_table.count()) != rows:
        raise ValueError(f"misaligned: {rows} rows for a dimension table of {wanted}")
    if expected_rows is not None and expected_rows != rows:
        warnings.warn(f"{rows} rows, {expected_rows} expected", stacklevel=2)
    return None if first is None else first | {"n_rows": rows}


def parts_sink(path: str, index_col: str | None = None, digits: int = 6) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: micro-batch k becomes part k. A batch that is delivered again replaces its own part, so that each
    row is written once. Without an index column rows get none: a stream has no running count."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"part-{batch_id:0{digits}d}"
        temp = files.join(path, f".writing-{name}")
        batch.write.mode("overwrite").option("compression", "zstd").parquet(temp)
        for f in files.listed(spark, path):
            if f.startswith(f"{name}-"):
                files.remove(spark, files.join(path, f))
        for k, f in enumerate(sorted(x for x in files.listed(spark, temp) if x.endswith(".parquet"))):
            files.move(spark, files.join(temp, f), files.join(path, f"{name}-{k:05d}.parquet"))
        files.remove(spark, temp)

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a stream into numbered parts; with once, until what is there has been read."""
    writer = stream.writeStream.foreachBatch(parts_sink(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
