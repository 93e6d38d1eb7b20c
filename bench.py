"""Headline operations on the sales matrix; prints one line of JSON with seconds by operation.

BENCH_SF_DIR: the tables (default sf0.1). BENCH_CPUS: threads (default 8). Each result is consumed whole by a sink that keeps
nothing; normalised counts too, which are lazy. The cells are written once and read by all operations, as from a package. The two
operations whose name begins with poisson run on the published benchmark's input: 5000 x 5000 Poisson(0.2) counts, four groups (12
ordered pairs).
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillon import catalogue  # noqa: E402
from quillon.operators import aggregate, correlate, markers, normalize, qc, variance  # noqa: E402
from quillon.plans.matrix import SparseMatrix  # noqa: E402
from quillon.sources import files  # noqa: E402


def poisson(spark: SparkSession, n: int = 5000, rate: float = 0.2) -> tuple[SparseMatrix, DataFrame]:
    """Counts by the inverse of the distribution function, and groups of equal size."""
    cells = spark.range(0, n * n, numPartitions=64).select((F.col("id") / n).cast("int").alias("feature"), (F.col("id") % n).cast("int").alias("sample"), F.rand(7).alias("u"))
    value, below, term = F.lit(0), 0.0, math.exp(-rate)
    for k in range(1, 12):
        below += term
        value = F.when(F.col("u") >= below, float(k)).otherwise(value)
        term *= rate / k
    axis = spark.range(n).select(F.col("id").cast("int").alias("feature"))
    samples = axis.withColumnRenamed("feature", "sample")
    cells = cells.select("feature", "sample", value.cast("double").alias("value")).where("value > 0")
    return SparseMatrix(files.written(cells, "bench"), files.written(axis, "bench"), files.written(samples, "bench")), files.written(samples.withColumn("group", F.col("sample") % 4), "bench")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lazy = catalogue.sales(spark, d)
    m = SparseMatrix(files.written(lazy.cells, "bench"), files.written(lazy.features, "bench"), files.written(lazy.samples, "bench"))
    groups = files.written(catalogue.regions(spark, d), "bench")
    logs = normalize.normalized(m)
    logs = SparseMatrix(files.written(logs.cells, "bench"), m.features, m.samples)
    top = logs.subset(features=files.written(variance.top_variable(variance.model_gene_var(logs), 200), "bench"))
    counts, four = poisson(spark)
    operations = {
        "per_cell_qc": lambda: qc.per_sample_qc(m),
        "per_feature_qc": lambda: qc.per_feature_qc(m),
        "summarize_by_group": lambda: aggregate.summarize_by_group(m, groups, ["sum"]),
        "normalize_counts": lambda: normalize.normalized(m).cells,
        "model_gene_var": lambda: variance.model_gene_var(logs),
        "correlate_pairs_200": lambda: correlate.correlate_pairs(top),
        "pairwise_t_tests": lambda: markers.pairwise_t_tests(logs, groups),
        "find_markers": lambda: markers.find_markers(logs, groups),
        "score_markers": lambda: markers.score_markers(logs, groups),
        "score_markers_exact_auc": lambda: markers.score_markers(logs, groups, true_auc=True),
        "poisson_score_markers": lambda: markers.score_markers(counts, four),
        "poisson_score_markers_exact_auc": lambda: markers.score_markers(counts, four, true_auc=True),
    }
    seconds = {}
    for name, make in operations.items():
        took = []
        for _ in range(2):  # the first run also compiles
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(min(took), 3)
    print(json.dumps({"metric": "matrix_operations_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
