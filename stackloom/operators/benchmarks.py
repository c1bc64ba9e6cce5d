"""Runs of benchmark suites compared: roll-ups over runs, overhead against a baseline, averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.callstack import percentage

# Programs whose process counts must be squares, and the scales of both kinds (fixed values of the suite).
SQUARE_PROGRAMS = ("bt", "sp")
SCALES = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
SQUARE_SCALES = (1, 4, 9, 16, 36, 64, 121, 256, 484)


def select_runs(runs: DataFrame, programs=None, klass: str | None = None, scales=SCALES, square_scales=SQUARE_SCALES) -> DataFrame:
    """runs (benchmark, class, num_processes) of the programs and class asked for, at the scales that a program allows."""
    out = runs
    if programs is not None:
        out = out.where(F.col("benchmark").isin(*programs))
    if klass is not None:
        out = out.where(F.col("class") == klass)
    return out.where(F.when(F.col("benchmark").isin(*SQUARE_PROGRAMS), F.col("num_processes").isin(*square_scales)).otherwise(F.col("num_processes").isin(*scales)))


def rollup_hotspots(hotspots: DataFrame) -> DataFrame:
    """Functions over many runs: samples added up and their shares of the samples of all runs.

    hotspots: run_id, total_samples (of the run), function_name, library_name, exclusive_samples, inclusive_samples.
    """
    total = hotspots.select("run_id", "total_samples").distinct().agg(F.sum("total_samples").alias("all_samples"))
    by = hotspots.groupBy("function_name").agg(F.min("library_name").alias("library_name"), F.sum("exclusive_samples").alias("exclusive_samples"), F.sum("inclusive_samples").alias("inclusive_samples"), F.countDistinct("run_id").alias("runs"))
    return by.crossJoin(F.broadcast(total)).select("function_name", "library_name", "exclusive_samples", "inclusive_samples", "runs", percentage(F.col("exclusive_samples"), F.col("all_samples")).alias("exclusive_percentage"), percentage(F.col("inclusive_samples"), F.col("all_samples")).alias("inclusive_percentage"))


def baseline_times(runs: DataFrame, running: bool = False) -> DataFrame:
    """Baseline seconds by (benchmark, class, num_processes): the mean over iterations.

    running=True folds iterations in order as (old + new) / 2 instead, which weighs later ones more.
    """
    keys = ["benchmark", "class", "num_processes"]
    if not running:
        return runs.groupBy(*keys).agg(F.avg("execution_time_sec").alias("baseline_time_sec"))
    times = F.transform(F.array_sort(F.collect_list(F.struct("iteration", "execution_time_sec"))), lambda x: x["execution_time_sec"])
    folded = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.element_at("t", 1), lambda a, x: (a + x) / 2)
    return runs.groupBy(*keys).agg(times.alias("t")).select(*keys, folded.alias("baseline_time_sec"))


def overhead(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """runs with baseline_time_sec and overhead_percent: quotient cut at 4 decimals, then 2; null where a time is 0."""
    out = runs.join(baseline, ["benchmark", "class", "num_processes"], "left")
    t, b = F.col("execution_time_sec"), F.col("baseline_time_sec")
    # Decimals, so that 2.1 stays 2.1 when digits are cut.
    diff = (t.cast("decimal(24,9)") - b.cast("decimal(24,9)")).cast("double")
    cut = lambda x, n: F.signum(x) * F.floor(F.abs(x) * 10.0**n + 1e-6) / 10.0**n
    quotient = cut(diff / b, 4)
    return out.withColumn("overhead_percent", F.when((t != 0) & (b != 0), F.round(quotient * 100.0, 2)))


def average_overhead(overheads: DataFrame) -> DataFrame:
    """Mean time and overhead by (benchmark, num_processes), over rows that have an overhead."""
    return overheads.where("overhead_percent is not null").groupBy("benchmark", "num_processes").agg(F.avg("overhead_percent").alias("overhead_percent"), F.avg("execution_time_sec").alias("execution_time_sec"), F.count("*").alias("runs"))
