"""Queries over traces of runs: telemetry, changes, drift response, fading, run matrices and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import previous


def changes(trace: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose rank differs from the row before."""
    return previous(trace, by, "rank", "_before").where(F.col("_before").isNotNull() & (F.col("_before") != F.col("rank"))).drop("_before")


def telemetry(trace: DataFrame, by: list[str]) -> DataFrame:
    """Mean, spread (of the population), range, number of changes and last value of the rank."""
    moved = F.coalesce((F.col("_before") != F.col("rank")).cast("long"), F.lit(0))
    return previous(trace, by, "rank", "_before").withColumn("_moved", moved).groupBy(*by).agg(
        F.count("*").alias("observations"),
        F.avg("rank").alias("rank_mean"),
        F.stddev_pop("rank").alias("rank_sd"),
        F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"),
        F.sum("_moved").alias("rank_changes"),
        F.max_by("rank", "t").alias("rank_final"),
    )


def histogram(trace: DataFrame, by: list[str]) -> DataFrame:
    """rank, n and percent of the rows of each group."""
    counts = trace.groupBy(*by, "rank").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)]))))


def chunk_ranks(trace: DataFrame, by: list[str], size: int) -> DataFrame:
    """Rank summary of each chunk of `size` rows; changes count within a chunk only."""
    marked = trace.withColumn("chunk", F.floor(F.col("t") / size).cast("long"))
    w = Window.partitionBy(*by, "chunk").orderBy("t")
    moved = F.coalesce((F.lag("rank").over(w) != F.col("rank")).cast("long"), F.lit(0))
    grouped = marked.withColumn("_moved", moved).groupBy(*by, "chunk")
    return grouped.agg(F.avg("rank").alias("rank_mean"), F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"), F.sum("_moved").alias("rank_changes"))


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for x in by:
        same = same & (F.col(x) == F.col(f"_{x}"))
    return same


def _binned_windows(drifts: DataFrame, by: list[str], within: int) -> DataFrame:
    """_by, _drift and _bin: each drift's window from it to `within` later lies in two bins of that width at most."""
    width = max(within, 1)
    bins = F.sequence(F.floor(F.col("drift") / width), F.floor((F.col("drift") + within) / width))
    return drifts.select(*[F.col(x).alias(f"_{x}") for x in by], F.col("drift").alias("_drift"), F.explode(bins).alias("_bin"))


def adaptation_delay(changed: DataFrame, drifts: DataFrame, by: list[str], within: int) -> DataFrame:
    """by, drift, delay: from a drift to the first change at most `within` later; null if there is none.  drifts: (by, drift).

    Changes and windows meet by run and bin, so a long run is many keys.
    """
    c = changed.select(*by, "t", F.floor(F.col("t") / max(within, 1)).alias("_at"))
    near = _same(by) & (F.col("_at") == F.col("_bin")) & F.col("t").between(F.col("_drift"), F.col("_drift") + within)
    first = _binned_windows(drifts.distinct(), by, within).join(c, near).groupBy(*[f"_{x}" for x in by], "_drift").agg(F.min("t").alias("_t"))
    on = _same(by) & (F.col("drift") == F.col("_drift"))
    return drifts.join(first, on, "left").groupBy(*by, "drift").agg((F.min("_t") - F.col("drift")).alias("delay"))


def false_changes(changed: DataFrame, drifts: DataFrame, by: list[str], within: int) -> DataFrame:
    """Changes outside every drift's window; both meet by run and bin."""
    marked = changed.withColumn("_at", F.floor(F.col("t") / max(within, 1)))
    near = _same(by) & (F.col("_at") == F.col("_bin")) & F.col("t").between(F.col("_drift"), F.col("_drift") + within)
    return marked.join(_binned_windows(drifts, by, within), near, "left_anti").drop("_at")


def recovery(chunks: DataFrame, drifts: DataFrame, by: list[str], share: float = 0.95, span: int = 1 << 20) -> DataFrame:
    """by, drift, target, recovery: end of the first later chunk that reaches a share of the score before the drift, less the drift.

    Chunks lie in blocks of `span` arrival numbers.  A run's largest scores by block are one array (an entry for some thousand
    chunks), in which each drift finds the first later block that reaches its target; only that block and its own are
    joined with the drift, by key.
    """
    before = chunks.select(*by, F.col("end").alias("drift"), (F.col("score") * share).alias("target"))
    d = drifts.join(before, [*by, "drift"], "left").withColumn("_own", F.floor(F.col("drift") / span))
    later = chunks.select(*[F.col(x).alias(f"_{x}") for x in by], F.floor(F.col("start") / span).alias("_block"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("score").alias("_score"))
    tops = later.groupBy(*[f"_{x}" for x in by], "_block").agg(F.max("_score").alias("_top"))
    tops = tops.groupBy(*[f"_{x}" for x in by]).agg(F.sort_array(F.collect_list(F.struct("_block", "_top"))).alias("_tops"))
    found = F.filter("_tops", lambda x: (x["_block"] > F.col("_own")) & (x["_top"] >= F.col("target")))
    asked = d.join(tops, _same(by)).select(*by, "drift", "target", F.explode(F.array_compact(F.array("_own", F.get(found, F.lit(0))["_block"]))).alias("_at"))
    on = _same(by) & (F.col("_block") == F.col("_at")) & (F.col("_start") >= F.col("drift")) & (F.col("_score") >= F.col("target"))
    first = asked.join(later, on).groupBy(*[F.col(x).alias(f"_{x}") for x in by], F.col("drift").alias("_drift"), F.col("target").alias("_target")).agg(F.min("_end").alias("_end"))
    same = _same(by) & (F.col("drift") == F.col("_drift")) & (F.col("target") == F.col("_target"))
    return d.join(first, same, "left").groupBy(*by, "drift", "target").agg((F.min("_end") - F.col("drift")).alias("recovery"))


def decimate(trace: DataFrame, by: list[str], every: int, marks: list[int]) -> DataFrame:
    """Every n-th row from the first, marked rows, and rows with a change."""
    moved = F.coalesce(F.col("_before") != F.col("rank"), F.lit(False))
    kept = previous(trace, by, "rank", "_before").withColumn("rank_changed", moved).drop("_before")
    return kept.where((F.col("t") % every == 1) | F.col("t").isin(marks) | F.col("rank_changed"))


def faded(weight: Column, rate: float, age: Column) -> Column:
    return weight * F.pow(F.lit(2.0), -rate * age)


def prune_period(rate: float, heavy: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.log2(F.lit(heavy) / (F.lit(heavy) - 1.0)) / rate)).cast("int")


def outlier_limit(rate: float, period: Column, age: Column) -> Column:
    """Least weight of an outlier of this age."""
    return (F.pow(F.lit(2.0), -rate * (age + period)) - 1.0) / (F.pow(F.lit(2.0), -rate * period) - 1.0)


def least_useful(state: DataFrame, by: list[str], now: Column, digits: int = 9) -> DataFrame:
    """by, id, utility: the cluster to evict, the lower id in ties.  state: (id, weight, last)."""
    u = F.round(F.col("weight") / (1.0 + F.greatest(now - F.col("last"), F.lit(0))), digits)
    return state.groupBy(*by).agg(F.min(F.struct(u.alias("utility"), F.col("id").alias("id"))).alias("m")).select(*by, "m.id", "m.utility")


def seed_summary(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean, sample spread (0 for one run) and number of runs."""
    return runs.groupBy(*by).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"), F.count("*").alias("runs"))


def mean_of_means(runs: DataFrame, outer: list[str], inner: list[str], metric: str) -> DataFrame:
    """Mean over inner groups of their means, and the total of runs."""
    first = runs.groupBy(*outer, *inner).agg(F.avg(metric).alias("m"), F.count("*").alias("n"))
    return first.groupBy(*outer).agg(F.avg("m").alias("mean"), F.sum("n").alias("runs"))


def missing_runs(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def record_errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that a record fails (null counts as failing), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
