"""Paired comparison of two methods over seeds: interval, signed ranks, effect sizes, Holm adjustment."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Student's t at 0.975 for 1 to 30 degrees of freedom.
T975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)


@lru_cache
def signed_rank_table(n: int) -> tuple[float, ...]:
    """Exact two-sided p of the smaller rank sum w = 0, 1, ... over all 2**n signs of the ranks 1 to n."""
    ways = [1]
    for r in range(1, n + 1):
        longer = ways + [0] * r
        for w, c in enumerate(ways):
            longer[w + r] += c
        ways = longer
    out, run = [], 0
    for w in range(n * (n + 1) // 4 + 1):
        run += ways[w]
        out.append(min(1.0, 2.0 * run / 2**n))
    return tuple(out)


def t975(free):
    """The 97.5 % point of Student's t by its expansion about the normal one; within 2e-6 beyond 30 degrees of freedom."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return sum((F.lit(c) / F.pow(free, F.lit(k + 1)) for k, c in enumerate(terms)), F.lit(z))


def paired(runs: DataFrame, family: str, left: str, right: str) -> DataFrame:
    """For each family a row: mean difference, 95 % interval, wins, ties, losses, W, dz, rank_biserial.  runs: (family, seed, left, right)."""
    d = runs.select(family, "seed", (F.col(left) - F.col(right)).alias("d")).where(F.col("d").isNotNull())
    w = Window.partitionBy(family, F.col("d") == 0).orderBy(F.abs("d"))
    same = Window.partitionBy(family, F.col("d") == 0, F.abs("d"))
    ranked = d.withColumn("r", F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0)
    zero = F.col("d") == 0
    sums = ranked.groupBy(family).agg(
        F.count("*").alias("n"),
        F.avg("d").alias("mean_difference"),
        F.stddev_samp("d").alias("_sd"),
        F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(zero, 1).otherwise(0)).alias("ties"),
        F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("losses"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("_up"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("_down"),
    )
    free = F.col("n") - 1
    listed = F.element_at(F.array(*[F.lit(x) for x in T975]), F.greatest(F.lit(1), F.least(F.lit(len(T975)), free)).cast("int"))
    t = F.when(free <= len(T975), listed).otherwise(t975(free))
    half = t * F.col("_sd") / F.sqrt(F.col("n"))
    return sums.select(
        family,
        "n",
        "mean_difference",
        (F.col("mean_difference") - half).alias("low"),
        (F.col("mean_difference") + half).alias("high"),
        "wins",
        "ties",
        "losses",
        F.least("_up", "_down").alias("w"),
        F.try_divide(F.col("mean_difference"), F.col("_sd")).alias("dz"),
        ((F.col("wins") - F.col("losses")) / F.col("n")).alias("rank_biserial"),
    )


def with_exact_p(stats: DataFrame, n: int) -> DataFrame:
    """Adds the exact p for families of n pairs; null for another number of pairs, and where ties or zeros make the sum of ranks another test's."""
    table = [(float(w), p) for w, p in enumerate(signed_rank_table(n))]
    known = stats.sparkSession.createDataFrame(table, "_w double, p double")
    fits = (F.col("w") == F.col("_w")) & (F.col("n") == n) & (F.col("ties") == 0)
    return stats.join(F.broadcast(known), fits, "left").drop("_w")


def holm(stats: DataFrame, p: str = "p") -> DataFrame:
    """Adds p_holm: the step-down adjustment over all rows."""
    every = Window.partitionBy(F.lit(1))
    placed = stats.withColumn("_i", F.row_number().over(every.orderBy(p)))
    placed = placed.withColumn("_step", F.col(p) * (F.count("*").over(every) - F.col("_i") + 1))
    run = every.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(run))).drop("_i", "_step")
