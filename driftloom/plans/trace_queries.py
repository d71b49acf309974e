"""Registered queries over traces, run matrices, summaries, statistics, text features and sets, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_features
from ..operators import paired, quantiles, traces
from ..sources import sinks, tables

WITHIN, DRIFTS = 20, (200, 400, 600)
CHUNK = 100


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


TRACE = """
tr AS (SELECT (user_id % 10)::INT AS seed, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS t,
              (4 + floor(abs(value)) % 5)::INT AS rank, event_type, value, event_id FROM events)"""
CHANGES = TRACE + """,
ch AS (SELECT * FROM (SELECT *, lag(rank) OVER (PARTITION BY seed ORDER BY t) AS before FROM tr) WHERE before <> rank),
dr AS (SELECT seed, unnest([200, 400, 600]::BIGINT[]) AS drift FROM (SELECT DISTINCT seed FROM tr))"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_trace(spark, sf_dir)


def drifts(tr: DataFrame) -> DataFrame:
    return tr.select("seed").distinct().withColumn("drift", F.explode(F.array(*[F.lit(x).cast("long") for x in DRIFTS])))


def telemetry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces.telemetry(trace(spark, sf_dir), ["seed"])
    return t.select("seed", "observations", r6("rank_mean").alias("rank_mean"), r6("rank_sd").alias("rank_sd"), "rank_min", "rank_max", "rank_changes", "rank_final")


def histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.histogram(trace(spark, sf_dir), ["seed"]).select("seed", "rank", "n", r6("percent").alias("percent"))


def pooled_histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank histogram of all runs together."""
    return traces.histogram(trace(spark, sf_dir), []).select("rank", "n", r6("percent").alias("percent"))


def chunk_ranks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = traces.chunk_ranks(trace(spark, sf_dir), ["seed"], CHUNK)
    return c.select("seed", "chunk", r6("rank_mean").alias("rank_mean"), "rank_min", "rank_max", "rank_changes")


def changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.changes(trace(spark, sf_dir), ["seed"]).select("seed", "t", "rank")


def delay_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = trace(spark, sf_dir)
    return traces.adaptation_delay(traces.changes(tr, ["seed"]), drifts(tr), ["seed"], WITHIN)


def false_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = trace(spark, sf_dir)
    found = traces.false_changes(traces.changes(tr, ["seed"]), drifts(tr), ["seed"], WITHIN)
    rows = tr.groupBy("seed").agg(F.count("*").alias("n"))
    return rows.join(found.groupBy(F.col("seed").alias("_s")).agg(F.count("*").alias("f")), F.col("seed") == F.col("_s"), "left").select(
        "seed", F.coalesce("f", F.lit(0)).alias("false_changes"), r6(1000.0 * F.coalesce("f", F.lit(0)) / F.col("n")).alias("per_1000")
    )


def _chunk_scores(tr: DataFrame) -> DataFrame:
    c = F.floor((F.col("t") - 1) / CHUNK).cast("long")
    return tr.groupBy("seed", c.alias("c")).agg(F.round(F.avg("value"), 9).alias("score")).select("seed", (F.col("c") * CHUNK).alias("start"), ((F.col("c") + 1) * CHUNK).alias("end"), "score")


def recovery_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = trace(spark, sf_dir)
    return traces.recovery(_chunk_scores(tr), drifts(tr), ["seed"]).select("seed", "drift", r6("target").alias("target"), "recovery")


def decimate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.decimate(trace(spark, sf_dir), ["seed"], 25, list(DRIFTS)).select("seed", "t", "rank", "rank_changed")


def drift_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the runs that have a delay, and how many have one."""
    d = delay_query(spark, sf_dir)
    return d.groupBy("drift").agg(r6(F.avg("delay")).alias("delay_mean"), F.count("delay").alias("with_delay"), F.count("*").alias("runs"))


def fading_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = trace(spark, sf_dir)
    last = tr.groupBy("seed").agg(F.max("t").alias("now")).withColumnRenamed("seed", "_s")
    w = tr.join(last, F.col("seed") == F.col("_s")).withColumn("w", traces.faded(F.lit(1.0), 0.01, F.col("now") - F.col("t")))
    return w.groupBy("seed", "event_type").agg(r6(F.sum("w")).alias("weight"))


def outlier_limit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every event."""
    ages, p = tables.table(spark, sf_dir, "events").select("event_id"), traces.prune_period(0.01, 1.2)
    return ages.select(F.col("event_id").alias("age"), p.alias("period"), r6(traces.outlier_limit(0.01, p, F.col("event_id"))).alias("limit"))


def eviction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are users: the least useful of each run."""
    e = tables.table(spark, sf_dir, "events")
    state = e.groupBy("user_id").agg(F.count("*").alias("weight"), F.max("event_id").alias("last")).select((F.col("user_id") % 10).cast("int").alias("seed"), F.col("user_id").alias("id"), "weight", "last")
    out = traces.least_useful(state, ["seed"], F.lit(1_000_000))
    return out.select("seed", "id", F.round(F.col("utility") * 1e6, 3).alias("utility"))


def promotion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faded weight of each user's last event if the events before it had been absorbed: what reaches the promotion weight."""
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    gap = e.withColumn("gap", F.col("event_id") - F.lag("event_id").over(w))
    faded = traces.faded(F.lit(1.0), 0.0028, F.col("gap")) + 1.0
    return gap.where(F.col("gap").isNotNull()).groupBy("user_id").agg(r6(F.max(faded)).alias("weight"), F.max((F.round(faded, 9) >= 1.2).cast("int")).alias("promoted"))


# Runs: suppliers' line items by return flag stand for results of (data set, method, seed).
RUNS = """
runs AS (SELECT l_returnflag AS dataset, l_linestatus AS method, (l_suppkey % 10)::INT AS seed, avg(l_discount) AS ari, avg(l_tax) AS nmi, count(*) AS n
         FROM lineitem GROUP BY ALL)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.table(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("method"), (F.col("l_suppkey") % 10).cast("int").alias("seed")]
    return li.groupBy(*keys).agg(F.avg("l_discount").alias("ari"), F.avg("l_tax").alias("nmi"), F.count("*").alias("n"))


def seed_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.seed_summary(runs(spark, sf_dir), ["dataset", "method"], "ari").select("dataset", "method", r6("mean").alias("mean"), r6("sd").alias("sd"), "runs")


def mean_of_means_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.mean_of_means(runs(spark, sf_dir), ["method"], ["dataset"], "ari").select("method", r6("mean").alias("mean"), "runs")


def windows_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import windows_summary

    s = windows_summary(runs(spark, sf_dir), ["method"])
    return s.select("method", "windows", "observations", *[r6(c).alias(c) for c in ("ari_weighted", "nmi_weighted", "ari_mean", "nmi_mean", "ari_sd", "ari_min", "ari_max")])


def resource_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(r6(F.expr("percentile(o_totalprice, 0.5)")).alias("median"), r6(F.max("o_totalprice")).alias("most"))


def missing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of priority and customer bucket without an order."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 2000).alias("bucket")).distinct()
    expected = o.select("o_orderpriority").distinct().crossJoin(spark.range(2000).select(F.col("id").alias("bucket")))
    return traces.missing_runs(expected, o, ["o_orderpriority", "bucket"])


def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 2000).alias("bucket"))
    expected = o.select("o_orderpriority").distinct().crossJoin(spark.range(2000).select(F.col("id").alias("bucket")))
    return sinks.manifest(o, expected, ["o_orderpriority", "bucket"])


def agreement_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the two methods of a data set and seed that agree within a tolerance."""
    r = runs(spark, sf_dir)
    a = r.where(F.col("method") == "F").select("dataset", "seed", F.col("ari").alias("a"))
    b = r.where(F.col("method") == "O").select("dataset", "seed", F.col("ari").alias("b"))
    return a.join(b, ["dataset", "seed"]).select("dataset", "seed", (F.abs(F.col("a") - F.col("b")) <= 0.002).alias("agree"))


def coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only labelled documents count for quality; the share that has a label is the coverage."""
    d, l = tables.table(spark, sf_dir, "documents").select("doc_id", "lang"), tables.table(spark, sf_dir, "labels").select("doc_id", "quality")
    both = d.join(l, "doc_id", "left").withColumn("pred", F.coalesce("quality", F.lit(-1)))
    return both.groupBy("lang").agg(
        F.sum((F.col("pred") >= 0).cast("long")).alias("assigned"),
        r6(F.avg((F.col("pred") >= 0).cast("double"))).alias("coverage"),
        r6(F.avg(F.when(F.col("pred") >= 0, F.col("pred").cast("double")))).alias("good"),
    )


def record_errors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    checks = {
        "schema": F.col("o_orderstatus").isin("F", "O"),
        "priority": F.col("o_orderpriority") != "5-LOW",
        "finite": ~F.isnan("o_totalprice") & (F.col("o_totalprice") > 50000),
    }
    return o.select("o_orderkey", F.array_join(traces.record_errors(checks), ",").alias("errors"))


def paired_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as the family, ten seeds, the two measures as the methods; Holm over the family."""
    p = paired.paired(runs(spark, sf_dir).groupBy("dataset", "seed").agg(F.avg("ari").alias("x"), F.avg("nmi").alias("y")), "dataset", "x", "y")
    out = paired.holm(paired.with_exact_p(p, 10))
    return out.select("dataset", "n", *[r6(c).alias(c) for c in ("mean_difference", "low", "high")], "wins", "ties", "losses", *[r6(c).alias(c) for c in ("w", "dz", "rank_biserial", "p", "p_holm")])


_P = ", ".join(f"({w}.0::DOUBLE, {p!r}::DOUBLE)" for w, p in enumerate(paired.signed_rank_table(10)))
PAIRED_SQL = f"""
WITH {RUNS}, v AS (SELECT dataset, seed, avg(ari) - avg(nmi) AS d FROM runs GROUP BY dataset, seed),
r AS (SELECT *, rank() OVER (PARTITION BY dataset, d = 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, d = 0, abs(d)) - 1) / 2.0 AS r FROM v),
s AS (SELECT dataset, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses,
             least(coalesce(sum(r) FILTER (d > 0), 0.0), coalesce(sum(r) FILTER (d < 0), 0.0)) AS w FROM r GROUP BY dataset),
t AS (SELECT *, ({list(paired.T975)})[(n - 1)::INT] AS t FROM s),
p(w, p) AS (VALUES {_P}),
q AS (SELECT t.*, p.p, row_number() OVER (ORDER BY p.p) AS i, p.p * (count(*) OVER () - row_number() OVER (ORDER BY p.p) + 1) AS step FROM t LEFT JOIN p USING (w))
SELECT dataset, n, round(m, 6) + 0.0 AS mean_difference, round(m - t * sd / sqrt(n), 6) + 0.0 AS low, round(m + t * sd / sqrt(n), 6) + 0.0 AS high, wins, ties, losses,
       round(w, 6) + 0.0 AS w, round(m / sd, 6) + 0.0 AS dz, round((wins - losses) / n, 6) + 0.0 AS rank_biserial, round(p, 6) + 0.0 AS p,
       round(least(1.0, max(step) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS p_holm FROM q"""


def method_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a figure of methods by quality shows: means and spreads of both measures."""
    r = runs(spark, sf_dir).groupBy("method")
    return r.agg(r6(F.avg("ari")).alias("ari"), r6(F.avg("nmi")).alias("nmi"), r6(F.stddev_samp("ari")).alias("ari_sd"), r6(F.stddev_samp("nmi")).alias("nmi_sd"))


def hashed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed_features(tables.table(spark, sf_dir, "documents"))
    return h.select("doc_id", "slot", r6("value").alias("value"))


HASHED_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]) ELSE [] END)) AS g FROM w),
h AS (SELECT doc_id, (('0x' || substr(md5(g), 1, 8))::BIGINT % 2048)::INT AS slot, count(*) AS n FROM g GROUP BY doc_id, slot),
n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM h GROUP BY doc_id)
SELECT doc_id, slot, round(n / norm, 6) + 0.0 AS value FROM h JOIN n USING (doc_id)"""


def split_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three splits in their order, with the label text mapped to a number."""
    o = tables.table(spark, sf_dir, "orders")
    label = F.when(F.upper("o_orderstatus") == "O", 1).when(F.upper("o_orderstatus") == "F", 0).otherwise(2)
    out = None
    for k, status in enumerate(("F", "O", "P")):
        part = o.where(F.col("o_orderstatus") == status).select(F.lit(k).alias("split"), F.col("o_orderkey").alias("line"), label.alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def inventory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one list and not of the other, either way, and all times of both."""
    o, c = tables.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k")).distinct(), tables.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 > 0).select(F.col("c_custkey").alias("k"))
    listed, present = c.exceptAll(o), o.exceptAll(c)
    marks = listed.where(F.col("k") % 25 == 1).union(present).distinct()
    return listed.select(F.lit("missing").alias("kind"), "k").union(present.select(F.lit("unlisted"), "k")).union(marks.select(F.lit("mark"), "k"))


def quantiles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of prices by return flag."""
    rows = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    found = quantiles.exact_quantiles(rows, ["l_returnflag"], F.col("price"), [0.5, 0.8, 0.99])
    return found.select("l_returnflag", "share", F.round("quantile", 5).alias("price"))


QUERIES = {
    "exact_quantiles": quantiles_query,
    "rank_telemetry": telemetry_query,
    "rank_histogram": histogram_query,
    "rank_histogram_pooled": pooled_histogram_query,
    "rank_chunks": chunk_ranks_query,
    "rank_changes": changes_query,
    "adaptation_delay": delay_query,
    "drift_summary": drift_summary_query,
    "false_changes": false_query,
    "recovery_time": recovery_query,
    "decimated_trace": decimate_query,
    "faded_weights": fading_query,
    "outlier_limit": outlier_limit_query,
    "outlier_limit_whole": outlier_limit_query,
    "utility_eviction": eviction_query,
    "promotion_weight": promotion_query,
    "seed_summary": seed_summary_query,
    "mean_of_means": mean_of_means_query,
    "windows_summary": windows_summary_query,
    "resource_summary": resource_query,
    "missing_runs": missing_query,
    "run_manifest": manifest_query,
    "run_agreement": agreement_query,
    "assigned_coverage": coverage_query,
    "record_errors": record_errors_query,
    "paired_statistics": paired_query,
    "method_quality": method_quality_query,
    "hashed_text_features": hashed_query,
    "ordered_split_union": split_union_query,
    "inventory_difference": inventory_query,
}

ORACLE_SQL = {
    "exact_quantiles": """
SELECT l_returnflag, share, round(price, 5) AS price FROM (
  SELECT l_returnflag, 0.5::DOUBLE AS share, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS price FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag, 0.8::DOUBLE, quantile_cont(l_extendedprice::DOUBLE, 0.8) FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag, 0.99::DOUBLE, quantile_cont(l_extendedprice::DOUBLE, 0.99) FROM lineitem GROUP BY l_returnflag)""",
    "rank_telemetry": f"""
WITH {TRACE}, m AS (SELECT *, coalesce((lag(rank) OVER (PARTITION BY seed ORDER BY t) <> rank)::INT, 0) AS moved FROM tr)
SELECT seed, count(*) AS observations, round(avg(rank), 6) + 0.0 AS rank_mean, round(stddev_pop(rank), 6) + 0.0 AS rank_sd, min(rank) AS rank_min, max(rank) AS rank_max,
       sum(moved)::BIGINT AS rank_changes, arg_max(rank, t) AS rank_final FROM m GROUP BY seed""",
    "rank_histogram_pooled": f"WITH {TRACE} SELECT rank, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM tr), 6) + 0.0 AS percent FROM tr GROUP BY rank",
    "rank_histogram": f"WITH {TRACE}, c AS (SELECT seed, rank, count(*) AS n FROM tr GROUP BY seed, rank) SELECT seed, rank, n, round(100.0 * n / sum(n) OVER (PARTITION BY seed), 6) + 0.0 AS percent FROM c",
    "rank_chunks": f"""
WITH {TRACE}, m AS (SELECT *, t // 100 AS chunk, coalesce((lag(rank) OVER (PARTITION BY seed, t // 100 ORDER BY t) <> rank)::INT, 0) AS moved FROM tr)
SELECT seed, chunk, round(avg(rank), 6) + 0.0 AS rank_mean, min(rank) AS rank_min, max(rank) AS rank_max, sum(moved)::BIGINT AS rank_changes FROM m GROUP BY seed, chunk""",
    "rank_changes": f"WITH {CHANGES} SELECT seed, t, rank FROM ch",
    "adaptation_delay": f"WITH {CHANGES} SELECT dr.seed, drift, min(ch.t) - drift AS delay FROM dr LEFT JOIN ch ON ch.seed = dr.seed AND ch.t BETWEEN drift AND drift + 20 GROUP BY dr.seed, drift",
    "drift_summary": f"""
WITH {CHANGES}, d AS (SELECT dr.seed, drift, min(ch.t) - drift AS delay FROM dr LEFT JOIN ch ON ch.seed = dr.seed AND ch.t BETWEEN drift AND drift + 20 GROUP BY dr.seed, drift)
SELECT drift, round(avg(delay), 6) + 0.0 AS delay_mean, count(delay) AS with_delay, count(*) AS runs FROM d GROUP BY drift""",
    "false_changes": f"""
WITH {CHANGES}, f AS (SELECT seed, count(*) AS f FROM ch WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.seed = ch.seed AND ch.t BETWEEN drift AND drift + 20) GROUP BY seed),
n AS (SELECT seed, count(*) AS n FROM tr GROUP BY seed)
SELECT n.seed, coalesce(f, 0) AS false_changes, round(1000.0 * coalesce(f, 0) / n, 6) + 0.0 AS per_1000 FROM n LEFT JOIN f ON f.seed = n.seed""",
    "recovery_time": f"""
WITH {CHANGES}, q AS (SELECT seed, (t - 1) // 100 * 100 AS s, ((t - 1) // 100 + 1) * 100 AS e, round(avg(value), 9) AS score FROM tr GROUP BY ALL),
d AS (SELECT dr.seed, drift, q.score * 0.95 AS target FROM dr LEFT JOIN q ON q.seed = dr.seed AND q.e = drift)
SELECT d.seed, drift, round(target, 6) + 0.0 AS target, min(q.e) - drift AS recovery FROM d LEFT JOIN q ON q.seed = d.seed AND q.s >= drift AND q.score >= target GROUP BY d.seed, drift, target""",
    "decimated_trace": f"""
WITH {TRACE}, m AS (SELECT *, coalesce(lag(rank) OVER (PARTITION BY seed ORDER BY t) <> rank, false) AS rank_changed FROM tr)
SELECT seed, t, rank, rank_changed FROM m WHERE t % 25 = 1 OR t IN (200, 400, 600) OR rank_changed""",
    "faded_weights": f"""
WITH {TRACE}, m AS (SELECT *, max(t) OVER (PARTITION BY seed) AS now FROM tr) SELECT seed, event_type, round(sum(pow(2.0, -0.01 * (now - t))), 6) + 0.0 AS weight FROM m GROUP BY seed, event_type""",
    "outlier_limit": """
WITH p AS (SELECT greatest(1, ceil(log2(1.2::DOUBLE / (1.2::DOUBLE - 1.0)) / 0.01::DOUBLE))::INT AS period)
SELECT event_id AS age, period, round((pow(2.0, -0.01 * (event_id + period)) - 1.0) / (pow(2.0, -0.01 * period) - 1.0), 6) + 0.0 AS limit FROM events, p""",
    "utility_eviction": """
WITH s AS (SELECT (user_id % 10)::INT AS seed, user_id AS id, count(*) AS weight, max(event_id) AS last FROM events GROUP BY user_id),
u AS (SELECT seed, id, round(weight / (1.0::DOUBLE + greatest(1000000 - last, 0)), 9) AS utility FROM s)
SELECT seed, arg_min(id, (utility, id)) AS id, round(min(utility) * 1e6, 3) AS utility FROM u GROUP BY seed""",
    "promotion_weight": """
WITH g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events),
f AS (SELECT user_id, pow(2.0, -0.0028 * gap) + 1.0 AS w FROM g WHERE gap IS NOT NULL)
SELECT user_id, round(max(w), 6) + 0.0 AS weight, max((round(w, 9) >= 1.2)::INT) AS promoted FROM f GROUP BY user_id""",
    "seed_summary": f"WITH {RUNS} SELECT dataset, method, round(avg(ari), 6) + 0.0 AS mean, round(coalesce(stddev_samp(ari), 0.0), 6) + 0.0 AS sd, count(*) AS runs FROM runs GROUP BY dataset, method",
    "mean_of_means": f"WITH {RUNS}, m AS (SELECT method, dataset, avg(ari) AS m, count(*) AS n FROM runs GROUP BY method, dataset) SELECT method, round(avg(m), 6) + 0.0 AS mean, sum(n)::BIGINT AS runs FROM m GROUP BY method",
    "windows_summary": f"""
WITH {RUNS} SELECT method, count(*) AS windows, sum(n)::BIGINT AS observations, round(sum(n * ari) / sum(n), 6) + 0.0 AS ari_weighted, round(sum(n * nmi) / sum(n), 6) + 0.0 AS nmi_weighted,
 round(avg(ari), 6) + 0.0 AS ari_mean, round(avg(nmi), 6) + 0.0 AS nmi_mean, round(coalesce(stddev_samp(ari), 0.0), 6) + 0.0 AS ari_sd, round(min(ari), 6) + 0.0 AS ari_min, round(max(ari), 6) + 0.0 AS ari_max
FROM runs GROUP BY method""",
    "resource_summary": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) + 0.0 AS median, round(max(o_totalprice), 6) + 0.0 AS most FROM orders GROUP BY o_orderpriority",
    "missing_runs": """
SELECT p.o_orderpriority, b.bucket FROM (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT unnest(range(0, 2000)) AS bucket) b
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = p.o_orderpriority AND o.o_custkey % 2000 = b.bucket)""",
    "run_manifest": """
WITH e AS (SELECT p.o_orderpriority, b.bucket FROM (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT unnest(range(0, 2000)) AS bucket) b),
h AS (SELECT DISTINCT o_orderpriority, o_custkey % 2000 AS bucket, true AS here FROM orders)
SELECT count(*) AS expected, count(here) AS present, count(*) - count(here) AS missing, count(*) = count(here) AS complete FROM e LEFT JOIN h USING (o_orderpriority, bucket)""",
    "run_agreement": f"WITH {RUNS} SELECT a.dataset, a.seed, abs(a.ari - b.ari) <= 0.002 AS agree FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.seed = b.seed WHERE a.method = 'F' AND b.method = 'O'",
    "assigned_coverage": """
WITH b AS (SELECT lang, coalesce(quality, -1) AS pred FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (pred >= 0) AS assigned, round(avg((pred >= 0)::INT), 6) + 0.0 AS coverage, round(avg(pred) FILTER (pred >= 0), 6) + 0.0 AS good FROM b GROUP BY lang""",
    "record_errors": """
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'schema' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'priority' END,
       CASE WHEN NOT (isfinite(o_totalprice) AND o_totalprice > 50000) THEN 'finite' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders""",
    "paired_statistics": PAIRED_SQL,
    "method_quality": f"WITH {RUNS} SELECT method, round(avg(ari), 6) + 0.0 AS ari, round(avg(nmi), 6) + 0.0 AS nmi, round(stddev_samp(ari), 6) + 0.0 AS ari_sd, round(stddev_samp(nmi), 6) + 0.0 AS nmi_sd FROM runs GROUP BY method",
    "hashed_text_features": HASHED_SQL,
    "ordered_split_union": """
SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS split, o_orderkey AS line, CASE upper(o_orderstatus) WHEN 'O' THEN 1 WHEN 'F' THEN 0 ELSE 2 END AS label
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""",
    "inventory_difference": """
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0),
l AS (SELECT k FROM c EXCEPT ALL SELECT k FROM o), p AS (SELECT k FROM o EXCEPT ALL SELECT k FROM c)
SELECT 'missing' AS kind, k FROM l UNION ALL SELECT 'unlisted', k FROM p UNION ALL SELECT 'mark', k FROM (SELECT k FROM l WHERE k % 25 = 1 UNION SELECT k FROM p)""",
}

# The same without the limit of rows.
ORACLE_SQL["outlier_limit_whole"] = ORACLE_SQL["outlier_limit"]
