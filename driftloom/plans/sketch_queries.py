"""Registered queries of the adaptive sketch over the whole embeddings table, with SQL where no eigenvectors or generator are involved.

The uniform numbers of the queries with SQL are hashes of t, which SQL can make as well; ``basis_trace`` and
``basis_scores`` draw from the generator itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import StreamConfig
from ..kernels.subspace import projection
from ..operators import sketch, vectors
from ..session import checkpointed
from ..sources import tables
from .vector_queries import CFG, PROJECTED, r6

WINDOW, EVERY = 100, 20  # of the moments: admitted rows, and admissions between refreshes
MOMENTS = StreamConfig.flat(original_dim=64, projection_dim=16, max_rank=16, window_size=WINDOW, basis_update_interval=EVERY, leverage_mode="uniform", retained_energy=0.7, min_rank=2, seed=CFG.seed, projection_seed=CFG.seed)


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.project_batches(tables.embeddings(spark, sf_dir), projection(CFG))


def hashed_uniform():
    """A number in 0..1 from the md5 of t."""
    return F.conv(F.substring(F.md5(F.col("t").cast("string")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = projected(spark, sf_dir)
    return sketch.probabilities(z.withColumn("leverage", sketch.initial_leverage("features", CFG.rank.first)), CFG.admission)


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.admitted(_scored(spark, sf_dir), CFG.admission, hashed_uniform())


def admission_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row under the first basis."""
    a = _admitted(spark, sf_dir).withColumn("tilt", sketch.tilt(F.col("influence"), CFG.admission))
    return a.select("t", r6("leverage").alias("leverage"), "n", r6("q").alias("q"), r6("prob").alias("prob"), "accepted", r6("weight").alias("weight"), r6("tilt").alias("tilt"), "ordinal")


ADMITTED_SQL = f"""
WITH {PROJECTED}, u AS (SELECT t, ('0x' || substr(md5(t::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM e),
l AS (SELECT t, sum(z * z) / 1.001 AS leverage FROM z WHERE j < 8 GROUP BY t),
n AS (SELECT t, leverage, count(*) OVER w AS n, sum(leverage) OVER w + 0.05 AS total FROM l WINDOW w AS (ORDER BY t ROWS BETWEEN 64 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, least(1.0, greatest(0.0, (leverage + 0.05 / n) / total)) AS q FROM n),
p AS (SELECT *, least(1.0, greatest(0.15, 0.65 * (n * q))) AS prob FROM q),
a AS (SELECT p.*, u <= prob AS accepted, CASE WHEN u <= prob THEN 1.0 / prob ELSE 0.0 END AS weight FROM p JOIN u USING (t)),
o AS (SELECT *, sum(accepted::INT) OVER (ORDER BY t) AS ordinal FROM a)"""


def admission_modes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each mode admits, and with what weight in all."""
    scored, out = _scored(spark, sf_dir), None
    for mode in ("sample", "uniform", "weight", "off"):
        c = StreamConfig.flat(original_dim=64, projection_dim=16, max_rank=16, window_size=64, leverage_mode=mode).admission
        a = sketch.admitted(scored, c, hashed_uniform())
        row = a.agg(F.lit(mode).alias("mode"), F.sum(F.col("accepted").cast("long")).alias("admitted"), r6(F.sum("weight")).alias("weight"))
        out = row if out is None else out.union(row)
    return out


ADMISSION_MODES_SQL = ADMITTED_SQL + """,
v AS (SELECT u <= 0.65 AS ok FROM l JOIN u USING (t))
SELECT 'sample' AS mode, sum(accepted::INT)::BIGINT AS admitted, round(sum(weight), 6) + 0.0 AS weight FROM o
UNION ALL SELECT 'uniform', sum(ok::INT)::BIGINT, round(sum(CASE WHEN ok THEN 1 / 0.65::DOUBLE ELSE 0 END), 6) + 0.0 FROM v
UNION ALL SELECT m, (SELECT count(*) FROM l), (SELECT count(*) FROM l)::DOUBLE FROM (VALUES ('weight'), ('off')) x(m)"""


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refresh, i, j (upper triangle), c."""
    places = spark.createDataFrame([(k, int(i), int(j)) for k, (i, j) in enumerate(sketch.cells_of(CFG.projection.size))], "cell int, i int, j int")
    m = sketch.window_moments(_admitted(spark, sf_dir).where("accepted"), MOMENTS.admission, EVERY)
    return m.join(F.broadcast(places), "cell").select("refresh", "i", "j", "c")  # a row for each cell of one matrix


def moments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir).select("refresh", "i", "j", r6("c").alias("c"))


MOMENTS_SQL = ADMITTED_SQL + f""",
k AS (SELECT t, weight, ordinal FROM o WHERE accepted),
r AS (SELECT (ordinal // {EVERY})::BIGINT AS refresh FROM k WHERE ordinal % {EVERY} = 0),
w AS (SELECT refresh, t, weight FROM r JOIN k ON ordinal > {EVERY} * refresh - {WINDOW} AND ordinal <= {EVERY} * refresh),
s AS (SELECT refresh, sum(weight) AS mass FROM w GROUP BY refresh),
m AS (SELECT refresh, x.j AS i, y.j AS j, sum(weight * x.z * y.z) / mass AS c FROM w JOIN s USING (refresh) JOIN z x USING (t) JOIN z y ON x.t = y.t AND x.j <= y.j GROUP BY refresh, mass, x.j, y.j)"""


def error_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every refresh, the share of energy, as a root, that the first coordinates miss."""
    on = _moments(spark, sf_dir).where(F.col("i") == F.col("j"))
    sums = on.groupBy("refresh").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("i") < CFG.rank.first, F.col("c")).otherwise(0.0)).alias("kept"))
    error = F.when(F.col("all") <= 1e-24, 0.0).otherwise(F.sqrt(F.greatest(F.col("all") - F.col("kept"), F.lit(0.0)) / F.col("all")))
    return sums.select("refresh", r6(error).alias("error"))


def energy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every refresh, how many of the coordinates' own energies, the largest first, hold the share that is to be kept."""
    c = MOMENTS.rank
    of = Window.partitionBy("refresh")  # as many rows as a matrix has columns
    on = _moments(spark, sf_dir).where(F.col("i") == F.col("j")).withColumn("place", F.row_number().over(of.orderBy(F.col("c").desc(), "i")))
    used = on.where(F.col("place") <= c.most).withColumn("share", F.sum("c").over(of.orderBy("place")) / F.sum("c").over(of))
    rank = F.sum((F.round("share", 12) < c.energy).cast("int")) + 1
    return used.groupBy("refresh").agg(F.least(F.lit(c.most), F.greatest(F.lit(c.least), rank)).cast("int").alias("rank"))


def _uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = projected(spark, sf_dir)
    return checkpointed(sketch.admitted(z, MOMENTS.admission, sketch.draws(F.col("t"), MOMENTS.seed)))


def basis_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every refresh of the run whose admission follows the rate alone: rank, error, threshold, candidate and largest eigenvalue."""
    found = sketch.bases(_uniform(spark, sf_dir).where("accepted"), MOMENTS.admission, MOMENTS.rank)
    return found.select("epoch", "rank", "error", "threshold", "candidate", F.element_at("values", 1).alias("largest"))


def score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leverage, in the same run, under the basis in effect when it arrives, and its influence."""
    rows = _uniform(spark, sf_dir)
    found = sketch.bases(rows.where("accepted"), MOMENTS.admission, MOMENTS.rank)
    first = sketch.first_refresh(MOMENTS.rank, WINDOW)
    marked = rows.withColumn("epoch", sketch.epochs(rows, EVERY, first)).select("t", "features", "epoch")
    lev = F.coalesce("leverage", sketch.initial_leverage(F.col("features"), MOMENTS.rank.first))
    scores = sketch.leverage_under(marked, found).withColumn("leverage", lev).drop("features")
    return sketch.probabilities(scores, MOMENTS.admission).select("t", "epoch", "leverage", "influence")


QUERIES = {
    "sketch_admission": admission_query,
    "admission_modes": admission_modes_query,
    "rolling_weighted_moments": moments_query,
    "reconstruction_error": error_query,
    "energy_rank": energy_query,
    "basis_trace": basis_query,
    "basis_scores": score_query,
}

ORACLE_SQL = {
    "sketch_admission": ADMITTED_SQL + """
SELECT t, round(leverage, 6) + 0.0 AS leverage, n, round(q, 6) + 0.0 AS q, round(prob, 6) + 0.0 AS prob, accepted, round(weight, 6) + 0.0 AS weight,
       round(least(3.0, greatest(0.35, 0.5 + n * q / (1 + n * q))), 6) + 0.0 AS tilt, ordinal::BIGINT AS ordinal FROM o""",
    "admission_modes": ADMISSION_MODES_SQL,
    "rolling_weighted_moments": MOMENTS_SQL + " SELECT refresh, i, j, round(c, 6) + 0.0 AS c FROM m",
    "reconstruction_error": MOMENTS_SQL + " SELECT refresh, round(sqrt(greatest(sum(c) - sum(c) FILTER (i < 8), 0.0) / sum(c)), 6) + 0.0 AS error FROM m WHERE i = j GROUP BY refresh",
    "energy_rank": MOMENTS_SQL + """,
v AS (SELECT refresh, c, row_number() OVER (PARTITION BY refresh ORDER BY c DESC, i) AS place FROM m WHERE i = j),
y AS (SELECT refresh, sum(c) OVER (PARTITION BY refresh ORDER BY place) / sum(c) OVER (PARTITION BY refresh) AS share FROM v WHERE place <= 16)
SELECT refresh, least(16, greatest(2, sum((round(share, 12) < 0.7)::INT) + 1))::INT AS rank FROM y GROUP BY refresh""",
}
