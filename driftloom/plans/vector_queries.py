"""Registered queries over vector streams, each with the DuckDB SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StreamConfig
from ..kernels.subspace import projection
from ..operators import coreset, kmeans, neighbors, quality, vectors
from ..session import checkpointed
from ..sources import tables

SEED = 7
CFG = StreamConfig.flat(original_dim=64, projection_dim=16, max_rank=16, window_size=64, seed=SEED, projection_seed=SEED)
REPS = 20
CALIBRATION = 1000  # rows that the reference calibrates the radius on


def r6(c: Column | str) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def omega_rows() -> list[tuple[int, int, float]]:
    m = projection(CFG)
    return [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]


def omega(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(omega_rows(), "dim int, j int, w double")


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(x) + ("::DOUBLE" if isinstance(x, float) else "") for x in row) + ")" for row in rows)


# The stream's cells in SQL: t, dim, v, label.
CELLS = """
e AS (SELECT vec_id AS t, label, embedding FROM embeddings),
cells AS (SELECT t, label, unnest(range(0, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM e)"""
OMEGA = f"omega(dim, j, w) AS ({values(omega_rows())})"
PROJECTED = f"{CELLS}, {OMEGA}, z AS (SELECT t, j, sum(v * w) AS z FROM cells JOIN omega USING (dim) GROUP BY t, j)"
ARI_NMI = """
c AS (SELECT truth, pred, count(*) AS n FROM p GROUP BY truth, pred),
s AS (SELECT (SELECT sum(n) FROM c)::DOUBLE AS n, (SELECT sum(n * (n - 1) / 2.0) FROM c) AS ij,
      (SELECT sum(a * (a - 1) / 2.0) FROM (SELECT sum(n)::DOUBLE AS a FROM c GROUP BY truth)) AS ai,
      (SELECT sum(b * (b - 1) / 2.0) FROM (SELECT sum(n)::DOUBLE AS b FROM c GROUP BY pred)) AS bj,
      (SELECT -sum(a / m * ln(a / m)) FROM (SELECT sum(n)::DOUBLE AS a, (SELECT sum(n) FROM c)::DOUBLE AS m FROM c GROUP BY truth)) AS ha,
      (SELECT -sum(b / m * ln(b / m)) FROM (SELECT sum(n)::DOUBLE AS b, (SELECT sum(n) FROM c)::DOUBLE AS m FROM c GROUP BY pred)) AS hb,
      (SELECT sum(n / m * ln(n * m / (a * b))) FROM (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY truth)::DOUBLE AS a,
              sum(n) OVER (PARTITION BY pred)::DOUBLE AS b, sum(n) OVER ()::DOUBLE AS m FROM c)) AS mi)
SELECT n::BIGINT AS n, round((ij - ai * bj / (n * (n - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)), 6) + 0.0 AS ari,
       round(greatest(0.0, least(1.0, mi / ((ha + hb) / 2))), 6) + 0.0 AS nmi FROM s"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.melt(tables.embeddings(spark, sf_dir))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.project(cells(spark, sf_dir), omega(spark))


def projection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir).select("t", "j", r6("z").alias("z"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows projected and assigned to the nearest class mean: t, truth, pred.  Rows pass in batches; only class means are shuffled."""
    z = vectors.project_batches(tables.embeddings(spark, sf_dir), projection(CFG), ("label",))
    near = vectors.nearest_rows(z, vectors.class_centers(z), ("label",))
    return near.select("t", F.col("label").alias("truth"), F.col("center").alias("pred"))


def stream_projection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.partition_quality(assigned(spark, sf_dir), [], "truth", "pred")
    return q.select("n", r6("ari").alias("ari"), r6("nmi").alias("nmi"))


ASSIGNED_SQL = f"""
WITH {PROJECTED},
k AS (SELECT label AS center, j, avg(z) AS c FROM z JOIN e USING (t) GROUP BY label, j),
d AS (SELECT z.t, k.center, round(sum((z.z - k.c) * (z.z - k.c)), 9) AS d2 FROM z JOIN k USING (j) GROUP BY z.t, k.center),
p AS (SELECT d.t, e.label AS truth, arg_min(d.center, (d.d2, d.center)) AS pred FROM d JOIN e USING (t) GROUP BY d.t, e.label)"""


def contingency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contingency(assigned(spark, sf_dir), [], "truth", "pred")


def standardize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.causal_standardize(cells(spark, sf_dir)).select("t", "dim", r6("z").alias("z"))


def prefix_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.range_scale(cells(spark, sf_dir), 100).select("t", "dim", r6("z").alias("z"))


def full_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.range_scale(cells(spark, sf_dir)).select("t", "dim", r6("z").alias("z"))


def feature_subset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice of dimensions is the operator; every row has it."""
    part = tables.embeddings(spark, sf_dir).select("t", F.slice("features", 1, 8).alias("features"))
    return vectors.melt(part).select("t", "dim", r6("v").alias("v"))


def lineitem_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lineitems(spark, sf_dir).groupBy("label", F.floor(F.col("t") / 1000).cast("long").alias("chunk")).agg(
        F.count("*").alias("n"), r6(F.avg(F.element_at("features", 1))).alias("quantity"), r6(F.avg(F.element_at("features", 2))).alias("price")
    )


def lineitem_standardize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal standardization of a long stream, by chunk."""
    z = vectors.causal_standardize(vectors.melt(tables.lineitems(spark, sf_dir)))
    return z.groupBy("dim", F.floor(F.col("t") / 1000).cast("long").alias("chunk")).agg(F.round(F.avg("z"), 5).alias("z_mean"), F.round(F.max("z"), 5).alias("z_max"))


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.embeddings(spark, sf_dir).where(F.col("t") < REPS)
    return vectors.melt(part).select(F.col("t").alias("center"), "dim", F.col("v").alias("c"))


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_rows(tables.embeddings(spark, sf_dir), _reps(spark, sf_dir)).select("t", "center", r6("d2").alias("d2"))


NEAREST_SQL = f"""
WITH {CELLS}, k AS (SELECT t AS center, dim, v AS c FROM cells WHERE t < {REPS}),
d AS (SELECT cells.t, center, round(sum((v - c) * (v - c)), 9) AS d2 FROM cells JOIN k USING (dim) GROUP BY cells.t, center),
n AS (SELECT t, arg_min(center, (d2, center)) AS center, min(d2) AS d2 FROM d GROUP BY t)"""


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.embeddings(spark, sf_dir).select("t", (F.col("label") + 1).cast("double").alias("w"))


def coreset_mass_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vectors.mass_to_representatives(cells(spark, sf_dir), _masses(spark, sf_dir), _reps(spark, sf_dir))
    return m.select("center", r6("mass").alias("mass"))


def within_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.first_within(cells(spark, sf_dir), _reps(spark, sf_dir), 1.2)


def fitting_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes as clusters of sums: the first that a row fits into, in order of distance; the radius is their mean spread."""
    stream = tables.embeddings(spark, sf_dir)
    sums = stream.select("label", F.posexplode("features").alias("dim", "v")).groupBy(F.col("label").alias("center"), "dim")
    clusters = sums.agg(F.sum("v").alias("ls"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("*").cast("double").alias("w"))
    spread = clusters.groupBy("center").agg(F.sqrt(F.sum(F.col("ss") / F.col("w") - F.pow(F.col("ls") / F.col("w"), F.lit(2)))).alias("s"))
    radius = spread.agg(F.round(F.avg("s"), 6)).first()[0] or 0.0
    return vectors.first_fitting(cells(spark, sf_dir), clusters, radius)


FITTING_SQL = f"""
WITH {CELLS}, k AS (SELECT label AS center, dim, sum(v) AS ls, sum(v * v) AS ss, count(*)::DOUBLE AS w FROM cells GROUP BY label, dim),
q AS (SELECT round(avg(s), 6) AS radius FROM (SELECT sqrt(sum(ss / w - (ls / w) ** 2)) AS s FROM k GROUP BY center)),
d AS (SELECT cells.t, center, round(sum((v - ls / w) * (v - ls / w)), 9) AS d2,
             round(sqrt(sum(greatest((ss + v * v) / (w + 1) - ((ls + v) / (w + 1)) * ((ls + v) / (w + 1)), 0.0))), 9) AS r
      FROM cells JOIN k USING (dim) GROUP BY cells.t, center)
SELECT t, arg_min(center, (d2, center)) FILTER (WHERE r <= radius) AS center FROM d, q GROUP BY t"""


def lloyd_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weighted steps from the first five rows."""
    stream = tables.embeddings(spark, sf_dir).withColumn("w", (F.col("label") + 1).cast("double"))
    centers = _reps(spark, sf_dir).where(F.col("center") < 5)
    for _ in range(2):
        centers = vectors.lloyd_rows(stream, centers)
    return centers.select("center", "dim", r6("c").alias("c"))


def _lloyd_sql() -> str:
    sql = f"WITH {CELLS}, k0 AS (SELECT t AS center, dim, v AS c FROM cells WHERE t < 5)"
    for i in range(2):
        sql += f""",
d{i} AS (SELECT cells.t, center, round(sum((v - c) * (v - c)), 9) AS d2 FROM cells JOIN k{i} USING (dim) GROUP BY cells.t, center),
n{i} AS (SELECT t, arg_min(center, (d2, center)) AS own FROM d{i} GROUP BY t),
m{i} AS (SELECT own, dim, sum(v * (label + 1)) / sum(label + 1) AS m FROM cells JOIN n{i} USING (t) GROUP BY own, dim),
k{i + 1} AS (SELECT k{i}.center, k{i}.dim, coalesce(m, c) AS c FROM k{i} LEFT JOIN m{i} ON k{i}.center = own AND k{i}.dim = m{i}.dim)"""
    return sql + "\nSELECT center, dim, round(c, 6) + 0.0 AS c FROM k2"


def neighbors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pivot_neighbors(tables.embeddings(spark, sf_dir), 8, itself=False).select("i", "j", r6("d").alias("d"), "place")


def radius_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius from the rows that calibrate it: the first CALIBRATION of the stream, or all if there are fewer."""
    first = tables.embeddings(spark, sf_dir).orderBy("t").limit(CALIBRATION)
    return vectors.radius_of(neighbors.pivot_neighbors(first, 6, itself=True)).select(r6("radius").alias("radius"))


PAIRS_SQL = f"""
WITH {CELLS}, x AS (SELECT * FROM cells),
d AS (SELECT a.t AS i, b.t AS j, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS d FROM x a JOIN x b USING (dim) GROUP BY a.t, b.t)"""


def table_kmeans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers of the best of ten starts over the whole table, as many as there are classes, and the cost."""
    e = tables.embeddings(spark, sf_dir).where(F.col("t").isNotNull() & F.col("features").isNotNull())
    rows = e.select("t", "features", (F.col("label") + 1).cast("double").alias("w"))
    k = e.select("label").distinct().count()
    found = kmeans.table_kmeans(rows, max(k, 1), SEED, steps=100)
    told = [] if found is None else [(j, c.tolist(), found[1]) for j, c in enumerate(found[0])]
    return spark.createDataFrame(told, "center int, features array<double>, cost double")


def coreset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir).where(F.col("t").isNotNull())
    return coreset.coreset_tree(e.select("t", "features", (F.col("label") + 1).cast("double").alias("w")), seed=SEED)


def closest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = vectors.closest_pair(vectors.class_centers(tables.embeddings(spark, sf_dir)))
    return pair.select("a", "b", r6("d2").alias("d2"))


def weighted_center_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).join(tables.embeddings(spark, sf_dir).select("t", "label"), "t").withColumn("w", F.col("t") % 7 + 1)
    return vectors.weighted_centers(rows, "label", "w").select("label", "dim", r6("c").alias("c"))


def code_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and dimension."""
    coded = tables.embeddings(spark, sf_dir).select("t", F.posexplode(vectors.resonance_code(F.col("features"))).alias("place", "x"))
    return coded.select("t", "place", r6("x").alias("x"))


def choice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By all dimensions; the first rows are the prototypes."""
    coded = tables.embeddings(spark, sf_dir).select("t", vectors.resonance_code(F.col("features")).alias("code"))
    protos = coded.where(F.col("t") < 12).select(F.col("t").alias("category"), F.col("code").alias("proto"))
    return vectors.resonance_choice(coded, protos, 0.8)


CODE_SQL = """
WITH x AS (SELECT vec_id AS t, list_transform(embedding, lambda v: least(1.0, greatest(0.0, v::DOUBLE))) AS x FROM embeddings),
s AS (SELECT t, list_concat(x, list_transform(x, lambda v: pow(v, 0.5))) AS s FROM x),
k AS (SELECT t, list_concat(s, list_transform(s, lambda v: 1.0 - v)) AS code FROM s)"""


def confidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary confidence of every row as a cluster: one-sidedness, sparseness and change of weight of its neighborhood."""
    stream = tables.embeddings(spark, sf_dir)
    return _confidence(stream, checkpointed(neighbors.pivot_neighbors(stream, 8, itself=False)))


def _confidence(stream: DataFrame, near: DataFrame) -> DataFrame:
    """Vectors travel whole, once for each neighbor: rows for each dimension took many times as much."""
    part = neighbors.compact(stream.where(F.size("features") > 0).select("t", "features"))
    around = near.select("i", "j").join(part.select(F.col("t").alias("j"), F.col("features").alias("u")), "j").groupBy("i").agg(F.collect_list("u").alias("us"))
    both = around.join(part.select(F.col("t").alias("i"), F.col("features").alias("v")), "i")
    off = F.transform("v", lambda v, d: F.abs(F.size(F.filter("us", lambda u: F.get(u, d) > v)) / F.size("us") - 0.5))
    skew = both.select("i", (vectors.total(off) / F.size("v") * 2.0).alias("skew"))
    sparse = near.groupBy("i").agg(F.least(F.avg("d") / (1.2 + 1e-12), F.lit(2.0)).alias("sparse"))
    w = part.select("t").distinct().select(F.col("t").alias("i"), (F.col("t") % 5 + 1).cast("double").alias("w"))
    middle = w.agg(F.expr("percentile(w, 0.5)").alias("m"))
    change = w.crossJoin(F.broadcast(middle)).select("i", F.least(F.abs(F.col("w") - F.col("m")) / (F.col("m") + 1e-12), F.lit(2.0)).alias("change"))
    value = 1.0 - (F.col("skew") + F.col("sparse") / 2.0 + F.col("change") / 2.0) / 3.0
    return skew.join(sparse, "i").join(change, "i").select("i", r6(F.least(F.lit(1.0), F.greatest(F.lit(0.05), value))).alias("confidence"))


CONFIDENCE_SQL = f"""
WITH {CELLS}, x AS (SELECT * FROM cells),
d AS (SELECT a.t AS i, b.t AS j, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS d FROM x a JOIN x b USING (dim) WHERE a.t <> b.t GROUP BY a.t, b.t),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place FROM d) WHERE place <= 8),
s AS (SELECT n.i, a.dim, avg((b.v > a.v)::INT::DOUBLE) AS pos FROM n JOIN x a ON a.t = n.i JOIN x b ON b.t = n.j AND a.dim = b.dim GROUP BY n.i, a.dim),
k AS (SELECT i, avg(abs(pos - 0.5)) * 2.0 AS skew FROM s GROUP BY i),
p AS (SELECT i, least(avg(d) / (1.2 + 1e-12), 2.0) AS sparse FROM n GROUP BY i),
w AS (SELECT DISTINCT t AS i, (t % 5 + 1)::DOUBLE AS w FROM x),
c AS (SELECT i, least(abs(w - m) / (m + 1e-12), 2.0) AS change FROM w, (SELECT quantile_cont(w, 0.5) AS m FROM w))
SELECT i, round(least(1.0, greatest(0.05, 1.0 - (skew + sparse / 2.0 + change / 2.0) / 3.0)), 6) + 0.0 AS confidence FROM k JOIN p USING (i) JOIN c USING (i)"""

LINEITEMS_SQL = """
li AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS t, l_quantity, l_extendedprice, l_discount, l_tax,
              CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem)"""

QUERIES = {
    "stream_projection_quality": stream_projection_quality,
    "contingency_table": contingency_query,
    "random_projection": projection_query,
    "causal_standardize": standardize_query,
    "causal_standardize_long": lineitem_standardize_query,
    "prefix_range_scale": prefix_range_query,
    "full_range_scale": full_range_query,
    "feature_subset_prefix": feature_subset_query,
    "lineitem_stream_chunks": lineitem_stream_query,
    "nearest_center": nearest_query,
    "coreset_mass": coreset_mass_query,
    "nearest_within_radius": within_query,
    "first_fitting_cluster": fitting_query,
    "weighted_lloyd_steps": lloyd_query,
    "knn_graph": neighbors_query,
    "calibration_radius": radius_query,
    "closest_pair": closest_query,
    "table_kmeans": table_kmeans_query,
    "coreset_tree": coreset_query,
    "weighted_centers": weighted_center_query,
    "resonance_code": code_query,
    "resonance_choice": choice_query,
    "boundary_confidence": confidence_query,
    "feature_subset_whole": feature_subset_query,
    "resonance_code_whole": code_query,
    "resonance_choice_whole": choice_query,
    "knn_graph_whole": neighbors_query,
    "calibration_radius_reference": radius_query,
    "boundary_confidence_whole": confidence_query,
}

ORACLE_SQL = {
    "stream_projection_quality": ASSIGNED_SQL + "," + ARI_NMI,
    "contingency_table": ASSIGNED_SQL + " SELECT truth, pred, count(*) AS n FROM p GROUP BY truth, pred",
    "random_projection": f"WITH {PROJECTED} SELECT t, j, round(z, 6) + 0.0 AS z FROM z",
    "causal_standardize": f"""
WITH {CELLS}, w AS (SELECT t, dim, v, count(*) OVER b AS n, avg(v) OVER b AS mean, var_samp(v) OVER b AS var FROM cells
  WINDOW b AS (PARTITION BY dim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT t, dim, round(CASE WHEN n < 2 THEN v - coalesce(mean, 0.0) ELSE (v - mean) / sqrt(var + 1e-8) END, 6) + 0.0 AS z FROM w""",
    "causal_standardize_long": f"""
WITH {LINEITEMS_SQL}, cells AS (SELECT t, 0 AS dim, l_quantity AS v FROM li UNION ALL SELECT t, 1, l_extendedprice FROM li UNION ALL SELECT t, 2, l_discount FROM li UNION ALL SELECT t, 3, l_tax FROM li),
w AS (SELECT t, dim, v, count(*) OVER b AS n, avg(v) OVER b AS mean, var_samp(v) OVER b AS var FROM cells
  WINDOW b AS (PARTITION BY dim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT t, dim, CASE WHEN n < 2 THEN v - coalesce(mean, 0.0) ELSE (v - mean) / sqrt(var + 1e-8) END AS z FROM w)
SELECT dim, t // 1000 AS chunk, round(avg(z), 5) AS z_mean, round(max(z), 5) AS z_max FROM z GROUP BY dim, chunk""",
    "prefix_range_scale": f"""
WITH {CELLS}, b AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM cells WHERE t < 100 GROUP BY dim)
SELECT t, dim, round(least(1.0, greatest(0.0, (v - lo) / (hi - lo + 1e-12))), 6) + 0.0 AS z FROM cells JOIN b USING (dim)""",
    "full_range_scale": f"""
WITH {CELLS}, b AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM cells GROUP BY dim)
SELECT t, dim, round((v - lo) / greatest(hi - lo, 1e-12), 6) + 0.0 AS z FROM cells JOIN b USING (dim)""",
    "feature_subset_prefix": f"WITH {CELLS} SELECT t, dim, round(v, 6) + 0.0 AS v FROM cells WHERE dim < 8",
    "lineitem_stream_chunks": f"""
WITH {LINEITEMS_SQL} SELECT label, t // 1000 AS chunk, count(*) AS n, round(avg(l_quantity), 6) + 0.0 AS quantity, round(avg(l_extendedprice), 6) + 0.0 AS price
FROM li GROUP BY label, chunk""",
    "nearest_center": NEAREST_SQL + " SELECT t, center, round(d2, 6) + 0.0 AS d2 FROM n",
    "coreset_mass": NEAREST_SQL + " SELECT center, round(sum(label + 1)::DOUBLE, 6) + 0.0 AS mass FROM n JOIN e USING (t) GROUP BY center",
    "first_fitting_cluster": FITTING_SQL,
    "nearest_within_radius": NEAREST_SQL + " SELECT t, CASE WHEN sqrt(d2) <= 1.2 THEN center END AS center FROM n",
    "weighted_lloyd_steps": _lloyd_sql(),
    "knn_graph": PAIRS_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j)::INT AS place FROM d WHERE i <> j) SELECT i, j, round(d, 6) + 0.0 AS d, place FROM r WHERE place <= 8",
    "calibration_radius": PAIRS_SQL.replace("SELECT * FROM cells", f"SELECT * FROM cells WHERE t IN (SELECT t FROM e ORDER BY t LIMIT {CALIBRATION})") + """, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place FROM d)
SELECT round(greatest(quantile_cont(d, 0.8), 1e-6), 6) + 0.0 AS radius FROM r WHERE place = 6""",
    "closest_pair": f"""
WITH {CELLS}, k AS (SELECT label AS center, dim, avg(v) AS c FROM cells GROUP BY label, dim),
d AS (SELECT a.center AS a, b.center AS b, round(sum((a.c - b.c) * (a.c - b.c)), 9) AS d2 FROM k a JOIN k b USING (dim) WHERE a.center < b.center GROUP BY a.center, b.center)
SELECT a, b, round(d2, 6) + 0.0 AS d2 FROM d ORDER BY d2, a, b LIMIT 1""",
    "weighted_centers": f"WITH {CELLS} SELECT label, dim, round(sum(v * (t % 7 + 1)) / sum(t % 7 + 1), 6) + 0.0 AS c FROM cells GROUP BY label, dim",
    "resonance_code": CODE_SQL + " SELECT t, unnest(range(0, len(code)))::INT AS place, round(unnest(code), 6) + 0.0 AS x FROM k",
    "resonance_choice": CODE_SQL + """,
m AS (SELECT a.t, b.t AS category, list_sum(list_transform(list_zip(a.code, b.code), lambda p: least(p[1], p[2]))) AS match, list_sum(a.code) AS norm, list_sum(b.code) AS size
      FROM k a, (SELECT * FROM k WHERE t < 12) b),
c AS (SELECT t, category, round(match / (0.001 + size), 9) AS value, round(match / greatest(norm, 1e-12), 9) >= 0.8 AS fits FROM m)
SELECT t, arg_max(category, (value, category)) FILTER (fits) AS category FROM c GROUP BY t""",
    "boundary_confidence": CONFIDENCE_SQL,
}

# The same without the limits of rows and width.
# The same queries under the names that whole-table forms had beside prefix forms.
for _whole, _plain in (("feature_subset_whole", "feature_subset_prefix"), ("resonance_code_whole", "resonance_code"), ("resonance_choice_whole", "resonance_choice"), ("knn_graph_whole", "knn_graph"), ("calibration_radius_reference", "calibration_radius"), ("boundary_confidence_whole", "boundary_confidence")):
    ORACLE_SQL[_whole] = ORACLE_SQL[_plain]
