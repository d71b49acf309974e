"""Mixing sources to target weights by Pareto order sampling.

A source's target is a water filling: the total is dealt by weight, no source takes
more than ``max_repeats`` times its size, and the excess is dealt again.

Within a source, documents have unequal numbers of expected copies: a document's measure is the
number of binary digits of its size (longer texts carry more context, and a text of 4000 words
counts 3 times one of 15), and it expects  e = min(max_repeats, c * measure)  copies, where c is
such that the source's expected words are its target: another water filling, over the at most 64
measures.  floor(e) copies are certain; one more is sampled with inclusion probability
lambda = frac(e), which differs by document.

Documents are ranked by the Pareto variable  (u / (1 - u)) / (lambda / (1 - lambda)),
u a uniform number from the digest of id and text, and the lowest are taken: a sample of fixed
size, which is counted in words.  The prefix in this order that stays within the
remaining words is taken; then, where it brings the source nearer, the one document
whose size is nearest to the gap that is left (ties: lower rank).

The prefix is found without sorting a source in one task: two rounds of sums over fixed
grids (``GRID`` cells of the rank for each source) find the cell where the source's words
are used up, and only that cell's different rows are ordered, each with its number of copies.
A narrow table (id, source, size, digest) is checkpointed; texts are read once.

Cases: null text has size 0; null source is a source of its own, last in order; null and
repeated ids are drawn with the text's digest; rows that repeat wholly are ranked together and
a prefix may end among them (which of them are taken then is arbitrary, how many isn't);
empty tables give no rows; sources of size 0 take nothing; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import checkpointed, count_words, documents, running_number

GRID = 1 << 10
BROADCAST_SOURCES = 50_000


def filled(rows: DataFrame, group: list[str], order: list[Column], cap: Column, weight: Column, total: Column) -> DataFrame:
    """Adds _water: the level at which min(cap, level * weight) sums to the total of a group; null if all caps together don't exceed it.

    order: by rising cap / weight.  cap, weight and total are of rows of bounded tables.
    """
    w = Window.partitionBy(*group)
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = w.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    level = F.try_divide(total - F.coalesce(F.sum(cap).over(before), F.lit(0)), F.sum(weight).over(onward))
    out = rows.withColumn("_t", level)
    return out.withColumn("_water", F.max(F.when(F.col("_t") * weight <= cap, F.col("_t"))).over(w)).drop("_t")


def source_targets(sizes: DataFrame, total_share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """sizes: (source, source_size), a row for each source.  Adds target; weights repeat in order of the source's name."""
    last = F.col("source").asc_nulls_last()
    turn = F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(last)) - 1, F.lit(len(weights))).cast("int")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), turn + 1).cast("double")
    every = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(total_share)
    named = sizes.withColumn("_w", w).withColumn("_cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("_total", every).withColumn("_one", F.lit(0))
    full = filled(named, ["_one"], [F.col("_cap") / F.col("_w"), last], F.col("_cap"), F.col("_w"), F.col("_total"))
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("_w")))
    return full.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def expected_copies(classes: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """targets with _copies (measure -> expected copies of a document) and _need, the words that the sampled copies are to make up.

    classes: (source, _m, _words), the words of each measure.
    """
    same = F.col("source").eqNullSafe(F.col("_s"))
    sized = classes.join(targets.select(F.col("source").alias("_s"), "target"), same).drop("_s")
    full = filled(sized, ["source"], [F.col("_m").desc()], F.col("_words") * max_repeats, F.col("_words") * F.col("_m"), F.col("target"))
    e = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("_water").isNull(), F.lit(float(max_repeats))).otherwise(F.least(F.lit(float(max_repeats)), F.col("_water") * F.col("_m")))
    rows = full.withColumn("_e", e).groupBy(F.col("source").alias("_s"))
    table = rows.agg(F.map_from_entries(F.collect_list(F.struct("_m", "_e"))).alias("_copies"), F.sum(F.floor("_e") * F.col("_words")).alias("_certain"))  # 64 measures at most
    return targets.join(table, same).withColumn("_need", F.col("target") - F.col("_certain")).drop("_s", "_certain")


def by_source(rows: DataFrame, small: DataFrame, n_sources: int) -> DataFrame:
    """rows with small's columns, by source (null equals null): small is broadcast up to a checked number of sources."""
    small = small.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(small) if n_sources <= BROADCAST_SOURCES else small, rows["source"].eqNullSafe(F.col("_source")), "left").drop("_source")


def uniform(doc_id: Column, digest: Column) -> Column:
    """A number in (0, 1) from the md5 of the id and the text's digest."""
    hashed = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("/"), digest).cast("binary"))
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _drawn(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the size, its measure, the text's digest and the uniform number."""
    out = docs.withColumn("size", count_words(F.col("text"))).withColumn("_digest", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return out.withColumn("_m", F.length(F.bin("size"))).withColumn("_u", uniform(F.col("doc_id"), F.col("_digest")))


def _key() -> Column:
    return F.struct(F.col("_rank").alias("r"), F.col("doc_id").alias("i"), F.col("_digest").alias("c"))


def _ranked(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """rows with table's columns, certain copies, _rank (the Pareto variable q = odds(u) / odds(lambda) as q / (1 + q)) and its grid cells."""
    out = by_source(rows, table, n_sources).withColumn("_e", F.element_at("_copies", F.col("_m"))).drop("_copies")
    out = out.withColumn("_whole", F.floor("_e").cast("int")).withColumn("_lambda", F.col("_e") - F.floor("_e")).drop("_e")
    a, b = F.col("_u") * (1 - F.col("_lambda")), (1 - F.col("_u")) * F.col("_lambda")
    out = out.withColumn("_rank", F.when(F.col("_lambda") > 0, a / (a + b)).otherwise(F.lit(1.0)))
    out = out.withColumn("_c1", F.least(F.floor(F.col("_rank") * GRID), F.lit(GRID - 1)))
    return out.withColumn("_c2", F.least(F.floor((F.col("_rank") * GRID - F.col("_c1")) * GRID), F.lit(GRID - 1)))


def _crossing(sums: DataFrame, need: DataFrame, cell: str, base: Column, n_sources: int) -> DataFrame:
    """For each source: the first cell whose words exceed what is left, and the words before it."""
    w = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    run = by_source(sums, need, n_sources).withColumn("_run", F.sum("_words").over(w) + base)
    over = run.where(F.col("_run") > F.col("_need"))
    return over.groupBy("source").agg(F.min(F.struct(F.col(cell), (F.col("_run") - F.col("_words")).alias("before"))).alias("_x"))


def _inside() -> Column:
    """Whether a ranked row is in its source's prefix, given the crossing cell and the last key within it."""
    later = F.struct(F.col("_c1").alias("a"), F.col("_c2").alias("b"))
    cross = F.struct(F.col("_x1").alias("a"), F.col("_x2").alias("b"))
    inside = F.col("_x1").isNull() | (later < cross) | ((later == cross) & F.coalesce(_key() <= F.col("_until"), F.lit(False)))
    return F.coalesce(inside, F.lit(False)) & (F.col("_lambda") > 0)


def decisions(rows: DataFrame, total_share: float, max_repeats: int, weights: tuple[int, ...]) -> tuple[DataFrame, int]:
    """A row for each source: target, expected copies, where its prefix ends, how many rows of the next key it
    still takes (_part: k, n, take), and the closing document (_last: d, k, n).  rows: the narrow table."""
    classes = checkpointed(rows.groupBy("source", "_m").agg(F.sum("size").alias("_words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")), total_share, max_repeats, weights)
    targets = checkpointed(expected_copies(classes, targets, max_repeats))
    n = targets.count()
    ranked = _ranked(rows, targets.select("source", "_copies", "_need"), n)
    drawn, need = ranked.where(F.col("_lambda") > 0), targets.select("source", "_need")
    first = _crossing(drawn.groupBy("source", "_c1").agg(F.sum("size").alias("_words")), need, "_c1", F.lit(0), n)
    first = checkpointed(first.select("source", F.col("_x._c1").alias("_x1"), F.col("_x.before").alias("_b1")))
    inner = by_source(drawn, first, n).where(F.col("_c1") == F.col("_x1"))
    second = _crossing(inner.groupBy("source", "_c2").agg(F.sum("size").alias("_words")), by_source(need, first, n), "_c2", F.col("_b1"), n)
    cut = checkpointed(by_source(first, second, n).select("source", "_x1", F.col("_x._c2").alias("_x2"), F.col("_x.before").alias("_b2")))
    at = (F.col("_c1") == F.col("_x1")) & (F.col("_c2") == F.col("_x2"))
    # Equal rows are counted first; the prefix may end within such a group.
    groups = by_source(drawn, cut, n).where(at).groupBy("source", "_rank", "doc_id", "_digest", "size", "_need", "_b2").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("source").orderBy("_rank", "doc_id", "_digest").rowsBetween(Window.unboundedPreceding, 0)
    edge = groups.withColumn("_run", F.sum(F.col("size") * F.col("_n")).over(w) + F.col("_b2"))
    fits = F.col("_run") <= F.col("_need")
    left = F.col("_need") - F.col("_run") + F.col("size") * F.col("_n")
    part = F.struct(_key().alias("k"), F.col("_n").alias("n"), F.floor(F.try_divide(left, F.col("size"))).alias("take"), "size")
    ends = edge.groupBy("source").agg(F.max(F.when(fits, _key())).alias("_until"), F.min(F.when(~fits, part)).alias("_part"))
    table = checkpointed(by_source(by_source(targets, cut, n), ends, n))
    # The gap that the prefix leaves, and the one document outside that fills it best.
    chosen = _ranked(rows, table, n).withColumn("_in", _inside())
    got = chosen.groupBy("source").agg((F.coalesce(F.sum(F.when(F.col("_in"), F.col("size"))), F.lit(0)) + F.coalesce(F.max(F.col("_part.take") * F.col("_part.size")), F.lit(0))).alias("_got"))
    off = F.abs(F.col("_need") - F.col("_got") - F.col("size"))
    spare = ~F.col("_in") & (F.col("size") > 0) & (F.col("_whole") < max_repeats)
    spare = spare & ~F.coalesce((_key() == F.col("_part.k")) & (F.col("_part.take") >= F.col("_part.n")), F.lit(False))
    gaps = by_source(chosen.where(spare), checkpointed(got), n)
    gaps = gaps.where(off < F.col("_need") - F.col("_got")).groupBy("source", off.alias("d"), _key().alias("k")).agg(F.count("*").alias("n"))
    last = gaps.groupBy("source").agg(F.min(F.struct("d", "k", "n")).alias("_last"))
    return checkpointed(by_source(table, last, n)), n


def mix(docs: DataFrame, total_share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = (3, 1, 2), keep: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of docs (doc_id, text, source).

    With ``keep``, instead: doc_id, source, these columns of docs, and copies; the texts are
    scanned again, not shuffled, as a table with a row for each source decides about each row.
    """
    rows = checkpointed(_drawn(docs.select("doc_id", "source", "text")).drop("text"))
    table, n = decisions(rows, total_share, max_repeats, weights)
    plain = rows
    if keep is not None:
        plain = _drawn(docs.select("doc_id", "source", *dict.fromkeys((*keep, "text"))))
    out = _ranked(plain, table, n)
    ends, closes = (F.coalesce(_key() == F.col(f"{c}.k"), F.lit(False)) for c in ("_part", "_last"))
    more = F.when(ends, F.col("_part.take")).otherwise(0) + F.when(closes, 1).otherwise(0)
    out = out.withColumn("_in", _inside()).withColumn("_more", more.cast("long"))
    # Of a group of equal rows, only some are taken at the prefix's end: those rows alone get numbers.
    among = (F.col("_more") > 0) & F.when(ends, F.col("_part.n") > 1).otherwise(F.col("_last.n") > 1)
    one = out.where(~among).withColumn("_extra", (F.col("_in") | (F.col("_more") > 0)).cast("int"))
    if table.where((F.col("_part.take") > 0) | (F.col("_last.n") > 1)).limit(1).count():
        some = running_number(out.where(among), ["source", "doc_id", "_digest"], "_turn")
        out = one.unionByName(some.withColumn("_extra", (F.col("_in") | (F.col("_turn") < F.col("_more"))).cast("int")).drop("_turn"))
    else:
        out = one
    out = out.withColumn("copies", F.col("_whole") + F.col("_extra"))
    if keep is not None:
        return out.select("doc_id", "source", *keep, "copies")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(text, '')) AS digest,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
dm AS (SELECT *, length(bin(size))::BIGINT AS m FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
              (2 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM s1),
s3 AS (SELECT *, max(CASE WHEN t * w <= cap THEN t END) OVER () AS water FROM s2),
tg AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM s3),
k AS (SELECT source, m, sum(size)::BIGINT AS words FROM dm GROUP BY source, m),
k1 AS (SELECT k.*, tg.target,
              (tg.target - coalesce(sum(2 * words) OVER (PARTITION BY k.source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / nullif(sum(m * words) OVER (PARTITION BY k.source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS t
       FROM k JOIN tg ON k.source IS NOT DISTINCT FROM tg.source),
k2 AS (SELECT *, max(CASE WHEN t * (m * words)::DOUBLE <= (2 * words)::DOUBLE THEN t END) OVER (PARTITION BY source) AS water FROM k1),
k3 AS (SELECT source, m, words, CASE WHEN target <= 0 THEN 0.0::DOUBLE WHEN water IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, water * m) END AS e FROM k2),
nd AS (SELECT source, sum(floor(e) * words) AS certain FROM k3 GROUP BY source),
r AS (SELECT dm.doc_id, dm.source, dm.size, dm.digest, tg.source_size, tg.target, floor(k3.e) AS whole, k3.e - floor(k3.e) AS lam,
             tg.target - nd.certain AS need, dm.u
      FROM dm JOIN tg ON dm.source IS NOT DISTINCT FROM tg.source JOIN k3 ON dm.source IS NOT DISTINCT FROM k3.source AND dm.m = k3.m
           JOIN nd ON dm.source IS NOT DISTINCT FROM nd.source),
q AS (SELECT *, CASE WHEN lam > 0 THEN u * (1 - lam) / (u * (1 - lam) + (1 - u) * lam) ELSE 1.0::DOUBLE END AS rank FROM r),
c AS (SELECT *, (lam > 0 AND sum(CASE WHEN lam > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= need) AS inside FROM q),
g AS (SELECT *, need - sum(CASE WHEN inside THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
             CASE WHEN NOT inside AND size > 0 AND whole < 2 AND abs(gap - size) < gap THEN 0 ELSE 1 END, abs(gap - size), rank, doc_id, digest) = 1
             AND NOT inside AND size > 0 AND whole < 2 AND abs(gap - size) < gap AS closes FROM g)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN inside OR closes THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM f
"""
