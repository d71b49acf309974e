"""Readers of prepared and raw data files, with integrity checks; every reader takes Spark paths."""

from __future__ import annotations

import io
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.StructType([T.StructField("t", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])

# The columns of the raw electricity table.
ELECTRICITY = ("date", "day", "period", "nswprice", "nswdemand", "vicprice", "vicdemand", "transfer", "class")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file that matches."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified_bytes(spark: SparkSession, path: str, sha256: str | None = None) -> bytes:
    """A file's content; RuntimeError if its digest isn't the given one."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest")).first()
    if row is None:
        raise FileNotFoundError(path)
    if sha256 and row["digest"] != sha256:
        raise RuntimeError(f"{path}: digest {row['digest']} instead of {sha256}")
    return bytes(row["content"])


def read_npz(spark: SparkSession, path: str, rows: int | None = None, sha256: str | None = None) -> DataFrame:
    """(t, features, label) of an archive with arrays x and y; the archive is read whole, as its format asks."""
    with np.load(io.BytesIO(verified_bytes(spark, path, sha256)), allow_pickle=False) as data:
        x, y = data["x"].astype(np.float64), data["y"].astype(np.int64)
    if len(x) != len(y) or (rows is not None and len(x) != rows):
        raise ValueError(f"{path}: {len(x)} rows and {len(y)} labels instead of {rows or len(x)}")
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], VECTOR)


def read_npz_labels(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(t, label) of an archive with an array y."""
    with np.load(io.BytesIO(verified_bytes(spark, path)), allow_pickle=False) as data:
        y = data["y"].astype(np.int64)
    if rows is not None and len(y) != rows:
        raise ValueError(f"{path}: {len(y)} labels instead of {rows}")
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "t long, label int")


def is_absent(e: Exception) -> bool:
    """Whether an error says that a file isn't there; Spark reports absent paths as analysis errors."""
    return isinstance(e, FileNotFoundError) or "PATH_NOT_FOUND" in str(e)


def read_first(spark: SparkSession, readers: list) -> DataFrame:
    """The first of several readers whose file is there."""
    missing = []
    for reader in readers:
        try:
            return reader()
        except Exception as e:
            if not is_absent(e):
                raise
            missing.append(str(e).splitlines()[0])
    raise FileNotFoundError("; ".join(missing))


def check_shape(df: DataFrame, rows: int, width: int) -> DataFrame:
    """df, after a check of its number of rows and the width of every row."""
    found = df.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi")).first()
    if (found["n"], found["lo"], found["hi"]) != (rows, width, width):
        raise ValueError(f"{found['n']} rows of width {found['lo']} to {found['hi']} instead of {rows} of {width}")
    return df


def numbered_lines(spark: SparkSession, path: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """t (from 0, without gaps, in the order of file names and lines) and line, of the lines that ``keep`` keeps; line ends are cut.

    A line's number is its place in its block plus the lines of all blocks before it.  The table of blocks has one row for some 128 MB,
    and lines aren't shuffled: a block lies in one partition, where its lines follow each other.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = lines if keep is None else lines.where(keep(F.col("line")))
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    files = blocks.groupBy(F.col("_file").alias("_f")).agg(F.sum("_n").alias("_all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_f", F.coalesce(F.sum("_all").over(before(Window.partitionBy(F.lit(0)).orderBy("_f"))), F.lit(0)).alias("_far"))
    inner = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_file").orderBy("_block"))), F.lit(0))
    starts = blocks.withColumn("_near", inner).join(files, F.col("_file") == F.col("_f"))
    starts = starts.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "_first", (F.col("_near") + F.col("_far")).alias("_start"))
    joined = placed.join(starts, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return joined.select((F.col("_at") - F.col("_first") + F.col("_start")).cast("long").alias("t"), "line")


def read_headerless_csv(spark: SparkSession, path: str, features: int, first_label: int = 1) -> DataFrame:
    """Comma-separated numbers, gzip or not, without a header: features, then a label that starts at first_label.  Blank lines don't count."""
    names = [f"c{i}" for i in range(features + 1)]
    parsed = F.from_csv("line", ", ".join(f"{n} double" for n in names), {"mode": "FAILFAST"})
    df = numbered_lines(spark, path, lambda x: F.trim(x) != "").select("t", parsed.alias("c")).select("t", "c.*")
    return df.select("t", F.array(*names[:-1]).alias("features"), (F.col(names[-1]) - first_label).cast("int").alias("label"))


def read_arff(spark: SparkSession, path: str, columns: tuple[str, ...] = ELECTRICITY, classes: tuple[str, ...] = ("DOWN", "UP")) -> DataFrame:
    """Rows of an ARFF file or of a CSV file with a header; numbers that don't parse and unknown classes raise."""
    row = lambda x: ~F.trim(x).rlike("^[@%]") & (F.trim(x) != "") & (F.lower(F.trim(x)) != ",".join(columns))
    lines = numbered_lines(spark, path, row).select("t", F.trim("line").alias("line"))
    parts = F.split("line", ",")
    named = spark.read.text(path).where(F.lower(F.trim("value")).rlike("^@attribute\\s"))
    told = [r["c"] for r in named.select(F.lower(F.regexp_extract(F.trim("value"), "(?i)^@attribute\\s+'?([^'\\s]+)", 1)).alias("c")).collect()]
    if told and tuple(told) != tuple(columns):
        raise ValueError(f"{path}: columns {told} instead of {list(columns)}")
    ok = F.size(parts) == len(columns)
    cells = [F.element_at(parts, i + 1) for i in range(len(columns))]
    numbers = F.array(*[F.trim(c).cast("double") for c in cells[:-1]])
    name = F.upper(F.trim(F.regexp_replace(cells[-1], "['\"]", "")))
    label = F.when(F.lit(False), F.lit(0))
    for i, c in enumerate(classes):
        label = label.when(name == c, F.lit(i))
    label = label.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), name)).cast("int"))
    checked = F.when(ok, numbers).otherwise(F.raise_error(F.concat(F.lit("wrong number of columns: "), F.col("line"))).cast("array<double>"))
    return lines.select("t", checked.alias("features"), label.alias("label"))


def read_text_splits(spark: SparkSession, pairs: list[tuple[str, str]], rows: list[int] | None = None) -> DataFrame:
    """(split, line, text, label) of pairs of text and label files, united in the given order; lines are joined by number."""
    parts = []
    for k, (text, label) in enumerate(pairs):
        numbered = [numbered_lines(spark, p).select(F.col("t").alias("line"), F.col("line").alias(name)) for p, name in ((text, "text"), (label, "label"))]
        part = numbered[0].join(numbered[1], "line", "full").select(F.lit(k).alias("split"), "line", "text", F.col("label").cast("int").alias("label"))
        bad = part.where(F.col("text").isNull() | F.col("label").isNull()).count()
        if bad or (rows and part.count() != rows[k]):
            raise ValueError(f"{text}: {bad} lines without a partner, or not {rows[k] if rows else '?'} rows")
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(t, dim, v) of a table of (t, indices, values)."""
    df = spark.read.parquet(path)
    return df.select("t", F.explode(F.arrays_zip("indices", "values")).alias("c")).select("t", F.col("c.indices").alias("dim"), F.col("c.values").cast("double").alias("v"))


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result table with a header, with or without a byte order mark."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json_or_empty(spark: SparkSession, path: str) -> dict:
    """A JSON object, without its byte order mark; {} if the file isn't there or isn't one."""
    try:
        found = json.loads(verified_bytes(spark, path).decode("utf-8-sig"))
    except Exception as e:
        if isinstance(e, (ValueError, FileNotFoundError)) or "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return found if isinstance(found, dict) else {}
