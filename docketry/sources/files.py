"""Files: typed JSON lines with a quarantine, JSON arrays, manifests, and releases behind a pointer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine (file, line)) of JSON lines; blank lines are skipped, lines that don't fit the schema are set apart."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    marked = StructType([*schema.fields, StructField(BAD, StringType())])
    both = lines.withColumn("r", F.from_json("value", marked, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}))
    bad = F.col(f"r.{BAD}").isNotNull()
    return both.where(~bad).select("r.*").drop(BAD), both.where(bad).select("file", F.col("value").alias("line"))


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """JSON lines in fixed key order, ids in order over the files."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.option("ignoreNullFields", False).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, line ends counted as line feeds."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n")
    return raw.select("path", F.col("length").alias("bytes"), F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, records) of files of lines."""
    counts = spark.read.text(path).where("trim(value) <> ''").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("records"))
    return file_digests(spark, path).join(counts, "path", "left").na.fill(0, ["records"])


def verify_manifest(spark: SparkSession, path: str, stated: DataFrame) -> DataFrame:
    """(path, issue): files that are missing, unexpected, or of another digest or number of records."""
    row = lambda df, name: df.select("path", F.struct("sha256", "records").alias(name))
    met = row(stated, "s").join(row(manifest(spark, path), "f"), "path", "full_outer")
    issue = F.when(F.col("f").isNull(), "missing").when(F.col("s").isNull(), "unexpected").when(~F.col("s.sha256").eqNullSafe(F.col("f.sha256")), "digest").when(F.col("s.records") != F.col("f.records"), "records")
    return met.select("path", issue.alias("issue")).where("issue is not null")


def publish(tables: dict[str, DataFrame], folder: str, release_id: str) -> None:
    """Writes tables under a release and points to it only if the written counts are the given ones; old releases stay.

    A pointer is one more file, never an overwritten one, so that there is an active release at any time; the newest counts.
    """
    for name, df in tables.items():
        want = df.count()
        path = f"{folder}/{name}/release_id={release_id}"
        df.write.mode("errorifexists").parquet(path)
        if (got := df.sparkSession.read.parquet(path).count()) != want:
            raise ValueError(f"{name}: {got} rows written, {want} given")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(release_id, time.time_ns())], "release_id string, at long").coalesce(1).write.mode("append").parquet(f"{folder}/_active")


def read_release(spark: SparkSession, folder: str, name: str) -> DataFrame:
    active = spark.read.parquet(f"{folder}/_active").agg(F.max_by("release_id", "at")).first()[0]
    return spark.read.parquet(f"{folder}/{name}/release_id={active}")


def save_vectors(df: DataFrame, path: str, model: str, revision: str, dimensions: int) -> None:
    """Vectors with their specification in every row; other lengths are an error."""
    fine = df.withColumn("vector", F.when(F.size("vector") == dimensions, F.col("vector")).otherwise(F.raise_error(F.lit("vector of another length"))))
    fine.withColumns({"model": F.lit(model), "revision": F.lit(revision), "dimensions": F.lit(dimensions)}).write.parquet(path)


def load_vectors(spark: SparkSession, path: str, model: str, revision: str, dimensions: int) -> DataFrame:
    """Vectors, if all rows have the wanted specification."""
    df = spark.read.parquet(path)
    same = (F.col("model") == model) & (F.col("revision") == revision) & (F.col("dimensions") == dimensions)
    return df.withColumn("vector", F.when(same, F.col("vector")).otherwise(F.raise_error(F.lit("vectors of another specification")))).drop("model", "revision", "dimensions")
