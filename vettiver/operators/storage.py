"""Reports as CSV and JSON, and a vector table that is loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by '|', as CSV has none."""
    flat = [F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_report(row: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def fingerprint(rows: DataFrame) -> tuple[int, int]:
    """(rows, sum of their hashes): what tells one vector table from another, in whatever order it is stored."""
    columns = sorted(rows.columns)
    row = rows.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def load_vectors(vectors: DataFrame, path: str, partition: str = "language") -> bool:
    """Write the vector table unless the same rows are there; True if it was written.

    Compressed with zstd and partitioned by language, so a search of one language reads that alone; within a partition
    rows are ordered by parent, if there is one, so that a parent's chunks are read from few row groups.
    """
    spark = vectors.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there and fingerprint(spark.read.schema(vectors.schema).parquet(path)) == fingerprint(vectors):
        return False
    rows = vectors.sortWithinPartitions(partition, "parent_id") if "parent_id" in vectors.columns else vectors
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(partition).parquet(path)
    return True


def missing_languages(vectors: DataFrame, path: str, languages: list[str]) -> list[str]:
    """The languages of ``languages`` that the stored vector table has no partition of."""
    there = vectors.sparkSession.read.parquet(path).select("language").distinct()
    wanted = vectors.sparkSession.createDataFrame([(x,) for x in languages], "language string")
    return sorted(r["language"] for r in wanted.exceptAll(there).collect())
