"""Reading tables: CSV, Parquet, layered folders and the prepared table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.functions import rules
from tablewright.operators.cleaning import clean_table, cleaning_report


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None, corrupt: str | None = None) -> DataFrame:
    """CSV with a header.  Give a schema in jobs: inferring one reads the files twice.

    With a schema, ``corrupt`` names a column that keeps the text of lines that do not fit it."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if corrupt:
        if schema is None:
            raise ValueError("malformed lines are only known against a schema")
        known = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
        schema = known.add(corrupt, "string")
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(list(path) if isinstance(path, (list, tuple)) else path)


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def layer_path(root: str, layer: str, name: str) -> str:
    """Path of a table in the layered storage convention."""
    if layer not in rules.LAYERS:
        raise ValueError(f"unknown layer {layer}")
    return f"{root.rstrip('/')}/{layer}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def resolve_dataset(spark: SparkSession, paths: Sequence[str]) -> str:
    """First existing path, else the last one given (so that reading names it)."""
    return next((p for p in paths if path_exists(spark, p)), paths[-1])


def prepare_dataset(raw: DataFrame, path: str | None = None, periods=rules.PERIODS) -> tuple[DataFrame, str | None, DataFrame]:
    """Clean once, reuse often: persisted, or written to ``path`` and read back.

    Returns the cleaned table, its date column and the cleaning report.
    """
    cleaned, date = clean_table(raw, periods)
    if path:
        cleaned.write.mode("overwrite").parquet(path)
        cleaned = raw.sparkSession.read.parquet(path)
    else:
        cleaned = cleaned.persist(StorageLevel.MEMORY_AND_DISK)
    return cleaned, date, cleaning_report(raw, cleaned, date)


def raw_preview(df: DataFrame, order: Sequence[str], rows: int = 200) -> DataFrame:
    """The first ``rows`` rows by ``order``."""
    return df.orderBy(*order).limit(rows)


def year_partition_counts(df: DataFrame, date_col: str, years: int = 12) -> DataFrame:
    """Rows per year for the last years; rows without a date count as the latest."""
    counted = df.groupBy(F.year(date_col).alias("year")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc_nulls_first("year")).limit(years)
