"""Quality monitoring of arriving files: the batch rules on event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tablewright.functions.columns import ratio
from tablewright.operators.profile import drift_status


def read_files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """A Parquet folder as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def window_facts(df: DataFrame, time_col: str, cols: Sequence[str], span: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Rows, gaps, mean and spread per event-time window; the same plan serves batch and stream."""
    timed = df.withColumn("_t", F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if late and df.isStreaming else timed
    made: list[Column] = [F.count("*").alias("n")]
    for c in cols:
        made += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_missing"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    facts = timed.groupBy(F.window("_t", span).alias("_w")).agg(*made)
    return facts.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *[c for c in facts.columns if c != "_w"])


def baseline(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the mean and spread every window is compared with."""
    return df.agg(*[x for c in cols for x in (F.avg(c).alias(f"base_{c}_mean"), F.stddev_samp(c).alias(f"base_{c}_std"))])


def judge(facts: DataFrame, known: dict[str, float | None], cols: Sequence[str], warn_missing: float = 5, fail_missing: float = 20) -> DataFrame:
    """Missing and drift status per window and column against the row of ``baseline``, in long form."""
    cells = []
    for c in cols:
        gaps = F.coalesce(ratio(F.col(f"{c}_missing") * 100, F.col("n")), F.lit(0.0))
        mean, spread = F.lit(known[f"base_{c}_mean"]).cast("double"), F.lit(known[f"base_{c}_std"]).cast("double")
        z = ratio(F.col(f"{c}_mean") - mean, spread)
        pct = ratio((F.col(f"{c}_mean") - mean) * 100, F.abs(mean))
        health = F.when(gaps < warn_missing, "Pass").when(gaps < fail_missing, "Warning").otherwise("Fail")
        cells.append(F.struct(F.lit(c).alias("metric"), F.col("n"), gaps.alias("missing_pct"), health.alias("missing_status"), z.alias("z_shift"), drift_status(z, pct).alias("drift_status")))
    return facts.select("window_start", F.explode(F.array(*cells)).alias("r")).select("window_start", "r.*")


def start_monitor(
    stream: DataFrame, base: DataFrame, time_col: str, cols: Sequence[str], out: str, checkpoint: str, span: str = "1 day", late: str = "1 hour"
) -> StreamingQuery:
    """Judge every finished window and append it to ``out``.

    Each batch writes its own folder, so a batch that is run again after a failure
    replaces its rows instead of adding them twice.
    """
    facts = window_facts(stream, time_col, cols, span, late)
    known = base.first().asDict()  # once, not in every batch

    def write(batch: DataFrame, number: int) -> None:
        judge(batch, known, cols).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return facts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
