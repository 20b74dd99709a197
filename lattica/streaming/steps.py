"""Structured Streaming over folders of steps: each new step's spectrum is appended as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lattica.plans.power_spectrum import power_spectrum
from lattica.sources.snapshots import SCHEMA, read_step


def spectra_of_steps(spark: SparkSession, path: str, out: str, checkpoint: str, grid: int, **how) -> StreamingQuery:
    """A query that writes (step, k, value) to `out` for all steps below path/particles, also later ones, then ends.

    A step that comes with a batch is read again as a whole and written in place of what `out` has of it; so a batch
    that is tried again, or a step that comes in two batches, leaves one spectrum.
    """
    schema = T.StructType([*SCHEMA.fields, T.StructField("step", T.IntegerType())])
    steps = spark.readStream.schema(schema).parquet(f"{path}/particles")

    def each(batch: DataFrame, number: int) -> None:
        for (step,) in batch.select("step").distinct().orderBy("step").collect():  # as many rows as steps
            spec = power_spectrum(read_step(spark, path, step), grid, **how)
            spec.select("k", "value").coalesce(1).write.mode("overwrite").parquet(f"{out}/step={step}")

    return steps.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
