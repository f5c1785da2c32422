"""Results of a run as tables keyed by the time they were made, and the list of past runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Form of a run's id.
RUN_ID_FORMAT = "report_%Y_%m_%d_%H_%M_%S"
RUN_ID_PATTERN = r"^report_(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2})$"


class ReportError(ValueError):
    """A result that could not be written; the result itself is unharmed."""


def run_id(generated_at: datetime) -> str:
    return generated_at.strftime(RUN_ID_FORMAT)


def write_report_tables(
    tables: dict[str, DataFrame], output_dir: str, *, generated_at: datetime | None = None
) -> str:
    """Write each table below ``output_dir`` under the run's id, and the run itself last.

    A run is listed only once all its tables are there.
    """
    name = run_id(generated_at if generated_at is not None else datetime.now(timezone.utc))
    try:
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{output_dir}/{table}/run_id={name}")
        spark = next(iter(tables.values())).sparkSession
        marker = spark.createDataFrame([(name, list(tables))], "name STRING, tables ARRAY<STRING>")
        marker.coalesce(1).write.mode("overwrite").parquet(f"{output_dir}/runs/run_id={name}")
    except Exception as error:
        raise ReportError(f"could not write report to {output_dir}: {error}") from error
    return name


def read_report_table(spark: SparkSession, output_dir: str, table: str, name: str | None = None) -> DataFrame:
    """A table over all runs, or of one run; a run whose writing did not end is not among them."""
    df = spark.read.parquet(f"{output_dir}/{table}").withColumn("run_id", F.col("run_id").cast("string"))
    if name is not None:
        df = df.where(F.col("run_id") == name)
    return df.join(_written_runs(spark, output_dir), "run_id", "left_semi").select(df.columns)


def reports_in(names: DataFrame) -> DataFrame:
    """``run_id, generated_at`` of the names that are run ids, newest first."""
    stamp = F.concat(F.regexp_extract("run_id", RUN_ID_PATTERN, 1), F.lit(" +0000"))
    return (
        names.select("run_id", F.try_to_timestamp(stamp, F.lit("yyyy_MM_dd_HH_mm_ss Z")).alias("generated_at"))
        .where(F.col("generated_at").isNotNull())
        .orderBy(F.desc("generated_at"))
    )


def _written_runs(spark: SparkSession, output_dir: str) -> DataFrame:
    """``run_id`` of the runs that were written to the end; a missing folder holds none."""
    try:
        return spark.read.parquet(f"{output_dir}/runs").select(F.col("run_id").cast("string"))
    except AnalysisException:
        return spark.createDataFrame([], "run_id STRING")


def list_reports(spark: SparkSession, output_dir: str) -> DataFrame:
    """Past runs, newest first; a missing folder holds none, other names are ignored."""
    return reports_in(_written_runs(spark, output_dir))
