"""File sources and sinks: day files, symbol lists, watchlists, result tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.quality import normalize_symbol

#: The 32 bytes of a record of a day file.
DAY_RECORD = np.dtype([("day", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("rest", "<u4")])


def day_files(spark: SparkSession, path: str) -> DataFrame:
    """Bars of binary day files (``*.day``, named by symbol): prices and volumes are hundredths; days before 1990 are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                r = np.frombuffer(content[: len(content) // 32 * 32], dtype=DAY_RECORD)
                r = r[r["day"] >= 19900101]
                days = pd.to_datetime(r["day"].astype(str), format="%Y%m%d", errors="coerce").date
                yield pd.DataFrame({"code": name.rsplit("/", 1)[-1].removesuffix(".day"), "dt": days, **{c: r[c] / 100.0 for c in ("open", "high", "low", "close", "volume")}, "amount": r["amount"].astype(float)}).dropna(subset=["dt"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.day").load(path).select("path", "content")
    bars = files.mapInPandas(run, "code string, dt date, open double, high double, low double, close double, volume double, amount double")
    return bars.withColumn("symbol", normalize_symbol(F.col("code"))).drop("code")


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a list file, one a line, each once in order of its first line: seven digits with a market flag (0 SZ, 1 SH,
    2 BJ) before the code, or six."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("place"))
    flag, code = F.substring("line", 1, 1), F.substring("line", 2, 6)
    flagged = F.concat_ws(".", code, F.when(flag == "1", "SH").when(flag == "0", "SZ").when(flag == "2", "BJ"))
    symbol = F.when(F.col("line").rlike(r"^[012]\d{6}$"), flagged).when(F.col("line").rlike(r"^\d{6}$"), normalize_symbol(F.col("line")))
    return lines.select(symbol.alias("symbol"), "place").where("symbol is not null").groupBy("symbol").agg(F.min("place").alias("place")).orderBy("place").select("symbol")


def write_results(results: DataFrame, path: str) -> None:
    """Append-safe sink of scan results: rewriting a job replaces that job's folder only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def newest_jobs_only(results: DataFrame, keep: int = 5) -> DataFrame:
    """Rows of the newest ``keep`` jobs."""
    jobs = results.select("job_id").distinct()
    kept = jobs.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("job_id").desc()))).where(F.col("_rank") <= keep)
    return results.join(F.broadcast(kept.select("job_id")), "job_id", "left_semi")
