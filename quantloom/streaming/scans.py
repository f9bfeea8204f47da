"""Scans that store their results batch by batch, passes over stored results, and late bars.

A result store is a folder of Parquet files, ``job_id=<job>/flush=<key>``. What is written there can be written again: a
flush is one partition, replaced as a whole, and named by the smallest symbol in it, so two flushes of a job never share a
name unless they hold the same symbols.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.operators import jobs, quality

Evaluate = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _files(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"cannot move {old} to {new}")


def stored_results(spark: SparkSession, store: str, job: str, schema: StructType | str) -> DataFrame:
    """The rows of a job, once each; none before its first flush. Only this job's folder is listed."""
    recover(spark, store, job)
    path = f"{store}/job_id={job}"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def flush(batch: DataFrame, store: str, job: str, evaluate: Evaluate, schema: StructType | str) -> None:
    """Evaluate the symbols of ``batch`` that the job has no row of, and store their rows as one partition.

    ``evaluate`` takes a frame of symbols and returns a row for each that it can evaluate, with ``schema`` (symbol first). A
    symbol without a row failed; it stays open, so a later run tries it again.
    """
    spark = batch.sparkSession
    done = stored_results(spark, store, job, schema).select("symbol")
    todo = batch.select("symbol").where("symbol is not null").distinct().join(done, "symbol", "left_anti")
    made = evaluate(todo).withColumns({"job_id": F.lit(job)})
    # evaluated once: the staged rows name the partition that they then become
    staged = f"{store}/_staged/{job}"
    made.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(made.schema).parquet(staged)
    first = rows.agg(F.min("symbol")).first()[0]
    if first is not None:
        rows = rows.withColumn("flush", F.sha1(F.lit(first)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", "flush").parquet(store)


def run_scan(symbols: DataFrame, store: str, checkpoint: str, job: str, evaluate: Evaluate, schema: StructType | str) -> None:
    """A scan as a stream: ``symbols`` (a stream with a column symbol, whose source sets the size of a batch) is evaluated and
    flushed batch by batch until all of it is stored.

    The checkpoint replays a batch that was cut off, with the same symbols; those already stored are passed over, so a
    restart, also one with a fresh checkpoint, ends with the same rows, each once.
    """
    query = symbols.writeStream.foreachBatch(lambda batch, _: flush(batch, store, job, evaluate, schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def recover(spark: SparkSession, store: str, job: str) -> None:
    """Undo a replacement of the job's rows that was cut off between its two moves."""
    if not _exists(spark, f"{store}/job_id={job}") and _exists(spark, f"{store}/_before/job_id={job}"):
        _move(spark, f"{store}/_before/job_id={job}", f"{store}/job_id={job}")


def second_pass(spark: SparkSession, store: str, job: str, enrich: Evaluate, schema: StructType | str) -> None:
    """Replace all rows of a job by ``enrich`` of them.

    The new rows are written beside the old ones; then two moves put them in their place. Readers see the old rows or the new
    ones (or for a moment none, which recover() mends), and repeating the pass repeats its result.
    """
    rows = stored_results(spark, store, job, schema)
    keep = [f.name for f in rows.schema if f.name not in ("job_id", "flush")]
    made = enrich(rows.select(*keep))
    place, next_, before = f"{store}/job_id={job}", f"{store}/_next/job_id={job}", f"{store}/_before/job_id={job}"
    made.withColumn("flush", F.lit("all")).write.mode("overwrite").partitionBy("flush").parquet(next_)
    fs, old = _files(spark, before)
    if _exists(spark, place):
        fs.delete(old, True)
        _move(spark, place, before)
    _move(spark, next_, place)
    fs.delete(old, True)


def add_portfolio(results: DataFrame, returns: DataFrame, **sizing: float) -> DataFrame:
    """``results`` (symbol, entry, stop, verdict, ...) with the portfolio's sizes and scale, which replace those of an earlier pass;
    the risk of all candidates is known only when all rows are stored."""
    added = ["shares", "reason", "risk", "scale", "suggested_shares", "suggested_risk"]
    own = results.drop(*added)
    made = jobs.evaluate_portfolio(own.select("symbol", "entry", "stop", "verdict"), returns, **sizing)
    return own.join(made.select("symbol", *added), "symbol", "left")


def trailing(source: DataFrame, stored: DataFrame, days: int = 15) -> DataFrame:
    """Rows of ``source`` from ``days`` before the last stored day of their symbol on; of symbols not stored yet, all."""
    ends = stored.groupBy("symbol").agg(F.max("dt").alias("_end"))
    return source.join(ends, "symbol", "left").where(F.col("_end").isNull() | (F.col("dt") >= F.date_sub("_end", days))).drop("_end")


def touched_symbols(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Symbols of which ``fresh`` brings a day that is new or says something else than the stored one.

    Every row counts: a checksum over the first, middle and last bar would pass over a correction between them.
    """
    values = [c for c in fresh.columns if c not in ("symbol", "dt") and c in stored.columns]
    old = stored.join(fresh.select("symbol", "dt"), ["symbol", "dt"], "left_semi").select("symbol", "dt", F.struct(*values).alias("_old"))
    both = fresh.select("symbol", "dt", F.struct(*values).alias("_new")).join(old, ["symbol", "dt"], "left")
    return both.where(~F.col("_new").eqNullSafe(F.col("_old"))).select("symbol").distinct()


def late_bars(stored: DataFrame, source: DataFrame, days: int = 15, keep_old: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The bars after a re-read of each symbol's trailing window, and the symbols that it touched. Columns of ``keep_old`` keep
    their value where the source has none."""
    fresh = trailing(source, stored, days)
    return quality.upsert(stored, fresh, ["symbol", "dt"], list(keep_old)), touched_symbols(stored, fresh)


def refresh(results: DataFrame, bars: DataFrame, touched: DataFrame, evaluate: Evaluate) -> DataFrame:
    """``results`` with the rows of touched symbols made anew from their bars; all other rows stay as they are, and other symbols'
    bars are not evaluated. ``recomputed`` says which is which."""
    again = evaluate(bars.join(touched, "symbol", "left_semi")).withColumn("recomputed", F.lit(True))
    kept = results.drop("recomputed").join(touched, "symbol", "left_anti").withColumn("recomputed", F.lit(False))
    return kept.unionByName(again)


def append_stream(bars: DataFrame, late: str = "15 days") -> DataFrame:
    """A stream of bars (code, period, dt, ...) whose sources send trailing windows again: each bar passes once. State is kept for
    ``late`` behind the newest bar; older repetitions are dropped by the watermark."""
    return bars.withWatermark("dt", late).dropDuplicatesWithinWatermark(["code", "period", "dt"])
