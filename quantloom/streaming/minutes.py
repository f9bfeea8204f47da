"""Streams of ticks: tumbling bars, incremental append and keyed MACD states with their alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.sources.bars import minute_bars

LEAST_BARS = 60


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events that arrive as Parquet files under ``path``."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(ticks: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Bars of closed windows; a window closes once the watermark has passed it, so the newest stays open."""
    return minute_bars(ticks.withWatermark("ts", late), minutes)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it to ``path`` and read it back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_new(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Of a batch of bars those newer than the last stored bar of their code; all of a code not stored yet."""
    ends = stored.groupBy("code").agg(F.max("dt").alias("_last"))
    return batch.join(ends, "code", "left").where(F.col("_last").isNull() | (F.col("dt") > F.col("_last"))).drop("_last").dropDuplicates(["code", "dt"])


def macd_states(bars: DataFrame, notify_first: bool = False) -> DataFrame:
    """A stream of bars (code, dt, close) as events (code, dt, before, after) of the MACD state.

    The state of a code is golden or death from its 60th bar on; a flat bar neither reports nor changes the state. State
    kept: the two EMAs, the signal, the count and the last state, so it does not grow with the history.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fast, slow, signal, n, last = state.get if state.exists else (0.0, 0.0, 0.0, 0, "")
        events = []
        for row in pd.concat(list(batches)).sort_values("dt").itertuples():
            fast = row.close if n == 0 else fast + (row.close - fast) * 2 / 13
            slow = row.close if n == 0 else slow + (row.close - slow) * 2 / 27
            line = fast - slow
            signal = line if n == 0 else signal + (line - signal) * 2 / 10
            n += 1
            now = "golden" if line > signal + 1e-9 else "death" if line < signal - 1e-9 else "flat"
            if n >= LEAST_BARS and now != "flat":
                if last and last != now or not last and notify_first:
                    events.append((key[0], row.dt, last or "first", now))
                last = now
        state.update((fast, slow, signal, n, last))
        yield pd.DataFrame(events, columns=["code", "dt", "before", "after"])

    return bars.groupBy("code").applyInPandasWithState(
        run, "code string, dt timestamp, before string, after string", "fast double, slow double, signal double, n long, last string", "append", GroupStateTimeout.NoTimeout
    )
