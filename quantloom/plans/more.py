"""Further registered queries: waves, periods, stages, streams, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import quality, records, waves
from quantloom.operators.indicators import rounded
from quantloom.plans import sql
from quantloom.plans.catalog import checksum_sql, register
from quantloom.plans.sql import W, over
from quantloom.sources import bars as src
from quantloom.sources.bars import scratch
from quantloom.streaming import minutes

_WAVE = """v0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rk, count(*) OVER (PARTITION BY symbol) AS al, lag(close) OVER w AS c1,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS m20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
v1 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i FROM v0 WHERE rk <= 120 AND al >= 60),
a0 AS (SELECT symbol, any_value(n) AS n, arg_min(i, ROW(low, i)) AS i0, min(low) AS l0 FROM v1 WHERE i < greatest(1, floor(n * 0.5::DOUBLE)) GROUP BY symbol),
a1 AS (SELECT a0.symbol, arg_min(i, ROW(-high, i)) AS i1, max(high) AS h1 FROM v1 JOIN a0 USING (symbol) WHERE i >= i0 + 5 AND i <= v1.n - 6 GROUP BY 1),
a2 AS (SELECT symbol, arg_min(i, ROW(low, i)) AS i2, min(low) AS l2 FROM v1 JOIN a1 USING (symbol) WHERE i >= i1 + 5 GROUP BY 1),
a3 AS (SELECT symbol, a0.n, i0, l0, i1, h1, i2, l2 FROM a0 LEFT JOIN a1 USING (symbol) LEFT JOIN a2 USING (symbol)),
a4 AS (SELECT a3.symbol, any_value(a3.n) AS n, any_value(l0) AS l0, any_value(h1) AS h1, any_value(i2) AS i2, any_value(l2) AS l2,
  count(*) FILTER (i > i0 + 1 AND i <= i1 AND close > c1) / greatest(1, count(*) FILTER (i > i0 + 1 AND i <= i1))::DOUBLE AS up,
  avg(volume) FILTER (i > i0 AND i <= i1) AS vol1, avg(volume) FILTER (i > i1 AND i <= i2) AS vol2, min(i) FILTER (i > i2 AND close >= h1) AS i3, min(low) FILTER (i > i2) AS la
  FROM v1 JOIN a3 USING (symbol) GROUP BY 1),
a5 AS (SELECT a4.symbol, max(volume) FILTER (i > i2 AND i >= i3 - 2 AND i <= i3) AS bv, max(close) FILTER (i = i3) AS bc FROM v1 JOIN a4 USING (symbol) GROUP BY 1),
a6 AS (SELECT *, h1 / l0 - 1 AS gain, CASE WHEN h1 > l0 THEN (h1 - l2) / (h1 - l0) END AS re FROM v1 JOIN a4 USING (symbol) JOIN a5 USING (symbol) WHERE rk = 1),
a7 AS (SELECT *, coalesce(gain >= 0.15 AND up >= 0.5, false) AS k1 FROM a6),
a8 AS (SELECT *, k1 AND coalesce(re BETWEEN 0.3 AND 0.8 AND l2 > l0, false) AS k2 FROM a7),
wv AS (SELECT *, CASE WHEN k2 THEN l2 * 0.98::DOUBLE END AS st, CASE WHEN k2 THEN coalesce(bc, close) END AS en, k2 AND i3 IS NOT NULL AS br FROM a8)"""


@register("v2_wave_structure", over("""SELECT symbol, dt, CASE WHEN NOT k1 THEN 'no first wave' WHEN i2 IS NULL THEN 'second wave running' WHEN NOT k2 THEN 'second wave unfit' WHEN NOT br THEN 'waiting for break' ELSE 'third wave' END AS phase,
  round(gain, 5) AS gain, round(up, 5) AS up_ratio, round(re, 5) AS retrace, k1 AS wave1_ok, k1 AND i2 IS NOT NULL AS wave2_exists, k2 AS wave2_ok, k1 AND coalesce(vol2 / vol1 <= 0.85, false) AS shrinks, k2 AND coalesce(la >= l2 * 0.99::DOUBLE, true) AS stable,
  br AS breakout, br AND coalesce(bv / vol2 >= 1.5, false) AS expands, br AND coalesce(en / h1 - 1 > 0.05 OR v1_n - 1 - i3 > 5, false) AS chase_risk, coalesce(close < m20, false) OR coalesce(close < st, false) AS exhausted,
  en AS entry, st AS stop FROM (SELECT *, n AS v1_n FROM wv)""", _WAVE.replace("SELECT *, h1 / l0 - 1 AS gain", "SELECT v1.*, a4.* EXCLUDE (symbol, n), a5.* EXCLUDE (symbol), h1 / l0 - 1 AS gain")))  # fmt: skip
def v2_wave_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(waves.wave_structure(src.bars(spark, sf_dir)))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = src.bars(spark, sf_dir, weekdays=False)
    units = {u: waves.period_position(quality.resample(every, u), u) for u in ("week", "month")}
    return waves.alignment(waves.period_position(src.bars(spark, sf_dir), "day"), units["week"], units["month"])


def _period(name: str, source: str, back: int) -> str:
    rows = lambda n: f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""{name}_0 AS (SELECT *, row_number() OVER w AS rn, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rk, {", ".join(f"{sql.mean('close', n)} AS m{n}" for n in (5, 10, 20))}, min(low) {rows(60)} AS lo, max(high) {rows(60)} AS hi FROM {source} {W}),
{name} AS (SELECT symbol, CASE WHEN m5 > m10 AND m10 > m20 AND close > m20 THEN 1 WHEN m5 < m10 AND m10 < m20 THEN -1 ELSE 0 END AS d, (m20 - b) / abs(b) * 100 AS s,
  CASE WHEN hi <= lo THEN 'unknown' WHEN (close - lo) / (hi - lo) >= 0.8 THEN 'high' WHEN (close - lo) / (hi - lo) >= 0.3 THEN 'middle' ELSE 'low' END AS z FROM (SELECT *, lag(m20, {back}) OVER w AS b FROM {name}_0 {W}) WHERE rk = 1 AND rn >= 20)"""


_WEEKS, _MONTHS = sql.weeks().replace("r0", "rw0").replace("r1", "rw1").replace("res AS", "wk AS"), sql.weeks("month").replace("r0", "rm0").replace("r1", "rm1").replace("res AS", "mo AS")
_ALIGN = ", ".join([_WEEKS, _MONTHS, _period("pd", "bars", 20), _period("pw", "wk", 8), _period("pm", "mo", 6), """al AS (SELECT symbol, pd.d AS dd, pw.d AS dw, pm.d AS dm, pm.s AS ms, pd.z AS zd, pw.z AS zw, pm.z AS zm,
  (pd.d IS NOT NULL)::INT + (pw.d IS NOT NULL)::INT + (pm.d IS NOT NULL)::INT AS kn FROM pd FULL JOIN pw USING (symbol) FULL JOIN pm USING (symbol))"""])  # fmt: skip
_OK = "kn >= 2 AND NOT (coalesce(dd < 0, false) OR coalesce(dw < 0, false) OR coalesce(dm < 0, false)) AND (coalesce(dd = 1, false) OR coalesce(dw = 1, false))"


@register("v1_period_alignment", over(f"""SELECT symbol, dd AS day_direction, dw AS week_direction, dm AS month_direction, zd AS day_zone, zw AS week_zone, zm AS month_zone, kn AS known_periods, {_OK} AS trend_ok FROM al""", _ALIGN))
def v1_period_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("symbol", "day_direction", "week_direction", "month_direction", "day_zone", "week_zone", "month_zone", "known_periods", "trend_ok")


@register("r12_multi_period_factor", over("""SELECT symbol, CASE WHEN dm IS NULL THEN 1.0 WHEN dm = 1 THEN CASE WHEN sl > 1 THEN 1.15 WHEN sl < -1 THEN 1.0 ELSE 1.05 END WHEN dm = 0 THEN CASE WHEN sl > 1 THEN 1.05 WHEN sl < -1 THEN 0.95 ELSE 1.0 END
  ELSE CASE WHEN sl > 1 THEN 0.95 WHEN sl < -1 THEN 0.7 ELSE 0.85 END END::DOUBLE AS weight,
  (4.0 * ((coalesce(dw * dm, 0) = 1)::INT + (coalesce(dd * dm, 0) = 1)::INT + (coalesce(dw * dd, 0) = 1)::INT))::DOUBLE AS bonus, (9.0 * ((coalesce(dw * dm, 0) = -1)::INT + (coalesce(dd * dm, 0) = -1)::INT + (coalesce(dw * dd, 0) = -1)::INT))::DOUBLE AS penalty
  FROM (SELECT *, round(coalesce(ms, 0), 2) AS sl FROM al)""", _ALIGN))  # fmt: skip
def r12_multi_period_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("symbol", "weight", "bonus", "penalty")


@register("v3_rules_and_verdict")
def v3_rules_and_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = waves.wave_structure(src.bars(spark, sf_dir))
    return waves.rules_and_verdict(found, _positions(spark, sf_dir)).select("symbol", "phase", F.array_join(F.col("failed_hard").cast("array<string>"), ",").alias("failed_hard"), "quality", "verdict")


@register("r13_stage", over(f"""SELECT symbol, dt, round(t5, 5) AS t5, round(t20, 5) AS t20, vt AS volume_trend, am AS amplitude, CASE WHEN rn < 30 THEN 'unknown' WHEN close >= 0.9::DOUBLE * hi AND NOT close <= 1.1::DOUBLE * lo AND vt > 1.1 AND t20 < 0.05 THEN 'distribution' WHEN t20 < -0.03 AND vt > 1.1 THEN 'distribution'
  WHEN t20 > 0.03 AND t5 < -0.01 AND vt < 0.9 THEN 'shakeout' WHEN t20 > 0.08 AND (vt IS NULL OR vt >= 0.9) THEN 'rally' WHEN abs(t20) <= 0.05 AND vt > 1.1 AND close <= 1.1::DOUBLE * lo AND (am IS NULL OR am < 0.2) THEN 'accumulation' ELSE 'consolidation' END AS stage FROM (
  SELECT *, close / lag(close, 5) OVER w - 1 AS t5, close / lag(close, 20) OVER w - 1 AS t20, row_number() OVER w AS rn, max(close) OVER (w ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS hi, min(close) OVER (w ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS lo,
  CASE WHEN row_number() OVER w >= 25 THEN round(avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(volume) OVER (w ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING), 3) END AS vt,
  CASE WHEN row_number() OVER w >= 20 THEN round((max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - min(low) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) / avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) END AS am FROM bars {W})"""))  # fmt: skip
def r13_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(waves.stage(src.bars(spark, sf_dir)).select("symbol", "dt", "t5", "t20", "volume_trend", "amplitude", "stage"))


@register("n2_stream_bars", """WITH b AS (SELECT event_type AS code, time_bucket(INTERVAL '30 minutes', ts) AS dt, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, ROW(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
  SELECT * FROM b WHERE dt + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")  # fmt: skip
def n2_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all windows that a stream of the written events has closed."""
    path = scratch(spark)
    src.table(spark, sf_dir, "events").repartitionByRange(4, "ts").write.parquet(f"{path}/ticks")
    made = minutes.stream_bars(minutes.tick_stream(spark, f"{path}/ticks"))
    return minutes.run_once(made, f"{path}/out", f"{path}/state").withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@register("n3_macd_alerts", """WITH RECURSIVE b AS (SELECT event_type AS code, time_bucket(INTERVAL '30 minutes', ts) AS dt, arg_max(value, ROW(ts, event_id)) AS close FROM events GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt) AS rn FROM b),
e AS (SELECT code, dt, rn, close AS f, close AS s, 0::DOUBLE AS line, 0::DOUBLE AS sig FROM c WHERE rn = 1
  UNION ALL SELECT code, dt, rn, f, s, f - s, sig + ((f - s) - sig) * 2 / 10 FROM (
    SELECT c.code, c.dt, c.rn, e.f + (c.close - e.f) * 2 / 13 AS f, e.s + (c.close - e.s) * 2 / 27 AS s, e.sig FROM e JOIN c ON c.code = e.code AND c.rn = e.rn + 1)),
k AS (SELECT code, dt, CASE WHEN line > sig + 1e-9 THEN 'golden' ELSE 'death' END AS now FROM e WHERE rn >= 60 AND abs(line - sig) > 1e-9)
SELECT code, dt, coalesce(lag(now) OVER w, 'first') AS before, now AS after FROM k WINDOW w AS (PARTITION BY code ORDER BY dt) QUALIFY now IS DISTINCT FROM lag(now) OVER w""")
def n3_macd_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of every event type's 30-minute bars, replayed as a stream of written bars."""
    path = scratch(spark)
    src.minute_bars(src.table(spark, sf_dir, "events")).write.parquet(f"{path}/bars")
    stream = spark.readStream.schema("code string, dt timestamp, open double, high double, low double, close double, volume long").parquet(f"{path}/bars")
    return minutes.run_once(minutes.macd_states(stream, notify_first=True), f"{path}/out", f"{path}/state").withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@register("t6_minute_retention", """WITH b AS (SELECT event_type AS code, time_bucket(INTERVAL '30 minutes', ts) AS dt FROM events GROUP BY 1, 2)
  SELECT code, count(*) AS n_bars FROM b WHERE dt >= (SELECT max(dt) FROM b) - INTERVAL '20 days' GROUP BY code""")  # fmt: skip
def t6_minute_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.minute_bars(src.table(spark, sf_dir, "events"))
    newest = b.agg(F.max("dt").alias("newest"))
    return b.join(F.broadcast(newest)).where(F.col("dt") >= F.col("newest") - F.expr("interval 20 days")).groupBy("code").agg(F.count(F.lit(1)).alias("n_bars"))


_ADJUSTED = "adj AS (SELECT symbol, dt, open, high, low, close * CASE WHEN symbol LIKE '%3' THEN 1.01::DOUBLE ELSE 1 END AS close, volume FROM bars WHERE symbol NOT LIKE '%4')"


@register("q11_changed_symbols", over(f"SELECT symbol, a.checksum IS DISTINCT FROM b.checksum AS recompute FROM ({checksum_sql('bars')}) a LEFT JOIN ({checksum_sql('adj')}) b USING (symbol)", _ADJUSTED))
def q11_changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored are the checksums before some symbols' prices were adjusted by 1 %, and none of some new symbols."""
    b = src.bars(spark, sf_dir)
    before = b.where("symbol NOT LIKE '%4'").withColumn("close", F.col("close") * F.when(F.col("symbol").like("%3"), 1.01).otherwise(1.0))
    return records.changed(records.checksum(b), records.checksum(before))
