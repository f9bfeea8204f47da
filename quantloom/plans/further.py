"""Registered queries of the records around the bars: labels, filters, stored tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind
from quantloom.operators import quality, records, relations, rules
from quantloom.plans import sql
from quantloom.plans.catalog import _ema, _eval_sql, full_evaluation, register
from quantloom.plans.more import scratch
from quantloom.plans.sql import W, over
from quantloom.sources import bars as src
from quantloom.sources import watchlists

_SPELLED = "[' Daily', 'w', 'MONTHLY', '1d', 'weekly ', 'yearly']"


@register("p2_day_of_stamp", "SELECT ts::DATE AS dt, count(*) AS n FROM events GROUP BY 1")
def p2_day_of_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("ts")).groupBy(records.day("ts").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@register("p3_projection", over("SELECT symbol AS code, dt AS trade_date, open AS open_price, close AS close_price FROM bars WHERE dt >= DATE '1998-01-01'"))
def p3_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = src.bars(spark, sf_dir).withColumnsRenamed({"symbol": "code", "dt": "trade_date", "open": "open_price", "close": "close_price"})
    return named.select("code", "trade_date", "open_price", "close_price").where("trade_date >= date'1998-01-01'")


_SCOPES = {"stock": "n_name", "sector": "r_name", "market": "'ALL'"}


@register("p7_as_of", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(over(f"SELECT '{name}' AS scope, count(*) AS n_bars, max(dt) AS last_day FROM bars WHERE dt BETWEEN DATE '1995-01-01' AND DATE '1997-06-30'", ticks=t) for name, t in (("stock", sql.TICKS), ("sector", sql.SECTOR_TICKS), ("market", sql.MARKET_TICKS))) + ")")
def p7_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay's inputs as of one day: none of bars, sectors and index shows a later one."""
    first, last = F.lit("1995-01-01").cast("date"), F.lit("1997-06-30").cast("date")
    parts = [records.as_of(src.bars(spark, sf_dir, s), last, first).agg(F.count(F.lit(1)).alias("n_bars"), F.max("dt").alias("last_day")).select(F.lit(name).alias("scope"), "n_bars", "last_day") for name, s in _SCOPES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("p8_labels", f"""SELECT spelled, CASE lower(trim(spelled)) WHEN 'daily' THEN '1d' WHEN '1d' THEN '1d' WHEN 'w' THEN '1w' WHEN 'weekly' THEN '1w' WHEN 'monthly' THEN '1M' END AS freq,
  CASE c_mktsegment WHEN 'FURNITURE' THEN lower(c_mktsegment) ELSE 'qfq' END AS adjust, count(*) AS n FROM (SELECT {_SPELLED}[c_custkey % 6 + 1] AS spelled, c_mktsegment FROM customer) GROUP BY ALL""")  # fmt: skip
def p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers carry odd spellings of periods and adjustments here."""
    spelled = F.array(*(F.lit(x) for x in (" Daily", "w", "MONTHLY", "1d", "weekly ", "yearly")))[F.pmod(F.col("c_custkey"), F.lit(6)).cast("int")]
    adjust = records.adjustment(F.when(F.col("c_mktsegment") == "FURNITURE", F.col("c_mktsegment")).otherwise(" QFQ"))
    made = src.table(spark, sf_dir, "customer").select(spelled.alias("spelled"), records.frequency(spelled).alias("freq"), adjust.alias("adjust"))
    return made.groupBy("spelled", "freq", "adjust").agg(F.count(F.lit(1)).alias("n"))


@register("p9_stocks_only", "SELECT c_custkey AS code, c_name AS name FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 10 <> 7")
def p9_stocks_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("1"), F.lit(None).cast("string"), F.lit("2")), (F.pmod(key, F.lit(3)) + 1).cast("int"))
    listed = src.table(spark, sf_dir, "customer").select(key.alias("code"), F.when(key % 10 != 7, F.col("c_name")).otherwise(" ").alias("name"), kind.alias("type"))
    return records.stocks_only(listed).select("code", "name")


#: What a scan leaves of each symbol, and of the market itself as an index row.
_RES = """(SELECT f.symbol, f.sector, k.close, f.strict AS stock_strict, f.sector_up AS industry_up, f.market_trend = 'up' AS market_up, f.position <> 'high' AS market_not_high, false AS is_index, f.score,
  f.score >= 85 AND f.act AND f.market_trend = 'up' AND coalesce(f.sector_up, false) AND f.strict AND f.position <> 'high' AS true_resonance, f.strict AND coalesce(f.sector_up, false) AND f.market_trend = 'up' AS three_resonance FROM fin f JOIN lastk k USING (symbol, dt)
  UNION ALL SELECT 'ALL', NULL, NULL, NULL, NULL, market_trend = 'up', position <> 'high', true, NULL, NULL, NULL FROM lastm)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full evaluation's nested results as flat flags, and the market's own row, which has no stock legs."""
    r = rules.nested_result(full_evaluation(spark, sf_dir))
    stocks = r.select(
        "symbol", F.col("sector.name").alias("sector"), "stock.close", "stock.stock_strict", F.col("sector.up").alias("industry_up"), "market.market_up", (F.col("market.position") != "high").alias("market_not_high"),
        F.lit(False).alias("is_index"), "resonance.score", "resonance.true_resonance", "resonance.three_resonance",
    )
    leg = rules.market_leg_snapshot(r)
    index = leg.select(F.lit("ALL").alias("symbol"), "market_up", (F.col("position") != "high").alias("market_not_high"), F.lit(True).alias("is_index"))
    return stocks.unionByName(index, allowMissingColumns=True)


@register("p12_least_score", _eval_sql(f"SELECT symbol, score FROM {_RES} WHERE score >= 40"))
def p12_least_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.least_score(_results(spark, sf_dir), 40).select("symbol", "score")


@register("a14_only_market_mismatch", _eval_sql(f"SELECT symbol FROM {_RES} WHERE NOT is_index AND coalesce(stock_strict, false) AND coalesce(industry_up, false) AND (market_up IS false OR market_not_high IS false)"))
def a14_only_market_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.only_market_mismatch(_results(spark, sf_dir)).select("symbol")


_FACTORS = ["stock_strict", "industry_up", "market_up", "market_not_high", "true_resonance", "three_resonance"]


@register("a16_factor_counts", _eval_sql("SELECT factor, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, coalesce({f}::VARCHAR, 'null') AS value FROM {_RES}" for f in _FACTORS) + ") GROUP BY 1, 2"))
def a16_factor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.factor_counts(_results(spark, sf_dir), _FACTORS)


@register("a18_failure_alert", """SELECT job, n_ok, n_fail, round(CASE WHEN n_ok + n_fail > 0 THEN n_fail / (n_ok + n_fail) END, 5) AS fail_rate, n_ok + n_fail >= 20 AND n_fail / (n_ok + n_fail) > 0.02 AS alert
  FROM (SELECT user_id AS job, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_fail FROM events GROUP BY 1)""")  # fmt: skip
def a18_failure_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are a job here; errors are its failures."""
    jobs = src.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.count_if(F.col("event_type") != "error").alias("n_ok"), F.count_if(F.col("event_type") == "error").alias("n_fail"))
    return ind.rounded(records.failure_alert(jobs))


@register("a2_sector_weeks", over("""SELECT symbol, dt + ((12 - isodow(dt)) % 7)::INT AS dt, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume, round(sum(amount), 2) AS amount
  FROM alldays GROUP BY 1, 2 HAVING arg_max(close, dt) > 0""".replace("GROUP BY 1, 2 HAVING", "GROUP BY symbol, dt + ((12 - isodow(dt)) % 7)::INT HAVING"), ticks=sql.SECTOR_TICKS))  # fmt: skip
def a2_sector_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.friday_weeks(src.bars(spark, sf_dir, "r_name", weekdays=False))


@register("j8_orphan_results", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def j8_orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = src.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return records.orphans(src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), jobs, "o_custkey")


@register("j12_enriched_related", _eval_sql(f"SELECT 'S-' || n_nationkey AS symbol, r_name AS sector, score, close FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT symbol AS s, score, close FROM {_RES} WHERE score IS NOT NULL) ON s = n_name"))
def j12_enriched_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related symbols are spelled another way than in the results."""
    n, r = src.table(spark, sf_dir, "nation"), src.table(spark, sf_dir, "region")
    related = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("S-"), F.col("n_nationkey").cast("string")).alias("symbol"), F.col("r_name").alias("sector"))
    return records.enrich(related, _results(spark, sf_dir).where("score IS NOT NULL").select("symbol", "score", "close"))


@register("j13_changed_since", "SELECT DISTINCT o_custkey AS symbol, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS listed FROM orders WHERE o_orderdate >= DATE '1998-01-01'")
def j13_changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("dt"))
    return records.changed_since(events, src.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("symbol")), F.lit("1998-01-01").cast("date"))


@register("j14_held_flags", "SELECT event_id, user_id AS symbol, user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') AS held FROM events")
def j14_held_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    watchlist = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), (F.col("c_mktsegment") == "FURNITURE").alias("held"))
    return records.held_flags(src.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("symbol")), watchlist)


@register("z5_index_lag", over("""SELECT symbol, max(dt) AS last_day, max(dt) - DATE '1998-11-20' AS lag_days, max(dt) - DATE '1998-11-20' <= 3 AS index_known FROM bars GROUP BY 1""".replace("DATE '1998-11-20'", "(SELECT max(l_shipdate::DATE) FROM lineitem WHERE l_shipdate <= DATE '1998-11-20' AND isodow(l_shipdate) < 6)")))
def z5_index_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index ends in November 1998 here."""
    index = records.as_of(src.bars(spark, sf_dir, "'ALL'"), F.lit("1998-11-20").cast("date"))
    return records.index_lag(src.bars(spark, sf_dir), index).withColumn("lag_days", F.col("lag_days").cast("long"))


_TURN = lambda source: f"""SELECT symbol, CASE WHEN close >= max(close) OVER (w ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AND volume < lag(volume) OVER w THEN 'top' WHEN close <= min(close) OVER (w ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AND volume < lag(volume) OVER w THEN 'bottom' ELSE '' END AS x, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rk FROM {source} {W}"""
_BOTH = "WHEN coalesce(d.x, '') <> '' AND coalesce(k.x, '') <> '' THEN CASE WHEN d.x = k.x THEN 'day+week ' || d.x ELSE 'day ' || d.x || ' / week ' || k.x END"


@register("z14_divergence_label", over(f"SELECT d.symbol, CASE {_BOTH} WHEN coalesce(d.x, '') <> '' THEN 'day ' || d.x WHEN coalesce(k.x, '') <> '' THEN 'week ' || k.x ELSE '' END AS label FROM ({_TURN('bars')}) d LEFT JOIN ({_TURN('res')}) k ON k.symbol = d.symbol AND k.rk = 1 WHERE d.rk = 1", sql.weeks(), ticks=sql.SUPPLIER_TICKS))
def z14_divergence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A divergence here: a close at the end of its ten-bar range on less volume than the bar before. Suppliers are the symbols."""

    def newest(b: DataFrame) -> DataFrame:
        w = Window.partitionBy("symbol").orderBy("dt")
        less, nine = F.col("volume") < F.lag("volume").over(w), w.rowsBetween(-9, -1)
        x = F.when((F.col("close") >= F.max("close").over(nine)) & less, "top").when((F.col("close") <= F.min("close").over(nine)) & less, "bottom").otherwise("")
        return ind.latest(b.withColumn("x", x)).select("symbol", "x")

    days = newest(src.bars(spark, sf_dir, "l_suppkey")).withColumnRenamed("x", "d")
    weeks = newest(quality.resample(src.bars(spark, sf_dir, "l_suppkey", weekdays=False), "week")).withColumnRenamed("x", "k")
    return days.join(weeks, "symbol", "left").select("symbol", records.divergence_label(F.col("d"), F.col("k")).alias("label"))


@register("w19_doubled_macd", _ema("SELECT symbol, dt, round(line, 5) AS diff, round(sig, 5) AS dea, round((line - sig) * 2, 5) AS macd FROM e"))
def w19_doubled_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ind.macd(src.bars(spark, sf_dir))
    return ind.rounded(made.select("symbol", "dt", F.col("macd").alias("diff"), F.col("macd_signal").alias("dea"), (F.col("macd_hist") * 2).alias("macd")))


@register("t2_limited_universe", "SELECT c_custkey AS symbol FROM customer ORDER BY c_custkey LIMIT 100")
def t2_limited_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")).orderBy("symbol").limit(100)


@register("u2_open_targets", "SELECT c_custkey AS symbol FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01'")
def u2_open_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = src.table(spark, sf_dir, "orders").where("o_orderdate >= date'1997-01-01'").select(F.col("o_custkey").alias("symbol"))
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")).subtract(fresh)


_GAP = "((dt - DATE '1995-01-01') + length(symbol)) % 11"
_MOD = f"(({_GAP}) + 11) % 11"


@register("u7_outside_turnover", over(f"SELECT symbol, dt, CASE WHEN {_MOD} < 4 AND {_MOD} <> 1 THEN turn * 2 WHEN {_MOD} = 1 THEN NULL ELSE turn END AS turn, CASE WHEN {_MOD} < 4 AND {_MOD} <> 1 THEN 'outside' WHEN {_MOD} = 1 THEN NULL ELSE 'feed' END AS turn_source FROM bars"))
def u7_outside_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of eleven days are unknown, two derived; the other source lacks one of the unknown ones."""
    b = src.bars(spark, sf_dir)
    no = F.pmod(F.datediff("dt", F.lit("1995-01-01")) + F.length("symbol"), F.lit(11))
    own = b.withColumns({"turn": F.when(no >= 2, F.col("turn")), "turn_source": F.when(no >= 4, "feed").when(no >= 2, "derived")})
    outside = b.where(no != 1).select("symbol", "dt", (F.col("turn") * 2).alias("turn"))
    return records.fill_turnover(own, outside).select("symbol", "dt", "turn", "turn_source")


@register("s10_sector_upsert", over("SELECT symbol, dt, open, high, low, CASE WHEN dt >= DATE '1998-01-01' THEN close + 1 ELSE close END AS close, CASE WHEN dt >= DATE '1998-01-01' THEN 0 ELSE volume END AS volume, CASE WHEN dt >= DATE '1998-01-01' THEN 0 ELSE amount END AS amount FROM bars", ticks=sql.SECTOR_TICKS))
def s10_sector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.bars(spark, sf_dir, "r_name").drop("turn")
    new = records.sector_rows(b.where("dt >= date'1998-01-01'").withColumn("close", F.col("close") + 1).drop("volume", "amount"))
    return quality.upsert(records.sector_rows(b), new, ["symbol", "dt"], [])


@register("s11_snapshot_upsert", """WITH s AS (SELECT o_custkey AS code, o_orderdate::DATE AS as_of, o_totalprice AS cap, o_orderkey AS seq FROM orders)
  SELECT code, as_of, arg_max(cap, seq) AS cap FROM s GROUP BY 1, 2""")  # fmt: skip
def s11_snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("as_of"), F.col("o_totalprice").alias("cap"), F.col("o_orderkey").cast("long").alias("seq"))
    stored = o.groupBy("code", "as_of").agg(F.min_by("cap", "seq").alias("cap"))
    return records.newest_snapshots(stored, o, ["code", "as_of"])


@register("s12_relation_upsert", "SELECT n_name AS symbol, r_name AS sector, (n_nationkey % 2 = 0)::INT AS is_primary FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'ALL', 1 FROM nation WHERE n_nationkey % 2 = 0")
def s12_relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = src.table(spark, sf_dir, "nation"), src.table(spark, sf_dir, "region")
    stored = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.lit(0).alias("is_primary"), "n_nationkey")
    even = stored.where("n_nationkey % 2 = 0").select("symbol", "sector", F.lit(1).alias("is_primary"))
    return records.upsert_relation(stored.drop("n_nationkey"), even.unionByName(even.withColumn("sector", F.lit("ALL"))))


_M30 = "m30 AS (SELECT event_type AS code, time_bucket(INTERVAL '30 minutes', ts) AS dt, max(value) AS high, count(*) AS volume FROM events GROUP BY 1, 2)"


@register("s17_minute_upsert", f"WITH {_M30} SELECT code, dt, CASE WHEN dt >= TIMESTAMP '2024-01-15' THEN high + 1 ELSE high END AS high, volume FROM m30")
def s17_minute_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.minute_bars(src.table(spark, sf_dir, "events")).select("code", F.col("dt").cast("timestamp_ntz").alias("dt"), "high", "volume")
    new = m.where("dt >= timestamp_ntz'2024-01-15 00:00:00'").withColumn("high", F.col("high") + 1)
    return quality.upsert(m, new, ["code", "dt"], [])


@register("s2_adjusted_source", over("SELECT symbol, dt, close, amount FROM bars"))
def s2_adjusted_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that calls the amount turnover, written and read under the engine's names."""
    path = scratch(spark, "adjusted")
    src.bars(spark, sf_dir).select(F.col("symbol").alias("code"), F.col("dt").alias("date"), "close", F.col("amount").alias("turnover")).write.parquet(path)
    return spark.read.parquet(path).withColumnsRenamed({"code": "symbol", "date": "dt", "turnover": "amount"})


_LISTED = "SELECT lpad((c_custkey * 7 % 1000000)::VARCHAR, 6, '0') AS d, CASE c_custkey % 3 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' ELSE 'BJ' END AS x, replace(c_name, '#', ' ') AS name, c_custkey % 5 = 0 AS held, c_custkey FROM customer"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a watchlist with codes of all three exchanges."""
    key = F.col("c_custkey")
    code = F.concat_ws(".", F.lpad((key * 7 % 1000000).cast("string"), 6, "0"), F.element_at(F.array(*map(F.lit, ("SH", "SZ", "BJ"))), (key % 3 + 1).cast("int")))
    return src.table(spark, sf_dir, "customer").select(code.alias("symbol"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"), (key % 5 == 0).alias("held"))


@register("s7_watchlist_export", f"""SELECT value, count(*) AS n FROM (SELECT d || '.' || x || ',' || name || ',,,,' || CASE WHEN held THEN '是' ELSE '' END || ',' AS value FROM ({_LISTED}) UNION ALL SELECT d || '.' || x FROM ({_LISTED})
  UNION ALL SELECT CASE x WHEN 'SH' THEN '1' WHEN 'SZ' THEN '0' ELSE '2' END || d FROM ({_LISTED}) UNION ALL SELECT d || ' ' || name FROM ({_LISTED})
  UNION ALL SELECT printf('{{"symbol":"%s","name":"%s","held":%s}}', d || '.' || x, name, held::VARCHAR) FROM ({_LISTED})) GROUP BY 1""")  # fmt: skip
def s7_watchlist_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five forms, written and read again as text."""
    path, w = scratch(spark, "watchlist"), _listed(spark, sf_dir)
    for fmt in watchlists.FORMATS:
        watchlists.export_lines(w, fmt).write.text(f"{path}/{fmt}")
    return spark.read.text([f"{path}/{f}" for f in watchlists.FORMATS]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@register("s6_watchlist_import", f"""SELECT form, symbol, name, held FROM (SELECT d || '.' || x AS symbol, name, held FROM ({_LISTED})), (SELECT unnest(['json', 'flagged', 'txt']) AS form) WHERE form = 'json'
  UNION ALL SELECT form, d || '.' || x, '', false FROM ({_LISTED}), (SELECT unnest(['flagged', 'txt']) AS form) UNION ALL SELECT 'refused', 'no code here', '', false""")
def s6_watchlist_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of three forms (each one file) read back, two of them by detection, and a line that holds no code."""
    path, w = scratch(spark, "import"), _listed(spark, sf_dir)
    found = None
    for form, fmt in (("json", "auto"), ("txt", "auto"), ("flagged", "flagged")):
        lines = watchlists.export_lines(w, form)
        if form == "txt":
            lines = lines.unionByName(spark.range(1).select(F.lit("no-code-here").alias("value")))
        lines.coalesce(1).write.text(f"{path}/{form}")
        made, refused = watchlists.read_watchlist(spark, f"{path}/{form}", fmt)
        rows = made.select(F.lit(form).alias("form"), "symbol", "name", "held").unionByName(refused.select(F.lit("refused").alias("form"), F.replace("raw", F.lit("-"), F.lit(" ")).alias("symbol"), F.lit("").alias("name"), F.lit(False).alias("held")))
        found = rows if found is None else found.unionByName(rows)
    return found


@register("s15_json_shards", "SELECT event_type AS stage, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def s15_json_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    records.write_shards(src.table(spark, sf_dir, "events").select("event_id", "event_type"), path, F.col("event_type"))
    return spark.read.schema("event_id long, event_type string, stage string").json(path).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@register("s16_flat_report", _eval_sql(f"SELECT symbol, close, score, stock_strict, industry_up, market_up FROM {_RES}"))
def s16_flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results as a flat report: written as CSV with a header, read again."""
    path = scratch(spark, "report")
    _results(spark, sf_dir).select("symbol", "close", "score", "stock_strict", "industry_up", "market_up").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("symbol string, close double, score double, stock_strict boolean, industry_up boolean, market_up boolean").csv(path)


@register("m1_json_safe", "SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 5 > 1 THEN o_totalprice END AS value FROM orders")
def m1_json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are NaN or infinite for two of five customers here."""
    fifth = F.pmod(F.col("o_custkey"), F.lit(5))
    value = F.when(fifth == 0, F.lit(float("nan"))).when(fifth == 1, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    return records.json_safe(src.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), value.alias("value")))


@register("m10_summary_line", over("SELECT 'sectors: ' || string_agg(symbol || ' ' || n || ' bars', '; ' ORDER BY symbol) AS line FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)", ticks=sql.SECTOR_TICKS))
def m10_summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = src.bars(spark, sf_dir, "r_name").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return records.summary_line(counts, "sectors", "%s %d bars", ["symbol", "n"], "symbol")


@register("a21_coverage_report", over("""SELECT scope, symbols, with_bars, stale, without_shares, odd_spellings, unknown_chips, concat_ws(', ', CASE WHEN with_bars < symbols THEN 'no bars' END, CASE WHEN stale > 0 THEN 'old bars' END, CASE WHEN without_shares > 0 THEN 'no shares' END, CASE WHEN odd_spellings > 0 THEN 'spelling' END) AS warnings
  FROM (SELECT scope, count(*) AS symbols, count(l) AS with_bars, count(*) FILTER (l < (SELECT max(dt) FROM bars)) AS stale, count(*) FILTER (n_regionkey IS NULL OR n_regionkey = 0) AS without_shares, count(*) FILTER (symbol = 'sh.600519') AS odd_spellings, count(*) FILTER (scope = 'market' AND n_regionkey = 2) AS unknown_chips
    FROM (SELECT 'market' AS scope, n_name AS symbol, n_regionkey FROM nation UNION ALL SELECT 'watchlist', n_name, n_regionkey FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 'watchlist', 'sh.600519', NULL)
    LEFT JOIN (SELECT symbol, max(dt) AS l FROM bars GROUP BY 1) USING (symbol) GROUP BY 1)"""))  # fmt: skip
def a21_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = src.table(spark, sf_dir, "nation")
    own = n.select(F.lit("market").alias("scope"), F.col("n_name").alias("symbol"), "n_nationkey", (F.col("n_regionkey") == 2).alias("chip_unknown"))
    watch = own.where("n_nationkey < 9").select(F.lit("watchlist").alias("scope"), "symbol", F.lit(None).cast("boolean").alias("chip_unknown"))
    odd = n.where("n_nationkey = 0").select(F.lit("watchlist").alias("scope"), F.lit("sh.600519").alias("symbol"), F.lit(None).cast("boolean").alias("chip_unknown"))
    b = src.bars(spark, sf_dir)
    newest = b.agg(F.max("dt")).first()[0]
    shares = n.where("n_regionkey <> 0").select(F.col("n_name").alias("symbol"))
    return records.coverage_report(own.drop("n_nationkey").unionByName(watch).unionByName(odd), b, shares, F.lit(newest))
