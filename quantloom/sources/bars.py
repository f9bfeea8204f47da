"""Bars from trades and events."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round

#: Of 100 lots: what all symbols have on the market.
FLOAT_LOTS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str = "stream") -> str:
    """A folder that driver and executors share: in spark.checkpoint.dir, or a temporary one if the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quantloom-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def trades(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    """symbol, dt, price, quantity, amount and a key that orders a day's trades. ``symbol``: l_suppkey or a constant in quotes."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.expr(symbol).cast("string").alias("symbol"),
        F.to_date("l_shipdate").alias("dt"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("trade"),
    )


def daily_bars(ticks: DataFrame) -> DataFrame:
    """One bar per symbol and day: symbol, dt, open, high, low, close, volume, amount."""
    return ticks.groupBy("symbol", "dt").agg(
        F.min_by("price", "trade").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "trade").alias("close"),
        F.sum("quantity").alias("volume"),
        sql_round(F.sum("amount"), 2).alias("amount"),
    )


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return items.withColumn("dt", F.to_date("l_shipdate"))


def nation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, dt) with the bar's sums, its high and low, and its first and last trade with their prices. Written once.

    Customers meet orders before these meet the trades, so trades are shuffled once, with few columns. The sums are plain numbers,
    which hash without a sort; first and last trade are then looked up among the lines of each day's lowest and highest order only.
    """
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "nation")
    items = _prices(spark, sf_dir)
    owned = items.select("l_orderkey", "l_quantity", "l_extendedprice", "dt").join(owners.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    sums = owned.groupBy("nation", "dt").agg(
        F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"), F.min("l_orderkey").alias("_lowest"), F.max("l_orderkey").alias("_highest")
    )
    path = scratch(spark, "days")
    sums.write.parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums")
    ends = sums.select("nation", F.col("dt").alias("_day"), F.explode(F.array_distinct(F.array("_lowest", "_highest"))).alias("_order"))
    # two orders a nation and day, however many trades
    found = items.join(F.broadcast(ends), (F.col("l_orderkey") == F.col("_order")) & F.col("dt").eqNullSafe(F.col("_day")))
    trade = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "price")
    found = found.groupBy(F.col("nation").alias("_nation"), "_day").agg(F.min(trade).alias("first"), F.max(trade).alias("last"))
    whole = sums.join(found, (F.col("nation") == F.col("_nation")) & F.col("dt").eqNullSafe(F.col("_day")))
    whole.select("nation", "dt", "high", "low", "volume", "amount", "first", "last").write.parquet(f"{path}/whole")
    return spark.read.parquet(f"{path}/whole")


_SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def shared_days():
    """Within it, the days of nations are made once for each folder of tables, and read by all bars of nations and regions."""
    token = _SHARED.set({}) if _SHARED.get() is None else None
    try:
        yield
    finally:
        if token:
            _SHARED.reset(token)


def place_bars(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    """daily_bars() of nations or regions (n_name or r_name), from the days of nations."""
    shared = _SHARED.get()
    days = shared.get(sf_dir) if shared is not None else None
    if days is None:
        days = nation_days(spark, sf_dir)
        if shared is not None:
            shared[sf_dir] = days
    places = table(spark, sf_dir, "nation")
    if symbol == "r_name":
        places = places.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = days.join(F.broadcast(places.select(F.col("n_nationkey").alias("nation"), F.col(symbol).cast("string").alias("symbol"))), "nation")
    return named.groupBy("symbol", "dt").agg(
        F.min("first")["price"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last")["price"].alias("close"), F.sum("volume").alias("volume"), sql_round(F.sum("amount"), 2).alias("amount")
    )


def bars(spark: SparkSession, sf_dir: str, symbol: str = "n_name", weekdays: bool = True) -> DataFrame:
    """Daily bars with the turnover in percent; weekdays only unless told otherwise. ``symbol``: n_name, r_name, l_suppkey or a
    constant in quotes."""
    made = place_bars(spark, sf_dir, symbol) if symbol in ("n_name", "r_name") else daily_bars(trades(spark, sf_dir, symbol))
    made = made.withColumn("turn", F.col("volume") * 100 / FLOAT_LOTS)
    return made.where(F.dayofweek("dt").between(2, 6)) if weekdays else made


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose turnover is unknown on two of eleven days, as a source with gaps delivers it."""
    gap = F.pmod(F.datediff("dt", F.lit("1995-01-01")) + F.length("symbol"), F.lit(11)) < 2
    return bars(spark, sf_dir).withColumn("turn", F.when(~gap, F.col("turn"))).withColumn("turn_source", F.when(~gap, F.lit("feed")))


def minute_bars(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Tumbling bars of an event stream or table: code, dt (start), OHLC, volume."""
    at = F.struct("ts", "event_id")
    slot = F.window("ts", f"{minutes} minutes")
    made = events.groupBy(F.col("event_type").alias("code"), slot.alias("slot")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return made.select("code", F.col("slot.start").alias("dt"), "open", "high", "low", "close", "volume")
