"""Strokes and zones of a price series, and what stored tables of them say about the newest bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators.patterns import pivots

#: Tags by age: the third of a kind comes after the second and the first.
TAG_RANK = {"3": 3, "2": 2, "1": 1}


def strokes(bars: DataFrame) -> DataFrame:
    """symbol, no, direction, sdt, edt, high, low, confirmed: the moves between turning points of alternating kind.

    Of neighbouring turning points of one kind the furthest counts (of equals the first); a bar that is both counts as none.
    A stroke is confirmed while no later bar passes its end.
    """
    w = Window.partitionBy("symbol").orderBy("dt")
    turns = pivots(bars).withColumns({"_hi": F.max("high").over(w.rowsBetween(1, Window.unboundedFollowing)), "_lo": F.min("low").over(w.rowsBetween(1, Window.unboundedFollowing))})
    turns = turns.where("peak <> trough").withColumn("_new", F.when(F.col("peak") == F.lag("peak").over(w), 0).otherwise(1))
    turns = turns.withColumn("_island", F.sum("_new").over(w))
    ends = turns.groupBy("symbol", "_island").agg(F.max_by(F.struct("peak", "dt", "high", "low", "_hi", "_lo"), F.struct(F.when(F.col("peak"), F.col("high")).otherwise(-F.col("low")), -F.unix_date("dt"))).alias("e"))
    v = Window.partitionBy("symbol").orderBy("_island")
    made = ends.withColumns({"s": F.lag("e").over(v), "no": F.row_number().over(v) - 1}).where("s is not null")
    passed = F.when(F.col("e.peak"), F.col("e._hi") > F.col("e.high")).otherwise(F.col("e._lo") < F.col("e.low"))
    return made.select(
        "symbol", "no", F.when(F.col("e.peak"), "up").otherwise("down").alias("direction"), F.col("s.dt").alias("sdt"), F.col("e.dt").alias("edt"),
        F.when(F.col("e.peak"), F.col("e.high")).otherwise(F.col("s.high")).alias("high"), F.when(F.col("e.peak"), F.col("s.low")).otherwise(F.col("e.low")).alias("low"), (~F.coalesce(passed, F.lit(False))).alias("confirmed"),
    )


def zones(moves: DataFrame) -> DataFrame:
    """symbol, sdt, edt, zd, zg, dd, gg, n_strokes, finished: runs of strokes of which each three overlap.

    The zone's bounds are those of its first three strokes, dd and gg the extremes of all; it is finished once a stroke follows
    that does not belong to it.
    """
    w = Window.partitionBy("symbol").orderBy("no")
    three = w.rowsBetween(-2, 0)
    t = moves.withColumns({"zg": F.min("high").over(three), "zd": F.max("low").over(three), "dd": F.min("low").over(three), "gg": F.max("high").over(three), "_s": F.first("sdt").over(three), "_last": F.max("no").over(Window.partitionBy("symbol"))})
    t = t.withColumn("_in", (F.col("no") >= 3) & (F.col("zg") > F.col("zd")))
    t = t.withColumn("_run", F.sum(F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)).over(w)).where("_in")
    made = t.groupBy("symbol", "_run").agg(
        F.min("_s").alias("sdt"), F.max("edt").alias("edt"), F.min_by("zd", "no").alias("zd"), F.min_by("zg", "no").alias("zg"), F.min("dd").alias("dd"), F.max("gg").alias("gg"), (F.count(F.lit(1)) + 2).alias("n_strokes"), (F.max("no") < F.max("_last")).alias("finished")
    )
    return made.drop("_run")


def summary(bars: DataFrame, moves: DataFrame, areas: DataFrame) -> DataFrame:
    """One row for each symbol of ``bars``: what the last stroke and the last zone (by end, then start) say of the newest bar.

    direction and confirmed of the last stroke; place of the close against the last zone (above, in, below); leave: the side it
    leaves on, if the last stroke goes that way; stretch: the last stroke's height by the zone's; in_zone: whether the newest
    day lies within the zone's days; numbers of both, and whether the last zone is finished. NULL where there is none.
    """
    newest = bars.groupBy("symbol").agg(F.max("dt").alias("dt"), F.max_by("close", "dt").alias("close"))
    order = F.struct("edt", "sdt")
    last = moves.groupBy("symbol").agg(F.max_by(F.struct("direction", "confirmed", "high", "low"), order).alias("m"), F.count(F.lit(1)).alias("n_strokes"))
    area = areas.groupBy("symbol").agg(F.max_by(F.struct("zd", "zg", "sdt", "edt", "finished"), order).alias("z"), F.count(F.lit(1)).alias("n_zones"))
    rows = newest.join(last, "symbol", "left").join(area, "symbol", "left")
    place = F.when(F.col("close") > F.col("z.zg"), "above").when(F.col("close") < F.col("z.zd"), "below").when(F.col("z").isNotNull(), "in")
    rows = rows.withColumns({"direction": F.col("m.direction"), "confirmed": F.col("m.confirmed"), "place": place})
    leave = F.when((F.col("place") == "above") & (F.col("direction") == "up"), "up").when((F.col("place") == "below") & (F.col("direction") == "down"), "down")
    height = F.col("z.zg") - F.col("z.zd")
    return rows.select(
        "symbol", "dt", "close", "direction", "confirmed", "place", leave.alias("leave"), sql_round(F.abs(F.col("m.high") - F.col("m.low")) / F.when(height > 0, height), 2).alias("stretch"),
        F.coalesce(F.col("dt").between(F.col("z.sdt"), F.col("z.edt")), F.lit(False)).alias("in_zone"), F.coalesce("n_strokes", F.lit(0)).alias("n_strokes"), F.coalesce("n_zones", F.lit(0)).alias("n_zones"), F.coalesce("z.finished", F.lit(False)).alias("last_zone_finished"),
    )


def newest_tag(tags: DataFrame) -> DataFrame:
    """symbol, tag: of a symbol's tags (buy1 to sell3, with ``seen``, their order) the latest structure: third before second before
    first, of one rank the one seen first."""
    rank = F.coalesce(*(F.when(F.col("tag").endswith(n), r) for n, r in TAG_RANK.items()), F.lit(0))
    return tags.where("tag is not null").groupBy("symbol").agg(F.max_by("tag", F.struct(rank, -F.col("seen"))).alias("tag"))


def zone_tags(moves: DataFrame, areas: DataFrame) -> DataFrame:
    """symbol, tag, seen: tags that the last strokes give. buy3: a down stroke after the last zone that stays above it (sell3 the
    other way round); buy2: a down stroke with a higher low than the one before it; buy1: one with a lower low on less height."""
    w = Window.partitionBy("symbol").orderBy("no")
    rows = moves.withColumns({"_h": F.lag("high", 2).over(w), "_l": F.lag("low", 2).over(w), "_last": F.max("no").over(Window.partitionBy("symbol"))}).where("no = _last")
    zone = areas.groupBy("symbol").agg(F.max_by(F.struct("zd", "zg", "edt"), F.struct("edt", "sdt")).alias("z"))
    rows = rows.join(zone, "symbol", "left")
    down, up, less = F.col("direction") == "down", F.col("direction") == "up", F.col("high") - F.col("low") < F.col("_h") - F.col("_l")
    late = F.col("sdt") >= F.col("z.edt")
    found = [
        F.when(down & (F.col("low") < F.col("_l")) & less, "buy1").when(up & (F.col("high") > F.col("_h")) & less, "sell1"),
        F.when(down & (F.col("low") > F.col("_l")), "buy2").when(up & (F.col("high") < F.col("_h")), "sell2"),
        F.when(down & late & (F.col("low") > F.col("z.zg")), "buy3").when(up & late & (F.col("high") < F.col("z.zd")), "sell3"),
    ]
    return rows.select("symbol", F.posexplode(F.array(*found)).alias("seen", "tag")).where("tag is not null").select("symbol", "tag", "seen")
