"""Wall times to instants by an as-of join to zone-offset intervals."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import timestamps as ts
from marlstone.session import cut_lineage

#: No zone changes its offset before the first year, and all repeat theirs every CYCLE years
#: from the last rule on, as the calendar does: so each wall time has one of the same offset
#: within these years. Offsets are worked out for those of them that the data has.
FIRST_YEAR, LAST_RULE, CYCLE, STEP_DAYS = 1800, 2038, 400, 7
CYCLE_MICROS, SALTS = 146_097 * 86_400_000_000, 16
_INTERVALS = "zone string, starts long, ends long, offset int"


def _offset(zone: ZoneInfo, second: int) -> int:
    return int(datetime.fromtimestamp(second, timezone.utc).astimezone(zone).utcoffset().total_seconds())


def _begins(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())


def _zone_intervals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per span of UTC seconds during which a zone keeps one offset."""
    step = int(timedelta(days=STEP_DAYS).total_seconds())
    for frame in frames:
        rows = []
        for name, first, last in zip(frame["zone"], frame["first"], frame["last"]):
            try:
                zone = ZoneInfo(name)
            except Exception:  # no such zone: its stamps count as UTC
                continue
            lo, hi = _begins(int(first) - 1), _begins(int(last) + 2)
            at, off = lo, _offset(zone, lo)
            begun = lo if first > FIRST_YEAR else _EVER
            while at < hi:
                to = min(at + step, hi)
                if (new := _offset(zone, to)) != off:
                    a, b = at, to
                    while b - a > 1:
                        mid = (a + b) // 2
                        a, b = (mid, b) if _offset(zone, mid) == off else (a, mid)
                    rows.append((name, begun, b, off))
                    begun, off = b, _offset(zone, b)
                    to = b if off != new else to
                at = to
            rows.append((name, begun, hi, off))
        yield pd.DataFrame(rows, columns=["zone", "starts", "ends", "offset"])


_EVER = -(10**12)  # seconds, long before any year


def zone_offsets(zones: DataFrame) -> DataFrame:
    """Offset intervals of zones (zone, first, last: its years), exploded to one row per local year.

    Columns zone, year and spans, an array of (starts, ends, covers, offset) in
    microseconds of local time. `covers` is the start of the next interval where local
    time skips ahead, else `ends`: a skipped wall time falls between the two. There are
    as many rows as zones times their years, whatever the size of the data: the IANA list
    has about 600 zones, and no year lies beyond FIRST_YEAR and LAST_RULE + CYCLE, so the
    table stays below 400 000 rows of about 100 bytes.
    """
    raw = zones.select("zone", "first", "last").where(F.col("zone").isNotNull()).mapInPandas(_zone_intervals, _INTERVALS)
    w = Window.partitionBy("zone").orderBy("starts")
    local = raw.select("zone", "offset", (F.col("starts") + F.col("offset")).alias("ls"), (F.col("ends") + F.col("offset")).alias("le"), "starts").withColumn(
        "next", F.lead("ls").over(w)
    )
    covers = F.greatest("le", F.coalesce("next", "le"))
    year = lambda c: F.year(F.timestamp_seconds(c))
    return (
        local.select("zone", "offset", "ls", "le", covers.alias("cov"))
        .withColumn("year", F.explode(F.sequence(F.greatest(F.lit(FIRST_YEAR), year(F.col("ls") - 172800)), F.greatest(F.lit(FIRST_YEAR), year(F.col("cov") + 172800)))))
        .groupBy("zone", "year")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(*[(F.col(c).cast("long") * 1000000).alias(n) for c, n in (("ls", "starts"), ("le", "ends"), ("cov", "covers"), ("offset", "offset"))])
                )
            ).alias("spans")
        )
    )


def resolve_wall_times(stamps: DataFrame) -> DataFrame:
    """Add utc_micros and zone_case to rows with wall_micros, offset_s and zone.

    offset_s, where not null, is used directly ('stated'). Otherwise the wall time is
    joined as of its (zone, local year) to the offset intervals: one interval that holds
    it gives the offset ('direct'), two make it 'ambiguous' and the first instant is
    taken, none makes it 'nonexistent' and it moves forward by the gap. Without a known
    zone it counts as UTC ('utc'). Null wall times stay null.
    """
    need = F.when(F.col("offset_s").isNull(), F.col("zone"))
    year = F.year(F.timestamp_micros("wall_micros"))
    cycles = F.greatest(F.lit(0), F.floor((year - LAST_RULE) / CYCLE)).cast("long")
    keyed = stamps.withColumn("_z", need).withColumn("_y", F.greatest(F.lit(FIRST_YEAR), year - cycles.cast("int") * CYCLE)).withColumn("_moved", cycles * CYCLE_MICROS)
    zones = keyed.where("_z IS NOT NULL AND _y IS NOT NULL").groupBy(F.col("_z").alias("zone")).agg(F.min("_y").alias("first"), F.max("_y").alias("last"))
    spans = zone_offsets(zones)
    wall = F.col("wall_micros") - F.col("_moved")
    # At most zones x years rows (see zone_offsets), so this side may be broadcast.
    joined = keyed.join(
        F.broadcast(spans.select(F.col("zone").alias("_z"), F.col("year").alias("_y"), "spans")), ["_z", "_y"], "left"
    )
    hits = F.filter("spans", lambda s: (s["starts"] <= wall) & (wall < s["covers"]))
    inside = F.filter(F.col("_hits"), lambda s: wall < s["ends"])
    joined = joined.withColumn("_hits", hits).withColumn("_inside", inside)
    instant = lambda a: F.array_min(F.transform(a, lambda s: wall - s["offset"]))
    utc = (
        F.when(F.col("offset_s").isNotNull(), wall - F.col("offset_s").cast("long") * 1000000)
        .when(F.size("_inside") > 0, instant(F.col("_inside")))
        .when(F.size("_hits") > 0, instant(F.col("_hits")))
        .otherwise(wall)
    ) + F.col("_moved")
    case = (
        F.when(F.col("offset_s").isNotNull(), "stated")
        .when(F.size("_inside") > 1, "ambiguous")
        .when(F.size("_inside") == 1, "direct")
        .when(F.size("_hits") > 0, "nonexistent")
        .otherwise("utc")
    )
    return joined.withColumn("utc_micros", utc).withColumn("zone_case", F.when(wall.isNotNull(), case)).drop("_z", "_y", "_moved", "spans", "_hits", "_inside")


def _orders_by_group(parsed: DataFrame) -> DataFrame:
    """day_first per group: what its possible dates allow, else the order of smaller span.

    A date possible in one order only is evidence for it; impossible ones are none. With
    no evidence, the order whose dates lie closer together is taken, then day first.
    """
    dmy, mdy = F.col("_dmy"), F.col("_mdy")
    return (
        parsed.where(F.col("_group").isNotNull() & F.col("_open"))
        .groupBy("_group")
        .agg(
            F.sum(F.when(dmy.isNotNull() & mdy.isNull(), 1).otherwise(0)).alias("d"),
            F.sum(F.when(mdy.isNotNull() & dmy.isNull(), 1).otherwise(0)).alias("m"),
            (F.max("_dmy") - F.min("_dmy")).alias("ds"),
            (F.max("_mdy") - F.min("_mdy")).alias("ms"),
        )
        .select("_group", F.when(F.col("d") != F.col("m"), F.col("d") > F.col("m")).otherwise(F.coalesce(F.col("ds") <= F.col("ms"), F.lit(True))).alias("_day_first"))
    )


def normalise_stamps(df: DataFrame, stamp: str, zone: str, group: Column | None = None, rounded: Column | None = None) -> DataFrame:
    """Add utc_micros and zone_case for the stamp texts of df; unreadable ones get null.

    zone names a column with an IANA zone that holds where the text states none. Rows
    with the same `group` write day and month in the same order; rows with a null group
    take the only possible order, day first where both are. `rounded` marks epoch numbers
    to be rounded to the microsecond instead of cut. Null, empty and unreadable stamps,
    impossible dates and unknown notations give null; empty tables give empty results;
    other columns pass through (names beginning with '_' are reserved here).
    """
    group = F.lit(None).cast("string") if group is None else group
    rounded = F.lit(False) if rounded is None else rounded
    text = ts.tidy_stamp(F.col(stamp))
    df = df.withColumn("_text", text).withColumn("_group", group).withColumn("_epoch", ts.epoch_micros(F.col("_text"), rounded))
    df = df.withColumn("_f", ts.notation(F.when(F.col("_epoch").isNull(), F.col("_text"))))
    # Read twice below (order evidence, then every row): written once, so parsed once.
    df = cut_lineage(df, "stamps")
    f = F.col("_f")
    field = lambda k: F.get(f, F.lit(k))
    df = df.select("*", ts.clock_micros(f).alias("_clock"), field(0).alias("_year"), field(8).alias("_offset_text"), (field(9) != "").alias("_open"),
                   ts.month_text(field(1)).alias("_a"), ts.month_text(field(2)).alias("_b"))
    day = lambda month, of: F.col("_clock") + 86_400_000_000 * ts.day_number(F.col("_year"), F.col(month), F.col(of)).cast("long")
    df = df.withColumn("_mdy", day("_a", "_b")).withColumn("_dmy", F.when(F.col("_open"), day("_b", "_a")))
    # Salted, as one group may hold a large part of the rows, and so may those without one.
    spread = F.pmod(F.xxhash64("_text"), F.when(F.col("_group").isNull(), F.lit(997)).otherwise(F.lit(SALTS)))
    orders = _orders_by_group(df).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    df = df.withColumn("_salt", spread).join(orders, ["_group", "_salt"], "left")
    either = F.coalesce("_dmy", "_mdy")
    is_open = F.col("_open")
    wall = F.when(is_open & F.col("_day_first"), F.col("_dmy")).when(is_open & F.col("_day_first").isNull(), either).otherwise(F.col("_mdy"))
    df = df.withColumn("wall_micros", wall).withColumn("offset_s", ts.fixed_offset_seconds(F.col("_offset_text"))).withColumnRenamed(zone, "_zone_in").withColumn("zone", F.col("_zone_in"))
    out = resolve_wall_times(df)
    case = F.when(F.col("_epoch").isNotNull(), "epoch").otherwise(F.col("zone_case"))
    out = out.withColumn("utc_micros", F.coalesce("_epoch", "utc_micros")).withColumn("zone_case", case)
    keep = [c for c in out.columns if not c.startswith("_") and c not in ("wall_micros", "offset_s", "zone")]
    return out.select(*keep, F.col("_zone_in").alias(zone))
