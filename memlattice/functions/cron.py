"""Due times of cron expressions: fields as bit masks, the next one by the next set bit.

Five fields: minute, hour, day of month, month, day of week (0 or 7 is Sunday), each
``*``, numbers, ranges, lists, steps, and names of months and days.  If both day fields
are restricted a day may fit either.  All of it is columns; nothing is scanned minute by
minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS, DAYS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
#: First and last value of each field.
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: Months looked at: a 29th of February comes within eight years.
HORIZON = 97
_ITEM = r"^(?:\*|(\d{1,2})(?:-(\d{1,2}))?)(?:/(\d{1,2}))?$"


def _one() -> Column:
    return F.lit(1).cast("long")


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def mask(field: Column, low: int, high: int) -> Column:
    """A field's values as bits of a long; null if it is no field."""

    def bits(item: Column) -> Column:
        get = lambda k: F.try_to_number(F.nullif(F.regexp_extract(item, _ITEM, k), F.lit("")), F.lit("99")).cast("int")
        first, last, step = get(1), get(2), get(3)
        begin = F.coalesce(first, F.lit(low))
        end = F.when(first.isNull(), F.lit(high)).otherwise(F.coalesce(last, F.when(step.isNotNull(), F.lit(high)).otherwise(first)))
        step = F.coalesce(step, F.lit(1))
        good = F.regexp_like(item, F.lit(_ITEM)) & (begin >= low) & (end <= high) & (begin <= end) & (step > 0)
        values = F.sequence(begin, F.greatest(begin, end), F.greatest(step, F.lit(1)))
        return F.when(good, F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(_shift(_one(), v))))

    each = F.transform(F.split(field, ",", -1), bits)
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def masks(expression: Column) -> Column:
    """``minute``, ``hour``, ``dom``, ``month``, ``dow`` (Sunday is bit 0), and whether a day fits ``either``; null if it is no expression."""
    text = F.lower(F.trim(expression))
    parts = F.split(text, r"\s+")

    def named(part: Column, names: tuple[str, ...], first: int) -> Column:
        for k, name in enumerate(names):
            part = F.replace(part, F.lit(name), F.lit(str(k + first)))
        return part

    field = [parts[k] for k in range(5)]
    field[3], field[4] = named(field[3], MONTHS, 1), named(field[4], DAYS, 0)
    m, h, dom, month, dow = (mask(f, *bounds) for f, bounds in zip(field, FIELDS, strict=True))
    sunday = dow.bitwiseAND(0x7F).bitwiseOR(F.shiftright(dow, 7))
    free = lambda f: F.startswith(f, F.lit("*"))
    good = (F.size(parts) == 5) & m.isNotNull() & h.isNotNull() & dom.isNotNull() & month.isNotNull() & dow.isNotNull()
    return F.when(good, F.struct(m.alias("minute"), h.alias("hour"), dom.alias("dom"), month.alias("month"), sunday.alias("dow"), (~free(field[2]) & ~free(field[4])).alias("either")))


def next_bit(bits: Column, start: Column) -> Column:
    """The first set bit at ``start`` or above, null if there is none."""
    left = bits.bitwiseAND(_shift(F.lit(-1).cast("long"), start))
    return F.when((left != 0) & (start < 63), F.bit_count(left.bitwiseAND(-left) - 1))


def _days(m: Column, month: Column) -> Column:
    """The fitting days of the month that begins on the date ``month``, as bits 1 to 31."""
    weekday = F.dayofweek(month) - 1
    turned = F.shiftrightunsigned(m["dow"].bitwiseOR(_shift(m["dow"], F.lit(7))), 0)
    week = F.call_function("shiftright", turned, weekday).bitwiseAND(0x7F)  # bit 0: the first of the month
    all_weeks = week.bitwiseOR(_shift(week, F.lit(7))).bitwiseOR(_shift(week, F.lit(14))).bitwiseOR(_shift(week, F.lit(21))).bitwiseOR(_shift(week, F.lit(28)))
    of_week, of_month = _shift(all_weeks, F.lit(1)), m["dom"]
    days = F.when(m["either"], of_month.bitwiseOR(of_week)).otherwise(of_month.bitwiseAND(of_week))
    inside = _shift(_one(), F.day(F.last_day(month)) + 1) - 2
    asked = _shift(_one(), F.month(month)).bitwiseAND(m["month"]) != 0
    return F.when(asked, days.bitwiseAND(inside)).otherwise(F.lit(0).cast("long"))


def with_next_due(df: DataFrame, expression: Column, after: Column, name: str = "due", zone: str | None = None) -> DataFrame:
    """``df`` with the first due minute after a time as ``timestamp_ntz``; null for no expression, no time, or no due time within eight years.

    Times are of the wall clock.  With ``zone`` they are in UTC and the expression holds
    for that zone's clock: a minute that it jumps over is due right after, one that it
    shows twice the first time.
    """
    t = after.cast("timestamp_ntz")
    local = F.from_utc_timestamp(t.cast("timestamp"), zone).cast("timestamp_ntz") if zone else t
    # Masks and days are columns of one-row generators, so that they are worked out once a row.
    once = df.select("*", F.inline(F.array(F.struct(masks(expression).alias("_m"), local.alias("_t")))))
    m, t = F.col("_m"), F.col("_t")
    first_of_month = F.trunc(t.cast("date"), "month")
    months = F.transform(F.sequence(F.lit(1), F.lit(HORIZON)), lambda k: F.add_months(first_of_month, k))
    ahead = F.filter(F.transform(months, lambda d: F.struct(d.alias("d"), _days(m, d).alias("days"))), lambda x: x["days"] != 0)
    once = once.select("*", F.inline(F.array(F.struct(_days(m, first_of_month).alias("_this"), F.get(ahead, F.lit(0)).alias("_ahead"), first_of_month.alias("_first")))))
    today, hour, minute = F.day(t), F.hour(t), F.minute(t)
    same_hour = F.when(m["hour"].bitwiseAND(_shift(_one(), hour)) != 0, next_bit(m["minute"], minute + 1))
    later_hour, first_hour, first_minute = next_bit(m["hour"], hour + 1), next_bit(m["hour"], F.lit(0)), next_bit(m["minute"], F.lit(0))
    at = lambda day, h, mm: F.date_add(day, 0).cast("timestamp_ntz") + F.make_dt_interval(hours=h, mins=mm)
    date = t.cast("date")
    now = F.when(F.col("_this").bitwiseAND(_shift(_one(), today)) != 0, F.when(same_hour.isNotNull(), at(date, hour, same_hour)).when(later_hour.isNotNull(), at(date, later_hour, first_minute)))
    this_month = next_bit(F.col("_this"), today + 1)
    day = F.when(this_month.isNotNull(), F.date_add("_first", this_month - 1)).otherwise(F.date_add(F.col("_ahead.d"), next_bit(F.col("_ahead.days"), F.lit(0)) - 1))
    due = F.coalesce(now, at(day, first_hour, first_minute))
    due = F.to_utc_timestamp(due.cast("timestamp"), zone).cast("timestamp_ntz") if zone else due
    return once.withColumn(name, due).drop("_m", "_t", "_this", "_ahead", "_first")
