"""Scope limits and cron due times against brute force."""

import random
from datetime import datetime, timedelta
from fnmatch import fnmatchcase
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from memlattice.functions import cron
from memlattice.operators import scope_limits


def test_globs_fit_like_brute_force(spark):
    draw = random.Random(5)
    tags = ["", "run_1", "run_2", "shared", "a.b", "a+b", "[x]", "R", "r", "x\ny", "é", "^", "a-c"] + ["".join(draw.choices("ab_1", k=draw.randint(1, 5))) for _ in range(60)]
    globs = ["*", "?", "run_*", "*_1", "[ab]*", "[!a]*", "a.b", "a?b", "[[]x]", "*a*", "x?y", "[a-c]", "[^a]", "?*", "", "r", "sha**d", "*[1]"] + ["".join(draw.choices("ab_1*?", k=draw.randint(1, 4))) for _ in range(80)]
    found = {tuple(r) for r in scope_limits.fits(spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame([(g,) for g in globs], "glob string")).collect()}
    assert found == {(t, g) for t in tags for g in globs if g and fnmatchcase(t, g)}


def test_first_covering_rule_and_room(spark):
    draw = random.Random(6)
    pool = ["run_1", "run_2", "shared", "team:a", "team:b", "x"]
    scopes = [(draw.sample(pool, draw.randint(0, 4)),) for _ in range(60)] + [(["x", "x"],), ([None, "x"],), (None,)]
    rules = [(k, [draw.choice(["run_*", "shared", "team:?", "*", "x", "no*"]) for _ in range(draw.randint(1, 3))], draw.choice([-1, 0, 2, 50])) for k in range(40)] + [(50, [], 1), (51, None, 1), (52, ["x", None], 1), (-1, ["x"], None)]
    seen = [(draw.sample(pool, draw.randint(0, 6)),) for _ in range(200)] + [(None,)]
    frames = spark.createDataFrame(scopes, "scope array<string>"), spark.createDataFrame(rules, "rule_id int, globs array<string>, limit int"), spark.createDataFrame(seen, "tags array<string>")
    found = {tuple(r.scope): (r.rule_id, r.limit, r.n, r.room) for r in scope_limits.room(*frames, 7).collect()}
    expected = {}
    for (scope,) in scopes:
        tags = sorted({t for t in scope or [] if t is not None})
        good = [(k, limit) for k, globs, limit in rules if globs and None not in globs and limit is not None and all(any(fnmatchcase(t, g) for g in globs) for t in tags) and all(any(fnmatchcase(t, g) for t in tags) for g in globs)]
        if tags:
            rule, limit = min(good, default=(None, 7))
            n = sum(set(tags) <= set(s or []) for (s,) in seen)
            expected[tuple(tags)] = (rule, limit, n, max(0, limit - n) if limit >= 0 else None)
    assert found == expected


EXPRESSIONS = ["* * * * *", "0 0 29 2 *", "30 4 1,15 * 5", "*/7 */5 * * *", "5-50/9 22,23 31 * *", "0 12 * JAN-mar,dec sun", "59 23 * * 7", "0 0 30 2 *", "0 0 */10 * 1", "15 3 * * */2", "1 2 3 4", "61 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *", "", None, "0 9-17/4 13 * fri"]


def fields(expression):
    out = []
    for part, (low, high) in zip(expression.lower().split(), cron.FIELDS, strict=True):
        for k, n in enumerate(cron.MONTHS):
            part = part.replace(n, str(k + 1)) if high == 12 else part
        for k, n in enumerate(cron.DAYS):
            part = part.replace(n, str(k)) if high == 7 else part
        values = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span or not step else high)
            values |= set(range(a, b + 1, int(step or 1)))
        out.append((values, part.startswith("*")))
    return out


def scan(expression, after):
    """The next due minute, by asking every minute of every fitting day."""
    (m, _), (h, _), (dom, any_dom), (month, _), (dow, any_dow) = fields(expression)
    day = after.replace(hour=0, minute=0, second=0, microsecond=0)
    for k in range(3000):
        d = day + timedelta(days=k)
        weekday = d.isoweekday() % 7 in dow or (d.isoweekday() == 7 and 7 in dow)
        fit = (d.day in dom and weekday) if any_dom or any_dow else (d.day in dom or weekday)
        if d.month in month and fit:
            for minute in range(1440):
                t = d + timedelta(minutes=minute)
                if t > after and t.hour in h and t.minute in m:
                    return t
    return None


BAD = set(range(10, 17))


def test_next_due_equals_a_scan(spark):
    draw = random.Random(7)
    times = [datetime(2023, 2, 28, 23, 59), datetime(2024, 2, 29, 0, 0), datetime(2024, 2, 28, 12, 30, 30), datetime(2099, 12, 31, 23, 59, 59), datetime(2096, 2, 29, 0, 0, 1)]
    times += [datetime(2024, 1, 1) + timedelta(minutes=draw.randrange(3_000_000)) for _ in range(6)]
    rows = [(e, x, t) for e, x in enumerate(EXPRESSIONS) for t in times]
    frame = spark.createDataFrame(rows, "e int, x string, t timestamp_ntz")
    for r in cron.with_next_due(frame, F.col("x"), F.col("t")).collect():
        expected = None if r.e in BAD else scan(EXPRESSIONS[r.e], r.t)
        assert r.due == expected, (EXPRESSIONS[r.e], r.t)


def test_changes_of_clock(spark):
    zone = ZoneInfo("Europe/Berlin")
    rows = [(datetime(2024, 3, 30, 12), "30 2 * * *"), (datetime(2024, 3, 31, 0, 45), "30 2 * * *"), (datetime(2024, 10, 26, 12), "30 2 * * *"), (datetime(2024, 10, 27, 0, 29), "30 2 * * *"), (datetime(2024, 7, 1, 10), "0 12 * * *")]
    frame = spark.createDataFrame(rows, "t timestamp_ntz, x string")
    for r in cron.with_next_due(frame, F.col("x"), F.col("t"), zone="Europe/Berlin").collect():
        local = r.t.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None)
        wall = scan(r.x, local)
        assert r.due == wall.replace(tzinfo=zone).astimezone(ZoneInfo("UTC")).replace(tzinfo=None), r
