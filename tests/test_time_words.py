"""Time phrases in six languages, seen from one Wednesday."""

from datetime import date, datetime, timedelta

import pytest

from memlattice.functions import time_words

NOW = datetime(2025, 1, 15, 9, 30)
CASES = [
    ("june 2024", "2024-06-01", "2024-06-30"), ("dogs in June 2023", "2023-06-01", "2023-06-30"), ("Feb? no: February 2024!", "2024-02-01", "2024-02-29"),
    ("what happened last year", "2024-01-01", "2024-12-31"), ("what is the weather", None, None), ("a piece of jewelry last Saturday from whom?", "2025-01-11", "2025-01-11"),
    ("who did I meet last Friday?", "2025-01-10", "2025-01-10"), ("last wednesday", "2025-01-08", "2025-01-08"), ("next wednesday", "2025-01-22", "2025-01-22"), ("this monday", "2025-01-13", "2025-01-13"),
    ("what did I do yesterday?", "2025-01-14", "2025-01-14"), ("the day before yesterday", "2025-01-13", "2025-01-13"), ("what meetings did I have last week?", "2025-01-06", "2025-01-12"),
    ("expenses from last month", "2024-12-01", "2024-12-31"), ("what did I do last weekend?", "2025-01-11", "2025-01-12"), ("this week", "2025-01-13", "2025-01-19"), ("next month", "2025-02-01", "2025-02-28"),
    ("my friend a couple of days ago", "2025-01-12", "2025-01-14"), ("What did I do a few days ago?", "2025-01-10", "2025-01-13"), ("3 days ago", "2025-01-12", "2025-01-12"),
    ("two weeks ago", "2025-01-01", "2025-01-01"), ("a month ago", "2024-12-15", "2024-12-15"), ("11 months ago", "2024-02-15", "2024-02-15"), ("the last 3 days", "2025-01-12", "2025-01-15"), ("next two weeks", "2025-01-15", "2025-01-29"),
    ("in 2019 we met", "2019-01-01", "2019-12-31"), ("2019 items", None, None), ("in March", "2024-03-01", "2024-03-31"), ("in January", "2025-01-01", "2025-01-31"), ("last January", "2024-01-01", "2024-01-31"),
    ("on June 5th, 2024", "2024-06-05", "2024-06-05"), ("2024-02-29", "2024-02-29", "2024-02-29"), ("2023-02-29", None, None), ("31 april 2024", None, None), ("we may go", None, None),
    ("letzte Woche", "2025-01-06", "2025-01-12"), ("vor drei Tagen", "2025-01-12", "2025-01-12"), ("am 3. März 2024", "2024-03-03", "2024-03-03"), ("vorgestern", "2025-01-13", "2025-01-13"), ("letzten Freitag", "2025-01-10", "2025-01-10"), ("vor ein paar Tagen", "2025-01-10", "2025-01-13"),
    ("la semaine dernière", "2025-01-06", "2025-01-12"), ("il y a deux jours", "2025-01-13", "2025-01-13"), ("en août 2023", "2023-08-01", "2023-08-31"), ("avant-hier", "2025-01-13", "2025-01-13"), ("les 3 derniers jours", "2025-01-12", "2025-01-15"),
    ("el mes pasado", "2024-12-01", "2024-12-31"), ("hace 2 semanas", "2025-01-01", "2025-01-01"), ("en junio de 2023", "2023-06-01", "2023-06-30"), ("el viernes pasado", "2025-01-10", "2025-01-10"), ("el fin de semana pasado", "2025-01-11", "2025-01-12"),
    ("la settimana scorsa", "2025-01-06", "2025-01-12"), ("due giorni fa", "2025-01-13", "2025-01-13"), ("l'anno scorso", "2024-01-01", "2024-12-31"), ("na semana passada", "2025-01-06", "2025-01-12"), ("há 2 dias", "2025-01-13", "2025-01-13"), ("em março de 2024", "2024-03-01", "2024-03-31"),
    ("first yesterday, then last year", "2025-01-14", "2025-01-14"), ("", None, None), (None, None, None), ("x " * 20_000 + "yesterday", "2025-01-14", "2025-01-14"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(n, text, NOW) for n, (text, _, _) in enumerate(CASES)], "n int, text string, now timestamp_ntz")
    return {r.n: (r.low, r.high) for r in time_words.windows(rows).collect()}


def test_phrases(found):
    wrong = []
    for n, (text, low, high) in enumerate(CASES):
        expected = (None, None) if low is None else (datetime.fromisoformat(low), datetime.fromisoformat(high) + timedelta(days=1, microseconds=-1))
        if found[n] != expected:
            wrong.append((text and text[-60:], found[n], expected))
    assert not wrong, wrong


def test_every_day_of_leap_years(spark):
    """Calendar phrases from each day of three years against plain date arithmetic."""
    days = [date(2023, 1, 1) + timedelta(days=n) for n in range(1096)]
    texts = ["last week", "last month", "last monday", "last weekend", "12 days ago"]
    rows = [(t, datetime(d.year, d.month, d.day, 23, 59)) for d in days for t in texts]
    for r in time_words.windows(spark.createDataFrame(rows, "text string, now timestamp_ntz")).collect():
        d, low, high = r.now.date(), r.low.date(), r.high.date()
        monday = d - timedelta(days=d.weekday())
        if r.text == "last week":
            expected = monday - timedelta(days=7), monday - timedelta(days=1)
        elif r.text == "last weekend":
            expected = monday - timedelta(days=2), monday - timedelta(days=1)
        elif r.text == "last month":
            end = d.replace(day=1) - timedelta(days=1)
            expected = end.replace(day=1), end
        elif r.text == "last monday":
            back = (d.weekday() or 7)
            expected = d - timedelta(days=back), d - timedelta(days=back)
        else:
            expected = d - timedelta(days=12), d - timedelta(days=12)
        assert (low, high) == expected, (r.text, d)


def test_no_now_and_own_columns(spark):
    rows = spark.createDataFrame([("yesterday", None, 1)], "text string, now timestamp_ntz, kind int")
    row = time_words.windows(rows).first()
    assert (row.low, row.high, row.kind) == (None, None, 1)
    assert time_words.windows(rows.where("false")).count() == 0
