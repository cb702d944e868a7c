"""Time windows from words in texts: "last week", "vor drei Tagen", "junio de 2023", "in 2019".

A text becomes a string with one letter for each word that the lexicon knows, and a
regular expression over those letters, which is a finite automaton over kinds of words,
finds the first phrase.  Everything is column expressions; no text leaves the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCALES = ("en", "de", "fr", "es", "it", "pt")

#: Kinds of words: d day at an offset, r direction, u unit, n number, f vague number, g "ago" after
#: and b before its number, i "in", w weekday, m month, y year.  Weekdays and months come from the locales of the JVM.
DAY, WEEK, MONTH, YEAR, WEEKEND = range(1, 6)
WORDS = {
    ("d", 0): "today tonight heute oggi hoy hoje aujourdhui",
    ("d", -1): "yesterday gestern hier ayer ieri ontem",
    ("d", -2): "daybeforeyesterday vorgestern avanthier anteayer anteontem",
    ("d", 1): "tomorrow demain domani amanhã",
    ("r", -1): "last past previous letzte letzten letzter letztes letztem vergangene vergangenen vergangenes dernier dernière derniers dernières passé passée pasado pasada pasados pasadas último última últimos últimas scorso scorsa scorsi scorse ultimo ultima ultimi ultime passado passada passados passadas",
    ("r", 0): "this diese diesen dieser dieses diesem cette este esta questo questa",
    ("r", 1): "next nächste nächsten nächster nächstes prochain prochaine próximo próxima prossimo prossima",
    ("u", DAY): "day days tag tage tagen jour jours día días giorno giorni dia dias",
    ("u", WEEK): "week weeks woche wochen semaine semaines semana semanas settimana settimane",
    ("u", MONTH): "month months monat monate monaten monats mois mes meses mese mesi mês",
    ("u", YEAR): "year years jahr jahre jahren jahres an ans année années año años anno anni ano anos",
    ("u", WEEKEND): "weekend wochenende",
    ("n", 1): "one ein eine einen einem einer un une uno una um uma",
    ("n", 2): "two zwei deux dos due dois duas",
    ("n", 3): "three drei trois tres tre três",
    ("n", 4): "four vier quatre cuatro quattro quatro",
    ("n", 5): "five fünf cinq cinco cinque",
    ("n", 6): "six sechs seis sei",
    ("n", 7): "seven sieben sept siete sette sete",
    ("n", 8): "eight acht huit ocho otto oito",
    ("n", 9): "nine neun neuf nueve nove",
    ("n", 10): "ten zehn dix diez dieci dez",
    ("f", 2): "couple",
    ("f", 3): "few paar einigen quelques unos algunos pochi alguns",
    ("g", 0): "ago fa atrás",
    ("b", 0): "vor ilya hace há faz",
    ("i", 0): "in im en em nel during since",
    ("x", 0): "a of the de des los las le la les l der die dem den del dei do da",
}
#: Phrases of several words, or with a sign within, that count as one.
PHRASES = {"the day before yesterday": "daybeforeyesterday", "avant[- ]hier": "avanthier", "aujourd['’]hui": "aujourdhui", "il y a": "ilya", "last night": "yesterday", "this morning": "today", "fin de semana|fim de semana|fine settimana|week-end": "weekend"}
#: Phrases by kinds of words; of those that begin at one word the first counts.
GRAMMAR = ("bnfu", "b[nf]u", "bu", "nfug", "[nf]ug", "rug", "ug", "r[nf]u", "[nf]ru", "[nf]ur", "ru", "ur", "rw", "wr", "nmy", "mny", "imy", "rmy", "my", "rm", "mr", "imn", "im", "nm", "mn", "ynn", "iy", "d")
#: A vague number of units ago, from and to: "a couple of days ago", "a few days ago".
VAGUE = {2: (3, 1), 3: (5, 2)}


def lexicon(spark: SparkSession, locales: Sequence[str] = LOCALES) -> dict[str, tuple[str, int]]:
    """Words with kind and value; names of months and weekdays as the JVM spells them in each locale."""
    words = {word: key for key, held in WORDS.items() for word in held.split()}
    n = F.col("id").cast("int")
    dates = (("MMMM", "m", F.make_date(F.lit(2024), n, F.lit(1))), ("LLLL", "m", F.make_date(F.lit(2024), n, F.lit(1))), ("EEEE", "w", F.make_date(F.lit(2024), F.lit(1), n)))
    spelled = [F.to_csv(F.struct(date), {"locale": locale, "dateFormat": pattern}).alias(f"{letter}{k}{locale}") for k, (pattern, letter, date) in enumerate(dates) for locale in locales]
    for row in spark.range(1, 13, 1, 1).select("id", *spelled).collect():  # twelve rows
        for column, name in row.asDict().items():
            if column != "id" and (column[0] == "m" or row.id <= 7):
                for one in re.findall(r"\w+", name.lower())[:1]:
                    words.setdefault(one, (column[0], row.id))
    return words


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: the optimizer copies no expression past a generator."""
    one = df.select("*", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once"))
    return one.select("*", "_once.*").drop("_once")


def windows(df: DataFrame, text: str = "text", now: str = "now", locales: Sequence[str] = LOCALES) -> DataFrame:
    """``df`` with ``low`` and ``high``, the first and last moment of the first time phrase of ``text``, seen from ``now``.

    "last week" is the calendar week before, from Monday; "last friday" the latest
    before today; "3 weeks ago" a day; "last 3 weeks" what lies between then and today;
    a month without a year the latest that has begun.  Both are null if there is no
    phrase, no text, no ``now``, or no such day; columns of these names are replaced.
    """
    words = lexicon(df.sparkSession, locales)
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"))
    spelled = json.dumps({word: {"kind": kind, "value": value} for word, (kind, value) in sorted(words.items())})
    table = F.from_json(F.lit(spelled), "map<string,struct<kind:string,value:int>>")  # folded into one constant
    said = F.lower(F.col(text))
    for phrase, word in PHRASES.items():
        said = F.regexp_replace(said, rf"(?U)\b(?:{phrase})\b", f" {word} ")
    # (?U) lets \w and \b see letters of every script; 1st, 2nd, ... lose their ending.
    tokens = F.regexp_extract_all(F.regexp_replace(said, r"\b([0-9]{1,2})(?:st|nd|rd|th)\b", "$1"), F.lit(r"(?U)(\w+)"), 1)

    def known(token: Column) -> Column:
        digits = F.when(token.rlike("^[0-9]{1,4}$"), token.cast("int"))
        year = digits.between(1900, 2099) & (F.length(token) == 4)
        number = F.when(year, F.struct(F.lit("y").alias("kind"), digits.alias("value"))).when(digits < 1000, F.struct(F.lit("n").alias("kind"), digits.alias("value")))
        return F.coalesce(number, F.get(F.array(F.try_element_at(table, token)), F.lit(0)), entry("o", 0))

    taken = F.filter(F.transform(tokens, known), lambda w: w["kind"] != "x")
    day = lambda c: c.cast("date")
    rules = f"({'|'.join(GRAMMAR)})"
    each = _once(df, _words=taken, _today=day(F.col(now)))
    each = _once(each, _kinds=F.array_join(F.transform("_words", lambda w: w["kind"]), ""))
    part = F.slice("_words", F.greatest(F.regexp_instr("_kinds", F.lit(rules)), F.lit(1)), F.length(F.regexp_extract("_kinds", rules, 1)))
    each = _once(each, _rule=F.regexp_extract("_kinds", rules, 1), _part=part)
    value = lambda kind: F.get(F.filter("_part", lambda w: w["kind"] == kind), F.lit(0))["value"]
    each = _once(each, **{f"_{kind}": value(kind) for kind in "unrfmywd"}, _second=F.get("_part", F.lit(1))["value"], _third=F.get("_part", F.lit(2))["value"])
    unit, number, way, vague, month, year, weekday, offset = (F.col(f"_{kind}") for kind in "unrfmywd")
    rule, today = F.col("_rule"), F.col("_today")
    week, begin = day(F.date_trunc("week", today)), day(F.date_trunc("month", today))

    def moved(start: Column, n: Column) -> Column:
        """``start`` by ``n`` units."""
        days = F.date_add(start, n * F.when(unit == DAY, 1).otherwise(7))
        return F.when(unit.isin(MONTH, YEAR), F.add_months(start, n * F.when(unit == YEAR, 12).otherwise(1))).otherwise(days)

    few, many = F.when(vague == 2, VAGUE[2][1]).otherwise(VAGUE[3][1]), F.when(vague == 2, VAGUE[2][0]).otherwise(VAGUE[3][0])
    least, most = F.coalesce(F.when(vague.isNull(), number), few, F.lit(1)), F.coalesce(F.when(vague.isNull(), number), many, F.lit(1))
    count_ = lambda c: F.when(number.isNull() & vague.isNull(), 1).otherwise(c)
    ago = (moved(today, -count_(most)), moved(today, -count_(least)))
    rolling = (F.when(way > 0, today).otherwise(moved(today, -most)), F.when(way > 0, moved(today, most)).otherwise(today))
    start = F.when(unit == DAY, today).when(unit == MONTH, begin).when(unit == YEAR, day(F.date_trunc("year", today))).otherwise(week)
    period = (F.when(unit == WEEKEND, F.date_add(moved(start, way), 5)).otherwise(moved(start, way)), F.date_sub(moved(start, way + 1), 1))
    iso = F.weekday(today) + 1
    back = F.when(weekday < iso, iso - weekday).otherwise(iso - weekday + 7)
    ahead = F.when(weekday > iso, weekday - iso).otherwise(weekday - iso + 7)
    named_day = F.when(way < 0, F.date_sub(today, back)).when(way > 0, F.date_add(today, ahead)).otherwise(F.date_add(week, weekday - 1))
    # The year of a month without one: the latest that has begun; "last june" is over, "next june" has not begun.
    this_year, of_now = F.year(today), F.month(today)
    near = F.when(way < 0, this_year - (month >= of_now).cast("int")).when(way > 0, this_year + (month <= of_now).cast("int")).when(way == 0, this_year).otherwise(this_year - (month > of_now).cast("int"))
    first = F.make_date(F.coalesce(year, near), month, F.lit(1))
    nth = F.when(number.between(1, F.day(F.last_day(first))), F.date_add(first, number - 1))
    second, third = F.col("_second"), F.col("_third")
    iso_first = F.when(second.between(1, 12), F.make_date(year, second, F.lit(1)))
    iso_day = F.when(third.between(1, F.day(F.last_day(iso_first))), F.date_add(iso_first, third - 1))
    one = F.date_add(today, offset)
    low = F.lit(None).cast("date")
    high = low
    for held, a, b in (
        (("bnfu", "nfug", "bnu", "bfu", "bu", "nug", "fug", "rug", "ug"), *ago), (("rnu", "rfu", "nru", "fru", "nur", "fur"), *rolling), (("ru", "ur"), *period), (("rw", "wr"), named_day, named_day),
        (("nmy", "mny", "nm", "mn", "imn"), nth, nth), (("imy", "rmy", "my", "im", "rm", "mr"), first, F.last_day(first)), (("ynn",), iso_day, iso_day),
        (("iy",), F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))), (("d",), one, one),
    ):
        low, high = F.when(rule.isin(*held), a).otherwise(low), F.when(rule.isin(*held), b).otherwise(high)
    each = _once(each, _low=low, _high=high)
    low, high = F.col("_low"), F.col("_high")
    each = each.withColumns({"low": low.cast("timestamp_ntz"), "high": high.cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(1)) - F.make_dt_interval(secs=F.lit("0.000001").cast("decimal(18,6)"))})
    return each.select(*[c for c in df.columns if c not in ("low", "high")], "low", "high")
