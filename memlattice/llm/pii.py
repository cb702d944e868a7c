r"""Personal data: exact base kinds, and candidates chosen by boosted trees.

The base kinds are patterns with a check each.  Beyond them, generators of high
recall propose spans that may overlap (spelled-out e-mail addresses, national
telephone numbers, social security numbers, bank account numbers, short cards);
boosted trees score each by its format and by the words before it, a threshold
calibrated on held-out rows for precision accepts it, and of overlapping ones the
best stays.  Base spans always stay and take precedence.

Patterns are written so that Java's matcher neither recurses nor rescans: runs are
possessive, and a match that must start where a run starts says so, where ``\G``
stands for the end of the match before.  What they match is what the plain patterns
in ``BASE`` match.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.boosting import Boosted, calibrated_cut, fit
from memlattice.llm.common import settled, text_or_empty
from memlattice.llm.spans import NONE, contexts, joined, lengths, of_kind, places, scanned

#: The definitions, as plain patterns (fixed values).
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same for Java; the card's takes chains of 16 to 19 digits only.
JAVA = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be searched.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
BEFORE = 32
#: Candidate generators; the order is the feature "generator".
GENERATORS = {
    "email_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?(?:at|AT|@) ?[\])] ?| (?:at|AT) )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?(?:dot|DOT|\.) ?[\])] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{2,63}){1,4}",
    "phone_national": r"(?<![0-9+.-])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card_short": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
}
ANY = r"[\[(] ?(?:at|AT|@) ?[\])]| (?:at|AT) [A-Za-z0-9-]+(?:\.| (?:dot|DOT) | ?[\[(] ?(?:dot|DOT))|[0-9][)]?[ .-][0-9]{3,4}[ .-][0-9]{3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}|[0-9](?:[ -]?[0-9]){12}"
FOR = r"(?i)(?:phone|tel|call|mobile|fax|cell|contact|mail|write|reach|ssn|social|iban|account|bank|card|visa|amex|payment)[^a-z]*(?:(?:me|us|is|no|number|at|to)[^a-z]*)?$"
AGAINST = r"(?i)(?:isbn|order|invoice|version|page|pages|item|part|serial|ref|sku|id|model|chapter|figure|table|section|issue|build|date|code)[^a-z]*(?:(?:is|no|number)[^a-z]*)?$"
FEATURES = ("generator", "digits", "length", "marks", "luhn", "wanted", "unwanted", "brackets", "letters")
#: Labelled rows the classifier is fitted on, and the precision its threshold is calibrated for.
TRAINING_ROWS, PRECISION = 4000, 0.99


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    turned = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return (F.length(digits) > 1) & (F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    match = span["match"]
    if kind == "ip":
        return match.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$") & ~match.rlike(r"\.$")
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


#: Words before a wanted and an unwanted candidate in the rows for calibration, none of them in the rows for fitting.
OTHER_WANTED = {
    "email_words": ["reach me under", "my address:", "please mail", "send it to", "contact"],
    "phone_national": ["give me a ring:", "cell", "contact number is", "my phone is", "home tel", "ask for"],
    "ssn": ["social security no.", "ssn:", "tax file", "his social is"],
    "iban": ["transfer to account", "bank:", "please pay into", "iban no"],
    "card_short": ["charge my card", "payment by", "visa is", "paid with"],
}
OTHER_NOISE = ["lot", "tracking", "serial number", "part", "figure", "section", "dated", "score of", "between", "item", "room", "the code is", "chapter", "measured", "see also"]


def _examples(n: int, seed: int = 7, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates written from templates: features as the native expressions give them.

    With ``other`` the words around them, how often they tell, and the share of wanted
    ones are of another make, for calibration.
    """
    draw = random.Random(seed)
    digit = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda k: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    wanted = {
        "email_words": ["write to", "mail:", "contact me at", "reach us:"],
        "phone_national": ["phone:", "call", "tel.", "mobile number", "fax"],
        "ssn": ["SSN", "social", "ssn is"],
        "iban": ["IBAN", "bank account", "account no:"],
        "card_short": ["card number", "amex", "payment"],
    }
    noise = OTHER_NOISE if other else ["order", "isbn", "invoice no", "version", "page", "ref", "sku", "build", "and then", "the", "we met", "of which"]

    def luhn_tail(body: str) -> str:
        total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(body)))
        return body + str(-total % 10)

    rows, labels = [], []
    names = list(GENERATORS)
    wanted = OTHER_WANTED if other else wanted
    share, tells = (0.35, 0.75) if other else (0.5, 0.85)
    for _ in range(n):
        kind, good = draw.choice(names), draw.random() < share
        if kind == "email_words":
            ats, dots = (("[at]", "(at)", " [at] ", " at "), ("[dot]", "(dot)", " dot ", ".")) if good else ((" at ",), (".", ".", " dot "))
            at = draw.choice(ats)
            dot = draw.choice([d for d in dots if good and at.strip() != "at" or d.strip() != "." or not good] or [" dot "])
            match = word(draw.randint(3, 8)) + at + word(draw.randint(3, 8)) + dot + word(draw.randint(2, 3))
        elif kind == "phone_national":
            mark = draw.choice("-. ")
            match = draw.choice(["{}", "({})"]).format(digit(3)) + mark + digit(3) + mark + digit(4) if good else digit(draw.randint(2, 5)) + draw.choice("-. ") + digit(draw.randint(3, 4)) + draw.choice("-. ") + digit(draw.randint(3, 4))
        elif kind == "ssn":
            match = f"{digit(3)}-{digit(2)}-{digit(4)}"
        elif kind == "iban":
            match = draw.choice(["DE", "FR", "GB", "ES"]) + digit(2) + draw.choice(["", " "]).join(["", *(digit(4) for _ in range(4))]) if good else "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + digit(2) + "".join(draw.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(12))
        else:
            match = luhn_tail("3" + digit(13)) if good else digit(draw.randint(13, 15))
        before = draw.choice(wanted[kind]) if good and draw.random() < tells else draw.choice(noise)
        rows.append(python_features(names.index(kind), match, (word(5) + " " + before + " ")[-BEFORE:]))
        labels.append(float(good))
    return np.array(rows), np.array(labels)


def python_features(generator: int, match: str, before: str) -> list[float]:
    """The features of one candidate, for fitting and for tests of the native expressions."""
    digits = re.sub("[^0-9]", "", match)
    total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
    java = lambda pattern: bool(re.search(pattern, before))
    return [float(generator), float(len(digits)), float(len(match)), float(len(re.findall(r"[ .-]", match))), float(len(digits) > 1 and total % 10 == 0), float(java(FOR)), float(java(AGAINST)), float(len(re.findall(r"[\[\](){}]", match))), float(len(re.findall("[A-Z]", match)))]


@lru_cache(maxsize=2)
def classifier(rows: int = TRAINING_ROWS, precision: float = PRECISION) -> tuple[Boosted, float]:
    """The trees, fitted on ``rows`` labelled rows, and the margin from which a candidate is taken, calibrated on half as many of another make."""
    model = fit(FEATURES, *_examples(rows))
    x, y = _examples(rows // 2, seed=8, other=True)
    return model, calibrated_cut(model.predict(x), y, precision)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, an array of (start, end, match) for each base kind, and ``added``.

    ``added`` has (start, end, kind, margin) of the candidates taken.  Null texts
    count as empty, repeated rows each give a row, and other columns are not read.
    Only built-in functions run, nothing is shuffled, and texts without a trace of
    a kind are not searched for it.
    """
    none = F.expr(NONE)
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    kinds = list(JAVA)
    searched = {**JAVA, **GENERATORS}
    rows = settled(rows, **{f"_g_{k}": GATES[k](F.col("_t")) for k in kinds}, _g=F.col("_t").rlike(ANY))
    gate = {k: F.col(f"_g_{k}") for k in kinds} | {k: F.col("_g") for k in GENERATORS}
    rows = settled(rows, **{f"_m_{k}": F.when(gate[k], F.regexp_extract_all("_t", F.lit(p), F.lit(0))) for k, p in searched.items()})
    rows = settled(rows, **{f"_l_{k}": F.when(F.size(f"_m_{k}") > 0, lengths(F.split("_t", p, -1), F.col(f"_m_{k}"))) for k, p in searched.items()})
    # A candidate's context is the end of what stands before it, with the match before that; cutting it out of the text would walk the text for each.
    ends = {f"_b_{k}": F.when(F.size(f"_m_{k}") > 0, contexts(F.split("_t", p, -1), f"_m_{k}", BEFORE)) for k, p in GENERATORS.items()}
    rows = settled(rows, **{f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, places(f"_l_{k}", f"_m_{k}")) for k in searched}, **ends)
    rows = settled(rows, **{k: F.coalesce(F.filter(f"_p_{k}", partial(_valid, k)), none) for k in kinds})
    model, cut = classifier()

    def candidates(k: int, name: str) -> Column:
        def features(s: Column, before: Column) -> Column:
            match = s["match"]
            digits = _digits(match)
            values = {
                "generator": F.lit(float(k)),
                "digits": F.length(digits),
                "length": F.length(match),
                "marks": F.length(F.regexp_replace(match, r"[^ .-]", "")),
                "luhn": _luhn(digits),
                "wanted": before.rlike(FOR),
                "unwanted": before.rlike(AGAINST),
                "brackets": F.length(F.regexp_replace(match, r"[^\[\](){}]", "")),
                "letters": F.length(F.regexp_replace(match, r"[^A-Z]", "")),
            }
            return F.struct(*(v.cast("double").alias(f) for f, v in values.items()), s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("kind"))

        fields = "".join(f"{f}:double," for f in FEATURES)
        return F.coalesce(F.zip_with(f"_p_{name}", f"_b_{name}", features), F.expr(f"cast(array() as array<struct<{fields}start:int,end:int,kind:string>>)"))

    def ranked(s: Column) -> Column:
        margin = model.margin({f: s[f] for f in FEATURES})
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (-margin).alias("rank"), s["kind"].alias("kind"))

    proposed = F.filter(F.transform(F.concat(*(candidates(k, name) for k, name in enumerate(GENERATORS))), ranked), lambda c: -c["rank"] >= F.lit(cut))
    rows = settled(rows, _c=F.when(F.greatest(*(F.size(f"_p_{k}") for k in GENERATORS)) > 0, proposed))
    # Base spans rank before all candidates, with a null kind.
    base = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(float("-inf")).alias("rank"), F.lit(None).cast("string").alias("kind"))) for k in kinds))
    rows = settled(rows, _s=F.when(F.size("_c") > 0, F.array_sort(F.concat(base, F.col("_c")))))
    rows = settled(rows, _e=F.transform("_s", lambda s: s["end"]))
    # Spans overlap in runs: one starts where a span starts at or after the ends of all before it.
    rows = settled(rows, _f=F.filter(F.transform(F.zip_with("_s", scanned("_e", lambda a, b: F.greatest(a, b)), lambda s, end: s["start"] >= end), lambda first, i: F.when(first, i)), lambda i: i.isNotNull()))
    run = F.transform("_f", lambda i, k: F.slice("_s", i + 1, F.coalesce(F.get("_f", k + 1), F.size("_s")) - i))

    def take(chosen: Column, c: Column) -> Column:
        clash = F.exists(chosen, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return F.when(c["kind"].isNotNull() & clash, chosen).otherwise(F.concat(chosen, F.array(c)))

    def best(spans: Column) -> Column:
        by_rank = F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        empty = F.expr("cast(array() as array<struct<rank:double,start:int,end:int,kind:string>>)")
        return F.filter(F.aggregate(by_rank, empty, take), lambda s: s["kind"].isNotNull())

    rows = settled(rows, _chosen=F.when(F.size("_c") > 0, F.flatten(F.transform(run, best))))
    shown = F.transform("_chosen", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), (-c["rank"]).alias("margin")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,margin:double>>)")
    return settled(rows, added=F.coalesce(F.array_sort(shown), none)).select(id_col, *kinds, "added")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns; in ``spans`` the added kinds follow the base ones."""
    base = [(k, F.col(k)) for k in BASE]
    more = [(name, of_kind("added", name)) for name in GENERATORS]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base, "kind").cast("binary"), 256).alias("base_sha256"),
        joined([*base, *more], "kind").alias("spans"),
    )
