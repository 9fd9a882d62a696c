"""Text expressions: the lexical tokeniser, headings, sentences, figures, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case tokens; marks at the ends are stripped."""
    # Fixed value: what a token is.
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9.,%$/-]*)"), 1)
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"[.,/-]+$", "")), lambda t: t != "")


# The same tokens of a lower-cased text, for tasks in Python; marks at the ends are left out by going back.
find_tokens = re.compile(r"[a-z0-9](?:[a-z0-9.,%$/-]*[a-z0-9%$])?").findall


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the lower-cased text contains."""
    low = F.lower(text)
    out = F.lit(0)
    for t in terms:
        out = out + low.contains(t).cast("int")
    return out


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def looks_like_heading(text: Column) -> Column:
    t = F.trim(text)
    n = F.length(t)
    return n.between(3, 90) & ~t.rlike(r"[.,;]$") & (letters(t) >= F.greatest(F.lit(3.0), n * 0.5))


def years(text: Column, first: int, last: int) -> Column:
    """The four-digit numbers, with no digit beside them, from first to last; sorted, distinct."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(first, last))))


def markers(text: Column) -> Column:
    """The numbers in [n] marks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,4})\]"), 1), lambda n: n.cast("int"))


def percents(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)\s?%"), 1), lambda x: x.cast("double"))


# Marks of money, what a magnitude multiplies by, and the magnitudes that make a bare number money.
MARKS = ["us$", "usd", "$", "₹", "€", "£"]
MAGNITUDES = {
    "trillion": 1e12, "tn": 1e12, "t": 1e12, "billion": 1e9, "bn": 1e9, "b": 1e9,
    "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3,
}
BARE = ["trillion", "billion", "million", "thousand"]
_DIGITS = r"\d[\d,]*(?:\.\d+)?"
# Any number with what may stand around it: a mark, the digits, and a magnitude or a percent sign.  The look ahead
# passes most characters by at once.
_FIGURE = rf"(?i)(?=\s?\d|[{''.join(sorted({m[0] for m in MARKS}))}])(?:{'|'.join(m.replace('$', '[$]') for m in MARKS)})?\s?{_DIGITS}(?:\s?(?:(?:{'|'.join(MAGNITUDES)})\b|%))?"


def _figures(text: Column) -> Column:
    """Every number of a text in order: kind ('money', 'percent' or null), figure (as it stands) and value."""
    scale = F.create_map(*[x for k, v in MAGNITUDES.items() for x in (F.lit(k), F.lit(v))])

    def figure(x: Column) -> Column:
        unit = F.lower(F.regexp_extract(x, "([A-Za-z]+|%)$", 1))  # what stands after the digits
        marked = F.lower(F.substring(x, 1, 1)).isin(*sorted({m[0] for m in MARKS}))
        kind = F.when(unit == "%", "percent").when(marked | unit.isin(BARE), "money")
        value = F.replace(F.regexp_extract(x, _DIGITS, 0), F.lit(","), F.lit("")).cast("double") * F.coalesce(F.try_element_at(scale, unit), F.lit(1.0))
        return F.struct(kind.alias("kind"), x.alias("figure"), value.alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(_FIGURE), 0), figure)


def amounts(text: Column) -> Column:
    """Amounts of money with their magnitudes multiplied out: marked numbers, and bare ones before a magnitude's word."""
    return F.transform(F.filter(_figures(text), lambda x: x["kind"] == "money"), lambda x: x["value"])


def located(text: Column, width: int = 70) -> Column:
    """Money and percentages of a text in order: kind, figure, value, start (from 0) and the characters around it."""
    def around(text: Column, n: Column, x: Column, start: Column, end: Column) -> Column:
        first, last = F.greatest(start - width, F.lit(0)), F.least(end + width, n)
        words = F.trim(F.substring(text, first + 1, last - first))
        context = F.concat(F.when(first > 0, "…").otherwise(""), words, F.when(last < n, "…").otherwise(""))
        own = F.ltrim(x["figure"])
        return F.struct(x["kind"].alias("kind"), F.trim(x["figure"]).alias("figure"), x["value"].alias("value"), (end - F.length(own)).alias("start"), context.alias("context"))

    def placed(text: Column, n: Column, found: Column) -> Column:
        # Between figures there are no digits, so a figure's first place after the one before is its own.
        after = lambda at, x: F.call_function("locate", x["figure"], text, at) - 1 + F.length(x["figure"])
        ends = F.aggregate(found, F.array().cast("array<int>"), lambda ends, x: F.array_append(ends, after(F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) + 1, x)))
        told = F.filter(F.arrays_zip(found.alias("x"), ends.alias("end")), lambda y: y["x"]["kind"].isNotNull())
        return F.transform(told, lambda y: around(text, n, y["x"], y["end"] - F.length(y["x"]["figure"]), y["end"]))

    # In arrays of one, the text is made and its figures are found once and not for each use.
    once = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))
    return once(text, lambda t: once(F.struct(_figures(t).alias("found"), F.length(t).alias("n")), lambda x: placed(t, x["n"], x["found"])))


def year_month(text: Column) -> Column:
    """Months since year 0 of 'yyyy-mm' or 'Mon yyyy'; null for others."""
    iso = F.regexp_extract(text, r"(\d{4})-(\d{2})", 1)
    month = F.regexp_extract(text, r"(\d{4})-(\d{2})", 2)
    names = "jan feb mar apr may jun jul aug sep oct nov dec"
    name = F.lower(F.regexp_extract(text, r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{4})", 1))
    year = F.regexp_extract(text, r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{4})", 2)
    by_name = F.floor((F.call_function("instr", F.lit(names), name) - 1) / 4) + 1
    return F.when(iso != "", iso.try_cast("int") * 12 + month.try_cast("int") - 1).when(name != "", year.try_cast("int") * 12 + by_name - 1).cast("int")
