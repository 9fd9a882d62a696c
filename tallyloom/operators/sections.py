"""Section labels of lines, and how numeric a table is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Form, number and label of the items of annual and quarterly filings.
ITEMS = (
    ("10-K", "1", "Item 1 -Business"),
    ("10-K", "1A", "Item 1A -Risk Factors"),
    ("10-K", "1B", "Item 1B -Unresolved Staff Comments"),
    ("10-K", "1C", "Item 1C -Cybersecurity"),
    ("10-K", "2", "Item 2 -Properties"),
    ("10-K", "3", "Item 3 -Legal Proceedings"),
    ("10-K", "4", "Item 4 -Mine Safety Disclosures"),
    ("10-K", "5", "Item 5 -Market for Common Equity"),
    ("10-K", "6", "Item 6 -Selected Financial Data"),
    ("10-K", "7", "Item 7 -Management's Discussion and Analysis"),
    ("10-K", "7A", "Item 7A -Market Risk Disclosures"),
    ("10-K", "8", "Item 8 -Financial Statements"),
    ("10-K", "9", "Item 9 -Changes in and Disagreements with Accountants"),
    ("10-K", "9A", "Item 9A -Controls and Procedures"),
    ("10-K", "10", "Item 10 -Directors and Corporate Governance"),
    ("10-K", "11", "Item 11 -Executive Compensation"),
    ("10-K", "12", "Item 12 -Security Ownership"),
    ("10-K", "13", "Item 13 -Related Party Transactions"),
    ("10-K", "14", "Item 14 -Principal Accountant Fees"),
    ("10-K", "15", "Item 15 -Exhibits and Schedules"),
    ("10-Q", "1", "Item 1 -Financial Statements"),
    ("10-Q", "1A", "Item 1A -Risk Factors"),
    ("10-Q", "2", "Item 2 -Management's Discussion and Analysis"),
    ("10-Q", "3", "Item 3 -Market Risk Disclosures"),
    ("10-Q", "4", "Item 4 -Controls and Procedures"),
    ("10-Q", "5", "Item 5 -Other Information"),
    ("10-Q", "6", "Item 6 -Exhibits"),
)
# Words of headings in reports without items, in order; "…" stands for other words between.
NARRATIVE = {
    "Risk Factors": ("risk factors", "risk management"),
    "Management's Discussion and Analysis": ("management s discussion", "managements discussion"),
    "Income Statement": ("statement of income", "statements of income", "statement of operations", "statements of operations", "statement of profit", "statements of profit"),
    "Balance Sheet": ("balance sheet", "balance sheets", "statement of financial position", "statements of financial position"),
    "Cash Flow Statement": ("statement of cash flow", "statement of cash flows", "statements of cash flow", "statements of cash flows"),
    "Notes to Financial Statements": ("notes to … financial statements",),
    "Auditor's Report": ("auditor s report", "auditors report", "independent auditor", "independent auditors"),
    "Corporate Governance": ("corporate governance",),
    "Leadership Letter": (
        "chairman letter", "chairman message", "chairman statement",
        "chairman s letter", "chairman s message", "chairman s statement",
        "chairmans letter", "chairmans message", "chairmans statement",
        "ceo letter", "ceo message", "ceo statement",
        "ceo s letter", "ceo s message", "ceo s statement",
        "ceos letter", "ceos message", "ceos statement",
        "chief executive letter", "chief executive message", "chief executive statement",
        "chief executive s letter", "chief executive s message", "chief executive s statement",
        "chief executives letter", "chief executives message", "chief executives statement",
    ),
    "Business Overview": ("business overview", "business responsibility", "our business"),
    "Segment Information": ("segment information", "segment results", "segment reporting"),
}
HEADING_LENGTH = (3, 90)


def _item_parts(line: Column) -> tuple[Column, Column]:
    """(number, further words) of a line that begins with the word "item" and a number; null for others."""
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    marked = F.translate(F.try_element_at(words, F.lit(2)), ":)-–—", ".....")  # any of these ends the number
    number = F.upper(F.substring_index(marked, ".", 1))
    digits = F.translate(number, "ABC", "")
    one_letter = (F.length(number) - F.length(digits) <= 1) & (number.startswith(digits))
    valid = (F.lower(words[0]) == "item") & (F.size(words) > 1) & (F.translate(digits, "0123456789", "") == "") & F.length(digits).between(1, 2) & one_letter
    glued = F.substring(F.try_element_at(words, F.lit(2)), F.length(number) + 2, F.lit(HEADING_LENGTH[1]))
    rest = F.concat_ws(" ", glued, F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))))
    return F.when(valid, number), F.substring(F.btrim(rest, F.lit(" .:–—-")), 1, HEADING_LENGTH[1])


def item_heading(line: Column, form: Column) -> Column:
    """'Item n -Label' of an item's heading; unknown items keep their own words; null for other lines."""
    number, rest = _item_parts(line)
    known = lambda form: F.try_element_at(F.create_map(*[F.lit(x) for f, k, v in ITEMS if f == form for x in (k, v)]), number)
    label = F.when(F.upper(F.coalesce(form, F.lit(""))).startswith("10-Q"), known("10-Q")).otherwise(known("10-K"))
    own = F.concat(F.lit("Item "), number, F.coalesce(F.concat(F.lit(" -"), F.nullif(rest, F.lit(""))), F.lit("")))
    return F.when(number.isNotNull(), F.coalesce(label, own))


def narrative_heading(line: Column) -> Column:
    """The first label whose words stand in a short line."""
    own = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))

    def label(words: Column) -> Column:
        def holds(phrase: str) -> Column:
            first, _, then = phrase.partition(" … ")
            after = F.substring_index(words, f" {first} ", -1) if then else None
            return words.contains(f" {first} ") & (F.concat(F.lit(" "), after).contains(f" {then} ") if then else F.lit(True))

        return F.coalesce(*(F.when(reduce(Column.__or__, map(holds, phrases)), F.lit(n)) for n, phrases in NARRATIVE.items()))

    # In an array of one, the words are made once and not for each phrase.
    return F.when(F.length(F.trim(line)).between(*HEADING_LENGTH), F.get(F.transform(F.array(own), label), F.lit(0)))


def labelled(lines: DataFrame) -> DataFrame:
    """Adds section: the last heading before or at a line. ``lines``: doc_id, ordinal, line, form; filings with a form open sections by items only."""
    head = F.coalesce(item_heading(c("line"), c("form")), F.when(c("form").isNull(), narrative_heading(c("line"))))
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(order))


# Signs and units that a figure may carry.
CURRENCY_SIGNS = "$₹€£"
FIGURE_UNITS = ("%", "pts", "bps")


def is_figure(cell: Column) -> Column:
    """Whether a cell is one number, with a currency sign, a minus, brackets or a unit at most."""
    bare = cell
    for unit in FIGURE_UNITS:
        bare = F.when(bare.endswith(unit), F.substring(bare, F.lit(1), F.length(bare) - len(unit))).otherwise(bare)
    bare = F.ltrim(F.ltrim(F.rtrim(bare), F.lit("(")), F.lit(CURRENCY_SIGNS + " "))
    bare = F.rtrim(F.ltrim(bare, F.lit("-")), F.lit(")"))
    whole, part = F.substring_index(bare, ".", 1), F.substring(bare, F.length(F.substring_index(bare, ".", 1)) + 2, F.length(bare))
    only = lambda text, signs: F.translate(text, signs, "") == ""
    return (whole != "") & only(whole, "0123456789,") & only(part, "0123456789") & (~bare.contains(".") | (part != ""))


def numeric_ratio(table: Column) -> Column:
    """Share of a pipe table's filled cells that are figures."""
    lines = F.filter(F.split(table, "\n"), lambda x: x.startswith("|") & (F.translate(x, "|- ", "") != ""))
    cells = F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda y: F.trim(y)))), lambda y: y != "")
    figures = F.filter(cells, is_figure)
    return F.when(F.size(cells) > 0, F.size(figures) / F.size(cells)).otherwise(0.0)


def looks_numeric(table: Column) -> Column:
    """At least four numbers of two digits or more."""
    numbers = F.filter(F.split(table, r"[^0-9.,]+"), lambda x: F.length(F.translate(x, ".,", "")) >= 2)
    return F.size(numbers) >= 4
