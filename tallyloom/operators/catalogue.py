"""What an intake and its index list: documents in order, their years, origins and sections; guarded look-ups; answers' JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def guarded_ciks(companies: DataFrame, known: DataFrame) -> DataFrame:
    """Adds cik by ticker, for companies of the US only. ``companies``: ticker, country; ``known``: ticker, cik."""
    us = F.when(c("country") == "US", F.upper("ticker"))
    return companies.withColumn("_ticker", us).join(known.select(F.upper("ticker").alias("_ticker"), "cik"), "_ticker", "left").drop("_ticker")


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def base_ticker(ticker: Column) -> Column:
    return F.substring_index(ticker, ".", 1)


def document_label(fiscal_year: Column, period: Column, doc_type: Column) -> Column:
    """'FY2024 Annual report', 'Q3 FY2024 Presentation', or the type alone where there is no year."""
    kind = F.replace(F.concat(F.upper(F.substring(doc_type, 1, 1)), F.substring(doc_type, F.lit(2), F.length(doc_type))), F.lit("_"), F.lit(" "))
    quarter = F.when(period.startswith("Q"), period)
    return F.concat_ws(" ", quarter, F.concat(F.lit("FY"), fiscal_year.cast("string")), kind)


def discovered(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources' documents, the first's before the second's, each in its own order. Both: seq and the same columns."""
    both = first.withColumn("source_order", F.lit(0)).unionByName(second.withColumn("source_order", F.lit(1)))
    return both.withColumn("seq", F.struct("source_order", "seq")).drop("source_order")


def accepted_order(documents: DataFrame, *keys: str) -> DataFrame:
    """Adds place: the latest year first, then the latest quarter (a full year after all), then the most trusted, then seq."""
    quarter = F.when(c("fiscal_period") == "FY", 5).otherwise(F.coalesce(F.substring("fiscal_period", 2, 1).try_cast("int"), F.lit(0)))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("fiscal_year"), F.desc("_quarter"), F.desc("trust"), "seq")
    return documents.withColumn("_quarter", quarter).withColumn("place", F.row_number().over(order)).drop("_quarter")


def listed(documents: DataFrame, *keys: str) -> DataFrame:
    """The sorted distinct years (null and 0 left out) and origins of a key's documents. Both are few by their nature."""
    years = F.array_sort(F.collect_set(F.when(c("fiscal_year") != 0, c("fiscal_year"))))
    return documents.groupBy(*keys).agg(years.alias("years"), F.array_sort(F.collect_set("origin")).alias("origins"))


def section_list(lines: DataFrame) -> DataFrame:
    """(doc_id, place, section): each section once, in the order of its first line. ``lines``: doc_id, ordinal, section."""
    first = lines.filter("section is not null").groupBy("doc_id", "section").agg(F.min("ordinal").alias("ordinal"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))).drop("ordinal")


def top_unverified(figures: DataFrame, most: int = 25) -> DataFrame:
    """The first ``most`` untraced figures of each ticker, alike ones once, with the number of all of them.

    ``figures``: ticker, seq, figure, context, traced.  Alike: the same figure and the same first 40 characters.
    """
    bad = figures.filter(~c("traced")).withColumn("start", F.substring("context", 1, 40))
    counts = bad.groupBy("ticker").agg(F.count("*").alias("n_unverified"))
    first = bad.groupBy("ticker", "figure", "start").agg(F.min_by("context", "seq").alias("context"), F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("seq", "figure", "context"))
    return first.drop("start").withColumn("place", place).filter(c("place") <= most).join(counts, "ticker")


def json_of(answer: Column) -> Column:
    """The JSON text in an answer: the whole, else what a fence holds, else from the first brace to the last; null if none parses.

    Spark's parser stops after the first value; what follows one, a second value or other text, is found by parsing
    the text as an only element of a list and as the value of a key.
    """
    text = F.btrim(answer, F.lit(" \n\t\r"))
    fenced = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*(.*?)```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def valid(x: Column) -> Column:
        listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>")
        keyed = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
        return F.when((F.size(listed) == 1) & keyed.isNotNull() & x.rlike(r"^\s*[\[{]"), x)

    return F.coalesce(valid(text), valid(F.btrim(fenced, F.lit(" \n\t\r"))), valid(braced))


def statement_years(*statements: DataFrame, most: int = 6) -> DataFrame:
    """The latest years that any statement has, newest first by place. Each: ticker, fiscal_year and its own fields."""
    years = statements[0].select("ticker", "fiscal_year")
    for s in statements[1:]:
        years = years.union(s.select("ticker", "fiscal_year"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("fiscal_year")))
    return years.filter("fiscal_year is not null").distinct().withColumn("place", place).filter(c("place") <= most)


def statements_joined(*statements: DataFrame, most: int = 6) -> DataFrame:
    """A row for each of the latest years with all statements' fields, null where a statement lacks the year."""
    out = statement_years(*statements, most=most).drop("place")
    for s in statements:
        out = out.join(s, ["ticker", "fiscal_year"], "left")
    return out


def index_rows(pages: DataFrame, base: str) -> DataFrame:
    """(filing, kind, url): the cells of a filing index's table rows, each with its row's first link made absolute.

    ``pages``: filing, html.  Rows and cells end at the next one where they aren't closed; a row without a link, and
    a page that is null or no HTML, give nothing.
    """
    rows = pages.select("filing", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b.*?(?=<tr\b|</tr|</table|\z)"), 0)).alias("row"))
    link = F.trim(F.regexp_extract("row", r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)", 1))
    url = F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit(base.split("//")[0]), link)).when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(F.concat(F.lit(f"{base}/"), link))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)(?=</?td\b|\z)"), 1)
    plain = F.transform(cells, lambda x: F.btrim(F.replace(F.regexp_replace(x, "<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" ")), F.lit(" \n\t\r")))
    return rows.filter(link != "").select("filing", F.explode(plain).alias("kind"), url.alias("url"))


def exhibit(rows: DataFrame) -> DataFrame:
    """(filing, url): the page of the lowest EX-99 exhibit of a filing's index. ``rows``: filing, kind (a cell), url."""
    name = F.upper(F.trim("kind"))
    number = F.when(name == "EX-99", 1).when(name.startswith("EX-99."), F.substring(name, 7, 9).try_cast("int"))
    page = F.lower("url").endswith(".htm") | F.lower("url").endswith(".html")
    return rows.withColumn("_n", number).filter(c("_n").isNotNull() & page).groupBy("filing").agg(F.min_by("url", F.struct("_n", "url")).alias("url"))
