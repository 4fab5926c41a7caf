"""Columns that read listing markup with regular expressions; rows and cells keep their page order."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from .text import clean, filled, let

#: A row without a row or table inside; the possessive body never backtracks.
LEAF_ROW = r"(?is)<tr\b([^>]*)>((?:[^<]++|<(?!/?tr\b|table\b))*+)</tr>"
#: A cell ends at its end tag, at the next cell, or with the row.
CELL = r"(?is)<td\b[^>]*>((?:[^<]++|<(?!/?td\b))*+)"
LINK = r"(?is)<a\b([^>]*)>(.*?)</a>"


MARKUP_SIGNS = {"<": "&lt;", ">": "&gt;", "&": "&amp;", '"': "&quot;", "'": "&#39;"}
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


@F.pandas_udf(MapType(StringType(), StringType()))
def characters(references: pd.Series) -> pd.Series:
    """What each of a page's distinct references stands for. Spark has no table of the named ones, and a browser reads the beginnings of unknown ones, too."""
    sign = lambda x: MARKUP_SIGNS.get(unescape(x), unescape(x))
    return references.map(lambda found: None if found is None else {x: sign(x) for x in found})


def decoded(html: str) -> Column:
    """Markup with its character references as characters, but for the signs that mean markup, which get one name each.

    Python sees the distinct references of a page and no markup, so its batches stay small whatever the pages' size.
    """
    c = F.col(html)
    known = characters(F.when(F.contains(c, F.lit("&")), F.array_distinct(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)))))
    one = lambda m, part, x: F.when(x == "", part).otherwise(F.concat(F.try_element_at(m, x), F.substr(part, F.length(x) + 1)))
    parts = lambda m: F.transform(F.split(c, "(?=&)"), lambda part: let(F.regexp_extract(part, f"^{REFERENCE}", 0), lambda x: one(m, part, x)))
    return let(known, lambda m: F.when(m.isNull(), c).otherwise(F.array_join(parts(m), "")))


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def leaf_rows(html: Column) -> Column:
    """Innermost table rows, tags included."""
    return F.regexp_extract_all(without_comments(html), F.lit(LEAF_ROW), F.lit(0))


def cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(CELL), F.lit(1))


def text_of(html: Column) -> Column:
    """Cleaned text of markup: tags dropped, the references that ``decoded`` leaves (and no-break spaces) as characters."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return clean(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the text of a tag, null if it is missing or empty."""
    value = lambda x, sign: let(F.regexp_extract(x, rf"(?i)(?:^|[\s\"']){name}\s*=\s*{sign}([^{sign}]*){sign}", 1), filled)
    return let(tag, lambda x: F.coalesce(value(x, '"'), value(x, "'")))


def links(html: Column) -> Column:
    """array of (href, text) of the links with an address, in page order."""
    found = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda a: F.struct(attribute(F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1), "href").alias("href"), text_of(a).alias("text")))
    return F.filter(found, lambda x: x["href"].isNotNull())


def tables(html: Column) -> Column:
    """Innermost tables, tags included."""
    return F.regexp_extract_all(without_comments(html), F.lit(r"(?is)<table\b(?:[^<]++|<(?!/?table\b))*+</table>"), F.lit(0))
