"""Listing pages as notices. A page is a row with page_no, html and base_url; everything is built from column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, html
from ..functions.text import absolute_url, bracket_values, chain_parts, clean, division_split, filled, let, organisation_of, reference_id
from .json_feeds import first_per_key, notices

GENERAL = "Government eProcurement"
# The headers, ids and classes of the listings' markup stand in the functions below.


def _pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", html.decoded("html"))


def once(rows: DataFrame, fields: Column, *keep: str) -> DataFrame:
    """``keep`` and the fields of a struct, computed once a row: conditions on them are not pushed below, and columns made of them do not repeat them."""
    return rows.select(*keep, F.inline(F.array(fields)))


def listing(pages: DataFrame, portal: str) -> DataFrame:
    """Rows of listing tables: a linked title, a reference and at least one date (closing, then opening)."""
    rows = _pages(pages).select("page_no", "base_url", F.posexplode(html.leaf_rows(F.col("html"))).alias("pos", "row"))
    found = F.struct(F.try_element_at(html.links(F.col("row")), F.lit(1)).alias("link"), F.transform(html.cells(F.col("row")), html.text_of).alias("texts"))
    rows = once(rows, found, "page_no", "base_url", "pos").where((F.size("texts") >= 2) & (F.col("link.text") != ""))
    told = lambda x, date: F.struct(date.alias("date"), F.when(date.isNull(), reference_id(x)).alias("id"))
    others = F.transform(F.filter("texts", lambda x: x != F.col("link.text")), lambda x: let(dates.month_name(x), lambda date: told(x, date)))
    rows = once(rows, F.struct(others.alias("others")), "page_no", "base_url", "pos", "link")
    rows = rows.withColumns({
        "dates": F.filter(F.transform("others", lambda x: x["date"]), lambda x: x.isNotNull()),
        "number": F.try_element_at(F.filter(F.transform("others", lambda x: x["id"]), lambda x: x.isNotNull()), F.lit(1)),
    }).where((F.size("dates") > 0) & F.col("number").isNotNull())
    rows = first_per_key(rows, ["number"], "page_no", "pos")
    return notices(rows, portal=F.lit(portal), notice_id=F.col("number"), title=F.col("link.text"), closing=F.get("dates", F.lit(0)), opening=F.get("dates", F.lit(1)), url=absolute_url(F.concat("base_url", F.lit("/")), F.col("link.href")), status=F.lit("active"))


def organisation_index(pages: DataFrame) -> DataFrame:
    """(name, n, url) of the entries of an organisation index, the table with its two headers; entries without a positive count go."""
    tables = _pages(pages).select("base_url", F.explode(html.tables(F.col("html"))).alias("table"))
    tables = tables.where(F.col("table").contains("Organisation Name") & F.col("table").contains("Tender Count"))
    rows = tables.select("base_url", F.explode(html.leaf_rows(F.col("table"))).alias("row")).withColumn("cells", html.cells(F.col("row"))).where(F.size("cells") >= 3)
    link = F.try_element_at(F.filter(html.links(F.get("cells", F.lit(2))), lambda x: x["href"].contains("DirectLink")), F.lit(1))
    out = rows.withColumn("link", link).select(
        html.text_of(F.get("cells", F.lit(1))).alias("name"), F.regexp_replace("link.text", "[^0-9]", "").try_cast("long").alias("n"), absolute_url(F.col("base_url"), F.col("link.href")).alias("url")
    )
    return out.where((F.col("name") != "") & (F.col("n") > 0) & F.col("url").isNotNull())


def organisation_notices(pages: DataFrame, portal: str) -> DataFrame:
    """Rows of class even or odd with published, closing and opening dates, a bracketed title cell and a chain cell."""
    page = _pages(pages).where(F.col("html").contains("e-Published Date") & F.col("html").contains("Title and Ref.No./Tender ID"))
    rows = page.select("base_url", F.explode(html.leaf_rows(F.col("html"))).alias("row"))
    rows = rows.where(F.col("row").rlike(r"""(?is)^<tr\b[^>]*class\s*=\s*["'][^"']*\b(even|odd)\b"""))
    rows = once(rows, F.struct(html.cells(F.col("row")).alias("c")), "base_url").where(F.size("c") >= 6)
    cell = lambda i: html.text_of(F.get("c", F.lit(i)))
    link = F.try_element_at(F.filter(html.links(F.get("c", F.lit(4))), lambda x: x["href"].isNotNull()), F.lit(1))
    title = let(link, lambda x: F.struct(x["href"].alias("href"), F.regexp_replace(clean(x["text"]), r"^\[|\]$", "").alias("title")))
    rows = once(rows, F.struct("c", title.alias("link"), bracket_values(cell(4)).alias("marks"), chain_parts(cell(5), "||").alias("chain")), "base_url")
    title = F.col("link.title")
    org = organisation_of(F.col("chain"))
    return notices(
        rows, portal=F.lit(portal), notice_id=F.try_element_at("marks", F.lit(-1)), title=title, organisation=org["organisation"], department=org["department"], category=F.lit(GENERAL),
        description=F.concat_ws(" | ", title, F.try_element_at("marks", F.lit(-2)), F.array_join("chain", " | ")), published=dates.month_name(cell(1), True), closing=dates.month_name(cell(2), True),
        opening=dates.month_name(cell(3), True), url=F.coalesce(absolute_url(F.col("base_url"), F.col("link.href")), F.col("base_url")), status=F.lit("active"),
    )


def block_listing(pages: DataFrame, portal: str, as_of) -> DataFrame:
    """Two block layouts: classed links with a full date, and three paragraphs with a date split over three headings."""
    blocks = _pages(pages).select("page_no", "base_url", F.posexplode(F.split("html", r"""(?i)(?=<[a-z]+\b[^>]*class\s*=\s*["'][^"']*(?:\bsamer\b|\bupdate-nag\b|\bupdateNag\b))""")).alias("pos", "block"))
    classed = lambda name: html.text_of(F.regexp_extract("block", rf"""(?is)<(\w+)\b[^>]*class\s*=\s*["'][^"']*{name}[^"']*["'][^>]*>(.*?)</\1>""", 2))
    shape = lambda number, work, closing: F.struct(number.alias("number"), division_split(work).alias("work"), closing.alias("closing"))
    one = shape(F.coalesce(let(classed("coli-tno"), filled), let(classed("coli-id"), filled)), classed("tDesc"), dates.slash_half_day(classed("coli-date")))
    texts = lambda tag: F.transform(F.regexp_extract_all("block", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), html.text_of)
    at = lambda c, i: F.get(c, F.lit(i))
    date = lambda h: F.when(F.size(h) >= 3, dates.split_without_year(at(h, 0), at(h, 1), at(h, 2), as_of))
    two = let(texts("p"), lambda p: F.when(F.size(p) >= 3, shape(F.coalesce(filled(at(p, 1)), filled(at(p, 0))), at(p, 2), let(texts("h4"), date))))
    # A block may have both layouts' classes.
    is_one = F.col("block").rlike(r"""(?i)^<[a-z]+\b[^>]*class\s*=\s*["'][^"']*\bsamer\b""")
    is_two = F.col("block").rlike(r"""(?i)^<[a-z]+\b[^>]*class\s*=\s*["'][^"']*(update-nag\b|updateNag\b)""")
    rows = blocks.select("page_no", "base_url", "pos", F.inline(F.array(F.when(is_one, one), F.when(is_two, two))))
    rows = rows.where(F.col("number").isNotNull() & (F.col("work.title") != ""))
    rows = first_per_key(rows, ["number"], "page_no", "pos")
    return notices(rows, portal=F.lit(portal), notice_id=F.col("number"), title=F.col("work.title"), department=F.col("work.department"), category=F.lit(GENERAL), closing=F.col("closing"), url=F.col("base_url"), status=F.lit("active"))


def forward_fill(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last non-null ``value`` at or before each row of its group."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(window))


def closing_report(pages: DataFrame, portal: str) -> DataFrame:
    """The report table of a page, whose heading rows set organisation and department of the rows below them."""
    table = F.try_element_at(F.filter(html.tables(F.col("html")), lambda t: t.rlike(r"""(?i)^<table\b[^>]*\bid\s*=\s*["']?mytable\b""")), F.lit(1))
    rows = _pages(pages).select("page_no", "base_url", F.posexplode(html.leaf_rows(table)).alias("pos", "row"))
    rows = rows.withColumn("texts", F.transform(html.cells(F.col("row")), html.text_of))
    heading = F.when((F.size("texts") == 1) & F.col("row").contains("table_heading_row"), organisation_of(chain_parts(F.get("texts", F.lit(0)), "-"), True))
    rows = forward_fill(rows.withColumn("heading", heading), ["page_no"], "pos", "heading", "org").where(F.size("texts") >= 4)
    cell = lambda i: F.get("texts", F.lit(i))
    rows = rows.withColumn("number", F.coalesce(filled(cell(2)), filled(cell(1)))).where(F.col("number").isNotNull())
    rows = first_per_key(rows, ["number"], "page_no", "pos")
    title = F.coalesce(filled(cell(2)), F.concat(F.lit("Tender "), cell(1)))
    return notices(rows, portal=F.lit(portal), notice_id=F.col("number"), title=title, organisation=F.col("org.organisation"), department=F.col("org.department"), category=F.lit(GENERAL), closing=dates.dash_minutes(cell(3)), url=F.col("base_url"), status=F.lit("active"))


def calendar_counts(pages: DataFrame) -> DataFrame:
    """(day, n) of the counts that a script hands to JSON.parse; bad input gives no rows."""
    raw = F.regexp_extract("html", r"(?s)JSON\.parse\('(\{.*?\})'\)", 1)
    parsed = F.from_json(F.replace(F.replace(raw, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), "map<string,int>")
    return pages.select(F.explode(parsed).alias("day", "n")).where("n > 0")


def visible_rows(rows: DataFrame, portal: str, base_url: str, strict: bool = False) -> DataFrame:
    """Free-form rows (cells array, links array) by heuristics; ``strict`` portals need four cells and a digit in the id."""
    # The words of other rows, the shapes of ids and dates, and the words of bodies.
    found = rows.withColumn("cells", F.filter(F.transform("cells", clean), lambda x: x != "")).withColumn("text", F.array_join("cells", " | "))
    n = F.size("cells")
    found = found.where((n >= (4 if strict else 2)) & ~(F.col("text").rlike("(?i)tender id|tender no|closing date|published date") & (n < 4)) & ~F.col("text").rlike("(?i)no results found"))
    number = F.coalesce(filled(F.regexp_extract("text", r"(?i)(?<![A-Za-z0-9_])(?:GEM/\d{4}/[A-Z]/\d+|[A-Z0-9][A-Z0-9_./-]{4,}\d)(?![A-Za-z0-9_])", 0)), filled(F.regexp_extract("text", r"(?<![A-Za-z0-9_])\d{5,}(?![A-Za-z0-9_])", 0)))
    found = found.withColumn("number", number).where(F.col("number").isNotNull() & (F.col("number").rlike("[0-9]") if strict else F.lit(True)))
    times = F.regexp_extract_all("text", F.lit(r"(?i)(?<![A-Za-z0-9_])\d{1,2}[/-]\d{1,2}[/-]\d{2,4}(?:\s+\d{1,2}:\d{2}\s*(?:AM|PM)?)?"), F.lit(0))
    found = found.withColumn("times", F.filter(F.transform(times, dates.any_format), lambda x: x.isNotNull()))
    longest = F.array_sort(F.transform(F.filter("cells", lambda x: (x != F.col("number")) & (F.length(x) > 8) & ~x.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    body = F.try_element_at(F.filter("cells", lambda x: x.rlike("(?i)department|ministry|division|corporation|railway|board")), F.lit(1))
    link = F.coalesce(F.try_element_at(F.filter("links", lambda x: x.rlike("(?i)^https?://")), F.lit(1)), F.lit(base_url))
    return notices(
        found, portal=F.lit(portal), notice_id=F.col("number"), title=F.coalesce(F.try_element_at(longest, F.lit(1))["x"], F.col("text")), organisation=body, description=F.col("text"),
        published=F.try_element_at("times", F.lit(1)), closing=F.try_element_at("times", F.lit(-1)), url=link, status=F.lit("active"),
    )
