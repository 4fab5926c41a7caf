"""Main text of web pages: site templates removed by counting element subtrees per host.

Every block element's subtree gets a hash of its tag, class and content. Spark counts, for
each host, on how many different pages a subtree occurs (pages with the same content count
once, so a page that was fetched a thousand times is not a template). Subtrees that recur across many
of a host's pages are deleted from them, and so are elements whose kind says that they are not
article text: menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments. A class or an id
says so only if all its words do (``related-posts``, not ``share-price``) or if most of the element's text
is links, and never for an element that holds the page's article or, without one, most of its paragraphs; nor is a
form or a dialog dropped that does, as whole sites stand in one. Reader comments without such a name are known by their structure:
similar children, each with a date and something said, after the article's text.

Paragraphs, headings, lists and tables inside a page's article are kept even when they recur:
passages that articles quote from each other are text, not template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, stored, utf8

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+'|["'])*+)>|</?[a-zA-Z][^>]*+\Z|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that never hold an article.
DROPPED = set("head script style title textarea xmp iframe noembed noframes noscript template svg math canvas audio video object button select datalist".split())
#: Elements and roles beside an article, and such that may hold it.
BESIDE = set("nav footer aside menu navigation banner contentinfo complementary alert menubar toolbar tablist".split())
HOLDERS = set("form dialog search alertdialog".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comments comment disqus replies reply respond "
    "pagination pager toolbar widget widgets skip copyright".split()
)
#: Words that say nothing beside those.
FILLERS = set(
    "list box block container wrapper wrap section area top bottom left right primary secondary main page site global inner outer content bar "
    "link links button buttons icon icons item items post posts article articles form panel js user users reader readers slot slots unit thread tree "
    "body entry count meta holder row col div".split()
)
#: Whole names that say so though none of their words does.
NAMES = set("topbar top-bar pagenumbers page-numbers back-to-top".split())
#: Share of links in an element's text that makes it a menu.
LINKED = 0.5
#: Inside an article these hold its text.
PROSE = set("article main p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption body html".split())
#: A new element of the key ends an open one of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: ... but not across these.
SCOPES = set("ul ol dl table tbody thead tfoot select article section div body html main".split())
#: Rows of a host or of a menu that one task takes.
SALT_ROWS = 50_000
#: A date or the age of an entry, in an element of at most so many characters.
DATED = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}|\b(?:19|20)\d{2}\b|\b\d+\s*(?:s|m|min|h|d|sec|minute|hour|day|week|month|year)s?\s+ago\b|\b(?:yesterday|today)\b", re.I)
SHORT = 60
#: Characters without which a form is no page's text, if the page has no paragraphs.
LEAST_HELD = 400
PARAGRAPH_ENDS = BLOCKS - {"option", "optgroup"}


@dataclass
class Page:
    """Elements in page order, each after its parent, and the pieces of text between them."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    dropped: list[bool] = field(default_factory=lambda: [False])
    beside: list[bool] = field(default_factory=lambda: [False])  # in an element of ``BESIDE``
    inside: list[bool] = field(default_factory=lambda: [False])  # in an article or main element
    parts: list[list] = field(default_factory=lambda: [[]])
    text: list[tuple[int, str | None]] = field(default_factory=list)  # (element, text); None ends a block
    holders: list[int] = field(default_factory=list)  # elements of ``HOLDERS``
    named: list[tuple[int, bool]] = field(default_factory=list)  # elements with a word of ``WORDS``, and whether whole names say so


@lru_cache(100_000)
def split_name(word: str) -> tuple[str, ...]:
    """The known words that a joined name consists of, as few as it can; the name itself if there are none such."""
    best: list[tuple[str, ...] | None] = [()] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 16), end - 1):
            piece, before = word[start:end], best[start]
            if before is not None and (piece in WORDS or piece in FILLERS or piece == "header") and (best[end] is None or len(before) + 1 < len(best[end])):
                best[end] = (*before, piece)
    return best[-1] if best[-1] and len(word) <= 40 else (word,)


def _kind(tag: str, attributes: str, inside: bool) -> tuple[str, bool | None, str]:
    """What its kind makes of an element (dropped, beside, holder or nothing), what its names say (None, or whether a whole name says so), and the attributes that count for its hash."""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    name = f"{found.get('class', '')}#{found.get('id', '')}"
    if tag in DROPPED or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "dropped", None, name
    role = found.get("role", "").lower()
    if tag in BESIDE or role in BESIDE or (tag == "header" and not inside):
        return "beside", None, name
    if tag in HOLDERS or role in HOLDERS:
        return "holder", None, name
    said = None
    if len(name) > 1:
        for own in f"{found.get('class', '')} {found.get('id', '')}".split():
            plain = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", own).lower()
            words = [x for w in re.split(r"[^a-z]+", plain) if w for x in split_name(w)]
            if plain in NAMES or any(w in WORDS or (w == "header" and not inside) for w in words):
                said = bool(said) or plain in NAMES or all(w in WORDS or w in FILLERS or w == "header" for w in words)
    return "", said, name


def parse(html: str) -> Page:
    """Lenient parse in one pass; unclosed and crossed elements end where browsers end them, roughly.

    Each open element's place on the stack is known by its tag, so an end that matches nothing costs nothing, however deep the page is.
    """
    page = Page()
    stack = [0]
    places: dict[str, list[int]] = {}  # tag: where it is open on the stack
    scopes: list[int] = []
    at, size = 0, len(html)

    def close(to: int) -> None:
        while len(stack) > to:
            tag = page.tags[stack.pop()]
            places[tag].pop()
            if tag in SCOPES:
                scopes.pop()
            if tag in BLOCKS:
                page.text.append((stack[-1], None))

    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:  # not a comment, a declaration or a tag that the page breaks off in
                page.text.append((stack[-1], unescape(piece)))
                page.parts[stack[-1]].append(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            elif tag == "p":  # an empty paragraph
                page.text.append((stack[-1], None))
            continue
        if tag in PARAGRAPH_ENDS or tag in ENDS:
            ends = ENDS.get(tag, set()) | ({"p"} if tag in PARAGRAPH_ENDS else set())
            last = max((places[t][-1] for t in ends if places.get(t)), default=0)
            if last > (scopes[-1] if scopes else 0):
                close(last)
        parent = stack[-1]
        kind, said, name = _kind(tag, m[3], page.inside[parent])
        new = len(page.tags)
        page.tags.append(tag)
        page.names.append(name)
        page.parents.append(parent)
        page.dropped.append(kind == "dropped" or page.dropped[parent])
        page.beside.append(kind == "beside" or page.beside[parent])
        page.inside.append(not page.dropped[new] and not page.beside[new] and (page.inside[parent] or tag in ("article", "main")))
        page.parts.append([])
        page.parts[parent].append(new)
        if kind == "holder":
            page.holders.append(new)
        if said is not None:
            page.named.append((new, said))
        if tag in BLOCKS:
            page.text.append((parent, None))
        elif tag == "br":
            page.text.append((parent, " "))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            content = html[at : end.start() if end else size]
            at = end.end() if end else size
            page.parts[new].append(content)
        elif tag not in VOID and not m[3].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(new)
    close(1)
    _decide(page)
    return page


def _decide(page: Page) -> None:
    """Drops what is not the article, in a fixed number of passes over the elements: by kind, by name, menus beside an article, reader comments."""
    count = len(page.tags)
    article = next((k for k in range(count) if page.inside[k] and page.tags[k] in ("article", "main")), 0)
    last, text, linked, prose, aside = list(range(count)), [0] * count, [0] * count, [0] * count, [False] * count
    for k, piece in page.text:
        if piece and not page.dropped[k] and not page.beside[k]:
            n = len(piece.strip())
            text[k] += n
            aside[k] = aside[k] or bool(n and not page.inside[k])
    for k in range(count - 1, 0, -1):  # children come after their parents
        linked[k] = text[k] if page.tags[k] == "a" else linked[k]
        prose[k] = text[k] if page.tags[k] == "p" else prose[k]
        up = page.parents[k]
        last[up] = max(last[up], last[k])
        text[up], linked[up], prose[up], aside[up] = text[up] + text[k], linked[up] + linked[k], prose[up] + prose[k], aside[up] or aside[k]
    dropped = page.dropped
    holds = lambda k: k <= article <= last[k] if article else 2 * prose[k] > prose[0]
    for k in range(1, count):
        dropped[k] = dropped[k] or page.beside[k]
    for k in page.holders:
        most = not article and not prose[0] and 2 * text[k] > text[0] and text[k] - linked[k] >= LEAST_HELD
        dropped[k] = dropped[k] or not (holds(k) or most)
    for k, whole in page.named:
        own = page.tags[k] in ("html", "body") or (page.tags[k] in ("article", "main") and not page.inside[page.parents[k]])
        if not own and not holds(k) and (whole or linked[k] > LINKED * text[k]):
            dropped[k] = True
    if article:
        for k in range(1, count):
            # A menu beside the article; a link alone is none.
            if aside[k] and page.tags[k] not in ("html", "body", "a") and not k <= article <= last[k] and linked[k] > LINKED * text[k]:
                dropped[k] = True
    for k in range(1, count):
        dropped[k] = dropped[k] or dropped[page.parents[k]]
    for k in reader_comments(page, article, last, text):
        dropped[k] = True
    for k in range(1, count):
        dropped[k] = dropped[k] or dropped[page.parents[k]]


def reader_comments(page: Page, article: int, last: list[int], text: list[int]) -> list[int]:
    """Elements that hold reader comments: two children or more, most of one tag and name, each with a short dated element and more text beside it.

    They stand after most of the page's other text; a list that nothing stands before is an index of articles.
    """
    count = len(page.tags)
    own, before, total = [""] * count, [0] * count, 0
    for k, piece in page.text:
        if piece and not page.dropped[k]:
            total += len(piece.strip())
            if len(own[k]) <= SHORT:
                own[k] += piece
    dated = [False] * count
    for k in range(count - 1, 0, -1):
        if not page.dropped[k] and (page.tags[k] == "time" or (text[k] <= SHORT and DATED.search(own[k]))):
            dated[k] = True
    if sum(dated) < 2:
        return []
    # Whether an element holds a dated one and has text beside it.
    inner = [0] * count
    for k in range(count - 1, 0, -1):
        up = page.parents[k]
        inner[up] += text[k] if dated[k] else inner[k]
    bylined = [not dated[k] and 0 < inner[k] < text[k] for k in range(count)]
    seen, at = 0, 0
    for k, piece in page.text:  # the text before each element
        while at <= k:
            before[at] = seen
            at += 1
        if piece and not page.dropped[k]:
            seen += len(piece.strip())
    found = []
    for k in range(1, count):
        if page.dropped[k] or page.tags[k] in ("html", "body", "table", "tbody", "tr", "dl") or k <= article <= last[k]:
            continue
        kids = [x for x in page.parts[k] if isinstance(x, int) and page.tags[x] in BLOCKS and not page.dropped[x]]
        alike = Counter((page.tags[x], page.names[x]) for x in kids if bylined[x])
        if alike and alike.most_common(1)[0][1] >= max(2, 0.8 * len(kids)) and 2 * before[k] > total - text[k]:
            found.append(k)
    return found


def subtree_hashes(page: Page) -> list[int]:
    """64-bit hash of each element's tag, class, id and content, white space aside; children before parents."""
    out = [0] * len(page.tags)
    for k in range(len(page.tags) - 1, -1, -1):
        content = "\1".join(f"\2{out[x]}" if isinstance(x, int) else " ".join(x.split()) for x in page.parts[k])
        h = xxhash.xxh64_intdigest(f"{page.tags[k]}\1{page.names[k]}\1{content}".encode("utf-8", "surrogatepass"))
        out[k] = h - (1 << 64) if h >> 63 else h
    return out


def countable(page: Page) -> list[int]:
    """Elements that may be templates: blocks below the body, except prose inside an article."""
    return [k for k in range(1, len(page.tags)) if page.tags[k] in BLOCKS and page.tags[k] not in ("html", "body") and not (page.inside[k] and page.tags[k] in PROSE)]


def main_text(page: Page, deleted: set[int]) -> str:
    """Blocks joined by line breaks, without dropped elements and subtrees whose hash is in ``deleted``."""
    gone = page.dropped
    if deleted:
        hashes = subtree_hashes(page)
        gone = list(gone)
        doomed = {k for k in countable(page) if hashes[k] in deleted}
        for k in range(1, len(gone)):
            gone[k] = gone[k] or k in doomed or gone[page.parents[k]]
    blocks, own = [], []
    for k, piece in page.text:
        if piece is None:
            blocks.append("".join(own))
            own = []
        elif not gone[k]:
            own.append(piece)
    blocks.append("".join(own))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def needed_pages(pages: Column, least_pages: int, share: float, most_pages: int) -> Column:
    """On how many different pages of a host a template stands: a share, but at least and at most so many; on half of a small host's, but three."""
    half = F.greatest(F.lit(3), F.ceil(pages / 2))
    return F.when(pages < 2 * least_pages, half).otherwise(F.least(F.greatest(F.ceil(pages * share), F.lit(least_pages)), F.lit(most_pages)))


def templates(pages: DataFrame, html_col: str, url_col: str, least_pages: int, share: float, most_pages: int) -> tuple[DataFrame, DataFrame]:
    """(key, hash) of the unruled subtrees of each page, and (host, hash) of the recurring ones."""
    source = pages.select(F.xxhash64(F.col(url_col), F.col(html_col)).alias("key"), host_of(F.col(url_col)).alias("host"), utf8(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[tuple] = []
            for key, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = parse(html.decode("utf-8", "replace"))
                hashes = subtree_hashes(page)
                seen: dict[int, bool] = {}
                for k in countable(page):
                    seen[hashes[k]] = seen.get(hashes[k], True) and page.dropped[k]
                out += [(key, host, hashes[0], h, ruled) for h, ruled in seen.items()]
                out.append((key, host, hashes[0], None, True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "host", "page", "hash", "ruled"])

    parts = stored(source.mapInArrow(run, "key long, host string, page long, hash long, ruled boolean"), "html-subtrees")
    # Distinct pages first: partial sums shrink a host's rows before they meet.
    counts = parts.groupBy("host", "hash", "page").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = stored(counts.where("hash is null or n >= 3"), "html-counts")  # what recurs, and one row for each host
    most = counts.groupBy("host").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0]
    salts = salts_of(most)
    sizes = _over_salts(counts.where("hash is null").select("host", F.col("n").alias("pages")), salts)
    recurring = counts.where("hash is not null").withColumn("salt", F.pmod("hash", F.lit(salts)).cast("int"))
    common = recurring.join(sizes, ["host", "salt"]).where(F.col("n") >= needed_pages(F.col("pages"), least_pages, share, most_pages))
    return parts.where("hash is not null and not ruled").select("key", "host", "hash").distinct(), common.select("host", "hash", "n")


def salts_of(rows: int | None) -> int:
    """Parts that so many rows of one key are dealt into."""
    return 1 + (rows or 0) // SALT_ROWS


def _over_salts(rows: DataFrame, salts: int) -> DataFrame:
    """Each row once for every salt, to meet a hot key's rows that are dealt over them."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", least_pages: int = 8, share: float = 0.05, most_pages: int = 200) -> DataFrame:
    """``pages`` with a column ``text``, the main text, in place of any that it had.

    A subtree is a template of a host if it recurs on ``share`` of the host's different pages, but no fewer than ``least_pages`` and no more
    than ``most_pages``; on hosts of less than twice ``least_pages``, on half of them, and three at least.
    Null html gives an empty text, a null url the empty host. Equal rows get equal texts; other columns are kept.
    """
    parts, common = templates(pages, html_col, url_col, least_pages, share, most_pages)
    # A menu stands on all pages of a host: its rows are dealt over salts, as many as the most frequent one asks for.
    common = stored(common, "html-templates")
    salts = salts_of(common.agg(F.max("n")).first()[0])
    found = parts.withColumn("salt", F.pmod("key", F.lit(salts)).cast("int")).join(_over_salts(common.drop("n"), salts), ["host", "hash", "salt"])
    kept = [c for c in pages.columns if c.lower() != "text"]
    key, gone, source = (free_name(n, pages.columns) for n in ("key", "gone", "source"))
    # Only pages with something to delete; where that is small Spark itself broadcasts it and html is not shuffled.
    hits = stored(found.groupBy(F.col("key").alias(key)).agg(F.collect_set("hash").alias(gone)), "html-deletions")
    keyed = pages.withColumn(key, F.xxhash64(F.col(url_col), F.col(html_col)))
    own = [F.col(f"`{c}`") for c in kept]
    joined = keyed.join(hits, key, "left").select(*own, utf8(html_col).alias(source), F.coalesce(gone, F.expr("cast(array() as array<bigint>)")).alias(gone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n = batch.num_columns
            texts = [main_text(parse(h.decode("utf-8", "replace")), set(gone)) for h, gone in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(texts, pa.string())], [*kept, "text"])

    given = "".join(f"`{n}` {t}, " for n, t in joined.dtypes[: len(kept)])
    return joined.mapInArrow(run, f"{given}text string")
