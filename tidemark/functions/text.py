"""Column functions on texts: cleaning, identifiers, labels, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The rule patterns that give a notice its relevance label, as in the data's definition.
COMPONENT_WORDS = r"spares?|spare\s*parts?|components?|accessor(?:y|ies)|repair(?:ing)?\s*of|amc|annual\s+maintenance|refurbish(?:ment)?|overhaul|calibration|replacement\s+of|maintenance\s+of|servicing\s+of"
DEFENCE_WORDS = r"army|navy|naval|air\s*force|defence|defense|drdo|ordnance|military|para\s*military|border\s*security|bsf|crpf|itbp|ssb|cisf|nsg|coast\s*guard|railway\s*protection|surveillance|intelligence\s+bureau|home\s+affairs"
CIVIL_WORDS = r"college|university|school|polytechnic|panchayat|municipal|municipality|hospital|medical\s+college|agricultur|horticultur"
# Acronyms that a search also tries in their long form.
ALIASES = {
    "nvg": ["night vision goggles"],
    "nvd": ["night vision device"],
    "eoss": ["electro optical surveillance system"],
    "loros": ["long range observation system"],
    "ptz": ["pan tilt zoom camera"],
    "lrf": ["laser range finder"],
    "lwir": ["long wave infrared"],
    "mwir": ["mid wave infrared"],
}
# English words that a text search ignores.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# A second set of label patterns, for rows of before the first; these need no word boundaries.
LEGACY_COMPONENTS = r"spares?|spare\s*parts?|components?|accessor(y|ies)|repair(ing)?\s+of|amc|annual\s+maintenance|refurbishment?|overhaul|calibration|replacement\s+of|maintenance\s+of|servicing\s+of"
LEGACY_DEFENCE = r"army|navy|naval|air\s*force|defence|defense|drdo|ordnance|military|para\s*military|border\s*security|bsf|crpf|itbp|ssb|cisf|nsg|coast\s*guard|railway\s*protection|surveillance|intelligence\s*bureau|home\s*affairs"
# Keys of portals whose legacy names are known.
KNOWN_PORTALS = {
    "GeM": "gem", "CPPP": "cppp", "Defence": "defproc", "Maharashtra": "maharashtra", "Karnataka": "karnataka", "Tamil Nadu": "tamilnadu", "Telangana": "telangana",
    "Andhra Pradesh": "andhrapradesh", "Uttar Pradesh": "uttarpradesh", "Rajasthan": "rajasthan", "Madhya Pradesh": "madhyapradesh", "Haryana": "haryana", "Punjab": "punjab",
    "Kerala": "kerala", "West Bengal": "westbengal", "Odisha": "odisha", "Bihar": "bihar", "Jharkhand": "jharkhand", "Assam": "assam", "IREPS": "ireps",
    "Coal India": "coalindia", "Gujarat": "gujarat_nprocure",
}
# Phrases that the dashboard counts.
WATCH_PHRASES = ["Reflex Sight", "Thermal Weapon Sight", "Night Vision Goggles", "Image Intensifier", "Electro Optical Surveillance System", "PTZ Camera", "Border Surveillance System"]
# Wordings of a stated total, tried in this order.
TOTAL_PATTERNS = [
    r"showing\s+[0-9,]+\s+to\s+[0-9,]+\s+of\s+([0-9,]+)\s+entries",
    r"of\s+([0-9,]+)\s+entries",
    r"total\s+(?:no\.?\s*of\s+)?(?:records?|results?|tenders?)\s*:?\s*([0-9,]+)",
    r"([0-9,]+)\s+records?\s+found",
    r"([0-9,]+)\s+results?\s+found",
    r"([0-9,]+)\s+tenders?\s+found",
]
# Names with an established short form.
SHORT_NAMES = {"gem": "GeM", "cppp": "CPPP", "ireps": "IREPS"}
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
SPACE = r"[\s ]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(c: Column) -> Column:
    """White space runs (no-break spaces included) become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def filled(c: Column) -> Column:
    """Empty text as null."""
    return F.nullif(c, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, the one text function that Spark lacks."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_query(c: Column, compatibility: bool = True) -> Column:
    """Lower case; letters, digits, blanks and / _ - . stay, all else becomes a blank; runs collapse.

    ``compatibility`` applies NFKC first, in the only Python step; leave it out for plain ASCII tables.
    """
    text = F.lower(nfkc(c) if compatibility else c)
    return clean(F.regexp_replace(text, r"[^\p{L}\p{N}\s/_\-.]", " "))


# The shapes that make a query a reference.
def is_structured_reference(c: Column) -> Column:
    return (F.length(c) >= 6) & c.rlike("[a-zA-Z]") & c.rlike("[0-9]") & c.rlike("[/_.-]") & c.rlike(r"^[\p{L}\p{N}/_.\-\s]+$")


def is_raw_reference(c: Column) -> Column:
    return (F.length(F.trim(c)) >= 3) & (F.trim(c).rlike("^[0-9]+$") | F.trim(c).rlike("[/_.:&,-]"))


def division_split(c: Column) -> Column:
    """struct(title, department) of "title in Division No: department."; the whole text is the title otherwise."""
    # Fixed value: the wording that the listings use.
    pattern = r"(?i)^(.*?)\s+in\s+Division\s*No\s*:\s*(.+?)\.?\s*$"
    part = lambda x, i: F.trim(F.regexp_extract(x, pattern, i))
    return let(clean(c), lambda x: F.when(x.rlike(pattern), F.struct(part(x, 1).alias("title"), part(x, 2).alias("department"))).otherwise(F.struct(x.alias("title"), F.lit(None).cast("string").alias("department"))))


def chain_parts(c: Column, separator: str = "||") -> Column:
    """Cleaned, non-empty parts of an organisation chain."""
    pattern = "".join(f"[{x}]" for x in separator)
    return F.filter(F.transform(F.split(c, pattern), clean), lambda x: x != "")


def organisation_of(parts: Column, join_rest: bool = False) -> Column:
    """struct(organisation, department): the first part, and the second one or all the rest joined."""
    rest = filled(F.array_join(F.slice(parts, 2, 1_000_000), " - ")) if join_rest else F.try_element_at(parts, F.lit(2))
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("organisation"), rest.alias("department"))


def bracket_values(c: Column) -> Column:
    """Cleaned, non-empty texts in square brackets."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\[([^\]]*)\]"), F.lit(1)), clean), lambda x: x != "")


def reference_id(c: Column) -> Column:
    """The id after a label such as "Reference No:", else the trimmed text, null if that is empty."""
    # Fixed value: the labels that the listings use.
    return F.coalesce(filled(F.regexp_extract(F.trim(c), r"(?i)(?:reference|tender)\s*(?:no\.?|number|id)\s*[:-]?\s*([A-Za-z0-9/_.-]+)", 1)), filled(F.trim(c)))


def absolute_url(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, protocol-, root-, query-relative and relative to the base's folder."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(origin, folder, href))
    )


def document_link(origin: str, number: Column, bid_type: Column, evaluation: Column) -> Column:
    """Link whose page follows from the type codes of a bid."""
    # The pages of the type codes.
    page = F.when(bid_type == 5, "showdirectradocumentPdf").when(bid_type == 2, F.when(evaluation > 0, "list-ra-schedules").otherwise("showradocumentPdf")).otherwise("showbidDocument")
    return F.when(number.isNull() | (number.cast("string") == ""), F.lit(f"{origin}/all-bids")).otherwise(F.concat(F.lit(f"{origin}/"), page, F.lit("/"), number.cast("string")))


def short_name(key: Column, name: Column) -> Column:
    """An established short form, else the name without parentheses and a generic suffix, else the name."""
    fixed = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    # Fixed value: the generic suffix of portal names.
    stripped = F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "), r"(?i)\s*e-?Procurement(\s+(System|Portal))?\s*", " ")
    return F.coalesce(F.try_element_at(fixed, key), filled(clean(stripped)), name)


def content_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of name=value pairs in the order of their names, joined by |; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit(""))) for n, c in sorted(columns.items())]), 256)


def _words(pattern: str) -> str:
    return rf"(?i)(^|[^A-Za-z0-9_])({pattern})($|[^A-Za-z0-9_])"


def relevance(title: Column, category: Column, organisation: Column, department: Column) -> Column:
    """irrelevant for parts and repairs, then relevant for defence clients, irrelevant for civil ones, else unclassified.

    Words are bounded by ASCII letters, digits and _; order matters.
    """
    both = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(b, F.lit("")))
    item, client = both(title, category), both(organisation, department)
    return F.when(item.rlike(_words(COMPONENT_WORDS)), "irrelevant").when(client.rlike(_words(DEFENCE_WORDS)), "relevant").when(client.rlike(_words(CIVIL_WORDS)), "irrelevant").otherwise("unclassified")


def legacy_relevance(title: Column, category: Column, organisation: Column, department: Column) -> Column:
    """The label by the second rule set: the same order, patterns anywhere in the text."""
    item, client = F.concat_ws(" ", title, category), F.concat_ws(" ", organisation, department)
    return F.when(item.rlike(f"(?i)({LEGACY_COMPONENTS})"), "irrelevant").when(client.rlike(f"(?i)({LEGACY_DEFENCE})"), "relevant").when(client.rlike(f"(?i)({CIVIL_WORDS})"), "irrelevant").otherwise("unclassified")


def slug(name: Column, known: dict[str, str] | None = None) -> Column:
    """Key of a legacy name: the known one, else its lower-cased letters and digits."""
    plain = F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]+", ""))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), name), plain) if known else plain


def recipients(c: Column, most: int = 10) -> Column:
    """Distinct lower-cased addresses of a list split at ; , and line breaks; null unless 1 to ``most`` valid ones."""
    found = F.array_distinct(F.filter(F.transform(F.split(c, "[;,\n]"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return F.when(F.size(found).between(1, most) & F.forall(found, lambda x: x.rlike(EMAIL)), found)


def keyword_list(c: Column, most: int = 50) -> Column:
    """Trimmed keywords; null if one is empty or there are more than ``most``."""
    found = F.transform(c, lambda x: F.trim(x))
    return F.when((F.size(found) <= most) & F.forall(found, lambda x: x != ""), found)


def stated_total(c: Column) -> Column:
    """The first positive number that one of the wordings gives, thousands separators removed."""
    found = [F.regexp_replace(F.regexp_extract(c, "(?i)" + p, 1), ",", "").try_cast("bigint") for p in TOTAL_PATTERNS]
    return reduce(lambda a, b: F.coalesce(a, b), [F.when(x > 0, x) for x in found])


def page_gate(c: Column) -> Column:
    """captcha, login-required or ok; captcha first."""
    low = F.lower(c)
    return F.when(low.contains("captcha"), "captcha").when(low.contains("please login") | low.contains("session expired"), "login-required").otherwise("ok")


def is_script_shell(c: Column, least: int = 200) -> Column:
    """Whether a page has less text than ``least`` characters without its tags."""
    return F.length(F.trim(F.regexp_replace(c, "<[^>]+>", ""))) < least
