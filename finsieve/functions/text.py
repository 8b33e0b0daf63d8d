"""String, date and display helpers, all as built-in column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form words dropped from company names.
LEGAL_WORDS = (
    "inc", "corp", "llc", "ltd", "co", "corporation", "company", "holdings", "group",
    "international", "enterprises", "partners",
)
# Release number, date and respondent patterns, tried in this order.
RELEASE_NO = r"(?i)AAER.?(?:No\.?)?\s*(\d{3,4})"
DATES = (r"(\w+ \d{1,2},?\s*\d{4})", r"(\d{1,2}/\d{1,2}/\d{2,4})", r"(\d{4}-\d{2}-\d{2})")
RESPONDENTS = (
    r"(?i)In the Matter of\s+(.+?)(?:,|\.|;|\n)",
    r"(?i)Respondent[s]?[:\s]+(.+?)(?:,|\.|;|\n)",
    r"(?i)against\s+(.+?)(?:,|\.|;|\n)",
)
SITE = "https://www.sec.gov"


def normalise_name(name: Column) -> Column:
    """Lower case, punctuation to spaces, legal-form words removed, single spaces."""
    plain = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    bare = F.regexp_replace(plain, rf"(?U)\b(?:{'|'.join(LEGAL_WORDS)})\b", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def strip_registry_noise(name: Column) -> Column:
    """Removes an industry-code suffix and slash-enclosed status tags."""
    no_code = F.regexp_replace(name, r"(?i)\s*SIC:\d+.*$", "")
    return F.trim(F.regexp_replace(no_code, r"\s*/[^/]+/", " "))


def token_sorted(name: Column) -> Column:
    """Tokens in ascending order, joined by one space."""
    return F.array_join(F.array_sort(F.split(name, " ")), " ")


def pad_cik(c: Column) -> Column:
    """Ten digits with leading zeros; longer keys stay whole."""
    text = F.trim(c.cast("string"))
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def clean_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def listing_ticker(c: Column) -> Column:
    """Index-table form: trimmed, share-class dot as a dash."""
    return F.regexp_replace(F.trim(c), r"\.", "-")


def release_hits(text: Column, prefix: str) -> list[Column]:
    """First hit of every release pattern, as columns ``<prefix>no``, ``d0``.., ``r0``.."""
    return [
        F.regexp_extract(text, RELEASE_NO, 1).alias(f"{prefix}no"),
        *[F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").alias(f"{prefix}d{i}") for i, p in enumerate(DATES)],
        *[F.trim(F.regexp_extract(text, p, 1)).alias(f"{prefix}r{i}") for i, p in enumerate(RESPONDENTS)],
    ]


def release_number(prefix: str) -> Column:
    return F.col(f"{prefix}no").try_cast("int")


def release_date(prefix: str) -> Column:
    """Date from the pattern hits: first in order that parses.

    A hit no format accepts (month 13, "page 12 2001") falls to the next
    pattern. Two-digit years 69-99 are 19xx and 00-68 are 20xx.
    """
    words = F.initcap(F.regexp_replace(F.col(f"{prefix}d0"), r"\s+", " "))
    full = F.when(words.rlike(r"^[A-Za-z]+ \d{1,2} \d{4}$"), words)
    parts = F.split(F.col(f"{prefix}d1"), "/")
    month, day, year = (F.get(parts, i).try_cast("int") for i in range(3))
    digits = F.length(F.get(parts, 2))
    whole_year = (
        F.when(digits == 4, year).when((digits == 2) & (year >= 69), 1900 + year).when(digits == 2, 2000 + year)
    )
    slashed = F.when(whole_year.isNotNull(), F.format_string("%04d-%02d-%02d", whole_year, month, day))
    return F.coalesce(
        F.try_to_timestamp(full, F.lit("MMMM d yyyy")).cast("date"),
        F.try_to_timestamp(full, F.lit("MMM d yyyy")).cast("date"),
        F.try_to_date(slashed, "yyyy-MM-dd"),
        F.try_to_date(F.nullif(F.col(f"{prefix}d2"), F.lit("")), "yyyy-MM-dd"),
    )


def respondent(prefix: str) -> Column:
    """Name from the pattern hits, stripped of edge punctuation, or NULL."""
    first = F.coalesce(*[F.nullif(F.col(f"{prefix}r{i}"), F.lit("")) for i in range(len(RESPONDENTS))])
    return F.nullif(F.btrim(first, F.lit(" .,;")), F.lit(""))


_COMMON = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("apos", "'"))


def _entity_map() -> Column:
    """All named entities as one map, built once per task from a single literal of the standard table of names."""
    pairs = (f"{name[:-1]}\x02{' ' if name == 'nbsp;' else value}" for name, value in sorted(html5.items()) if name.endswith(";"))
    return F.str_to_map(F.lit("\x01".join(pairs)), F.lit("\x01"), F.lit("\x02"))


def _entity(body: Column) -> Column:
    """The character an entity stands for, without & and ;. NULL if there is none."""
    number = F.coalesce(
        F.conv(F.nullif(F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]{1,6})$", 1), F.lit("")), 16, 10).try_cast("int"),
        F.nullif(F.regexp_extract(body, r"^#([0-9]{1,7})$", 1), F.lit("")).try_cast("int"),
    )
    # a code point as UTF-16: one unit, or a surrogate pair
    high, low = F.lit(0xD800) + F.floor((number - 0x10000) / 0x400), F.lit(0xDC00) + (number - 0x10000) % 0x400
    units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(F.concat(F.hex(high.cast("int")), F.hex(low.cast("int"))))
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.when(number == 160, F.lit(" ")).otherwise(F.decode(F.unhex(units), "UTF-16BE")))


def unescape(text: Column) -> Column:
    """Numeric, hexadecimal and named entities replaced by their characters, a non-breaking space by a space.

    The text is taken apart at ampersands once; only texts that hold one are. An entity is read once, so ``&amp;lt;`` gives ``&lt;``.
    """
    def piece(part: Column) -> Column:
        body = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        char = F.when(body.startswith("#"), _entity(body))
        for name, value in _COMMON:  # spares most entities the search of the long table
            char = char.when(body == name, F.lit(value))
        char = char.when(body != "", F.try_element_at(_entity_map(), body))
        return F.when(char.isNotNull(), F.concat(char, F.substr(part, F.length(body) + 2))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    resolved = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))
    return F.when(text.contains("&"), resolved).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text of a page: comments, scripts, styles and tags removed."""
    no_blocks = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!doctype[^>]*>", " ")
    no_tags = F.regexp_replace(no_blocks, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(no_tags), r"\s+", " "))


def fixed(v: Column, decimals: int) -> Column:
    """Decimal text with a fixed number of places: exact value, ties to even,
    and a negative value that rounds to nothing keeps its sign."""
    return F.replace(F.format_number(v, decimals), F.lit(","), F.lit(""))


def money(v: Column) -> Column:
    """$1.23T / $1.23B / $1.2M / $1,234, N/A when missing."""
    size = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")
    shown = (
        F.when(size >= 1e12, F.concat(fixed(size / 1e12, 2), F.lit("T")))
        .when(size >= 1e9, F.concat(fixed(size / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(fixed(size / 1e6, 1), F.lit("M")))
        .otherwise(F.format_number(size, 0))
    )
    return F.when(v.isNull(), "N/A").otherwise(F.concat(sign, F.lit("$"), shown))


def percent(v: Column, missing: str = "N/A") -> Column:
    return F.when(v.isNull(), missing).otherwise(F.concat(fixed(v * 100, 1), F.lit("%")))


def multiple(v: Column) -> Column:
    return F.when(v.isNull(), "N/A").otherwise(F.concat(fixed(v, 2), F.lit("x")))


def change_text(now: Column, before: Column) -> Column:
    """Arrow and size of a year-over-year change; empty with one value only."""
    moved = now - before
    share = F.when(before == 0, F.lit(0.0)).otherwise(F.abs(moved / F.nullif(before, F.lit(0.0))))
    text = F.concat(F.when(moved > 0, "▲").otherwise("▼"), F.lit(" "), fixed(share * 100, 1), F.lit("% YoY"))
    return F.when(now.isNull() | before.isNull(), "").otherwise(text)


def year_range(first: Column, last: Column) -> Column:
    return F.concat_ws("–", first.cast("string"), last.cast("string"))
