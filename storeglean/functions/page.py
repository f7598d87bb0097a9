"""Single facts of a page: platform, embedded store settings, brand name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import urls
from .text import any_of, blank_to_null, has_text, strip


def has_platform_marker(html: Column, markers: list[str]) -> Column:
    """Whether the page holds one of the markers, upper and lower case alike."""
    words = [m.lower() for m in markers]
    return F.coalesce(F.lower(html).rlike(any_of(words)), F.lit(False))


def embedded_settings(html: Column) -> Column:
    """Currency, country and shop name from the store's inline JSON; null where absent."""
    return F.struct(
        blank_to_null(F.regexp_extract(html, rules.CURRENCY_PATTERN, 1)).alias("currency"),
        blank_to_null(F.regexp_extract(html, rules.COUNTRY_PATTERN, 1)).alias("country"),
        blank_to_null(F.regexp_extract(html, rules.SHOP_NAME_PATTERN, 1)).alias("shop_name"),
    )


def brand_from_title(title: Column) -> Column:
    """Text before the earliest separator."""
    return strip(F.get(F.split(title, any_of(rules.TITLE_SEPARATORS)), F.lit(0)))


def brand_from_title_crawl(title: Column) -> Column:
    """Text before the first separator, in list order, that occurs at all."""
    out = None
    for sep in rules.TITLE_SEPARATORS_CRAWL:
        cut = F.split_part(title, F.lit(sep), F.lit(1))
        hit = title.contains(sep)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return strip(out.otherwise(title))


def brand_name(og: Column, title: Column, url: Column) -> Column:
    return (
        F.when(has_text(og), strip(og))
        .when(has_text(title), brand_from_title(title))
        .otherwise(urls.brand_from_url(url))
    )


def brand_name_crawl(og: Column, title: Column, logo_alt: Column, url: Column) -> Column:
    return (
        F.when(has_text(og), strip(og))
        .when(has_text(title), brand_from_title_crawl(title))
        .when(has_text(logo_alt), strip(logo_alt))
        .otherwise(urls.brand_from_url(url))
    )
