"""Lists in free text: URLs in JSON, fenced JSON or prose, and product categories in JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import strip


def _payload(text: Column) -> Column:
    """The fenced part that holds a list, or the whole text."""
    whole = strip(text)
    fenced = F.filter(F.split(whole, "```"), lambda p: p.contains("[") & p.contains("]"))
    return F.when(
        whole.contains("```"), F.coalesce(F.get(fenced, F.lit(0)), whole)
    ).otherwise(whole)


def _urls(payload: Column) -> Column:
    parsed = F.try_parse_json(payload)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    in_prose = F.regexp_extract_all(payload, F.lit(rules.LIST_URL_PATTERN), F.lit(0))
    return (
        F.when(parsed.isNull(), in_prose)
        .when(is_list, F.from_json(payload, "array<string>"))
        .otherwise(F.array().cast("array<string>"))
    )


def competitor_urls(text: Column) -> Column:
    """Web addresses in list order without trailing slashes; example addresses left out."""
    payload = _payload(text)
    payload = F.when(payload.startswith("json"), strip(F.substr(payload, F.lit(5)))).otherwise(
        payload
    )
    real = F.filter(
        F.coalesce(_urls(payload), F.array().cast("array<string>")),
        lambda u: F.coalesce(u.startswith("http"), F.lit(False)),
    )
    cut = F.transform(real, lambda u: F.regexp_replace(u, "/+$", ""))
    return F.filter(cut, lambda u: ~F.lower(u).contains("example"))


def industry_default_urls(text: Column, n: int) -> Column:
    """First `n` addresses of a suggestion text for an industry.

    Example addresses are left out of a JSON list only, not out of prose.
    """
    payload = _payload(text)
    parsed = F.try_parse_json(payload)
    found = F.coalesce(_urls(payload), F.array().cast("array<string>"))
    kept = F.when(
        parsed.isNotNull(),
        F.filter(found, lambda u: F.coalesce((u != "") & ~F.lower(u).contains("example"), F.lit(False))),
    ).otherwise(found)
    return F.slice(kept, 1, n)


def category_lists(text: Column) -> Column:
    """Category to product names from a JSON object, plain or fenced; null where it is not one."""
    body = strip(F.regexp_replace(F.regexp_replace(strip(text), "^```json", ""), "```$", ""))
    return F.from_json(body, "map<string, array<string>>")
