"""Industry of a store from its product types and names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .arrays import cut, size0
from .text import blank_to_null, contains_any, first_matching_label


def product_types(catalog: Column, n: int | None = None, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Distinct lower-case types of the products, first-seen order, at most `n`."""
    first = cut(catalog, limits.products_for_industry)
    types = F.transform(first, lambda p: blank_to_null(F.lower(p["product_type"])))
    return cut(F.array_distinct(F.filter(types, lambda t: t.isNotNull())), n)


def names_text(catalog: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Lower-case names of the products in one text."""
    first = cut(catalog, limits.products_for_industry)
    return F.array_join(F.transform(first, lambda p: F.lower(p["name"])), " ")


def keyword_from_names(text: Column) -> Column:
    return first_matching_label(text, rules.KEYWORD_FROM_NAMES)


def keywords(catalog: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Product types, or one keyword inferred from the names where there are none."""
    types = product_types(catalog, limits.keywords, limits)
    inferred = keyword_from_names(names_text(catalog, limits))
    return (
        F.when(size0(types) > 0, types)
        .when(inferred.isNotNull(), F.array(inferred))
        .otherwise(F.array().cast("array<string>"))
    )


def of_keywords(words: Column) -> Column:
    """One of seven industries, or null."""
    return first_matching_label(F.lower(F.array_join(words, " ")), rules.INDUSTRY_FROM_KEYWORDS)


def long_name(text: Column) -> Column:
    """One of eight longer industry names, or general retail."""
    return first_matching_label(
        F.lower(text), rules.INDUSTRY_LONG_NAMES, F.lit(rules.INDUSTRY_LONG_DEFAULT)
    )


def fallback_leaders(industry: Column) -> Column:
    """Stores for four industries found by word; empty otherwise."""
    low = F.lower(industry)
    out = None
    for words, brands in rules.FALLBACK_LEADERS:
        value = F.array(*[F.lit(b) for b in brands])
        hit = contains_any(low, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.array().cast("array<string>"))
