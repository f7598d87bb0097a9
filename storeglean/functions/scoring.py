"""How complete a store's record is."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import size0
from .text import has_text


def _flag(c: Column, points: int) -> Column:
    return F.when(c, F.lit(float(points))).otherwise(F.lit(0.0))


def score_from_counts(
    products: Column,
    heroes: Column,
    policies: Column,
    faqs: Column,
    has_context: Column,
    socials: Column,
    has_email: Column,
    has_phone: Column,
    links: Column,
) -> Column:
    """0 to 100 from the counts alone; every term is a multiple of one half."""
    return (
        F.least(F.lit(20.0), products * F.lit(0.5))
        + F.least(F.lit(10.0), heroes * F.lit(2.0))
        + policies * F.lit(5.0)
        + F.least(F.lit(10.0), faqs * F.lit(1.0))
        + _flag(has_context, 10)
        + F.least(F.lit(10.0), socials * F.lit(2.0))
        + _flag(has_email, 5)
        + _flag(has_phone, 5)
        + F.least(F.lit(10.0), links * F.lit(1.0))
    )


def policies_present() -> Column:
    names = ["privacy_policy", "return_refund_policy", "shipping_policy", "terms_of_service"]
    total = F.lit(0)
    for name in names:
        total = total + has_text(F.col(name)).cast("int")
    return total


def quality_score(count_defaults: bool = True) -> Column:
    """Score of a brand_insights row; padded FAQs and links can be left out of it."""
    faqs, links = F.col("faqs"), F.col("important_links")
    if not count_defaults:
        faqs = F.filter(faqs, lambda q: ~q["is_default"])
        links = F.filter(links, lambda k: ~k["is_default"])
    contact = F.col("contact_info")
    return score_from_counts(
        size0(F.col("product_catalog")),
        size0(F.col("hero_products")),
        policies_present(),
        size0(faqs),
        has_text(F.col("brand_context")),
        size0(F.col("social_handles")),
        size0(contact["emails"]) > 0,
        size0(contact["phone_numbers"]) > 0,
        size0(links),
    )
