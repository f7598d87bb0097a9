"""Important links and hero products, from the anchors of one page."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import urls
from .arrays import cut, keep_first_by, let
from .text import contains_any, first_matching_label, has_text, head, longer_than, one_of, sql_text, strip


def stored_category(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(one_of(low, rules.STORED_LINK_CATEGORIES), low).otherwise(F.lit("other"))


def raw_category(text: Column, href: Column, ladder: dict[str, list[str]] | None = None) -> Column:
    """First category one of whose words is in the text or the address; null if none is."""
    both = F.lower(F.concat_ws("\n", text, href))
    return let(both, lambda words: first_matching_label(words, ladder or rules.LINK_KEYWORDS))


def _link(name: Column, url: Column, raw: Column, is_default: bool) -> Column:
    return F.struct(
        name.alias("name"),
        url.alias("url"),
        stored_category(raw).alias("category"),
        raw.alias("raw_category"),
        F.lit(is_default).alias("is_default"),
    )


def _anchors_up_to(anchors: Column, borders: Column) -> Column:
    """For each border, in their order, how many anchors stand up to it. Anchors and borders are sorted together once: what
    stands before a border and is no border is an anchor."""
    marked = F.transform(anchors, lambda a: F.struct(a["idx"].alias("at"), F.lit(-1).alias("region")))
    own = F.transform(borders, lambda b, r: F.struct(b.alias("at"), r.alias("region")))
    placed = F.transform(F.sort_array(F.concat(marked, own)), lambda m, i: F.struct(m["region"].alias("region"), i.alias("place")))
    counted = F.transform(
        F.filter(placed, lambda m: m["region"] >= 0), lambda m, j: F.struct(m["region"], (m["place"] - j).alias("n"))
    )
    return F.transform(F.sort_array(counted), lambda c: c["n"])


def anchors_in_regions(anchors: Column, regions: Column) -> Column:
    """Anchors of each region in turn; one in two regions comes twice. Anchors are in the order of their places, so those of
    a region are a stretch of them."""

    def stretches(found: Column) -> Column:
        before = _anchors_up_to(found, F.transform(regions, lambda r: r["start"]))
        upto = _anchors_up_to(found, F.transform(regions, lambda r: r["stop"]))
        spans = F.arrays_zip(before.alias("before"), upto.alias("upto"))
        return F.flatten(
            F.transform(spans, lambda s: F.slice(found, s["before"] + 1, F.greatest(s["upto"] - s["before"], F.lit(0))))
        )

    return let(anchors, stretches)


def important_links(
    anchors: Column,
    regions: Column,
    base: Column,
    ladder: dict[str, list[str]] | None = None,
    limits: rules.Limits = rules.KEEP_ALL,
) -> Column:
    """Categorised links of footer, nav, header and link containers, each URL once.

    A URL counts as seen before social links and uncategorised links are left out.
    """
    if limits.link_boxes is not None:
        regions = F.filter(regions, lambda r: r["box"] < limits.link_boxes)
    scanned = cut(anchors_in_regions(anchors, regions), limits.links_scanned)
    usable = F.filter(
        scanned,
        lambda a: has_text(a["href"]) & longer_than(a["text"], rules.LINK_NAME_MIN),
    )
    placed = F.transform(
        usable,
        lambda a: F.struct(
            a["text"].alias("text"), a["href"].alias("href"), urls.resolve(base, a["href"]).alias("url")
        ),
    )
    first_seen = keep_first_by(placed, lambda a: a["url"])
    own = F.filter(first_seen, lambda a: ~contains_any(a["href"], rules.SOCIAL_LINK_HOSTS))
    labelled = F.transform(
        own,
        lambda a: F.struct(
            head(a["text"], limits.link_name_chars).alias("name"),
            a["url"].alias("url"),
            raw_category(a["text"], a["href"], ladder).alias("raw"),
        ),
    )
    return F.transform(
        F.filter(labelled, lambda k: k["raw"].isNotNull()), lambda k: _link(k["name"], k["url"], k["raw"], False)
    )


def important_links_crawl(anchors: Column, base: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Other form: footer anchors, then header and nav anchors."""
    pool = F.concat(
        F.filter(anchors, lambda a: a["in_footer"]), F.filter(anchors, lambda a: a["in_header_nav"])
    )
    scanned = F.filter(
        cut(pool, limits.links_crawl_scanned),
        lambda a: has_text(a["href"]) & has_text(a["first_text"]),
    )

    def labelled(a: Column) -> Column:
        text, url = strip(a["first_text"]), urls.resolve(base, a["href"])
        return _link(
            head(text, limits.link_name_chars),
            url,
            raw_category(text, url, rules.LINK_KEYWORDS_CRAWL),
            False,
        )

    return F.filter(F.transform(scanned, labelled), lambda k: k["raw_category"].isNotNull())


def default_links(base: Column) -> Column:
    rows = ", ".join(
        f"named_struct('name', {sql_text(name)}, 'path', {sql_text(path)}, 'raw', {sql_text(raw)})"
        for name, path, raw in rules.DEFAULT_LINKS
    )
    return F.transform(
        F.expr(f"array({rows})"), lambda k: _link(k["name"], F.concat(base, k["path"]), k["raw"], True)
    )


def pad_links(links: Column, base: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Fewer than five links are filled up with default ones."""
    room = F.lit(rules.LINKS_PAD_UNTIL)

    def padded(found: Column) -> Column:
        filled = F.concat(found, F.slice(default_links(base), F.lit(1), room - F.size(found)))
        return F.when(F.size(found) < rules.LINKS_PAD_BELOW, filled).otherwise(found)

    return cut(let(links, padded), limits.links)


def dedup_links(links: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    return cut(keep_first_by(links, lambda k: k["url"]), limits.links)


def hero_links(
    anchors: Column, base: Column, pattern: str = "/products/", limits: rules.Limits = rules.KEEP_ALL
) -> Column:
    """Featured products: the product anchors."""
    scanned = cut(F.filter(anchors, lambda a: a["href"].rlike(pattern)), limits.heroes_scanned)

    def product(a: Column) -> Column:
        title, text = a["title"], a["text"]
        name = F.when(has_text(title), title).when(has_text(text), text).otherwise(F.lit("Product"))
        image = F.when(has_text(a["img_src"]), urls.resolve(base, a["img_src"]))
        return F.struct(
            name.alias("name"),
            a["parent_price"].alias("price"),
            image.alias("image_url"),
            urls.resolve(base, a["href"]).alias("product_url"),
        )

    return cut(F.transform(scanned, product), limits.heroes)


def hero_links_crawl(anchors: Column, base: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Other form: unnamed anchors are left out."""
    scanned = cut(F.filter(anchors, lambda a: a["href"].contains("/products/")), limits.heroes_scanned)

    def product(a: Column) -> Column:
        name = (
            F.when(has_text(a["title"]), a["title"])
            .when(has_text(a["aria_label"]), a["aria_label"])
            .when(has_text(a["first_text"]), a["first_text"])
        )
        return F.struct(
            strip(name).alias("name"),
            strip(a["inner_price"]).alias("price"),
            F.when(has_text(a["img_src"]), urls.resolve(base, a["img_src"])).alias("image_url"),
            urls.resolve(base, a["href"]).alias("product_url"),
        )

    return F.filter(F.transform(scanned, product), lambda p: p["name"].isNotNull())


