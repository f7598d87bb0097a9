"""Social handles in raw page text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .arrays import keep_first_by, let
from .text import SPACE_LISTED, blank_to_null, one_of


def _regex(pattern: str) -> str:
    """Case is ignored for ASCII letters only: host names have no others, and it is much faster."""
    return "(?i)" + pattern.replace(r"\s", SPACE_LISTED)


def normalize_platform(p: Column) -> Column:
    low = F.lower(p)
    return F.when(one_of(low, rules.SOCIAL_PLATFORMS), low).otherwise(F.lit("other"))


def _handle(platform: str, url: Column, handle: Column) -> Column:
    known = platform if platform in rules.SOCIAL_PLATFORMS else "other"
    return F.struct(F.lit(known).alias("platform"), url.alias("url"), handle.alias("handle"))


def find_handles(
    html: Column, patterns: dict[str, str] | None = None, scan_past: bool = False
) -> Column:
    """One handle per platform.

    The first match decides: if it is a share button, the platform is left out. With
    `scan_past`, share buttons are skipped and the next match counts.
    """
    tried = []
    for platform, pattern in (patterns or rules.SOCIAL_PATTERNS).items():
        if scan_past:
            real = F.filter(
                F.regexp_extract_all(html, F.lit(_regex(pattern)), F.lit(1)), lambda h: ~one_of(h, rules.PSEUDO_HANDLES)
            )
            first = F.get(real, F.lit(0))
        else:
            first = blank_to_null(F.regexp_extract(html, _regex(pattern), 1))
        tried.append(F.struct(F.lit(platform).alias("name"), first.alias("handle")))
    # The page is searched once for each platform; what was found is looked at several times.
    real = F.filter(F.array(*tried), lambda t: ~one_of(t["handle"], rules.PSEUDO_HANDLES))

    def handle(t: Column) -> Column:
        known = F.when(one_of(t["name"], rules.SOCIAL_PLATFORMS), t["name"]).otherwise(F.lit("other"))
        url = F.concat(F.lit("https://"), t["name"], F.lit(".com/"), t["handle"])
        return F.struct(known.alias("platform"), url.alias("url"), t["handle"].alias("handle"))

    return F.transform(real, handle)


def _first_real(html: Column, platform: str, pattern: str, group: int) -> Column:
    regex = _regex(pattern)
    matches = F.transform(
        F.regexp_extract_all(html, F.lit(regex), F.lit(0)),
        lambda m: F.struct(m.alias("text"), F.regexp_extract(m, regex, group).alias("handle")),
    )
    real = F.filter(matches, lambda m: ~one_of(m["handle"], rules.PSEUDO_HANDLES_CRAWL))
    return let(
        F.get(real, F.lit(0)),
        lambda m: F.when(
            m.isNotNull(), _handle(platform, F.concat(F.lit("https://"), m["text"]), m["handle"])
        ),
    )


def find_handles_crawl(html: Column) -> Column:
    """Seven platforms, share buttons skipped, URL as it stands on the page."""
    found = [_first_real(html, name, *rule) for name, rule in rules.SOCIAL_PATTERNS_CRAWL.items()]
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def platform_of_url(url: Column, hosts: dict[str, str] | None = None, exact_host: bool = False):
    """Platform of the first listed host that occurs in the URL, or is its host."""
    out = None
    site = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z]+:)?//([^/?#]*)", 1)), r"^www\.", "")
    for domain, platform in (hosts or rules.SOCIAL_HOSTS).items():
        hit = (site == domain) if exact_host else url.contains(domain)
        out = F.when(hit, F.lit(platform)) if out is None else out.when(hit, F.lit(platform))
    return out


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)" + rules.HREF_PATTERN), F.lit(1))


def find_links(html: Column, hosts: dict[str, str] | None = None, exact_host: bool = False) -> Column:
    """Distinct (platform, url) pairs among all href values."""
    pairs = F.transform(
        hrefs(html),
        lambda u: F.struct(platform_of_url(u, hosts, exact_host).alias("platform"), u.alias("url")),
    )
    return F.array_distinct(F.filter(pairs, lambda p: p["platform"].isNotNull()))


def handle_of_url(url: Column, patterns: list[str] | None = None) -> Column:
    tries = [
        blank_to_null(F.regexp_extract(url, "(?U)" + p, 1))
        for p in (patterns or rules.HANDLE_FROM_URL_PATTERNS)
    ]
    return F.regexp_replace(F.coalesce(*tries), "^@+", "")


def dedup_handles(handles: Column) -> Column:
    return keep_first_by(handles, lambda h: F.concat(h["platform"], F.lit(":"), h["url"]))
