"""URL columns: normalise, split, resolve, classify."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .text import blank_to_null

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
#: A scheme and a host that are in key form but for the slashes after them.
_BARE = r"^https?://[a-z0-9.\-]+/*\z"


def normalize(u: Column) -> Column:
    """Add https:// when no http scheme is given and cut trailing slashes."""
    full = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(full, "/+$", "")


def netloc(u: Column) -> Column:
    """Text between :// and the next / ? or #; empty without a scheme."""
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def host(u: Column) -> Column:
    return F.lower(netloc(u))


def bare_host(u: Column) -> Column:
    """Host of a URL, or the value itself if it is a host already."""
    return F.when(
        u.contains("://"), F.split_part(F.split_part(u, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    ).otherwise(u)


def is_valid(u: Column) -> Column:
    return F.coalesce(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+"), F.lit(False))


def canonical(u: Column) -> Column:
    """Key form of a store URL: normalised, host in lower case, `/` after a bare host.

    URLs of a bare host in lower case, as most are, take one pattern; the others are taken apart.
    """
    return F.when(u.rlike(_BARE), F.concat(F.rtrim(u, F.lit("/")), F.lit("/"))).otherwise(_taken_apart(u))


def _taken_apart(u: Column) -> Column:
    full = normalize(u)
    rest = F.regexp_extract(full, r"^[a-zA-Z]+://[^/?#]*(.*)$", 1)
    origin = F.concat(
        F.lower(F.regexp_extract(full, r"^([a-zA-Z]+)://", 1)), F.lit("://"), host(full)
    )
    origin = F.regexp_replace(origin, r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.concat(origin, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def brand_from_url(u: Column) -> Column:
    """First label of the host without `www.`, capitalised."""
    label = F.split_part(F.replace(netloc(u), F.lit("www."), F.lit("")), F.lit("."), F.lit(1))
    return F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substr(label, F.lit(2))))


def _drop_dots(path: Column) -> Column:
    """Remove `.` and `..` segments from a rooted path."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(segments, -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
        lambda acc: F.concat(F.lit("/"), F.array_join(acc, "/")),
    )
    closed = F.when(last.isin(".", "..") & ~folded.endswith("/"), F.concat(folded, F.lit("/")))
    return F.coalesce(closed, folded)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of `href` seen on page `base`."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", 0)
    no_fragment = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    base_path = F.regexp_extract(no_query, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*(/.*)$", 1)
    folder = F.coalesce(blank_to_null(F.regexp_extract(base_path, r"^(.*/)", 1)), F.lit("/"))
    target = F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))

    def rooted(t: Column) -> Column:
        path = F.regexp_extract(t, r"^[^?#]*", 0)
        tail = F.regexp_extract(t, r"[?#].*$", 0)
        fixed = F.when(path.rlike(r"/\.{1,2}(/|$)"), _drop_dots(path)).otherwise(path)
        return F.concat(origin, fixed, tail)

    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(let(target, rooted))
    )


def policy_type(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.contains("privacy"), F.lit("privacy_policy"))
        .when(p.rlike("return|refund"), F.lit("return_refund_policy"))
        .when(p.contains("shipping"), F.lit("shipping_policy"))
        .when(p.contains("terms"), F.lit("terms_of_service"))
        .otherwise(F.lit("unknown"))
    )


def page_type(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.contains("faq"), F.lit("faq"))
        .when(p.rlike("about|story"), F.lit("about"))
        .when(p.contains("contact"), F.lit("contact"))
        .otherwise(F.lit("unknown"))
    )


def is_competitor_candidate(u: Column, excluded: list[str]) -> Column:
    return F.coalesce(u.startswith("http") & ~F.lower(u).rlike("|".join(excluded)), F.lit(False))
