"""Queries over the table of web pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import faq, links, page, social, urls
from ..sources import feed as feeds
from ..sources.dom import page_facts
from ..sources.landed import ok_pages, search_candidates
from . import roles
from .sqltext import ANCHORS, PAIRS, TITLES, decode, ladder, q, strip, words_in


def page_scan(spark: SparkSession, d: str) -> DataFrame:
    return ok_pages(roles.store_pages(roles.table(spark, d, "pages"))).select("page_id", "store_url", "path", "url")


PAGE_SCAN = """
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS store_url,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, url
FROM pages WHERE NOT contains(url, 'spam-farm') AND NOT contains(url, 'cheap-pills')
"""


def page_features(spark: SparkSession, d: str) -> DataFrame:
    facts = page_facts(
        roles.table(spark, d, "pages").drop("url"), ["title", "anchors", "link_regions", "jsonld"]
    )
    return facts.select(
        "page_id",
        "title",
        F.size("anchors").alias("n_anchors"),
        F.array_join(F.transform("anchors", lambda a: a["href"]), " ").alias("hrefs"),
        F.size("link_regions").alias("n_link_regions"),
        F.size("jsonld").alias("n_jsonld"),
    )


PAGE_FEATURES = f"""
WITH {TITLES}
SELECT p.page_id, t.title,
  len(regexp_extract_all(p.html, '<a [^>]*>')) AS n_anchors,
  array_to_string(regexp_extract_all(p.html, '<a href="([^"]*)">', 1), ' ') AS hrefs,
  CAST(contains(p.html, '<footer') AS INT) + CAST(contains(p.html, '<nav') AS INT) AS n_link_regions,
  0 AS n_jsonld
FROM pages p JOIN titles t ON p.page_id = t.page_id
"""


def brand_name(spark: SparkSession, d: str) -> DataFrame:
    facts = page_facts(roles.table(spark, d, "pages"), ["title", "og_site_name", "logo_alt"])
    og, title, url = F.col("og_site_name"), F.col("title"), F.col("url")
    return facts.select(
        "page_id",
        page.brand_name(og, title, url).alias("brand"),
        page.brand_name_crawl(og, title, F.col("logo_alt"), url).alias("brand_by_order"),
        urls.brand_from_url(url).alias("brand_of_host"),
    )


_HOST_LABEL = "split_part(replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', ''), '.', 1)"
BRAND_NAME = f"""
WITH {TITLES}, hosts AS (
  SELECT page_id, title, upper(left({_HOST_LABEL}, 1)) || lower(substr({_HOST_LABEL}, 2)) AS host_brand
  FROM titles
)
SELECT page_id,
  CASE WHEN title = '' THEN host_brand ELSE {strip("regexp_extract(title, '^[^|–-]*')")} END AS brand,
  CASE WHEN title = '' THEN host_brand ELSE {strip('''
    CASE WHEN contains(title, '|') THEN split_part(title, '|', 1)
      WHEN contains(title, '-') THEN split_part(title, '-', 1)
      WHEN contains(title, '·') THEN split_part(title, '·', 1)
      WHEN contains(title, '–') THEN split_part(title, '–', 1)
      WHEN contains(title, '—') THEN split_part(title, '—', 1)
      ELSE title END''')} END AS brand_by_order,
  host_brand AS brand_of_host
FROM hosts
"""


def main_text(spark: SparkSession, d: str) -> DataFrame:
    facts = page_facts(roles.table(spark, d, "pages").drop("url"), ["main_text"])
    text = F.col("main_text")
    return facts.select(
        "page_id",
        F.length(text).alias("n_chars"),
        (F.length(text) > rules.POLICY_MIN).alias("is_policy"),
        F.md5(text).alias("text_md5"),
    )


_BODY = r"regexp_extract(html, '<body[^>]*>(.*)$', 1, 's')"
_KEPT = _BODY
for _tag in ("nav", "header", "footer", "script", "style"):
    _KEPT = f"regexp_replace({_KEPT}, '<{_tag}[ >].*?</{_tag}>', '<x>', 'gs')"
_PIECE = strip(decode("x"))
MAIN_TEXT = f"""
WITH pieces AS (
  SELECT page_id, i, {_PIECE} AS piece
  FROM (
    SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i
    FROM (SELECT page_id, regexp_split_to_array({_KEPT}, '<[^>]*>') AS l FROM pages)
  )
), texts AS (
  SELECT page_id, coalesce(string_agg(piece, ' ' ORDER BY i) FILTER (WHERE piece <> ''), '') AS text
  FROM pieces GROUP BY page_id
)
SELECT page_id, length(text) AS n_chars, length(text) > {rules.POLICY_MIN} AS is_policy,
  md5(text) AS text_md5
FROM texts
"""


_MARKERS, _OTHER_MARKERS = ["TRACK(1", "spam-farm"], ["Cheap-Pills", "<article", "ad 7 -->"]


def platform_detect(spark: SparkSession, d: str) -> DataFrame:
    pages = roles.table(spark, d, "pages")
    html = F.col("html")
    body = F.when(
        F.col("url").contains("/en/"), F.format_string('{"products":[{"title":"%d"}]}', "page_id")
    ).otherwise(F.lit("<html>not a feed</html>"))
    feed = pages.select(
        F.col("url").alias("store_url"), F.lit(1).alias("page"), F.lit(200).alias("status"), body.alias("body")
    )
    marked = pages.select(
        "page_id",
        F.col("url").alias("store_url"),
        page.has_platform_marker(html, _OTHER_MARKERS).alias("other_markers"),
        page.has_platform_marker(html, _MARKERS).alias("given_markers"),
    )
    with_feed = feeds.feed_has_products(feed).withColumn("has_feed", F.lit(True))
    return marked.join(with_feed, "store_url", "left").select(
        "page_id",
        "other_markers",
        "given_markers",
        (F.col("given_markers") | F.coalesce("has_feed", F.lit(False))).alias("is_platform"),
    )


PLATFORM_DETECT = f"""
SELECT page_id, {words_in('lower(html)', [m.lower() for m in _OTHER_MARKERS])} AS other_markers,
  {words_in('lower(html)', [m.lower() for m in _MARKERS])} AS given_markers,
  {words_in('lower(html)', [m.lower() for m in _MARKERS])} OR contains(url, '/en/') AS is_platform
FROM pages
"""

_HOSTS = {"/The": "instagram", "/th": "facebook", "a": "twitter"}
_HANDLES = [r"^/(th@?[\w\-\.]+)", r"^/(@?[\w\-\.]+)"]


def href_links(spark: SparkSession, d: str) -> DataFrame:
    found = roles.table(spark, d, "pages").select(
        "page_id", F.explode(social.find_links(F.col("html"), _HOSTS)).alias("link")
    )
    return found.select(
        "page_id",
        "link.platform",
        "link.url",
        social.handle_of_url(F.col("link.url"), _HANDLES).alias("handle"),
    )


HREF_LINKS = rf"""
WITH hrefs AS (
  SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href=[''"]?([^''" >]+)', 1)) AS url FROM pages
), marked AS (
  SELECT page_id, url, {ladder('url', {v: [k] for k, v in _HOSTS.items()})} AS platform FROM hrefs
)
SELECT page_id, platform, url,
  regexp_replace(coalesce(
    nullif(regexp_extract(url, '^/(th@?[\p{{L}}\p{{N}}\p{{M}}_\-\.]+)', 1), ''),
    nullif(regexp_extract(url, '^/(@?[\p{{L}}\p{{N}}\p{{M}}_\-\.]+)', 1), '')), '^@+', '') AS handle
FROM marked WHERE platform IS NOT NULL
"""


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    found = roles.table(spark, d, "pages").select(
        "page_id", "url", F.posexplode(social.hrefs(F.col("html"))).alias("pos", "href")
    )
    parent = F.concat(F.lit("../"), F.substr(F.col("href"), F.lit(2)))
    return found.select(
        "page_id",
        "pos",
        "href",
        urls.resolve(F.col("url"), F.col("href")).alias("rooted"),
        urls.resolve(F.col("url"), parent).alias("from_parent"),
    )


RESOLVE_LINKS = r"""
WITH hrefs AS (
  SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos, origin, folder
  FROM (
    SELECT page_id, regexp_extract_all(html, '(?i)href=[''"]?([^''" >]+)', 1) AS l,
      regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
      regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) AS folder
    FROM pages
  )
)
SELECT page_id, pos, href, origin || href AS rooted,
  origin || regexp_replace(folder, '[^/]+/$', '') || substr(href, 2) AS from_parent
FROM hrefs
"""

_LADDER = {
    "tracking": ["the"], "contact": ["in"], "blog": ["an", "le"], "support": ["ou"], "about": ["er"],
    "legal": ["st"], "shopping": ["re"], "account": ["ti"],
}
_STORED = "CASE WHEN raw_category IN ({}) THEN raw_category ELSE 'other' END".format(
    ", ".join(q(c) for c in rules.STORED_LINK_CATEGORIES)
)


def link_categories(spark: SparkSession, d: str) -> DataFrame:
    facts = page_facts(roles.table(spark, d, "pages").drop("url"), ["anchors"])
    found = facts.select("page_id", F.posexplode("anchors").alias("pos", "a"))
    raw = links.raw_category(F.col("a.text"), F.col("a.href"), _LADDER)
    return found.select("page_id", "pos", "a.href", raw.alias("raw_category")).withColumn(
        "category", links.stored_category(F.col("raw_category"))
    )


LINK_CATEGORIES = f"""
WITH {ANCHORS}, marked AS (
  SELECT page_id, pos, href, {ladder("lower(text || chr(10) || href)", _LADDER)} AS raw_category FROM anchors
)
SELECT page_id, pos, href, raw_category, {_STORED} AS category FROM marked
"""


def _page_links(spark: SparkSession, d: str) -> DataFrame:
    facts = page_facts(roles.store_pages(roles.table(spark, d, "pages")).drop("path", "status", "url"), ["anchors", "link_regions"])
    return facts.select(
        "page_id",
        "store_url",
        links.important_links(F.col("anchors"), F.col("link_regions"), F.col("store_url"), _LADDER).alias("links"),
    )


def important_links(spark: SparkSession, d: str) -> DataFrame:
    found = _page_links(spark, d).select(
        "page_id", F.posexplode(links.dedup_links(F.col("links"))).alias("pos", "k")
    )
    return found.select("page_id", "pos", "k.name", "k.url", "k.raw_category", "k.category")


_IMPORTANT = f"""
{ANCHORS}, usable AS (
  SELECT page_id, pos, regexp_extract(page_url, '^[a-z]+://[^/?#]*') AS base, href, text
  FROM anchors WHERE href <> '' AND length(text) > {rules.LINK_NAME_MIN}
), first_seen AS (
  SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1
), labelled AS (
  SELECT page_id, pos, text AS name, base || href AS url,
    {ladder("lower(text || chr(10) || href)", _LADDER)} AS raw_category
  FROM first_seen WHERE NOT {words_in('href', rules.SOCIAL_LINK_HOSTS)}
), important AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, name, url, raw_category,
    {_STORED} AS category
  FROM labelled WHERE raw_category IS NOT NULL
)
"""
IMPORTANT_LINKS = f"WITH {_IMPORTANT} SELECT * FROM important"


def pad_defaults(spark: SparkSession, d: str) -> DataFrame:
    padded = _page_links(spark, d).select(
        "page_id",
        F.size("links").alias("found"),
        links.pad_links(F.col("links"), F.col("store_url")).alias("padded"),
        # Pages with many links stand in for pages with FAQs.
        faq.pad_pairs(F.when(F.size("links") > 4, F.slice(faq.default_pairs(), 1, 2))).alias("pairs"),
    )
    return padded.select(
        "page_id",
        "found",
        F.size("padded").alias("kept"),
        F.size(F.filter("padded", lambda k: k["is_default"])).alias("defaults"),
        F.element_at("padded", -1)["url"].alias("last_url"),
        F.size("pairs").alias("faqs"),
    )


PAD_DEFAULTS = f"""
WITH {_IMPORTANT}, counts AS (
  SELECT p.page_id, regexp_extract(any_value(p.url), '^[a-z]+://[^/?#]*') AS base, count(i.pos) AS found,
    max(i.url) FILTER (WHERE i.pos = m.n - 1) AS last_found
  FROM pages p LEFT JOIN important i ON p.page_id = i.page_id
  LEFT JOIN (SELECT page_id, count(*) AS n FROM important GROUP BY page_id) m ON p.page_id = m.page_id
  GROUP BY p.page_id
)
SELECT page_id, found,
  CASE WHEN found < 5 THEN found + 5 ELSE found END AS kept,
  CASE WHEN found < 5 THEN 5 ELSE 0 END AS defaults,
  CASE WHEN found < 5 THEN base || '/pages/support' ELSE last_found END AS last_url,
  CASE WHEN found > 4 THEN 2 ELSE 3 END AS faqs
FROM counts
"""


def hero_links(spark: SparkSession, d: str) -> DataFrame:
    facts = page_facts(
        roles.store_pages(roles.table(spark, d, "pages")).drop("path", "status", "url"), ["anchors"], product_pattern="^/t"
    )
    found = facts.select(
        "page_id",
        F.posexplode(links.hero_links(F.col("anchors"), F.col("store_url"), "^/t")).alias("pos", "p"),
    )
    return found.select("page_id", "pos", "p.name", "p.price", "p.product_url")


HERO_LINKS = f"""
WITH {ANCHORS}, matched AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos,
    CASE WHEN text = '' THEN 'Product' ELSE text END AS name, CAST(NULL AS VARCHAR) AS price,
    regexp_extract(page_url, '^[a-z]+://[^/?#]*') || href AS product_url
  FROM anchors WHERE starts_with(href, '/t')
)
SELECT * FROM matched
"""

_SOCIAL = {
    "instagram": r'example\.com/([^/\s\?"]+)',
    "facebook": r'example\.net/([^/\s\?"]+)',
    "twitter": r'example\.org/([^/\s\?"]+)',
    "pinterest": r'href="/([^/\s\?"]+)',
    "vimeo": r'href="/(sh[^/\s\?"]+)',
}


def social_handles(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "url", "html")
    found = roles.table(spark, d, "pages").select(
        "page_id", F.explode(social.dedup_handles(social.find_handles(text, _SOCIAL))).alias("s")
    )
    return found.select("page_id", "s.platform", "s.handle", "s.url")


_SOCIAL_ARMS = " UNION ALL ".join(
    f"SELECT page_id, {q(p)} AS site, regexp_extract(url || ' ' || html, {q('(?i)' + r)}, 1) AS handle FROM pages"
    for p, r in _SOCIAL.items()
)
SOCIAL_HANDLES = f"""
SELECT page_id, CASE WHEN site = 'vimeo' THEN 'other' ELSE site END AS platform, handle,
  'https://' || site || '.com/' || handle AS url
FROM ({_SOCIAL_ARMS})
WHERE handle <> '' AND handle NOT IN ({', '.join(q(h) for h in rules.PSEUDO_HANDLES)})
"""


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u, bare = F.col("url"), F.regexp_replace("url", "^[a-z]+://", "")
    return roles.table(spark, d, "pages").select(
        "page_id",
        urls.normalize(u).alias("normalized"),
        urls.normalize(bare).alias("with_scheme"),
        urls.canonical(F.upper(urls.host(u))).alias("store_key"),
        urls.netloc(u).alias("netloc"),
        urls.bare_host(u).alias("host"),
        urls.is_valid(u).alias("valid"),
        urls.is_valid(bare).alias("bare_valid"),
    )


URL_PARTS = """
SELECT page_id, rtrim(url, '/') AS normalized,
  'https://' || rtrim(regexp_replace(url, '^[a-z]+://', ''), '/') AS with_scheme,
  'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/' AS store_key,
  regexp_extract(url, '://([^/?#]*)', 1) AS netloc,
  split_part(split_part(url, '://', 2), '/', 1) AS host, true AS valid, false AS bare_valid
FROM pages
"""

_PATHS = rules.CRAWL_POLICY_PATHS + rules.CRAWL_CONTENT_PATHS


def path_types(spark: SparkSession, d: str) -> DataFrame:
    path = F.get(F.lit(_PATHS), (F.col("page_id") % len(_PATHS)).cast("int"))
    return roles.table(spark, d, "pages").select(
        "page_id",
        path.alias("path"),
        urls.policy_type(path).alias("policy_type"),
        urls.page_type(path).alias("page_type"),
    )


PATH_TYPES = f"""
WITH paths AS (
  SELECT page_id, [{', '.join(q(p) for p in _PATHS)}][page_id % {len(_PATHS)} + 1] AS path FROM pages
)
SELECT page_id, path,
  CASE WHEN path LIKE '%privacy%' THEN 'privacy_policy' WHEN path LIKE '%return%' OR path LIKE '%refund%'
    THEN 'return_refund_policy' WHEN path LIKE '%shipping%' THEN 'shipping_policy'
    WHEN path LIKE '%terms%' THEN 'terms_of_service' ELSE 'unknown' END AS policy_type,
  CASE WHEN path LIKE '%faq%' THEN 'faq' WHEN path LIKE '%about%' OR path LIKE '%story%' THEN 'about'
    WHEN path LIKE '%contact%' THEN 'contact' ELSE 'unknown' END AS page_type
FROM paths
"""


def search_candidates_(spark: SparkSession, d: str) -> DataFrame:
    link = F.regexp_replace("url", r"example\.net", "facebook.net")
    results = roles.table(spark, d, "pages").select(
        F.col("page_id").alias("rank"), urls.host(F.col("url")).alias("brand_name"), link.alias("link")
    )
    return search_candidates(results).select("brand_name", "rank", "link")


SEARCH_CANDIDATES = f"""
WITH results AS (
  SELECT regexp_extract(url, '://([^/?#]*)', 1) AS brand_name, replace(url, 'example.net', 'facebook.net') AS link,
    page_id AS rank
  FROM pages
)
SELECT brand_name, rank, link FROM results
WHERE NOT {words_in('lower(link)', rules.EXCLUDED_COMPETITOR_SITES)}
"""


def _pair_pages(spark: SparkSession, d: str, html) -> DataFrame:
    return roles.turn_pairs(spark, d).select("conv_id", "turn", html.alias("html"))


def faq_jsonld(spark: SparkSession, d: str) -> DataFrame:
    script = roles.jsonld_script(roles.jsonld(F.col("question"), F.col("answer")))
    broken = F.lit('<script type="application/ld+json">{"@type": "FAQPage", </script>')
    facts = page_facts(_pair_pages(spark, d, F.concat(broken, script)), ["jsonld"])
    return facts.select("conv_id", "turn", F.explode(faq.from_jsonld(F.col("jsonld"))).alias("p")).select(
        "conv_id", "turn", "p.question", "p.answer"
    )


FAQ_JSONLD = f"WITH {PAIRS} SELECT conv_id, turn, question, answer FROM pairs WHERE question <> '' AND answer <> ''"


# One page form for each pair of elements that a question and its answer may stand in.
_FAQ_FORMS = [
    ("<h3>", "</h3><p>-</p><div><b>", "</b></div>"),
    ("<h4>", "</h4><ul></ul><p>", "</p>"),
    ("<details><summary>", "</summary><div>", "</div></details>"),
    ("<button>", "</button><div>", "</div>"),
    ('<span class="big question">', '</span><i class="answer">', "</i>"),
    ('<p class="faq-question">', '</p><section class="faq-answer x">', "</section>"),
    ("<dl><dt>", "</dt><dd>", "</dd></dl>"),
]


def faq_elements(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of turns on pages of seven forms in turn."""
    forms = F.array(*[F.struct(*[F.lit(part).alias(n) for n, part in zip("abc", form)]) for form in _FAQ_FORMS])
    form = F.get(forms, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_FAQ_FORMS))).cast("int"))
    html = F.concat(
        F.lit("<body>"), form["a"], roles.escape(F.col("question")), form["b"], roles.escape(F.col("answer")), form["c"],
        F.lit("</body>"),
    )
    facts = page_facts(_pair_pages(spark, d, html), ["faq_candidates"])
    pairs = faq.from_elements(F.col("faq_candidates"))
    return facts.select("conv_id", "turn", F.explode(pairs).alias("p")).select(
        "conv_id", "turn", "p.question", "p.answer"
    )


_IS_QUESTION = f"(contains(question, '?') OR {words_in('lower(question)', rules.QUESTION_WORDS)})"
FAQ_ELEMENTS = f"""
WITH {PAIRS} SELECT conv_id, turn, {strip('question')} AS question, {strip('answer')} AS answer
FROM pairs WHERE {_IS_QUESTION} AND {strip('question')} <> '' AND length({strip('answer')}) > 10
"""


def faq_items(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(
        F.lit("<body><details><summary>"), roles.escape(F.col("question")),
        F.lit('</summary><div class="accordion-content big">'), roles.escape(F.col("answer")),
        F.lit("</div></details></body>"),
    )
    facts = page_facts(_pair_pages(spark, d, html), ["faq_items"])
    return facts.select("conv_id", "turn", F.explode(faq.from_items(F.col("faq_items"))).alias("p")).select(
        "conv_id", "turn", "p.question", "p.answer"
    )


FAQ_ITEMS = f"""
WITH {PAIRS} SELECT conv_id, turn, {strip('question')} AS question, {strip('answer')} AS answer
FROM pairs WHERE question <> '' AND answer <> ''
"""


def direct_text(spark: SparkSession, d: str) -> DataFrame:
    """Own text of the content element and the postal address, on pages made of documents."""
    html = F.concat(
        F.lit("<body><nav>n</nav><article>"), roles.escape(F.col("text")), F.lit("<b>"), "source",
        F.lit('</b></article><p class="shop-address"> '), "source", F.lit(" Road </p></body>"),
    )
    docs = roles.table(spark, d, "documents").select("doc_id", html.alias("html"))
    facts = page_facts(docs, ["main_text_direct", "address"])
    return facts.select(
        "doc_id",
        F.md5("main_text_direct").alias("text_md5"),
        F.trim("address").alias("address"),
    )


DIRECT_TEXT = f"SELECT doc_id, md5({strip('text')}) AS text_md5, source || ' Road' AS address FROM documents"

QUERIES = {
    "page_scan": (page_scan, PAGE_SCAN),
    "page_features": (page_features, PAGE_FEATURES),
    "brand_name": (brand_name, BRAND_NAME),
    "main_text": (main_text, MAIN_TEXT),
    "direct_text": (direct_text, DIRECT_TEXT),
    "platform_detect": (platform_detect, PLATFORM_DETECT),
    "href_links": (href_links, HREF_LINKS),
    "resolve_links": (resolve_links, RESOLVE_LINKS),
    "link_categories": (link_categories, LINK_CATEGORIES),
    "important_links": (important_links, IMPORTANT_LINKS),
    "pad_defaults": (pad_defaults, PAD_DEFAULTS),
    "hero_links": (hero_links, HERO_LINKS),
    "social_handles": (social_handles, SOCIAL_HANDLES),
    "url_parts": (url_parts, URL_PARTS),
    "path_types": (path_types, PATH_TYPES),
    "search_candidates": (search_candidates_, SEARCH_CANDIDATES),
    "faq_jsonld": (faq_jsonld, FAQ_JSONLD),
    "faq_elements": (faq_elements, FAQ_ELEMENTS),
    "faq_items": (faq_items, FAQ_ITEMS),
}
