"""Queries over documents and conversations as page and policy text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import contact, faq, industry, lists, page, text
from ..operators.keyed import first_valid
from . import roles
from .sqltext import PAIRS, ladder, q, strip, words_in


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "documents")


def extract_emails(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).select(
        "doc_id", F.posexplode(contact.find_emails(F.col("text"))).alias("pos", "email")
    )
    return found.select("doc_id", "pos", "email")


EXTRACT_EMAILS = rf"""
WITH found AS (
  SELECT doc_id, unnest(l) AS email, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, {q(rules.EMAIL_PATTERN)}) AS l FROM documents)
), firsts AS (SELECT doc_id, email, min(i) AS i FROM found GROUP BY doc_id, email)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, email FROM firsts
"""

_PLACEHOLDERS = ["mail1.example.com", "mail7"]


def clean_emails(spark: SparkSession, d: str) -> DataFrame:
    raw = contact.find_emails(F.col("text"))
    upper = F.concat(F.transform(raw, F.upper), raw)
    return (
        _documents(spark, d)
        .select("doc_id", upper.alias("emails"))
        .where(F.size("emails") > 0)
        .select(
            "doc_id",
            F.array_join(contact.clean_emails(F.col("emails"), _PLACEHOLDERS), ",").alias("kept"),
            F.size(contact.clean_emails(F.col("emails"))).alias("kept_by_default"),
            F.size(contact.clean_emails_strict(F.col("emails"))).alias("kept_strict"),
        )
    )


CLEAN_EMAILS = f"""
WITH found AS (
  SELECT doc_id, unnest(l) AS email, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, {q(rules.EMAIL_PATTERN)}) AS l FROM documents)
), firsts AS (
  SELECT doc_id, lower(email) AS email, min(i) AS i,
    NOT {words_in('lower(email)', _PLACEHOLDERS)} AS given,
    NOT {words_in('lower(email)', rules.PLACEHOLDER_EMAIL_PARTS)} AS dflt,
    split_part(lower(email), '@', 2) NOT IN ({', '.join(q(x) for x in rules.PLACEHOLDER_EMAIL_DOMAINS_ALL)})
      AND NOT regexp_matches(lower(email), '\\.(png|jpg|jpeg|gif|svg|webp)$') AS strict
  FROM found GROUP BY doc_id, lower(email)
)
SELECT doc_id,
  coalesce(string_agg(email, ',' ORDER BY i) FILTER (WHERE given), '') AS kept,
  count(*) FILTER (WHERE dflt) AS kept_by_default,
  count(*) FILTER (WHERE strict) AS kept_strict
FROM firsts GROUP BY doc_id
"""


def extract_phones(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).select(
        "doc_id", F.posexplode(contact.find_phones(F.col("text"))).alias("pos", "phone")
    )
    return found.select("doc_id", "pos", "phone")


_PHONES = f"""
found AS (
  SELECT doc_id, phone, i, regexp_replace(phone, '[^0-9]', '', 'g') AS digits
  FROM (
    SELECT doc_id, unnest(l) AS phone, generate_subscripts(l, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, {q(rules.PHONE_PATTERN)}) AS l FROM documents)
  )
)
"""
EXTRACT_PHONES = f"""
WITH {_PHONES}, kept AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, phone
  FROM found WHERE length(digits) >= {rules.PHONE_MIN_DIGITS}
)
SELECT * FROM kept
"""


def clean_phones(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract_all("text", F.lit("(?U)" + rules.PHONE_PATTERN), F.lit(0))
    # Each number twice, the second time with another spelling of the same digits.
    twice = F.concat(raw, F.transform(raw, lambda p: F.concat(F.lit("+"), p)))
    found = _documents(spark, d).select(
        "doc_id", F.posexplode(contact.clean_phones(twice)).alias("pos", "phone")
    )
    return found.select("doc_id", "pos", "phone")


CLEAN_PHONES = f"""
WITH {_PHONES}, firsts AS (
  SELECT doc_id, arg_min(phone, i) AS phone, min(i) AS i FROM found
  WHERE length(digits) >= {rules.PHONE_MIN_DIGITS} GROUP BY doc_id, digits
), kept AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, phone FROM firsts
)
SELECT * FROM kept
"""


def embedded_metadata(spark: SparkSession, d: str) -> DataFrame:
    kind = F.upper("event_type")
    settings = F.concat(
        F.lit('<script>s={"currency":"'), F.left(kind, F.lit(3)), F.lit('",'),
        F.when(F.col("event_type") != "error", F.concat(F.lit('"country":"'), F.left(kind, F.lit(2)), F.lit('",'))).otherwise(F.lit("")),
        F.format_string('"shop_name":"%s-%d","p":', "event_type", "user_id"), F.col("props"), F.lit("}</script>"),
    )
    events = roles.table(spark, d, "events").select("event_id", settings.alias("html"))
    return events.select("event_id", page.embedded_settings(F.col("html")).alias("s")).select("event_id", "s.*")


EMBEDDED_METADATA = """
SELECT event_id, upper(left(event_type, 3)) AS currency,
  CASE WHEN event_type <> 'error' THEN upper(left(event_type, 2)) END AS country,
  event_type || '-' || user_id AS shop_name
FROM events
"""


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    cleaned = text.clean(F.col("text"))
    return _documents(spark, d).select("doc_id", cleaned.alias("t")).select(
        "doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5")
    )


CLEAN_TEXT = rf"""
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM flat
"""


def scrub_text(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat_ws(" ", F.lit("Menu"), "text", F.lit("see https://a.b/c?d=1 Cookie notice: accept"))
    rows = _documents(spark, d).select("doc_id", noisy.alias("text"))
    return rows.select("doc_id", text.scrub(F.col("text")).alias("t")).select(
        "doc_id", F.md5("t").alias("text_md5"), F.md5(text.paragraph_head(F.col("t"))).alias("head_md5")
    )


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as paragraphs, of which those of more than 50 characters stay."""
    split = F.regexp_replace("text", r"[.!?] ", ".\n\n")
    head = text.paragraph_head(split)
    return _documents(spark, d).select("doc_id", F.length(head).alias("n_chars"), F.md5(head).alias("head_md5"))


PARAGRAPHS = r"""
WITH kept AS (
  SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '[.!?] ', '.' || chr(10) || chr(10), 'g'), chr(10) || chr(10)),
    lambda p: length(p) > 50), chr(10) || chr(10)) AS head
  FROM documents
)
SELECT doc_id, CAST(length(head) AS INT) AS n_chars, md5(head) AS head_md5 FROM kept
"""


SCRUB_TEXT = r"""
WITH scrubbed AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    'Menu ' || text || ' see https://a.b/c?d=1 Cookie notice: accept',
    '\s+', ' ', 'g'), '(?i)(Menu|Navigation|Footer|Header|Cookie.*?accept)', '', 'g'),
    'https?://\S+', '', 'g'), '\S+@\S+', '', 'g'), '^\s+|\s+$', '', 'g') AS t
  FROM documents
)
SELECT doc_id, md5(t) AS text_md5,
  md5(CASE WHEN length(t) > 50 THEN t ELSE '' END) AS head_md5
FROM scrubbed
"""


def faq_lines(spark: SparkSession, d: str) -> DataFrame:
    # Clauses that end in a comma become questions; some lines become answers.
    questions = F.regexp_replace("text", ", ", "?\n")
    marked = F.regexp_replace(questions, r"(?m)^(Th|De|En|É)", "A: $1")
    marked = F.regexp_replace(marked, r"(?m)^(an|la|in)", "Q. $1")
    found = _documents(spark, d).select("doc_id", F.posexplode(faq.from_text(marked)).alias("pos", "p"))
    return found.select("doc_id", "pos", "p.question", "p.answer")


FAQ_LINES = rf"""
WITH texts AS (
  SELECT doc_id, regexp_replace(regexp_replace(replace(text, ', ', '?' || chr(10)),
    '(?m)^(Th|De|En|É)', 'A: \1', 'g'), '(?m)^(an|la|in)', 'Q. \1', 'g') AS t
  FROM documents
), lines AS (
  SELECT doc_id, {strip('s')} AS line, i
  FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM texts))
), kinds AS (
  SELECT doc_id, line, i, regexp_matches(line, '^(Q:|Question:|Q\.)') OR ends_with(line, '?') AS is_q,
    regexp_matches(line, '^(A:|Answer:|A\.)') AS is_a
  FROM lines WHERE line <> ''
), blocks AS (
  SELECT *, sum(CAST(is_q AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM kinds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, block, is_q ORDER BY i) AS k FROM blocks
), pairs AS (
  SELECT doc_id, block,
    max(regexp_replace(line, '^(Q:|Question:|Q\.)\s*', '')) FILTER (WHERE is_q) AS question,
    string_agg(regexp_replace(line, '^(A:|Answer:|A\.)\s*', ''), ' ' ORDER BY i)
      FILTER (WHERE NOT is_q AND (is_a OR k <= 3)) AS answer
  FROM numbered WHERE block > 0 GROUP BY doc_id, block
), kept AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS pos,
    question, answer
  FROM pairs WHERE question <> '' AND answer IS NOT NULL
)
SELECT * FROM kept
"""


def faq_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = roles.turn_pairs(spark, d).where(
        faq.is_question(F.col("question")) & (F.length("answer") > rules.FAQ_ANSWER_MIN)
    )
    return pairs.select("conv_id", "turn", "question", "answer")


FAQ_PAIRS = f"""
WITH {PAIRS} SELECT conv_id, turn, question, answer FROM pairs
WHERE (contains(question, '?') OR {words_in('lower(question)', rules.QUESTION_WORDS)}) AND length(answer) > 10
"""

_LANGS = ["en", "fr", "de", "es"]


def first_valid_path(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    tried = docs.where(F.col("lang").isin(_LANGS)).select(
        "source",
        F.array_position(F.lit(_LANGS), F.col("lang")).alias("place"),
        "doc_id",
        "lang",
        F.length("text").alias("length"),
    )
    chosen = first_valid(tried, ["source"], ["place", "doc_id"], F.col("length") > rules.POLICY_MIN)
    texts = docs.select("doc_id", F.md5("text").alias("text_md5"))
    return chosen.join(texts, "doc_id").select("source", "lang", "doc_id", "text_md5")


FIRST_VALID_PATH = f"""
SELECT source, lang, doc_id, md5(text) AS text_md5
FROM documents WHERE length(text) > {rules.POLICY_MIN} AND lang IN ({', '.join(q(x) for x in _LANGS)})
QUALIFY row_number() OVER (PARTITION BY source
  ORDER BY list_position([{', '.join(q(x) for x in _LANGS)}], lang), doc_id) = 1
"""


def industry_names(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", industry.long_name(F.col("text")).alias("industry"))


INDUSTRY_NAMES = f"""
SELECT doc_id, {ladder('lower(text)', rules.INDUSTRY_LONG_NAMES, q(rules.INDUSTRY_LONG_DEFAULT))} AS industry
FROM documents
"""


def url_list_parse(spark: SparkSession, d: str) -> DataFrame:
    site = F.replace("url", F.lit("example"), F.lit("shopsite"))
    listed = F.to_json(F.array(F.concat(site, F.lit("/")), F.lit("https://example1.com"), F.lit("note"), site))
    response = (
        F.when(F.col("url").contains("/en/"), listed)
        .when(F.col("url").contains("/fr/"), F.concat(F.lit("Here:\n```json\n"), listed, F.lit("\n```\nBye")))
        .when(F.col("url").contains("/de/"), F.lit('{"stores": []}'))
        .otherwise(F.concat(F.lit("Try "), site, F.lit(" or https://www.example.org!")))
    )
    rows = roles.table(spark, d, "pages").select("page_id", response.alias("response"))
    return rows.select(
        "page_id",
        F.array_join(lists.competitor_urls(F.col("response")), " ").alias("urls"),
        F.array_join(lists.industry_default_urls(F.col("response"), 2), " ").alias("defaults"),
    )


URL_LIST_PARSE = """
WITH sites AS (
  SELECT page_id, url, replace(url, 'example', 'shopsite') AS site,
    regexp_extract(replace(url, 'example', 'shopsite'), 'https?://[a-zA-Z0-9\\-\\.]+\\.[a-zA-Z]{2,}') AS origin
  FROM pages
)
SELECT page_id,
  CASE WHEN contains(url, '/en/') OR contains(url, '/fr/')
      THEN regexp_replace(site || '/', '/+$', '') || ' ' || rtrim(site, '/')
    WHEN contains(url, '/de/') THEN '' ELSE origin END AS urls,
  CASE WHEN contains(url, '/en/') THEN site || '/ note'
    WHEN contains(url, '/fr/') THEN origin || ' https://example1.com'
    WHEN contains(url, '/de/') THEN '' ELSE origin || ' https://www.example.org' END AS defaults
FROM sites
"""

QUERIES = {
    "extract_emails": (extract_emails, EXTRACT_EMAILS),
    "clean_emails": (clean_emails, CLEAN_EMAILS),
    "extract_phones": (extract_phones, EXTRACT_PHONES),
    "clean_phones": (clean_phones, CLEAN_PHONES),
    "embedded_metadata": (embedded_metadata, EMBEDDED_METADATA),
    "clean_text": (clean_text, CLEAN_TEXT),
    "scrub_text": (scrub_text, SCRUB_TEXT),
    "paragraphs": (paragraphs, PARAGRAPHS),
    "faq_lines": (faq_lines, FAQ_LINES),
    "faq_pairs": (faq_pairs, FAQ_PAIRS),
    "first_valid_path": (first_valid_path, FIRST_VALID_PATH),
    "industry_names": (industry_names, INDUSTRY_NAMES),
    "url_list_parse": (url_list_parse, URL_LIST_PARSE),
}
