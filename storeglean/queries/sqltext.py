"""Small pieces of SQL text shared by the check statements."""


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def decode(x: str) -> str:
    """HTML entities that the given pages hold, decoded; the ampersand last."""
    out = x
    for pattern, char in (
        ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&copy;?", "©"),
        ("&middot;?", "·"), ("&amp;?", "&"),
    ):
        out = f"regexp_replace({out}, {q(pattern)}, {q(char)}, 'g')"
    return out


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def ladder(x: str, rules: dict[str, list[str]], default: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({x}, {q(w)})' for w in words)} THEN {q(label)}"
        for label, words in rules.items()
    )
    return f"CASE {arms} ELSE {default} END"


def words_in(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


ANCHORS = f"""
anchors AS (
  SELECT page_id, url AS page_url, i - 1 AS pos,
    regexp_extract(a, '<a href="([^"]*)">', 1) AS href,
    {strip(decode("regexp_extract(a, '<a href=[^>]*>(.*?)</a>', 1, 's')"))} AS text
  FROM (
    SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS i
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">.*?</a>', 0, 's') AS l FROM pages)
  )
)
"""

TITLES = f"""
titles AS (
  SELECT page_id, url, {decode("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title
  FROM pages
)
"""

PAIRS = """
pairs AS (
  SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'
)
"""

RUNS = """
runs AS (
  SELECT event_id, user_id, 'https://store-' || user_id || '.example.com/' AS website_url,
    ts AS extraction_timestamp, event_type <> 'error' AS extraction_success,
    CASE WHEN event_type = 'error' THEN props END AS error_message,
    value AS extraction_duration_seconds,
    CAST(json_extract(props, '$.k') AS DOUBLE) AS quality_score
  FROM events
)
"""

LATEST = """
latest AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY website_url ORDER BY extraction_timestamp DESC, event_id DESC) = 1
)
"""
