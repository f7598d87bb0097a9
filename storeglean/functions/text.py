"""Whitespace, cleaning and truncation of text columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .arrays import cut

# The white space characters of Unicode and the four separator controls.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_LISTED = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\s\x1c-\x1f"  # for use inside a class, under the flag (?U)
_RUNS = rf"(?U)[{SPACE}]+"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def head(c: Column, n: int | None) -> Column:
    """The first `n` characters; all of them for None."""
    return c if n is None else F.substring(c, 1, n)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def has_text(c: Column) -> Column:
    """True/false, never null: the value is present and not empty."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def longer_than(c: Column, n: int) -> Column:
    return F.coalesce(F.length(c) > n, F.lit(False))


def clean(c: Column, limit: int | None = None) -> Column:
    """Collapse white space; a text over `limit`, if there is one, is cut there and marked with dots."""
    flat = collapse(F.coalesce(c, F.lit("")))
    if limit is None:
        return flat
    return F.when(F.length(flat) > limit, F.concat(head(flat, limit), F.lit("..."))).otherwise(flat)


def scrub(c: Column) -> Column:
    """Drop navigation words, URLs and e-mail addresses. Gaps they leave are kept."""
    out = F.regexp_replace(c, _RUNS, " ")
    # The look-ahead and look-behind change no match; they only rule out most starting points.
    out = F.regexp_replace(
        out, r"(?iu)(?=[mnfhc])(?:Menu|Navigation|Footer|Header|Cookie.*?accept)", ""
    )
    out = F.regexp_replace(out, rf"(?U)https?://[^{SPACE}]+", "")
    word, start = rf"[^{SPACE}]+", rf"(?<![^{SPACE}])"
    out = F.when(out.contains("@"), F.regexp_replace(out, f"(?U){start}{word}@{word}", "")).otherwise(out)
    return strip(out)


def paragraph_head(scrubbed: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Paragraphs of more than 50 characters."""
    paragraphs = F.filter(F.split(scrubbed, "\n\n"), lambda p: F.length(p) > 50)
    return head(F.array_join(cut(paragraphs, limits.paragraphs), "\n\n"), limits.paragraph_chars)


def leading_paragraphs(c: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    return paragraph_head(scrub(c), limits)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: list[str]) -> Column:
    """Constant array of texts, built in one step."""
    return F.expr(f"array({', '.join(sql_text(v) for v in values)})")


def one_of(c: Column, values: list[str]) -> Column:
    return F.array_contains(text_array(values), c)


def any_of(words: list[str]) -> str:
    """Regex that finds any of the literal words."""
    special = set(r"\.^$|?*+()[]{}-")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike(any_of(words))


def first_matching_label(c: Column, ladder: dict[str, list[str]], default: Column | None = None):
    """Label of the first ladder entry one of whose words occurs in `c`."""
    out = None
    for label, words in ladder.items():
        hit = contains_any(c, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))
