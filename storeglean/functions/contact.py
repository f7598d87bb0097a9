"""E-mail addresses and phone numbers in raw text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .arrays import cut, keep_first_by
from .text import SPACE, any_of, contains_any, one_of, strip

# Same matches as the plain pattern. It is tried only where a run of address characters starts
# or the last match ended, because inside such a run no other starting point can succeed.
_EMAIL = r"(?:(?<![a-zA-Z0-9._%+-])|\G)" + rules.EMAIL_PATTERN
_PHONE = "(?U)" + rules.PHONE_PATTERN.replace(r"\s", SPACE)
_PHONE_GROUPED = "(?U)" + rules.PHONE_PATTERN_GROUPED.replace(r"\s", SPACE)


def _with_at(text: Column, found: Column) -> Column:
    return F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>"))


def _endings(suffixes: list[str]) -> str:
    return f"({any_of(suffixes)})$"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def find_emails(text: Column) -> Column:
    """Distinct addresses in first-seen order, spelled as found."""
    return _with_at(text, F.array_distinct(F.regexp_extract_all(text, F.lit(_EMAIL), F.lit(0))))


def find_emails_bounded(text: Column) -> Column:
    """Word-bounded form: lower-cased, placeholder domains and image names left out."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + rules.EMAIL_PATTERN_BOUNDED), F.lit(0))
    kept = F.filter(
        found,
        lambda e: ~one_of(F.lower(F.element_at(F.split(e, "@"), -1)), rules.PLACEHOLDER_EMAIL_DOMAINS)
        & ~e.rlike(_endings(rules.PLACEHOLDER_EMAIL_SUFFIXES)),
    )
    return _with_at(text, F.array_distinct(F.transform(kept, F.lower)))


def clean_emails(
    emails: Column, placeholders: list[str] | None = None, limits: rules.Limits = rules.KEEP_ALL
) -> Column:
    """Lower-case, drop placeholders, keep first of each."""
    words = rules.PLACEHOLDER_EMAIL_PARTS if placeholders is None else placeholders
    plain = F.transform(emails, lambda e: strip(F.lower(e)))
    kept = F.filter(plain, lambda e: ~contains_any(e, words)) if words else plain
    return cut(F.array_distinct(kept), limits.emails)


def clean_emails_strict(emails: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """As `clean_emails`, with the longer domain and extension lists."""
    plain = F.transform(emails, lambda e: strip(F.lower(e)))
    kept = F.filter(
        plain,
        lambda e: ~one_of(F.element_at(F.split(e, "@"), -1), rules.PLACEHOLDER_EMAIL_DOMAINS_ALL)
        & ~e.rlike(_endings(rules.PLACEHOLDER_EMAIL_SUFFIXES_ALL)),
    )
    return cut(F.array_distinct(kept), limits.emails)


def find_phones(text: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Number-like matches with ten digits or more."""
    found = F.regexp_extract_all(text, F.lit(_PHONE), F.lit(0))
    looked_at = cut(found, limits.phones_scanned)
    kept = F.filter(looked_at, lambda p: F.length(digits(p)) >= rules.PHONE_MIN_DIGITS)
    return cut(kept, limits.phones)


def find_phones_grouped(text: Column) -> Column:
    """Other pattern: every whole match of 10 to 15 characters counting digits and plus signs."""
    found = F.regexp_extract_all(text, F.lit(_PHONE_GROUPED), F.lit(0))
    kept = F.filter(
        found,
        lambda p: F.length(F.regexp_replace(p, r"[^0-9+]", "")).between(
            rules.PHONE_MIN_DIGITS, rules.PHONE_MAX_DIGITS
        ),
    )
    return F.array_distinct(kept)


def clean_phones(phones: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """First number of each digit sequence, written as found."""
    kept = F.filter(phones, lambda p: F.length(digits(p)) >= rules.PHONE_MIN_DIGITS)
    return cut(keep_first_by(kept, digits), limits.phones)
