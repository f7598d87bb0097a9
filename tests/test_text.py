from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from storeglean.functions import text, urls
from storeglean.functions.contact import clean_emails, clean_phones, find_emails, find_emails_bounded, find_phones, find_phones_grouped
import re

from storeglean import rules

TEXT = StructType([StructField("t", StringType())])


def column(spark, values, make):
    rows = spark.createDataFrame([(v,) for v in values], TEXT).coalesce(1)
    return [r[0] for r in rows.select(make(F.col("t"))).collect()]


def test_strip_matches_python(spark):
    values = ["\t a \n", "\xa0x\u2003", "\x1c\x1fy\x85", "", "   ", "a b"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_collapse_matches_python(spark):
    values = ["a \t b\xa0\u3000c", "\x1d x\x1e\x1e y ", "", "one"]
    assert column(spark, values, text.collapse) == [" ".join(v.split()) for v in values]


def test_clean_cuts_long_text(spark):
    values = ["a" * 5000, "a" * 5001, None]
    assert column(spark, values, lambda c: text.clean(c, 5000)) == ["a" * 5000, "a" * 5000 + "...", ""]


def scrub(t):
    t = re.sub(r"\s+", " ", t)
    t = re.sub(r"(Menu|Navigation|Footer|Header|Cookie.*?accept)", "", t, flags=re.IGNORECASE)
    t = re.sub(r"https?://\S+", "", t)
    return re.sub(r"\S+@\S+", "", t).strip()


words = st.sampled_from(
    ["menu", "COOKIE", "accept", "a@b", "@", "@x", "x@", "a@@b", "http://q?@z", "https://", "é@ü", " ", "\n", "\xa0", "w", "\n\n"]
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(words, max_size=14).map("".join), min_size=60, max_size=60))
def test_scrub_matches_sequential_rules(spark, values):
    assert column(spark, values, text.scrub) == [scrub(v) for v in values]


def test_leading_paragraph(spark):
    rows, whole = ["x" * 60 + "\n\n" + "y" * 2100, "short"], "x" * 60 + " " + "y" * 2100
    assert column(spark, rows, text.leading_paragraphs) == [whole, ""]
    assert column(spark, rows, lambda c: text.leading_paragraphs(c, rules.DISPLAY)) == [whole[:2000], ""]


pieces = st.sampled_from(["a", "b.c", "@", "@x.com", ".co", "5", "%", " ", "é", "-", "_z@q.org", ".png"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(pieces, max_size=12).map("".join), min_size=60, max_size=60))
def test_find_emails_matches_plain_pattern(spark, values):
    wanted = [list(dict.fromkeys(re.findall(rules.EMAIL_PATTERN, v))) for v in values]
    assert column(spark, values, find_emails) == wanted


digits = st.sampled_from(["1", "23", "456", "7890", "-", ".", " ", "(", ")", "+", "x", "\xa0"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(digits, max_size=24).map("".join), min_size=60, max_size=60))
def test_find_phones_matches_sequential_rules(spark, values):
    def sequential(v):
        first = re.findall(rules.PHONE_PATTERN, v)[:5]
        return [p for p in first if len(re.sub(r"\D", "", p)) >= 10][:3]

    assert column(spark, values, lambda c: find_phones(c, rules.DISPLAY)) == [sequential(v) for v in values]


def test_all_numbers_are_looked_at_or_the_first_five(spark):
    t = "1111 x 2222 x 3333 x 4444 x 5555 x 212-555-0199"
    assert column(spark, [t], find_phones) == [["212-555-0199"]]
    assert column(spark, [t], lambda c: find_phones(c, rules.DISPLAY)) == [[]]


def test_grouped_phone_pattern_gives_whole_matches(spark):
    assert column(spark, ["call +1 212-555-0199 now"], find_phones_grouped) == [["+1 212-555-0199"]]


def test_bounded_emails(spark):
    t = "A@B.co a@b.co x@example.com icon@2x.png ok@shop.org"
    assert column(spark, [t], find_emails_bounded) == [["a@b.co", "ok@shop.org"]]


def test_clean_emails_and_phones(spark):
    row = spark.range(1).select(
        clean_emails(F.expr("array(' A@B.co', 'a@b.co', 'x@example.com', 'c@d.e', 'f@g.h', 'i@j.k')")).alias("e"),
        clean_phones(F.expr("array('(212) 555-0199', '212.555.0199', '12', '+44 20 7946 0958')")).alias("p"),
    ).first()
    assert row["e"] == ["a@b.co", "c@d.e", "f@g.h", "i@j.k"]
    assert row["p"] == ["(212) 555-0199", "+44 20 7946 0958"]


def test_url_forms(spark):
    values = ["A.com/", "https://A.com", "http://a.com:80/x/", "https://a.com?q=1", "https://a.com/p//"]
    assert column(spark, values, urls.canonical) == [
        "https://a.com/", "https://a.com/", "http://a.com/x", "https://a.com/?q=1", "https://a.com/p"
    ]
    assert column(spark, ["https://www.shop-one.co/", "http://a.www.b.c"], urls.brand_from_url) == ["Shop-one", "A"]
    assert column(spark, ["https://a/b", "a.com", "mailto:x", None], urls.is_valid) == [True, False, False, False]


def test_resolve_matches_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["https://a.com", "https://a.com/p/q?x=1#f", "http://a.com/p/"]
    refs = ["/x", "x", "../x", "./x/..", "//h/y", "#top", "?q=2", "mailto:a@b", "https://o.org/z", "", "/a/../../b", "x/./y/", ".."]
    pairs = [(b, r) for b in bases for r in refs]
    rows = spark.createDataFrame(pairs, "b string, r string").coalesce(1)
    found = [x[0] for x in rows.select(urls.resolve(F.col("b"), F.col("r"))).collect()]
    assert dict(zip(pairs, found)) == {(b, r): urljoin(b, r) for b, r in pairs}


def test_cheaper_patterns_match_the_plain_ones(spark):
    """The plain patterns, with flags and without look-aheads, find the same in odd texts."""
    import random

    from pyspark.sql import functions as F

    from storeglean import rules
    from storeglean.functions import contact, social, text

    rng = random.Random(4)
    parts = [
        " ", "  ", "\t", "\n", "\n\n", "\x1c", "\x85", " ", "  ", " ", "Menu", "mENU", "navigatıon", "Footer", "HEADER", "Cookie", "cookies",
        "Kookie", "cooKie", "accept", "ACCEPT", "x@y", "@", "a@b.c", "http://", "https://a.b/c", "://", "h", "word", "(212) 555-0100", "+1 212 555 0100", "(", "+", "55",
        "instagram.com/", "Instagram.COM/acme", "facebook.com/sharer", "FaceBook.com/x?y", "youtube.com/c/@", "İnstagram.com/z", "tiktok.com/@t", '"', "pinterest.com/share",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    space, c = r"\s\x1c-\x1f", F.col("t")
    flat = F.regexp_replace(c, rf"(?U)[{space}]+", " ")
    plain = F.regexp_replace(flat, r"(?iu)(?:Menu|Navigation|Footer|Header|Cookie.*?accept)", "")
    plain = F.regexp_replace(plain, rf"(?U)https?://[^{space}]+", "")
    plain = F.regexp_replace(plain, rf"(?U)[^{space}]+@[^{space}]+", "")
    phones = F.regexp_extract_all(c, F.lit("(?U)" + rules.PHONE_PATTERN.replace(r"\s", space)), F.lit(0))
    first = {p: F.regexp_extract(c, social._regex(r), 1) for p, r in rules.SOCIAL_PATTERNS.items()}
    found = social.find_handles(c)
    rows = df.select(
        "t",
        text.scrub(c).alias("scrub"), text.strip(plain).alias("plain_scrub"),
        text.collapse(c).alias("collapse"), F.trim(flat).alias("plain_collapse"),
        contact.find_phones(c).alias("phones"), F.filter(phones, lambda p: F.length(contact.digits(p)) >= rules.PHONE_MIN_DIGITS).alias("plain_phones"),
        F.transform(found, lambda h: F.concat(h["platform"], F.lit(" "), h["handle"])).alias("handles"), F.struct(*[v.alias(p) for p, v in first.items()]).alias("plain_handles"),
    ).collect()
    for r in rows:
        assert r["scrub"] == r["plain_scrub"], r["t"]
        assert r["collapse"] == r["plain_collapse"] and r["phones"] == r["plain_phones"], r["t"]
        if r["t"] is None:
            continue
        wanted = {p: h for p, h in r["plain_handles"].asDict().items() if h and h not in rules.PSEUDO_HANDLES}
        assert r["handles"] == [f"{p} {h}" for p, h in wanted.items()], r["t"]
