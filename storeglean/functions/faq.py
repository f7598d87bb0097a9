"""Question and answer pairs from JSON-LD blocks, page elements and plain text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules, schemas
from .arrays import cut, let
from .text import blank_to_null, contains_any, has_text, head, longer_than, sql_text, strip

_QUESTION_LINE = r"^(?:Q:|Question:|Q\.)|\?$"
_QUESTION_LABEL = r"(?U)^(Q:|Question:|Q\.)\s*"
_ANSWER_LINE = r"^(?:A:|Answer:|A\.)"
_ANSWER_LABEL = r"(?U)^(A:|Answer:|A\.)\s*"


def is_question(text: Column) -> Column:
    """Has a question mark, or one of the question words anywhere inside."""
    return F.coalesce(
        text.contains("?") | contains_any(F.lower(text), rules.QUESTION_WORDS), F.lit(False)
    )


def _pair(question: Column, answer: Column, category: Column, is_default: bool = False) -> Column:
    return F.struct(
        question.alias("question"),
        answer.alias("answer"),
        category.alias("category"),
        F.lit(is_default).alias("is_default"),
    )


def _general() -> Column:
    return F.lit("general")


def from_jsonld(scripts: Column, answer_limit: int | None = None) -> Column:
    """Pairs of every FAQPage block; other and broken blocks give nothing."""
    blocks = F.filter(
        F.transform(scripts, lambda s: F.from_json(s, schemas.FAQ_BLOCK)),
        lambda b: b["@type"] == "FAQPage",
    )
    items = F.flatten(
        F.filter(F.transform(blocks, lambda b: b["mainEntity"]), lambda m: m.isNotNull())
    )
    valid = F.filter(
        items,
        lambda m: (m["@type"] == "Question")
        & has_text(m["name"])
        & has_text(m["acceptedAnswer"]["text"]),
    )

    def pair(m: Column) -> Column:
        answer = m["acceptedAnswer"]["text"]
        return _pair(m["name"], head(answer, answer_limit) if answer_limit else answer, _general())

    return F.transform(valid, pair)


def from_elements(candidates: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Pairs of the first element pattern that gives any."""
    if limits.faqs is not None:
        candidates = F.filter(candidates, lambda c: c["pos"] < limits.faqs)
    valid = F.filter(
        candidates,
        lambda c: is_question(c["question"])
        & has_text(c["question"])
        & longer_than(c["answer"], rules.FAQ_ANSWER_MIN),
    )
    best = F.array_min(F.transform(valid, lambda c: c["pattern"]))
    return F.transform(
        F.filter(valid, lambda c: c["pattern"] == best),
        lambda c: _pair(c["question"], head(c["answer"], limits.faq_answer_chars), _general()),
    )


def from_items(items: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Other form: question and answer inside one item element."""
    valid = F.filter(cut(items, limits.faq_items), lambda c: has_text(c["question"]) & has_text(c["answer"]))
    return F.transform(
        valid,
        lambda c: _pair(
            strip(c["question"]), head(strip(c["answer"]), limits.faq_answer_chars), F.lit("General")
        ),
    )


def of_page(jsonld: Column, candidates: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """JSON-LD pairs, or element pairs where the page has none."""
    return let(
        from_jsonld(jsonld),
        lambda found: F.when(F.size(found) > 0, found).otherwise(from_elements(candidates, limits)),
    )


def default_pairs() -> Column:
    rows = ", ".join(
        f"named_struct('question', {sql_text(q)}, 'answer', {sql_text(a)}, 'category', {sql_text(c)},"
        " 'is_default', true)"
        for q, a, c in rules.DEFAULT_FAQS
    )
    return F.expr(f"array({rows})")


def pad_pairs(pairs: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Three default pairs where there are none."""
    return cut(F.when(F.coalesce(F.size(pairs) > 0, F.lit(False)), pairs).otherwise(default_pairs()), limits.faqs)


def from_text(text: Column, limits: rules.Limits = rules.KEEP_ALL) -> Column:
    """Pairs in Q:/A: text, in one pass over its lines and without a shuffle.

    A question line opens a block that ends before the next one. The first three lines of a block are its answer, and answer
    lines wherever they stand in it. Blocks without a question or an answer give no pair.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")

    def pair(block: Column) -> Column:
        parts = F.transform(
            F.filter(block["body"], lambda line, i: (i < 3) | line.rlike(_ANSWER_LINE)),
            lambda line: F.when(line.rlike(_ANSWER_LINE), F.regexp_replace(line, _ANSWER_LABEL, "")).otherwise(line),
        )
        return F.struct(
            head(block["question"], limits.faq_question_chars).alias("question"),
            head(F.array_join(parts, " "), limits.faq_answer_chars).alias("answer"),
        )

    def pairs(s: Column) -> Column:
        starts, held = s["starts"], s["lines"]

        def block(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(held))
            return F.struct(
                F.regexp_replace(F.get(held, at), _QUESTION_LABEL, "").alias("question"),
                F.slice(held, at + 2, F.greatest(end - at - 1, F.lit(0))).alias("body"),
            )

        ready = F.filter(F.transform(starts, block), lambda b: has_text(b["question"]) & (F.size(b["body"]) > 0))
        return F.transform(cut(ready, limits.faqs), pair)

    def opened(held: Column) -> Column:
        places = F.transform(held, lambda line, i: F.when(line.rlike(_QUESTION_LINE), i))
        return F.struct(held.alias("lines"), F.filter(places, lambda i: i.isNotNull()).alias("starts"))

    return let(let(lines, opened), pairs)


def or_general(category: Column) -> Column:
    return F.coalesce(blank_to_null(category), F.lit("General"))
