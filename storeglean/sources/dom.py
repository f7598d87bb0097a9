"""Structural facts of HTML pages.

The only Python on the data path. It reports where things are on a page; every decision about
them (what counts, what is kept, in which order) is made later by JVM-side functions. Pages are
parsed in Arrow batches, in whatever partitions the scan produced, without a shuffle.
"""

import re
import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain, repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .. import rules, schemas

# The parser travels with the job, so that executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__.split(".")[0]])

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HIDDEN = frozenset(["script", "style", "template"])
_DROPPED = frozenset(["nav", "header", "footer", "script", "style"])
_PRICE = re.compile("price|money")
_CONTAINER = re.compile("footer|nav|menu|links")
#: Bytes of html that are parsed before their facts are sent on; a longer page is sent by itself.
_PART_BYTES = 1 << 20


class _Page(HTMLParser):
    """Elements in document order, each with its text range and its last descendant."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parents = [], [], []
        self.last, self.first_piece, self.end_piece = [], [], []
        self.pieces, self.owners = [], []
        self._open = []
        self._held = Counter()  # open elements by tag
        self._anchor = None
        self._fresh = True
        self.feed(html)
        self.close()
        self._pop_to(0)
        self._of_tag, self._owned = {}, {}
        for i, tag in enumerate(self.tags):
            self._of_tag.setdefault(tag, []).append(i)
        for k, owner in enumerate(self.owners):
            self._owned.setdefault(owner, []).append(k)

    def updatepos(self, i, j):
        """Lines and columns are not counted: nothing here reports them."""
        return j

    def handle_starttag(self, tag, attrs):
        self._fresh = True
        if tag == "a":  # ends one that was not closed
            if self._anchor is not None:
                self._pop_to(self._anchor)
            self._anchor = len(self._open)
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parents.append(self._open[-1] if self._open else -1)
        self.last.append(i)
        self.first_piece.append(len(self.pieces))
        self.end_piece.append(len(self.pieces))
        if tag not in _VOID:
            self._open.append(i)
            self._held[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._pop_to(len(self._open) - 1)

    def handle_endtag(self, tag):
        self._fresh = True
        if not self._held[tag]:
            return
        for depth in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[depth]] == tag:
                self._pop_to(depth)
                return

    def handle_comment(self, data):
        self._fresh = True

    def handle_data(self, data):
        if self._fresh:
            self.pieces.append(data)
            self.owners.append(self._open[-1] if self._open else -1)
            self._fresh = False
        else:
            self.pieces[-1] += data

    def _pop_to(self, depth):
        self._fresh = True
        if self._anchor is not None and depth <= self._anchor:
            self._anchor = None
        for i in self._open[depth:]:
            self._held[self.tags[i]] -= 1
            self.last[i] = len(self.tags) - 1
            self.end_piece[i] = len(self.pieces)
        del self._open[depth:]

    # -- lookups

    def find(self, tag=None, css=None, within=None) -> list[int]:
        lo, hi = (0, len(self.tags) - 1) if within is None else (within + 1, self.last[within])
        if tag is None:
            found = range(lo, hi + 1)
        else:
            same = self._of_tag.get(tag, [])
            found = same[bisect_left(same, lo) : bisect_right(same, hi)]
        return [i for i in found if css is None or css in self.classes(i)]

    def select(self, selector: str) -> list[int]:
        tag, _, css = selector.partition(".")
        return self.find(tag or None, css or None)

    def first(self, *args, **kwargs):
        return next(iter(self.find(*args, **kwargs)), None)

    def within(self, i, chosen: list[int]) -> Iterator[int]:
        """Those of the elements `chosen`, in document order, that lie inside an element."""
        for at in range(bisect_right(chosen, i), len(chosen)):
            if chosen[at] > self.last[i]:
                return
            yield chosen[at]

    def classes(self, i) -> list[str]:
        return self.attrs[i].get("class", "").split()

    def class_like(self, i, pattern) -> bool:
        return bool(pattern.search(self.attrs[i].get("class", "")))

    def texts(self, i, dropped=frozenset()) -> list[str]:
        return [
            self.pieces[k]
            for k in range(self.first_piece[i], self.end_piece[i])
            if k not in dropped and self.tags[self.owners[k]] not in _HIDDEN
        ]

    def text(self, i) -> str:
        return "".join(self.texts(i)).strip()

    def own_texts(self, i) -> list[str]:
        return [self.pieces[k] for k in self._owned.get(i, ())]

    def covered(self, chosen) -> bytearray:
        """For each element whether it lies inside one of the elements `chosen`."""
        marks, reach, out = set(chosen), -1, bytearray(len(self.tags))
        for i, last in enumerate(self.last):
            out[i] = i <= reach
            if i in marks:
                reach = max(reach, last)
        return out


def _joined(parts) -> str:
    return " ".join(p for p in (t.strip() for t in parts) if p)


def _main_text(page: _Page, drop: bool) -> str | None:
    gone, upto = set(), 0
    alive = [i for i in page.find("main") + page.find("div", "page-content")]
    if drop:
        dropped = [i for i, tag in enumerate(page.tags) if tag in _DROPPED]
        for i in dropped:  # a part inside another one is in its range already
            gone.update(range(max(upto, page.first_piece[i]), page.end_piece[i]))
            upto = max(upto, page.end_piece[i])
        covered = page.covered(dropped)
        alive = [i for i in alive if not covered[i]]
        alive += page.find("body")[:1]
    return _joined(page.texts(alive[0], gone)) if alive else None


def _direct_text(page: _Page) -> str:
    for selector in rules.CONTENT_SELECTORS + ["body"]:
        parts = [t for i in page.select(selector) for t in page.own_texts(i)]
        if parts:
            return " ".join(parts).strip()
    return ""


def _anchors(page: _Page, product: str) -> list[dict]:
    in_footer, in_top = page.covered(page.find("footer")), page.covered(page.find("header") + page.find("nav"))
    images, marked = page.find("img"), [k for k, attrs in enumerate(page.attrs) if attrs.get("class")]
    prices = [k for k in marked if page.class_like(k, _PRICE)]
    shown = [k for k in marked if _price_like(page, k)]
    price_text: dict[int, str] = {}
    rows = []
    for i in page.find("a"):
        attrs, href = page.attrs[i], page.attrs[i].get("href")
        texts = page.texts(i)
        row = {
            "idx": i,
            "href": href,
            "text": "".join(texts).strip(),
            "first_text": texts[0] if texts else None,
            "title": attrs.get("title"),
            "aria_label": attrs.get("aria-label"),
            "img_src": None,
            "parent_price": None,
            "inner_price": None,
            "in_footer": bool(in_footer[i]),
            "in_header_nav": bool(in_top[i]),
        }
        if href and re.search(product, href):
            image = next(page.within(i, images), None)
            row["img_src"] = page.attrs[image].get("src") if image is not None else None
            row["inner_price"] = next((t for k in page.within(i, shown) for t in page.own_texts(k)), None)
            near = next(page.within(page.parents[i], prices), None) if page.parents[i] >= 0 else None
            if near is not None:
                if near not in price_text:
                    price_text[near] = page.text(near)
                row["parent_price"] = price_text[near]
        rows.append(row)
    return rows


def _price_like(page: _Page, i: int) -> bool:
    return "money" in page.classes(i) or "price" in page.attrs[i].get("class", "")


def _link_regions(page: _Page) -> list[dict]:
    heads = [page.first(tag) for tag in ("footer", "nav", "header")]
    boxes = [i for i in page.find("div") if page.class_like(i, _CONTAINER)]
    found = [(i, -1) for i in heads if i is not None] + [(i, k) for k, i in enumerate(boxes)]
    return [{"start": i, "stop": page.last[i], "box": k} for i, k in found]


def _faq_candidates(page: _Page) -> list[dict]:
    """For each element pair: the questions and the next answer element of each."""
    rows = []
    for n, (question, answer) in enumerate(rules.FAQ_ELEMENT_PAIRS):
        answers = page.select(answer)
        for pos, i in enumerate(page.select(question)):
            k = bisect_right(answers, i)
            if k < len(answers):
                rows.append(
                    {"pattern": n, "pos": pos, "question": page.text(i), "answer": page.text(answers[k])}
                )
    return rows


def _faq_items(page: _Page) -> list[dict]:
    chosen = sorted({i for s in rules.FAQ_CRAWL_ITEMS for i in page.select(s)})
    told = [
        sorted({i for s in selectors for i in page.select(s) if page.own_texts(i)})
        for selectors in (rules.FAQ_CRAWL_QUESTIONS, rules.FAQ_CRAWL_ANSWERS)
    ]

    def first_text(item, wanted):
        at = bisect_left(wanted, item)
        return page.own_texts(wanted[at])[0] if at < len(wanted) and wanted[at] <= page.last[item] else None

    return [
        {"pattern": 0, "pos": p, "question": first_text(i, told[0]), "answer": first_text(i, told[1])}
        for p, i in enumerate(chosen)
    ]


def _first_attr(page: _Page, tag: str, name: str, test) -> str | None:
    return next((page.attrs[i].get(name) for i in page.find(tag) if test(page.attrs[i])), None)


def _address(page: _Page) -> str | None:
    hits = (
        i for i, tag in enumerate(page.tags)
        if tag == "address" or "address" in page.attrs[i].get("class", "")
    )
    return next((t for i in hits for t in page.own_texts(i)), None)


def _is_logo(attrs: dict) -> bool:
    return "logo" in attrs.get("class", "") or "logo" in attrs.get("id", "")


_READERS = {
    "title": lambda p, _: next(("".join(p.own_texts(i)) for i in p.find("title")), None),
    "og_site_name": lambda p, _: _first_attr(
        p, "meta", "content", lambda a: a.get("property") == "og:site_name"
    ),
    "logo_alt": lambda p, _: _first_attr(p, "img", "alt", _is_logo),
    "main_text": lambda p, _: _main_text(p, True),
    "main_text_raw": lambda p, _: _main_text(p, False),
    "main_text_direct": lambda p, _: _direct_text(p),
    "address": lambda p, _: _address(p),
    "anchors": _anchors,
    "link_regions": lambda p, _: _link_regions(p),
    "jsonld": lambda p, _: [
        "".join(p.own_texts(i)) for i in p.find("script") if p.attrs[i].get("type") == "application/ld+json"
    ],
    "faq_candidates": lambda p, _: _faq_candidates(p),
    "faq_items": lambda p, _: _faq_items(p),
}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows whose html has _PART_BYTES together, or of one row, so that what a worker holds does not
    depend on how many pages Spark puts into a batch."""
    start, held = 0, 0
    for at, n in enumerate(pc.binary_length(batch.column("html")).fill_null(0).to_pylist()):
        if at > start and held + n > _PART_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    yield batch.slice(start)


def page_facts(
    pages: DataFrame,
    facts: list[str] | None = None,
    product_pattern: str = "/products/",
    kind_column: str | None = None,
    kinds: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add the wanted structural facts of column `html`; the other columns pass through.

    Only the facts asked for are computed, and with `kind_column` only those that `kinds` lists
    for the page's kind. A null page gives null facts. Column `html` itself is dropped, so that
    it travels no further than the parser.
    """
    wanted = facts or list(schemas.PAGE_FACTS)
    added = _parse_datatype_string(", ".join(f"{n} {schemas.PAGE_FACTS[n]}" for n in wanted))
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = StructType(kept + list(added.fields))
    arrow_types = [f.type for f in to_arrow_schema(added)]
    readers = [_READERS[n] for n in wanted]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_parts, batches)):
            columns = [[] for _ in wanted]
            kind_of = batch.column(kind_column).to_pylist() if kind_column else repeat(None)
            for html, kind in zip(batch.column("html").to_pylist(), kind_of):
                page = None if html is None else _Page(html)
                needed = wanted if kinds is None else kinds.get(kind, ())
                for name, out, reader in zip(wanted, columns, readers):
                    known = page is not None and name in needed
                    out.append(reader(page, product_pattern) if known else None)
            arrays = [batch.column(f.name) for f in kept]
            arrays += [pa.array(c, type=t) for c, t in zip(columns, arrow_types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return pages.mapInArrow(parse, schema)
