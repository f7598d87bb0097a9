"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows scans each text once.

Words are lower-cased (A-Z only) runs of digits, letters a-z and characters beyond ASCII. A window is 13 consecutive
words of an item; a shorter item is one window. Texts are normalised byte by byte into words between single spaces, so
that a window occurs where the automaton finds it between spaces, and places map back to the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import fresh, kept, table

WINDOW = 13
BLOCK_BYTES = 4_000_000
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
HITS = "struct<n_words:bigint,words:array<int>,places:array<int>,ends:array<int>,items:array<bigint>>"
_SPANS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("words", pa.list_(pa.int32())),
        ("places", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("items", pa.list_(pa.int64())),
    ]
)
_BUILT: dict[str, object] = {}


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_TABLE).split()


def _automaton(token: str, items: list[tuple[int | None, bytes]], window: int):
    """The automaton of one block of items, built once per Python worker; the last one is kept."""
    if token not in _BUILT:
        named: dict[bytes, tuple[int, set]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                named.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item)
        made = ahocorasick.Automaton()
        for key, (n, ids) in named.items():
            made.add_word(key.decode("latin-1"), (n, tuple(i for i in ids if i is not None)))
        if named:
            made.make_automaton()
        _BUILT.clear()
        _BUILT[token] = made if named else None
    return _BUILT[token]


def _scan(text: bytes | None, automaton) -> dict:
    """Number of words, runs of hit words as [first, past the last], their character offsets, and the items found."""
    if not text:
        return {"n_words": 0, "words": [], "places": [], "ends": [], "items": []}
    plain = text.translate(_TABLE)
    words = plain.split()
    found = {"n_words": len(words), "words": [], "places": [], "ends": [], "items": []}
    if automaton is None or not words:
        return found
    joined = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(joined.decode("latin-1")))
    if not hits:
        return found
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in hits])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - np.array([n for _, (n, _) in hits]), 1)
    np.add.at(change, last, -1)
    edge = np.diff((np.cumsum(change[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    solid = np.diff((np.frombuffer(plain, np.uint8) != 32).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(solid == 1), np.flatnonzero(solid == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    found["words"] = np.stack([first, past], 1).ravel().tolist()
    found["places"] = chars[starts[first]].tolist()
    found["ends"] = chars[ends[past - 1]].tolist()
    found["items"] = sorted({i for _, (_, ids) in hits for i in ids})
    return found


def _merge(a: dict, b: dict) -> dict:
    """What two blocks found in one text, as if one automaton had."""
    runs = sorted(
        zip(a["words"][::2] + b["words"][::2], a["words"][1::2] + b["words"][1::2], a["places"] + b["places"], a["ends"] + b["ends"], strict=True)
    )
    out: list[list[int]] = []
    for first, past, place, end in runs:
        if out and first <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], past), max(out[-1][3], end)
        else:
            out.append([first, past, place, end])
    return {
        "n_words": a["n_words"],
        "words": [x for r in out for x in r[:2]],
        "places": [r[2] for r in out],
        "ends": [r[3] for r in out],
        "items": sorted({*a["items"], *b["items"]}),
    }


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of at most so many bytes of text (or one item), streamed through the driver."""
    block, size = [], 0
    for item, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    yield block


def _scanners(token: str, sent: Broadcast, window: int):
    """The first pass over the texts, and one that adds to what passes before it found."""

    @F.arrow_udf(HITS)
    def scan(text: pa.Array) -> pa.Array:
        made = _automaton(token, sent.value, window)
        return pa.array([_scan(t, made) for t in text.cast(pa.binary()).to_pylist()], _SPANS)

    @F.arrow_udf(HITS)
    def scan_more(text: pa.Array, held: pa.Array) -> pa.Array:
        made = _automaton(token, sent.value, window)
        both = zip(text.cast(pa.binary()).to_pylist(), held.to_pylist(), strict=True)
        return pa.array([_merge(h, _scan(t, made)) for t, h in both], _SPANS)

    return scan, scan_more


def hits(docs: DataFrame, benchmark: DataFrame, out: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds `out`: n_words; words, the runs of hit words as first and past the last in turn; places and ends, the
    character offsets of each run in the original text; items, the ids of items with occurring windows in order.

    A null or empty text has no words. Items without words have no window; an item without id can be hit but is not
    listed; items that share an id count once. Other columns of `docs` go through. The benchmark is read in blocks of
    `block_bytes`, one pass over the texts for each: an automaton never holds more than a block.
    """
    before, result = fresh(docs, "_before"), docs
    spark = docs.sparkSession
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        scan, scan_more = _scanners(uuid.uuid4().hex, spark.sparkContext.broadcast(block), window)
        if k == 0:
            result = docs.withColumn(before, scan("text"))
        else:
            result = kept(result).withColumn(before, scan_more("text", before))
    return result.withColumnRenamed(before, out)


def n_hit(found: Column) -> Column:
    """Number of hit words of a `hits` column."""
    runs = found["words"]
    signed = F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(found: Column) -> Column:
    """Whether a twentieth of the words or more is hit."""
    n = n_hit(found)
    return (n > 0) & (n * 20 >= found["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns as they are, whatever they are called.

    Null, empty and wordless texts stay. Each row is judged by itself, whole, so repeated rows and ids share their fate with equal
    texts only. An empty benchmark, or one without words, contaminates nothing; an empty table stays empty.
    """
    found = fresh(docs, "_hits")
    return hits(docs, benchmark, found).where(~contaminated(F.col(found))).drop(found)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items found and the verdict."""
    found = F.col("found")
    ids = F.array_sort(F.transform(found["items"], lambda i: i.cast("string")))
    return hits(docs.select("doc_id", "text"), benchmark, "found").select(
        "doc_id",
        found["n_words"].alias("n_words"),
        n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated(found).alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """All documents against all benchmark items."""
    return report(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = rf"""
WITH items AS (SELECT item_id, {WORDS_SQL} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS k, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM items WHERE len(words) > 0)
),
docs AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
places AS (
  SELECT doc_id, k, p, array_to_string(words[p:p + k - 1], ' ') AS win
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM windows))
),
found AS (SELECT doc_id, p, k, item_id FROM places JOIN windows USING (k, win)),
hit AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS w FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {"op8_decontamination": (op8_decontamination, SQL)}
