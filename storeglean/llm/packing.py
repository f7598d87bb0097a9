"""Best-fit packing of tokenised documents into sequences, planned over a histogram of lengths.

The planner sees how many pieces there are of each length, never the pieces. Best fit, longest first, is done for whole
groups of equally filled sequences at once, so its work and the plan depend on the capacity, not on the corpus. Each
piece then takes a planned slot: its rank within its length, joined with the plan.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import fresh, kept, ranked, table

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
SEPARATOR = 0
#: How a byte-level text falls into parts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The settings of a file that these ids hold for; kinds of added tokens that they do not hold for.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
    "byte_fallback": None, "ignore_merges": None,
}
_ODD = ("single_word", "lstrip", "rstrip", "normalized")
PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint>>"
_PIECES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
PLAN = "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, offset_from long"


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a `tokenizers` file for `tiktoken`: the same ids in half the time.

    That holds where ids follow the order of merges and the file asks for nothing but byte-level parts; a file with other
    settings is refused. Its added tokens are one id wherever they stand in a text, as in that library.
    """
    with open(path, encoding="utf-8") as file:
        asked = json.load(file)
    model = asked["model"]
    for name, (found, wanted) in {
        "normalizer": (asked.get("normalizer"), [None]),
        "pre_tokenizer": ({k: v for k, v in (asked.get("pre_tokenizer") or {}).items() if k != "trim_offsets"}, [_BYTE_LEVEL]),
        **{k: (model.get(k) or None, [wanted]) for k, wanted in _PLAIN.items()},
        **{f"added_tokens.{k}": (any(t.get(k) for t in asked.get("added_tokens", [])), [False]) for k in _ODD},
    }.items():
        if found not in wanted:
            raise ValueError(f"{path}: {name} is {found!r}, which is not built")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as they are
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    for rank, (a, b) in enumerate(merged, 256):
        if model["vocab"][a + b] != rank:
            raise ValueError(f"the ids of {path} do not follow its merges")
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merged)}
    added = {t["content"]: t["id"] for t in asked.get("added_tokens", [])}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def ids(made: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text; added tokens in it are ids of their own."""
    return made.encode_to_numpy(text, allowed_special="all")


def _cut(encoded: bytes, capacity: int) -> list[dict]:
    """Pieces of `capacity` ids; the first takes what is over."""
    n = len(encoded) // 4
    starts = [0, *range(n % capacity or capacity, n, capacity)]
    return [
        {"start": a, "length": b - a, "ids_crc32": zlib.crc32(encoded[4 * a : 4 * b])}
        for a, b in zip(starts, [*starts[1:], n], strict=True)
    ]


def cut(text: Column, tokenizer: str, capacity: int = CAPACITY) -> Column:
    """The pieces of a text with its separator: start, length and checksum of each."""

    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        made = encoder(tokenizer)
        end = np.array([SEPARATOR], "<u4").tobytes()
        found = (ids(made, t.as_py() or "").astype("<u4").tobytes() + end for t in texts)
        return pa.array([_cut(i, capacity) for i in found], _PIECES)

    return pieces(text)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over the number of pieces of each length: rows of PLAN.

    The pieces of a length that have ranks from `rank_from` to before `rank_to` go, `per_sequence` each, into the
    sequences from `sequence_from` on, the first of each at `offset_from`. Sequences that were filled alike are one group,
    and a length splits at most one group, so there are some two groups for each length; a group has at most as many rows
    as there are different lengths that fit in a sequence together.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids -> groups: first sequence, number
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, number: int, each: int, free: int, length=length) -> int:
            """Fills `number` sequences with `each` pieces; returns how many that are."""
            rows.append((length, rank, rank + number * each, each, first, capacity - free))
            if free > each * length:
                room[free - each * length].append((first, number))
            return number * each

        while left:
            free = next((f for f in range(length, capacity + 1) if room.get(f)), None)
            if free is None:
                each = capacity // length
                first, number, free = sequences, -(-left // each), capacity
                sequences += number
            else:
                first, number = room[free].pop()
                each = free // length
            full = min(number, left // each)
            if full:
                done = put(first, full, each, free)
                rank, left, first, number = rank + done, left - done, first + full, number - full
            if left and number:
                done = put(first, 1, left, free)
                rank, left, first, number = rank + done, 0, first + 1, number - 1
            if number and free < capacity:
                room[free].append((first, number))
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its separator alone. Repeated rows and null ids are packed like others; which of
    equal rows takes which slot is arbitrary. An empty table has no pieces. Other columns are not read. The plan that is
    broadcast is bounded by `capacity` (see `plan`).
    """
    spark = docs.sparkSession
    cut_up = docs.select("doc_id", F.posexplode(cut(F.col("text"), tokenizer, capacity)).alias("piece", "p"))
    pieces = kept(cut_up.select("doc_id", F.col("piece").cast("int"), "p.start", "p.length", "p.ids_crc32"))
    counts = dict(pieces.groupBy("length").count().collect())  # a row for each length up to the capacity
    planned = spark.createDataFrame(plan(counts, capacity), PLAN)
    rank = fresh(pieces, "_rank")
    placed = ranked(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], rank)
    at, slot = F.col(rank), F.col(rank) - F.col("rank_from")
    return (
        placed.join(F.broadcast(planned), "length")
        .where((at >= F.col("rank_from")) & (at < F.col("rank_to")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("sequence_from") + F.floor(slot / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("offset_from") + (slot % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def op4_packing(spark: SparkSession, directory: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack(table(spark, directory, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op4_packing": (op4_packing, None)}
