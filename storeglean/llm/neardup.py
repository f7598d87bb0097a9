"""MinHash near-duplicates by an inverted join of signature coordinates.

Every set of shingles posts its document under the (coordinate, value) pairs of its signature. Two documents are a
candidate pair if they collide in at least `matches` coordinates; `matches` is the most that a pair at the similarity
asked for reaches but with probability MISS. Candidates are confirmed on the full shingle sets.

Prefix: a pair with that many collisions meets in one of the `coordinates - matches + 1` rarest pairs of each side, so
only those are posted. Pairs that one document has alone are no posts at all, and a document with too few shared ones
has no partner.
Skip: equal sets are one class with one representative. A first round only confirms each document against the
smallest one of its lists (one pair a document); lists whose documents are by then in one component are skipped, and in
the others only pairs across components are counted. A long list is counted part by part. Pairs go on if sizes,
collisions and (Jaccard distance is a metric) their distances from a common partner allow a link. What goes on is the pair
of blocks they are in, not each pair: a task confirms the pairs of two blocks and returns links that connect them.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storeglean.llm.common import discard, fresh, hash32, kept, scratch, table
from storeglean.llm.components import components

COORDINATES = 64
MISS = 1e-5
#: Documents of a block of a long list, and of a block that is confirmed against another.
LIST_BLOCK, TEXT_BLOCK = 1024, 256
#: Posts and pairs that a task counts at a time.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 20_000, 1_000_000
REMEMBERED = 300_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SKETCH = pa.struct([("n", pa.int64()), ("fp", pa.string()), ("sig", pa.list_(pa.int32()))])
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)


def matches_for(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of collisions that a pair at `similarity` falls short of with probability `miss` at most."""
    below = 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > miss:
            return max(m, 1)
    return coordinates


@lru_cache(maxsize=1)
def _known() -> dict[bytes, int]:
    return {}


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles; one of all words if there are fewer; none without words."""
    parts = (text or b"").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    known = _known()
    if len(known) > REMEMBERED:
        known.clear()
    for p in set(parts):
        if p not in known:
            known[p] = xxhash.xxh64_intdigest(p)
    hashed = np.array([known[p] for p in parts], np.uint64)
    width = min(words, len(parts))
    held = np.full(len(parts) - width + 1, width, np.uint64)
    for i in range(width):
        held = (held ^ hashed[i : len(parts) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        held ^= held >> np.uint64(31)
    return np.unique(held * np.uint64(0xD6E8FEB86659FD93))


def signature(held: np.ndarray) -> np.ndarray:
    """For each coordinate the least value of its hash over the set."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(held), 4096):
        best = np.minimum(best, (held[i : i + 4096, None] * _A + _B).min(0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(words: int):
    @F.arrow_udf("struct<n:bigint,fp:string,sig:array<int>>")
    def sketch(text: pa.Array) -> pa.Array:
        out = []
        for t in text.cast(pa.binary()):
            held = shingles(t.as_py(), words)
            known = len(held) > 0
            out.append(
                {
                    "n": len(held),
                    "fp": hashlib.md5(held.tobytes()).hexdigest() if known else None,
                    "sig": signature(held) if known else None,
                }
            )
        return pa.array(out, _SKETCH)

    return sketch


def _posts(sets: DataFrame, matches: int) -> DataFrame:
    """(node, mask, coordinate, value, head) for the rarest shared coordinate-value pairs of each node; mask has a bit for
    each of them, head is the smallest node of the list."""
    # one long for a pair
    pair = F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(0xFFFFFFFF)))
    each = sets.select("node", F.explode(pair).alias("pair"))
    common = each.groupBy("pair").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    room = COORDINATES - matches + 1
    chosen = kept(
        each.join(common, "pair")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("often", "pair"))).alias("held"))
        .where(F.size("held") >= matches)
        # the pairs that are not shared come first in the order of rarity
        .select("node", F.expr(f"slice(held, 1, {room} - ({COORDINATES} - size(held))).pair").alias("held"))
    )
    mask = F.expr("aggregate(held, 0L, (m, p) -> m | shiftleft(1L, int(shiftright(p, 32))))")
    posts = chosen.select("node", mask.alias("mask"), F.explode("held").alias("pair"))
    lists = posts.groupBy("pair").agg(F.min("node").alias("head"), F.max("node").alias("tail"))
    return posts.join(lists.where("head < tail"), "pair").select(
        "node",
        "mask",
        F.shiftright("pair", 32).cast("int").alias("coordinate"),
        "pair",
        "head",
    )


def _confirm(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, n_both, n_any) of pairs (a, b, block_a, block_b), each pair of blocks in one group with the texts of both."""
    keyed = pairs.select(
        "a", "b", F.struct(F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y")).alias("k")
    )
    keyed = keyed.select("a", "b", F.concat_ws(":", "k.x", "k.y").alias("k"))
    ends = keyed.select("k", F.col("a").alias("node")).unionByName(keyed.select("k", F.col("b").alias("node"))).distinct()
    with_text = ends.join(texts, "node").select(F.col("k").alias("of"), "node", "text")

    def confirm(links: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, list[np.ndarray]] = {}
        for node, text in zip(held["node"], held["text"], strict=True):
            sets.setdefault(node, []).append(shingles(text.encode(), words))
        rows = []
        for a, b in zip(links["a"], links["b"], strict=True):
            found = [(len(np.intersect1d(s, t, True)), len(s) + len(t)) for s in sets[a] for t in sets[b]]
            both, total = max(found, key=lambda f: f[0] / max(1, f[1] - f[0]))
            rows.append((a, b, both, total - both))
        return pd.DataFrame(rows, columns=["a", "b", "n_both", "n_any"]).astype("int64")

    return (
        keyed.groupBy("k")
        .cogroup(with_text.groupBy("of"))
        .applyInPandas(confirm, "a long, b long, n_both long, n_any long")
    )


def _able(a: dict, b: dict, x: np.ndarray, y: np.ndarray, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows x of a and y of b that may be links across components, by sizes, by distances from a
    common partner and by collisions."""
    fits = (a["node"][x] != b["node"][y]) & (a["component"][x] != b["component"][y])
    low, high = np.minimum(a["n"][x], b["n"][y]), np.maximum(a["n"][x], b["n"][y])
    apart = np.abs(a["distance"][x] - b["distance"][y]) > 1 - percent / 100 + 1e-9
    fits &= (100 * low >= percent * high) & ~((a["hub"][x] == b["hub"][y]) & apart)
    x, y = x[fits], y[fits]
    good = [np.count_nonzero(a["sig"][x[i : i + 20_000]] == b["sig"][y[i : i + 20_000]], 1) >= matches for i in range(0, len(x), 20_000)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return x[good], y[good]


def _columns(held: pd.DataFrame, names: tuple[str, ...]) -> dict:
    return {c: held[c].to_numpy() for c in names} | {"sig": np.stack(held["sig"].to_list())}


_FACTS = ("node", "n", "component", "hub", "distance")


def _across(members: DataFrame, facts: DataFrame, percent: int, matches: int) -> DataFrame:
    """(x, y): pairs of blocks that hold a pair of documents in different components which collide often enough.

    members: pair, node, component; facts: a row per node with its block, size, signature, component, and distance from
    a partner.
    """
    lists = members.groupBy("pair").agg(
        F.count(F.lit(1)).alias("often"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    parts = F.ceil(F.col("often") / LIST_BLOCK).cast("int")
    mixed = lists.where("low < high").select("pair", parts.alias("parts"))
    dealt = kept(
        members.select("pair", "node")
        .join(mixed, "pair")
        .withColumn("part", F.shiftright(hash32(F.col("node")) * F.col("parts"), 32).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("pair", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    # lists, or pairs of parts of one, that are counted by one task at a time
    tasks = max(1, math.ceil(dealt.count() / ROWS_AT_ONCE))
    unit = ["pair", "i", "j"]
    full = dealt.join(facts, "node").withColumn("task", F.pmod(F.xxhash64(*unit), F.lit(tasks)))

    def count(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(unit, ignore_index=True)
        get = _columns(held, (*_FACTS, "block", "part", "i", "j"))
        change = np.flatnonzero(np.any([np.diff(held[c].to_numpy()) != 0 for c in unit], axis=0)) + 1
        found, pairs, size = set(), [], 0

        def settle() -> None:
            x, y = _able(get, get, *(np.concatenate([p[k] for p in pairs]) for k in (0, 1)), percent, matches)
            found.update(tuple(sorted(p)) for p in set(zip(get["block"][x], get["block"][y], strict=True)))

        for start, end in zip([0, *change], [*change, len(held)], strict=True):
            at = np.arange(start, end)
            if get["i"][start] == get["j"][start]:
                x, y = (at[k] for k in np.triu_indices(len(at), 1))
            else:
                left, right = (at[get["part"][start:end] == get[k][start]] for k in ("i", "j"))
                x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            pairs.append((x, y))
            size += len(x)
            if size > PAIRS_AT_ONCE:
                settle()
                pairs, size = [], 0
        if pairs:
            settle()
        return pd.DataFrame(sorted(found), columns=["x", "y"], dtype=object)

    return full.groupBy("task").applyInPandas(count, "x string, y string").distinct()


def _links_between(blocks: DataFrame, facts: DataFrame, texts: DataFrame, words: int, percent: int, matches: int) -> DataFrame:
    """(a, b): links across components between each two blocks (x, y), as many as connect what they connect."""
    ends = blocks.select(F.concat_ws("|", "x", "y").alias("k"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    full = ends.join(facts, "block").join(texts, "node")

    def confirm(held: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t.encode(), words) for t in held["text"]]
        filled = [len(s) > 0 for s in sets]  # rows that share an id may have texts without words
        held, sets = held[filled], [s for s in sets if len(s)]
        get = _columns(held, _FACTS)
        x, y = _able(get, get, *np.triu_indices(len(held), 1), percent, matches)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        rows = []
        for start, end in zip(*(np.searchsorted(x, np.unique(x), side) for side in ("left", "right")), strict=True):
            one, others = x[start], y[start:end]
            lengths = np.array([len(sets[o]) for o in others])
            joined = np.concatenate([sets[o] for o in others])
            at = np.minimum(np.searchsorted(sets[one], joined), len(sets[one]) - 1)
            both = np.add.reduceat((sets[one][at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
            for o in others[100 * both >= percent * (len(sets[one]) + lengths - both)]:
                a, b = sorted((top(get["component"][one]), top(get["component"][o])))
                if a != b:
                    root[b] = a
                    rows.append((get["node"][one], get["node"][o]))
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return full.groupBy("k").applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept.

    Documents are linked if the Jaccard similarity of their shingle sets is at least `similarity` (in whole percent). A
    document without words has no shingles, is linked with nothing and kept. Rows that share an id are one document, all
    with one component. Rows without id take no part: component_id is null and they are kept. Other columns are not read.
    """
    spark = docs.sparkSession
    percent, matches = round(100 * similarity), matches_for(similarity)
    named = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    sketched = kept(
        docs.select("doc_id", _sketch(words)("text").alias("s")).select("doc_id", "s.n", "s.fp", "s.sig")
    )
    rows = sketched.select("doc_id", "n", "fp")
    known = sketched.where("fp is not null and doc_id is not null")
    first = known.groupBy("fp").agg(F.min("doc_id").alias("node"))
    sets = known.join(first.select(F.col("node").alias("doc_id"), "fp"), ["doc_id", "fp"])
    sets = sets.dropDuplicates(["doc_id", "fp"]).withColumnRenamed("doc_id", "node")
    posts = kept(_posts(sets, matches))

    # first round: each document against the smallest of its lists that it meets most often
    star = (
        posts.where("node > head")
        .groupBy("node", "head")
        .agg(F.count(F.lit(1)).alias("met"))
        .groupBy("node")
        .agg(F.max(F.struct("met", (-F.col("head")).alias("hub"))).alias("best"))
        .select("node", (-F.col("best.hub")).alias("hub"))
    )
    held = posts.select("node").distinct().join(star, "node", "left")
    group = F.coalesce("hub", "node")  # with the documents that share its partner
    sizes = held.groupBy(group.alias("g")).agg(F.ceil(F.count(F.lit(1)) / TEXT_BLOCK).alias("blocks"))
    blocks = kept(
        held.join(sizes, group == F.col("g")).select(
            "node", "hub", F.concat_ws("-", "g", F.shiftright(hash32(F.col("node")) * F.col("blocks"), 32)).alias("block")
        )
    )
    path = scratch(spark, "texts")
    named.withColumnRenamed("doc_id", "node").join(blocks.select("node"), "node", "left_semi").write.parquet(path)
    texts = spark.read.parquet(path)
    block_of = blocks.select("node", "block")

    def with_blocks(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(block_of.select(F.col("node").alias(end), F.col("block").alias(f"block_{end}")), end)
        return pairs

    def linked(confirmed: DataFrame) -> DataFrame:
        return confirmed.where(F.col("n_both") * 100 >= percent * F.col("n_any")).select("a", "b")

    tried = blocks.where("hub is not null").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = kept(_confirm(with_blocks(tried), texts, words))
    # rows that share an id
    same = known.join(first, "fp").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    links = linked(stars).unionByName(same.where("a < b").select("a", "b"))
    so_far = kept(components(links))

    # second round: pairs across components
    distance = stars.select(F.col("b").alias("node"), F.col("a").alias("hub"), (1 - F.col("n_both") / F.col("n_any")).alias("distance"))
    facts = kept(
        block_of.join(so_far, "node", "left")
        .join(distance, "node", "left")
        .withColumns(
            {
                "component": F.coalesce("component", "node"),
                "hub": F.coalesce("hub", "node"),
                "distance": F.coalesce("distance", F.lit(0.0)),
            }
        )
        .join(sets.select("node", "n", "sig"), "node")
    )
    members = posts.select("pair", "node").join(facts.select("node", "component"), "node")
    across = kept(_across(members, facts, percent, matches))
    more = kept(_links_between(across, facts, texts, words, percent, matches))
    whole = kept(components(links.unionByName(more)))
    discard(spark, path)

    # a text that only rows without id have is not in `first`
    classes = first.join(whole, "node", "left").select("fp", F.coalesce("component", "node").alias("class"))
    own = rows.where("fp is null").withColumn("class", F.col("doc_id"))
    return (
        rows.where("fp is not null")
        .join(classes, "fp", "left")
        .unionByName(own)
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("class"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents of which no near-duplicate has a smaller id, columns as they are. Of several rows with words that
    share an id the longest stays; rows without id all stay."""
    goes, again, row = (fresh(docs, n) for n in ("_goes", "_again", "_row"))
    decided = near_duplicates(docs, words, similarity).where("doc_id is not null")
    marks = (
        decided.groupBy("doc_id")
        .agg((~F.min("kept")).alias(goes), (F.sum((F.col("n_shingles") > 0).cast("int")) > 1).alias(again))
        .where(F.col(goes) | F.col(again))
    )
    marked = docs.join(marks, "doc_id", "left").where(~F.coalesce(F.col(goes), F.lit(False)))
    longest = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), "text")
    repeated = marked.where(F.col(again)).withColumn(row, F.row_number().over(longest)).where(F.col(row) == 1)
    single = marked.where(~F.coalesce(F.col(again), F.lit(False)))
    return single.select(*docs.columns).unionByName(repeated.select(*docs.columns))


def op9_minhash(spark: SparkSession, directory: str) -> DataFrame:
    """All documents, three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, directory, "documents"), 3, 0.85)


QUERIES = {"op9_minhash": (op9_minhash, None)}
